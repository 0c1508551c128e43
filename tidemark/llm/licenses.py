"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of words of every text is joined, by hash, to the places where
license templates hold it: pairs of words for base phrases and short notices, five
words for whole license texts. A hit at text position ``p`` and template position ``t``
votes for diagonal ``p - t``. Diagonals that lie next to each other (a few words more or
less) are merged, and a span stands if it covers enough of its template, in the
template's order; base phrases must be covered whole on one diagonal. A span is then
verified by its words: those that decide between licenses must agree.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.license_texts import BODIES

#: Words as the contract takes them, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters named one by one, which Java matches several times faster,
#: and those of texts that are not lower-cased.
FAST_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Words of the k-grams of phrases and notices, and of whole texts.
SHORT, LONG = 2, 5
#: Diagonals at most so far apart are merged, by k.
NEIGHBOURS = {SHORT: 2, LONG: 8}
#: Share of a template's k-grams that a span must cover, by k: a changed word costs k of them.
COVER = {SHORT: 0.7, LONG: 0.5}

#: Words kept with each hit, from its pair on, as a version can stand behind the span, and before it, as a "not" can.
AHEAD, BEHIND = 6, 2
#: Words right before a notice that take it back.
NEGATIONS = ("not", "never", "cannot")
#: Words that a span must hold if its template does, with what may stand for them.
DECIDING = {w: w for w in ("apache", "mozilla", "attribution", "nc", "free", "unencumbered", "or")} | {
    "mit": "mit (?:open source )?licen[cs]e",
    "lesser": "(?:lesser|library)",
}
#: Words that make another license of a span, if its template lacks them.
VARIANTS = (
    "nc", "non ?commercial", "nd", "no ?deriv(?:ative)?s", "sa", "share ?alike", "lesser", "library general", "affero",
    "organi[sz]ations?", "not", "never", "cannot",
)

# The phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices of well-known public licenses, in lower case and without punctuation.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def fold(text: Column) -> Column:
    """Lower case in which ASCII letters come from A-Z only: the Kelvin sign, which
    Unicode lower-cases to k, is put aside first."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ue000")))


class Template(NamedTuple):
    """A phrase (``base``) or text to look for; ``needs`` and ``forbids`` are patterns, None for those of ``verified``."""

    words: list[str]
    label: str
    base: bool = False
    k: int = SHORT
    needs: tuple[str, ...] | None = None
    forbids: tuple[str, ...] = ()

    @property
    def places(self) -> int:
        return len(self.words) - self.k + 1


def all_templates(base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], bodies: Sequence[tuple[str, str, tuple, tuple]]) -> list[Template]:
    found = [Template(p.split(), label, True) for p, label in base] + [Template(t.split(), label) for t, label in templates]
    found += [Template(text.split(), label, False, LONG, needs, forbids) for label, text, needs, forbids in bodies]
    if any(re.search(r"[^0-9a-z ]", " ".join(t.words)) for t in found):
        raise ValueError("templates hold lower-case letters, digits and spaces alone")
    if any(t.places < 1 for t in found):
        raise ValueError(f"a phrase or notice needs {SHORT} words at least, a text {LONG}")
    return found


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """A row per k-gram of each template: a table of the size of the arguments."""
    rows = [f"({number}, {place}, '{' '.join(t.words[place : place + t.k])}')" for number, t in enumerate(templates) for place in range(t.places)]
    words = F.split("words", " ")
    grams = [gram(*[F.get(words, F.lit(i)) for i in range(k)]) for k in (SHORT, LONG)]
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, place, words)")
    return table.select("template", "place", F.when(F.size(words) == SHORT, grams[0]).otherwise(grams[1]).alias("gram"))


def gram(*words: Column) -> Column:
    """A k-gram's hash; two different ones agree with a chance of 5e-20."""
    return F.xxhash64(F.lit(len(words)), *words)


def by_template(column: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), column + 1)


def holds(patterns: Sequence[str]) -> str:
    """A pattern that finds whole words, in words with single spaces between them."""
    return rf"(?:^| )(?:{'|'.join(patterns)})(?: |$)"


def deciding(words: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """What a span of a notice must hold, what it must not, and the numbers of its version."""
    own = " ".join(words)
    # the library's license is an earlier name of the lesser one
    other = [v for v in VARIANTS if not re.search(holds([v]), own) and not (v == "library general" and "lesser" in words)]
    return [DECIDING[w] for w in dict.fromkeys(words) if w in DECIDING], other, [w for w in words if re.fullmatch("[0-9]+", w)]


def verified(words: Sequence[str], inside: Column, ahead: Column) -> Column:
    """Whether a span's words ``inside``, and ``ahead`` with those behind it, hold what decides for the template.

    The first number must be the template's version, alone or with its minor 0.
    """
    needs, other, numbers = deciding(words)
    sound = ~inside.rlike(holds(other))
    for need in needs:
        sound = sound & ahead.rlike(holds([need]))
    if numbers:
        sound = sound & ahead.rlike(rf"^(?:(?!(?:v|version)?[0-9]+(?: |$))[^ ]+ )*(?:v|version)?{numbers[0]}(?: {''.join(numbers[1:2]) or 0}(?: |$)|(?! [0-9](?: |$))(?: |$))")
    return sound


def license_spans(
    spark: SparkSession,
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = BASE,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    bodies: Sequence[tuple[str, str, tuple, tuple]] = BODIES,
) -> DataFrame:
    """``doc_id, text_key, template, label, base, start, stop, coverage``: a row per span found.

    ``start`` and ``stop`` are word positions, ``stop`` exclusive. ``text_key`` is a
    hash of the id and the text; rows equal in both have equal spans, given once.
    """
    wanted = all_templates(base, templates, bodies)
    words = docs.select("doc_id", text_key("doc_id", "text"), F.regexp_extract_all(fold(F.col("text")), F.lit(FAST_WORD), F.lit(0)).alias("w0"))
    later = [F.slice("w0", i + 1, F.greatest(F.size("w0"), F.lit(1))).alias(f"w{i}") for i in range(1, AHEAD)]
    earlier = [F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), i), F.col("w0")), F.lit(1), F.size("w0")).alias(f"b{i}") for i in range(BEHIND, 0, -1)]
    runs = words.select("doc_id", "text_key", *earlier, F.col("w0"), *later)
    rows = runs.select("doc_id", "text_key", F.posexplode(F.arrays_zip(*runs.columns[2:])).alias("at", "w"))
    at = [F.col(f"w.{n}") for n in runs.columns[2:]]
    grams = [gram(*at[BEHIND : BEHIND + k]) for k in (SHORT, LONG)]
    keyed = rows.select("doc_id", "text_key", "at", "w", F.explode(F.array(*grams)).alias("gram"))
    hits = keyed.join(F.broadcast(template_grams(spark, wanted)), "gram")
    group = ["doc_id", "text_key", "template"]
    whole = by_template(F.col("template"), [t.base for t in wanted])
    # words behind their positions in ten digits, so that they sort by position
    near = F.array_compact(F.array(*[F.concat(F.lpad((F.col("at") + i).cast("string"), 10, "0"), word) for i, word in enumerate(at, -BEHIND)]))
    votes = hits.select(*group, (F.col("at") - F.col("place")).alias("diagonal"), "place", "at", F.when(~whole, near).alias("near")).distinct()
    diagonals = votes.groupBy(*group, "diagonal").agg(F.collect_set(F.struct("at", "place")).alias("places"), F.flatten(F.collect_list("near")).alias("near"))
    # a phrase has at most as many places as its template, however long the text
    in_order = Window.partitionBy(*group).orderBy("diagonal")
    reach = by_template(F.col("template"), [NEIGHBOURS[t.k] for t in wanted])
    apart = by_template(F.col("template"), [t.base for t in wanted]) | (F.col("diagonal") - F.lag("diagonal").over(in_order) > reach)
    merged = diagonals.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(in_order))
    spans = merged.groupBy(*group, "span").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.collect_list("near").alias("near"))
    # places that follow each other in the text as they do in the template
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x["place"] > a["last"], F.struct(x["place"].alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    spans = spans.withColumn("n", F.aggregate("places", start, step)["n"])
    size, k = by_template(F.col("template"), [t.places for t in wanted]), by_template(F.col("template"), [t.k for t in wanted])
    first, last = F.element_at("places", 1)["at"], F.element_at("places", -1)["at"]
    spans = spans.select(*group, "n", "near", first.alias("start"), (last + k).alias("stop"), (F.col("n") / size).alias("coverage"), by_template(F.col("template"), [t.base for t in wanted]).alias("base"))
    spans = spans.where(F.when(F.col("base"), F.col("n") == size).otherwise(F.col("coverage") >= by_template(F.col("template"), [float(COVER[t.k]) for t in wanted])))
    near = F.array_sort(F.array_distinct(F.flatten("near")))
    place = lambda w: F.substring(w, 1, 10).cast("int")
    parts = {
        "before": F.filter("near", lambda w: place(w) < F.col("start")),
        "inside": F.filter("near", lambda w: (place(w) >= F.col("start")) & (place(w) < F.col("stop"))),
        "ahead": F.filter("near", lambda w: place(w) >= F.col("start")),
    }
    spans = spans.withColumn("near", near)
    spans = spans.withColumns({name: F.array_join(F.transform(c, lambda w: F.substr(w, F.lit(11))), " ") for name, c in parts.items()})
    sound = F.lit(True)
    for number, t in enumerate(wanted):
        if t.base:
            continue
        own = verified(t.words, F.col("inside"), F.col("ahead")) & ~F.col("before").rlike(holds(NEGATIONS)) if t.needs is None else F.lit(True)
        for pattern in t.needs or ():
            own = own & F.col("ahead").rlike(holds([pattern]))
        for pattern in t.forbids:
            own = own & ~F.col("inside").rlike(holds([pattern]))
        sound = F.when(F.col("template") == number, own).otherwise(sound)
    spans = spans.where(F.col("base") | sound)
    label = by_template(F.col("template"), [t.label for t in wanted]).alias("label")
    return spans.select("doc_id", "text_key", "template", label, "base", F.col("start").cast("long"), F.col("stop").cast("long"), "coverage")


def text_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key")


def scan_licenses(
    spark: SparkSession,
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = BASE,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    bodies: Sequence[tuple[str, str, tuple, tuple]] = BODIES,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word``
    are their smallest and largest start. ``labels`` adds those of the templates that
    a span covers. ``score`` is the best coverage, 0 without any span.

    * Null and empty texts have 0 words, no labels (empty strings) and score 0.
    * Repeated rows, and null doc_ids, each keep a row of their own.
    * An empty table gives an empty result; only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = license_spans(spark, docs, base, templates, bodies)
    own = F.when(F.col("base"), F.col("start"))
    found = spans.groupBy(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).agg(
        F.count(own).alias("n_base"),
        F.min(own).alias("first_word"),
        F.max(own).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select("doc_id", text_key("doc_id", "text"), F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    same = (F.col("text_key") == F.col("found_key")) & F.col("doc_id").eqNullSafe(F.col("found_id"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(k: int) -> str:
    rows = []
    for number, t in enumerate(all_templates(BASE, TEMPLATES, BODIES)):
        if t.k == k:
            rows += [f"({number}, '{t.label}', {t.base}, {t.places}, {i}, '{' '.join(t.words[i : i + k])}')" for i in range(t.places)]
    return ", ".join(rows)


def _votes(k: int) -> str:
    return f"""SELECT doc_id, template, label, base, places, {k} AS k, {NEIGHBOURS[k]} AS reach, {COVER[k]} AS cover, i - 1 - place AS diagonal, place, i - 1 AS pos
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {k - 2})) AS i FROM docs WHERE len(words) >= {k})
  JOIN (VALUES {_values(k)}) t(template, label, base, places, place, gram) ON gram = array_to_string(words[i : i + {k - 1}], ' ')"""


def _sound() -> str:
    """The verification of each template as SQL, over ``before``, ``inside``, ``ahead`` and, word by word, ``near``."""
    cases = []
    for number, t in enumerate(all_templates(BASE, TEMPLATES, BODIES)):
        if t.base:
            continue
        if t.needs is None:
            needs, other, numbers = deciding(t.words)
            tests = [f"NOT regexp_matches(before, '{holds(NEGATIONS)}')", f"NOT regexp_matches(inside, '{holds(other)}')"]
            if numbers:
                minor = "".join(numbers[1:2]) or "0"
                tests.append(f"coalesce(regexp_replace(near[digits], '^(version|v)', '') = '{numbers[0]}' AND (near[digits + 1] IS NULL OR near[digits + 1] = '{minor}' OR NOT regexp_full_match(near[digits + 1], '[0-9]')), FALSE)")
        else:
            needs, tests = t.needs, [f"NOT regexp_matches(inside, '{holds([f])}')" for f in t.forbids]
        tests += [f"regexp_matches(ahead, '{holds([n])}')" for n in needs]
        cases.append(f"WHEN {number} THEN {' AND '.join(tests)}")
    return f"CASE template {' '.join(cases)} END"


OP4_SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents
), votes AS (
  {_votes(SHORT)} UNION ALL {_votes(LONG)}
), diagonals AS (
  SELECT doc_id, template, label, base, places, k, reach, cover, diagonal, list(DISTINCT {{'p': pos, 'place': place}}) AS seen FROM votes GROUP BY ALL
), lagged AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > reach, TRUE) THEN 1 ELSE 0 END AS apart
  FROM diagonals
), merged AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM lagged
), spans AS (
  SELECT doc_id, template, label, base, places, k, cover, span, list_sort(flatten(list(seen))) AS seen FROM merged GROUP BY ALL
), ordered AS (
  SELECT *, seen[1].p AS start, seen[-1].p + k AS stop,
    list_reduce(list_transform(seen, lambda x: {{'last': x.place, 'n': 1}}), lambda a, x: CASE WHEN x.last > a.last THEN {{'last': x.last, 'n': a.n + 1}} ELSE a END).n AS n
  FROM spans
), covering AS (
  SELECT *, n / places AS coverage FROM ordered WHERE CASE WHEN base THEN n = places ELSE n / places >= cover END
), placed AS (
  SELECT c.*, words, list_sort(list_distinct(flatten(list_transform(seen, lambda x: range(x.p, least(x.p + {AHEAD}, len(words))))))) AS spots FROM covering c JOIN docs USING (doc_id)
), worded AS (
  SELECT *, array_to_string(list_transform(range(greatest(start - {BEHIND}, 0), start), lambda i: words[i + 1]), ' ') AS before, list_transform(spots, lambda i: words[i + 1]) AS near,
    array_to_string(list_transform(list_filter(spots, lambda i: i < stop), lambda i: words[i + 1]), ' ') AS inside FROM placed
), read_ AS (
  SELECT *, array_to_string(near, ' ') AS ahead, list_filter(range(1, len(near) + 1), lambda i: regexp_full_match(near[i], '(v|version)?[0-9]+'))[1] AS digits FROM worded
), good AS (
  SELECT * FROM read_ WHERE base OR {_sound()}
), found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM good GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (doc_id)
"""
