"""Quality rules, filter audit, source divergence: brute force, SQL and edge cases on small tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, filter_audit, perplexity

from .test_small_ops import DOCS, HARD, clashing, hard  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LABELS = "doc_id long, quality int, toxic int"


# --- quality rules


def _texts(rng, n, alphabet="abcdeé", words=(60, 120)):
    vocabulary = ["".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(200)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(*words))) for _ in range(n)]


class _Kneser:
    """Interpolated modified Kneser-Ney over the characters of words, straight from its definition."""

    def __init__(self, words, order):
        raw = Counter()
        for w, n in words.items():
            s = f" {w}\n"
            for i in range(1, len(s)):
                raw[s[max(0, i + 1 - order) : i + 1]] += n
        self.counts = {order: {g: n for g, n in raw.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            before = Counter(g[1:] for g in self.counts[k + 1])
            self.counts[k] = dict(before) | {g: n for g, n in raw.items() if len(g) == k and g[0] == " "}
        self.order, self.discount = order, {}
        for k, counts in self.counts.items():
            n = Counter(counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            d = []
            for i in (1, 2, 3):
                value = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else i / 2
                d.append(min(max(value, 0.05), i - 0.05))
            self.discount[k] = d
        self.follow = {k: defaultdict(list) for k in self.counts}
        for k, counts in self.counts.items():
            for g, n in counts.items():
                self.follow[k][g[:-1]].append(n)

    def rest(self, k, context):
        n = self.follow[k][context]
        return sum(self.discount[k][min(a, 3) - 1] for a in n) / sum(n)

    def chance(self, g):
        k = len(g)
        if k == 0:
            return 1 / (len(self.counts[1]) + 1)
        if g[:-1] not in self.follow[k]:
            return self.chance(g[1:])
        a = self.counts[k].get(g, 0)
        own = max(a - self.discount[k][min(a, 3) - 1], 0) / sum(self.follow[k][g[:-1]]) if a else 0
        return own + self.rest(k, g[:-1]) * self.chance(g[1:])

    def bits(self, word):
        s = f" {word}\n"
        return -sum(math.log2(self.chance(s[max(0, i + 1 - self.order) : i + 1])) for i in range(1, len(s)))


@pytest.mark.parametrize("file_rows, slice_words", [(1 << 20, perplexity.SLICE), (100, 7)])
def test_model_is_modified_kneser_ney(spark, monkeypatch, file_rows, slice_words):
    rng = random.Random(3)
    texts = {"xx": _texts(rng, 12), "": _texts(rng, 3, "abß🙂")}
    docs = spark.createDataFrame([(i, t, lang or None) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    model = perplexity.fit(spark, docs, 4, file_rows=file_rows)
    assert len(model.files) > 1 or file_rows > 100
    keys = np.concatenate([np.array([r["key"] for r in spark.read.parquet(f).collect()]) for f in model.files])
    assert len(set(keys.tolist())) == len(keys)
    for f in model.files:
        part = [r["key"] for r in spark.read.parquet(f).collect()]
        assert part == sorted(part)
    monkeypatch.setattr(perplexity, "SLICE", slice_words)
    strange = ["abc", "zzz", "ab#", "a" * 300, "éé", "q"]
    for lang, listed in texts.items():
        words = Counter(w for t in listed for w in t.split())
        wanted = _Kneser(words, 4)
        asked = list(words) + strange
        found = perplexity.word_bits(perplexity.Arrays(model), 4, {lang: [w.encode() for w in asked]})[lang]
        np.testing.assert_allclose(found, [wanted.bits(w) for w in asked], rtol=1e-5)
        for context in ("", " ", " a", "ab", "bca"):  # all that can follow, and the characters never seen
            if context in wanted.follow[len(context) + 1]:
                total = sum(wanted.chance(context + c[-1]) for c in wanted.counts[1])
                assert total < 1 and math.isclose(total + 1 - total, 1)
    nobody = perplexity.word_bits(perplexity.Arrays(model), 4, {"no such language": [b"abc"]})
    assert np.isfinite(nobody["no such language"]).all()


def _base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "b ", "é", " ", "\n", "\t", "a b c ", "#", "<", " ", "\x1c", " ", "x\n"], k=rng.randint(0, 250))) for _ in range(150)]
    texts += ["a b c a b c", "a a a a", "one two", "\n\n", "x y z " * 40, "a\na\n a\na ", "w" * 50_000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in perplexity.quality_rules(spark, docs, block_bytes=2_000).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(t), repr(t)
        assert not (r["kept"] and r["base_failed"])


def test_bands_reject_what_is_unlike_its_language(spark):
    rng = random.Random(8)
    good = _texts(rng, 300, "etaoin")
    hashes = [" ".join("".join(rng.choices("qxzjkvw", k=9)) for _ in range(80)) for _ in range(6)]
    dull = ["e t " + " ".join(rng.choices(["e", "t"], k=80)) for _ in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(good + hashes + dull)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in perplexity.quality_rules(spark, docs).where("not base_failed").collect()}
    kept = [found[i]["kept"] for i in range(300) if i in found]
    assert sum(kept) >= 0.99 * len(kept)
    high = [found[i] for i in range(300, 306)]
    assert all(not r["kept"] and r["log2_perplexity"] > r["high"] for r in high)
    assert all(not found[i]["kept"] and found[i]["log2_perplexity"] < found[i]["low"] for i in range(306, 312) if i in found)
    stays = {r["doc_id"] for r in perplexity.keep_fluent(spark, docs).collect()}
    assert stays == {i for i, r in found.items() if r["kept"]}


def test_band_parts(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(50, 2_000, 20_000)
    x = 13 + rng.normal(size=n.size) * np.sqrt(0.04 + 36 / n)
    r = perplexity.bands(spark, spark.createDataFrame(list(zip(["en"] * n.size, n.tolist(), x.tolist(), strict=True)), "lang string, n_words long, x double")).first()
    assert abs(r["center"] - 13) < 0.02 and 28 < r["within"] < 44 and 0.02 < r["between"] < 0.06


def test_rules_of_the_given_tables(spark):
    """Of labelled documents that pass the base rules, nearly all good ones stay and most of the others go."""
    folder = "/root/testdata/sf0.01"
    found = perplexity.op11_quality_rules(spark, folder).where("not base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    share = {r["quality"]: r["kept"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.6


def test_rules_hard_rows(spark, hard, clashing):  # noqa: F811
    for docs in (hard, clashing):
        found = perplexity.quality_rules(spark, docs).collect()
        assert len(found) == len(HARD)
        texts = defaultdict(list)
        for i, t, *_ in HARD:
            texts[i].append(t)
        for r in found:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(texts[r["doc_id"]][0])
            assert not r["kept"] and r["lang"] is not None
        kept = perplexity.keep_fluent(spark, docs)
        assert kept.columns == docs.columns and kept.count() == 0
    assert perplexity.quality_rules(spark, hard.limit(0)).collect() == []


# --- filter audit


def _fails(text, first):
    words = WORD.findall(text)
    return (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), not first
    )


def _audit(rows, labels):
    """``{(part, order, step): counts}`` by applying the filters one after the other."""
    first, docs = {}, []
    for i, t, _, source, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    for i, t, _, source, _ in rows:
        docs.append((source or "", _fails(t or "", i is None or first[t or ""] == i), i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        alive = list(docs)
        for step, f in enumerate(order, 1):
            k = "ABCDE".index(f)
            for part in {d[0] for d in docs}:
                gone = [d for d in alive if d[0] == part and d[1][k]]
                everyone = [d for d in docs if d[0] == part and d[1][k]]
                out[part, order, step] = [
                    sum(d[0] == part for d in alive) - len(gone), len(gone), len(everyone) - len(gone), sum(sum(d[1]) == 1 for d in everyone), sum(d[2] for d in gone), sum(d[3] for d in gone)
                ]
                shapley[part, f] += len(gone)
            alive = [d for d in alive if not d[1][k]]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit_rows(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in MEASURES) for r in found.collect()}


def test_audit_against_one_filter_after_the_other(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = [f"w{j}" if rng.random() < 0.7 else "Same" for j in range(rng.choice([5, 150, 230]))]
        if rng.random() < 0.3:
            words.append("#")
        rows.append((i if i % 13 else None, " ".join(words) if i % 4 else "copy of it", "en", rng.choice(["a", "b", None]), 0))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 4, None]]
    found = filter_audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert _audit_rows(found) == _audit(rows, labels)


def test_audit_hard_rows(spark, hard, clashing):  # noqa: F811
    labels = spark.createDataFrame([(3, 1, 1), (None, 1, 1)], LABELS)
    for docs in (hard, clashing):
        assert _audit_rows(filter_audit.audit_filters(docs, labels)) == _audit(HARD, [(3, 1, 1)])
    assert filter_audit.audit_filters(hard.limit(0), labels).collect() == []
    assert filter_audit.audit_filters(hard, labels.limit(0)).count() == 600 * len({r[3] or "" for r in HARD})


def test_contractions_are_sums_over_cells():
    tensor = np.random.default_rng(0).integers(0, 1_000, (2,) * 5)
    _, own, select = filter_audit.selectors()
    orders = list(itertools.permutations(range(5)))
    for i in range(0, 600, 7):
        order, step = orders[i // 5], i % 5
        assert own[i] == order[step]
        cells = [(c, int(tensor[c])) for c in itertools.product((0, 1), repeat=5)]
        alive = [(c, n) for c, n in cells if not any(c[f] for f in order[:step])]
        assert filter_audit.contract(tensor, select["kept"][i : i + 1])[0] == sum(n for c, n in alive if not c[order[step]])
        assert filter_audit.contract(tensor, select["removed"][i : i + 1])[0] == sum(n for c, n in alive if c[order[step]])


# --- source divergence


def _divergence(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source, _ in rows:
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        group = (lang or "", source or "")
        groups.add(group)
        counts[group].update(found)
        docs.update((group[0], t) for t in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (x, t), n in docs.items() if x == lang and n >= least), key=lambda t: t.encode())
        chance = lambda n, total, v=len(kept): 1 + 1_000_000_000 * (n + 1) // (total + v)
        mine = sorted(g for g in groups if g[0] == lang)
        total = {g: sum(counts[g][t] for t in kept) for g in mine}
        p = {g: [chance(counts[g][t], total[g]) for t in kept] for g in mine}
        everything = sum(total.values())
        q = [chance(sum(counts[g][t] for g in mine), everything) for t in kept]
        price = lambda a, b: (a - b) ** 2 // b
        for g in mine:
            pairs = [(-sum(map(price, p[g], p[h])), h[1]) for h in mine if h != g]
            terms = [(-price(x, y), t) for t, x, y in zip(kept, p[g], q, strict=True) if counts[g][t] and x > y]
            for part, listed in (("pair", pairs), ("term", terms)):
                listed.sort(key=lambda r: (r[0], r[1].encode()))
                out |= {(*g, part, item, -value, rank) for rank, (value, item) in enumerate(listed, 1) if part == "pair" or rank <= top}
    return out


def _rows(found):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _corpus(rng, n):
    terms = ["".join(rng.choices("abcDEé𝔘", k=rng.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(rng.choices(terms, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 30))) + rng.choice(["", " x1y", "-a_b", "\x00z"]) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "en", "de", None]), rng.choice([f"s{j}" for j in range(9)] + [None]), 0) for i, t in enumerate(texts)]
    return rows + [(1_000, "", "en", "bare", 0), (1_001, "only once", "xx", "a", 0), (1_002, None, "xx", "b", 0)]


@pytest.mark.parametrize("options", [{}, {"block_terms": 5, "tile_sources": 2}, {"block_terms": 1, "tile_sources": 3, "top": 4}])
def test_divergence_against_brute_force(spark, options):
    rows = _corpus(random.Random(4), 150)
    found = divergence.divergences(spark, spark.createDataFrame(rows, DOCS), **options)
    assert _rows(found) == _divergence(rows, top=options.get("top", 200))


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = _corpus(random.Random(6), 40)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 10)
    batch = divergence.pa.record_batch([[r[2] or "" for r in rows], [r[3] or "" for r in rows], [(r[1] or "").encode() for r in rows]], names=["lang", "source", "text"])
    found = Counter()
    for part in divergence._count(iter([batch])):
        for lang, source, term, n, _ in zip(*[c.to_pylist() for c in part.columns], strict=True):
            found[lang, source, term] += n
    wanted = Counter((lang or "", source or "", t) for _, text, lang, source, _ in rows for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    assert found == wanted


def test_divergence_hard_rows(spark, hard, clashing):  # noqa: F811
    for docs in (hard, clashing):
        assert _rows(divergence.divergences(spark, docs, least_docs=2)) == _divergence(HARD, least=2)
    assert divergence.divergences(spark, hard.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 37, 64])
def test_trees_share_nodes_and_walks_add_up(width):
    rng = np.random.default_rng(width)
    counts = rng.integers(0, 3, (6, width))
    rows, terms = np.nonzero(counts)
    tree = divergence.Tree(divergence.block_matrix(rows, terms, counts[rows, terms], 6, width))
    for lefts, rights in tree.levels:
        assert len({*zip(lefts.tolist(), rights.tolist(), strict=True)}) == len(lefts)  # equal subtrees are one node
    a, b = np.triu_indices(6)
    priced = []

    def price(i, left, right):
        priced.append(len(i))
        return [np.where(left == divergence.NONE, 0, (left - right) ** 2 * (i + 1)), np.where(left == divergence.NONE, 0, left * right)]

    square, product = divergence.walk(tree, a, b, price)
    assert square.tolist() == [int(((counts[x] - counts[y]) ** 2).sum()) * (i + 1) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    assert product.tolist() == [int((counts[x] * counts[y]).sum()) for x, y in zip(a, b, strict=True)]
    assert priced[0] <= len(a) * 10  # pairs of counts, once per pair of trees and not per place


def test_scaled_chances_are_exact():
    rng = random.Random(1)
    for _ in range(2_000):
        total = rng.randrange(10 ** rng.randint(1, 15))
        count, terms = rng.randrange(total + 1), rng.randrange(1, 10**8)
        wanted = 1 + 1_000_000_000 * (count + 1) // (total + terms)
        assert divergence.scaled(np.array([count]), np.array([total]), np.array([terms]))[0] == wanted


@pytest.mark.parametrize("name, query, sql", [("op12", filter_audit.op12_filter_audit, filter_audit.OP12_SQL), ("op13", divergence.op13_source_divergence, divergence.OP13_SQL)])
def test_audits_and_their_sql(spark, name, query, sql):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    found = query(spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(cursor.fetchall())
