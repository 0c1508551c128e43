"""How quality filters interact: what each removes, alone and after others, in every order.

Each document is reduced to the filters that it fails, a cell of a contingency tensor with
an axis of two (pass, fail) per filter. Spark counts the cells of each part; all orders and
steps are then contractions of the part's tensor, in which each axis takes its passing
half, its failing half or both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Rows, plain_text

#: The filters, each an axis of the tensor; E is found by comparing documents.
FILTERS = "ABCDE"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a document counts for: itself, a good one, a toxic one.
MARKS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a whole text, as booleans; the text must not be null."""
    words = F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ")
    n_words = F.size(F.array_remove(words, ""))
    distinct = F.size(F.array_remove(F.array_distinct(words), ""))
    upper = F.length(text) - F.length(F.translate(text, LETTERS, ""))
    return {
        "A": n_words < 200,
        "B": 100 * distinct.cast("long") < 50 * n_words.cast("long"),
        "C": 100 * upper.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cell, n, good, toxic``: documents of each part by the filters that they fail.

    Bit i of ``cell`` is set if the i-th of ``FILTERS`` fails. Only hashes, ids and bits are
    shuffled, never texts. A text's first id is a minimum over its rows, combined before the
    shuffle, and it is met by (text, id), so a text that a third of the rows share meets its
    first id in many tasks. Rows with the same text and the same smallest id all count as
    first; a row without id has no smaller one and is no copy. A document is good (toxic) if
    any label row of its id says so.
    """
    text = plain_text("text")
    bits = F.lit(0)
    for i, failed in enumerate(text_failures(F.col("t")).values()):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    # texts are told apart by 128 bits of hash and their length
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), F.length("t").alias("size"), bits.cast("int").alias("bits"))
    key = ["h1", "h2", "size"]
    first = rows.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("x")).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max(F.col("q") == 1).alias("good"), F.max(F.col("x") == 1).alias("toxic"))
    found = rows.join(first, [*key, "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    cell = F.col("bits") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return found.groupBy("part", cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def tensors(cells: DataFrame) -> DataFrame:
    """One row per part: ``part, cells``, the list of its cells that hold documents, 32 at most."""
    return cells.groupBy("part").agg(F.collect_list(F.struct("cell", *MARKS)).alias("cells"))


def selectors() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """``orders, filter of each step, {measure: selector}`` for all orders and steps.

    A selector has, for each (order, step) and axis, the weights of pass and fail: (1, 0),
    (0, 1) or, for both, (1, 1).
    """
    passing, failing, both = (1, 0), (0, 1), (1, 1)
    orders = ["".join(p) for p in permutations(FILTERS)]
    count = len(FILTERS)
    own = np.array([[FILTERS.index(f) for f in order] for order in orders])
    place = np.argsort(own, axis=1)  # the step of each filter
    step = np.arange(count)
    earlier = place[:, None, :] < step[None, :, None]
    here = place[:, None, :] == step[None, :, None]

    def choose(at_earlier, at_here, at_later) -> np.ndarray:
        out = np.where(earlier[..., None], at_earlier, np.where(here[..., None], at_here, at_later))
        return out.astype(np.int64).reshape(-1, count, 2)

    return orders, own.reshape(-1), {
        "kept": choose(passing, passing, both),
        "removed": choose(passing, failing, both),
        "failed": choose(both, failing, both),
        "unique_fails": choose(passing, failing, passing),
    }


def contract(tensor: np.ndarray, selector: np.ndarray) -> np.ndarray:
    """The sum over the cells that each row of ``selector`` selects, in whole numbers."""
    return np.einsum("abcde,na,nb,nc,nd,ne->n", tensor, *[selector[:, i] for i in range(len(FILTERS))], optimize="greedy")


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(n, pa.int64()) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit_rows(cells: Sequence[dict]) -> Iterator[tuple]:
    """All rows of a part but its name, from its cells with the counts of ``MARKS``."""
    orders, own, select = selectors()
    flat = {m: np.zeros(1 << len(FILTERS), np.int64) for m in MARKS}
    for cell in cells:
        for m in MARKS:
            flat[m][cell["cell"]] += cell[m]
    # the first filter is the lowest bit of a cell, so the last axis of the reshaped counts
    of = {m: counts.reshape((2,) * len(FILTERS)).transpose() for m, counts in flat.items()}
    found = {name: contract(of["n"], s) for name, s in select.items()}
    good, toxic = contract(of["good"], select["removed"]), contract(of["toxic"], select["removed"])
    shapley = np.array([found["removed"][own == f].sum() for f in range(len(FILTERS))])
    steps = len(FILTERS)
    for i in range(len(own)):
        removed = int(found["removed"][i])
        yield (
            orders[i // steps], i % steps + 1, int(found["kept"][i]), removed, int(found["failed"][i]) - removed, int(found["unique_fails"][i]),
            int(good[i]), int(toxic[i]), int(shapley[own[i]]),
        )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What filters A to E remove from each part of ``docs`` at each step of each of the 120 orders.

    Filters, on whole texts (null as empty, words between the six ASCII white spaces): A
    under 200 words; B fewer than half of the words distinct; C more than 2 % of the
    characters A-Z; D any of ``#$%&*|``; E the text of a smaller doc_id, wherever it is.
    Returns ``part`` (the source, null as empty), ``filter_order``, ``step``, ``kept`` after
    the step, ``removed`` by it, ``redundant`` (failing its filter, gone before),
    ``unique_fails`` (failing no other filter), ``good_lost`` and ``toxic_lost`` among those
    removed, and ``shapley``, what its filter removes in all orders together.

    * Every part has 600 rows, zeros included; an empty table gives none.
    * Null ids are never copies; rows with one id and text are all first or all copies.
      Labels with a null id or value mark nothing; conflicting ones mark as both.
    * Of other columns, whatever their names, nothing is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_AUDIT)
        for batch in batches:
            for row in batch.to_pylist():
                for values in audit_rows(row["cells"]):
                    if out.add(64, row["part"], *values):
                        yield out.batch()
        yield out.batch()

    return tensors(failure_cells(docs, labels)).mapInArrow(run, AUDIT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit_filters(docs.select("doc_id", "text", "source"), labels)


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_F = "(1 << (ascii(substr(filter_order, step, 1)) - 65))"
OP12_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, part, t, len({_WORDS}) AS n_words, len(list_distinct({_WORDS})) AS n_distinct,
    length(t) - length(translate(t, '{LETTERS}', '')) AS n_upper, min(doc_id) OVER (PARTITION BY t) AS first_id FROM base
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN n_words < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * n_distinct < 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_upper > 2 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS cell
  FROM words LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, cell, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, cell
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, {_F} AS own FROM orders, range(1, 6) r(step)
), masks AS (
  SELECT s.filter_order, s.step, s.own, coalesce(sum(p.own) FILTER (p.step < s.step), 0) AS before FROM steps s JOIN steps p USING (filter_order) GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN cell & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN cell & before = 0 AND cell & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN cell & before > 0 AND cell & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN cell = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN cell & before = 0 AND cell & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN cell & before = 0 AND cell & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, (SELECT filter_order, step, own, CAST(before AS INTEGER) AS before FROM masks) m GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
