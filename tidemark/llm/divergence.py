"""How sources of a language differ in their words: divergences of pairs and most telling terms.

Terms are counted per source; the divergence of two sources is then a sum over all terms of
the language. A task holds a block of terms and a tile of sources. The counts of each source
in the block are a segment tree over term ids, whose nodes are hash-consed: subtrees with
equal counts, of whatever source and place, are one node. Two trees are walked together
from their roots, and each pair of nodes that the walk meets is priced once.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import hot_join, materialize, plain_text, release, released

#: Terms of a block and sources of a tile, on average.
BLOCK_TERMS, TILE_SOURCES = 16_384, 32
#: Pairs of trees that are walked at a time.
WALK_PAIRS = 16
#: A task's table of counts is handed on once it has so many places.
HELD_COUNTS = 4 << 20
#: At most so many groups (some 10 MB) are broadcast.
BROADCAST_GROUPS = 100_000
#: Documents that a kept term is in at least, parts of a probability, ranks of the term part.
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200

#: Letters A-Z lower-cased and bytes of other alphabets as they are; all else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows (lang, source, text in UTF-8) by group and term, once or a few times per task."""
    terms: dict[bytes, int] = defaultdict(itertools.count().__next__)
    groups: dict[tuple, int] = defaultdict(itertools.count().__next__)
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    held = 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if keys:
            key, n = np.concatenate(keys), np.concatenate(times)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count, docs, key = np.add.reduceat(n, starts), np.diff(np.append(starts, len(key))), key[starts]
            names = pa.array(list(terms), pa.binary()).cast(pa.string())
            places = list(groups)
            of_lang, of_source = (pa.array([p[i] for p in places], pa.string()) for i in (0, 1))
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                group = pa.array(key[part] >> 32)
                columns = [of_lang.take(group), of_source.take(group), names.take(pa.array(key[part] & 0xFFFFFFFF)), pa.array(count[part]), pa.array(docs[part])]
                yield pa.record_batch(columns, schema=_COUNTS)
        for part in (keys, times, terms, groups):
            part.clear()
        terms.default_factory = itertools.count().__next__
        groups.default_factory = itertools.count().__next__
        held = 0

    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            group = groups[lang.as_py(), source.as_py()]
            found = text.as_py().translate(_TERMS).split()
            if not found:
                continue
            ids, n = np.unique(np.fromiter(map(terms.__getitem__, found), np.int64, len(found)), return_counts=True)
            keys.append(ids + (group << 32))
            times.append(n)
            held += len(ids)
            if held >= HELD_COUNTS:
                yield from close()
    yield from close()


def scaled(count, total, terms, div=np.floor_divide):
    """``1 + floor(SCALE * (count + 1) / (total + terms))`` in whole numbers of 64 bits.

    For arrays, or for columns with ``div=_div``. Three digits of SCALE are taken at a time,
    so nothing overflows while counts are below 9e15.
    """
    out, rest, size = 0, count + 1, total + terms
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + div(rest, size), rest % size
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def priced(p, q, div=np.floor_divide):
    """A term's part of the divergence of p from q; all are at most 1e9 + 1, so the square fits."""
    return div((p - q) * (p - q), q)


class Tree:
    """Hash-consed segment trees over the columns of a matrix of counts, one tree per row.

    ``levels[k]`` holds, for each node of height k + 1, its left and right node of height k;
    a node of height 0 is one of ``leaves``. ``roots`` has the root of each row. Equal
    subtrees, of any row and place, are the same node.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            width = int(nodes.max()) + 1
            pairs, found = np.unique(nodes[:, 0::2] * width + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // width, pairs % width))
            nodes = found.reshape(nodes.shape[0], -1)
        self.roots = nodes[:, 0]


def walk(tree: Tree, a: np.ndarray, b: np.ndarray, price) -> list[np.ndarray]:
    """What ``price`` gives for the leaves of trees ``a[i]`` and ``b[i]``, summed over their common places.

    Both trees of each pair are walked down together. The nodes that the walk meets at a
    height are kept once per pair of trees, so subtrees that occur side by side in many
    places are priced once. ``price(i, left, right)`` takes pair numbers and leaf counts
    and returns a list of arrays; so does this, with a value per pair of trees.
    """
    number, left, right = np.arange(len(a)), tree.roots[a], tree.roots[b]
    met: list[np.ndarray] = []
    for lefts, rights in reversed(tree.levels):
        width = max(int(lefts.max()), int(rights.max())) + 1
        below = [(number * width + of[left]) * width + of[right] for of in (lefts, rights)]
        keys, places = np.unique(np.concatenate(below), return_inverse=True)
        met.append(places)
        number, left, right = keys // (width * width), keys // width % width, keys % width
    values = price(number, tree.leaves[left], tree.leaves[right])
    for places in reversed(met):
        half = len(places) // 2
        values = [v[places[:half]] + v[places[half:]] for v in values]
    return values


#: The leaf of a place that no term has.
NONE = -1


def block_matrix(rows: np.ndarray, terms: np.ndarray, n: np.ndarray, sources: int, width: int) -> np.ndarray:
    """Counts of ``sources`` in the terms of a block, ``width`` of them, and ``NONE`` up to a power of two.

    Term ids are given by the counts themselves: terms that are alike in all sources lie
    side by side, so that their subtrees are equal.
    """
    counts = np.zeros((sources, width), np.int64)
    counts[rows, terms] = n
    counts = counts[:, np.lexsort(counts)]
    whole = np.full((sources, 1 << max(0, width - 1).bit_length()), NONE, np.int64)
    whole[:, :width] = counts
    return whole


PARTS = "lang string, source string, item string, value long"
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pairs(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Divergences within a block of terms, of all pairs of sources of a tile in both directions."""
    if not sources.num_rows:
        return _PARTS.empty_table()
    sources = sources.sort_by("source")
    names, total, side = sources["source"].combine_chunks(), sources["total"].to_numpy(), sources["side"].to_numpy()
    terms, width = sources["terms"].to_numpy(), int(sources["width"][0].as_py())
    rows = pc.index_in(counts["source"], names).to_numpy()
    places = counts["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    tree = Tree(block_matrix(rows, places, counts["n"].to_numpy(), len(names), width))
    a, b = np.triu_indices(len(names), 1)
    if sources["tile_a"][0] != sources["tile_b"][0]:  # two tiles meet: only pairs between them
        between = side[a] != side[b]
        a, b = a[between], b[between]
    out = []
    for at in range(0, len(a), WALK_PAIRS):
        x, y = a[at : at + WALK_PAIRS], b[at : at + WALK_PAIRS]

        def price(i, left, right, x=x, y=y):
            p, q = scaled(left, total[x[i]], terms[x[i]]), scaled(right, total[y[i]], terms[y[i]])
            there = left != NONE
            return [np.where(there, priced(p, q), 0), np.where(there, priced(q, p), 0)]

        forth, back = walk(tree, x, y, price)
        for source, item, value in ((x, y, forth), (y, x, back)):
            out.append(pa.table([pa.repeat(sources["lang"][0], len(value)), names.take(pa.array(source)), names.take(pa.array(item)), pa.array(value)], schema=_PARTS))
    release()
    return pa.concat_tables(out) if out else _PARTS.empty_table()


def divergences(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """Divergence of each source of a language from each other one, and its most telling terms.

    Null text, lang and source are read as ''. Terms are runs of letters A-Z, lower-cased,
    and of characters beyond ASCII; a language keeps those in ``least_docs`` of its rows.
    With counts n, their sum N and V kept terms, p = 1 + floor(1e9 (n + 1) / (N + V)), for a
    source and for the whole language, and f = floor((p - q)^2 / q). Returns ``lang, source,
    part, item, value, rank``: in part ``pair`` an item is another source with the sum of f
    over all kept terms, in part ``term`` a term of the source with p > q, q the language's,
    of which the ``top`` best are there. Ranks go by falling value, then by item.

    * Sources without kept terms take part, with N = 0; where V = 0 all pairs have value 0.
    * Equal values rank by item; a language of one source has no pairs; repeated rows count
      as often as they are there; an empty table gives an empty result.
    * Of other columns, whatever their names, nothing is read.

    Counts are added up within a task, then by (lang, source, term), so that no term or
    source is hot; a term then meets its sources once. Blocks of terms and tiles of sources
    bound what a task holds; a tile pair sees each block.
    """
    rows = docs.select(plain_text("lang").alias("lang"), plain_text("source").alias("source"), plain_text("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(released(_count), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"_docs": F.sum("docs").over(by_term), "all_n": F.sum("n").over(by_term), "first": F.col("source") == F.min("source").over(by_term)})
    kept = materialize(spark, kept.where(F.col("_docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "first"), "divergence-terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("all_total"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(per_lang, "lang").na.fill(0, ["total", "terms", "all_total"])
    groups = materialize(spark, groups.withColumns({
        "blocks": F.ceil(F.col("terms") / block_terms).cast("int"),
        "tiles": F.ceil(F.col("sources") / tile_sources).cast("int"),
    }), "divergence-groups")
    groups = groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    facts = hot_join(spark, kept, groups.select("lang", "source", "total", "terms", "all_total", "blocks", "tiles", "tile"), ["lang", "source"], ["term"], BROADCAST_GROUPS)

    p, q = scaled(F.col("n"), F.col("total"), F.col("terms"), _div), scaled(F.col("all_n"), F.col("all_total"), F.col("terms"), _div)
    telling = facts.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    telling = telling.select("lang", "source", "part", "item", priced(F.col("p"), F.col("q"), _div).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # a tile goes to all pairs of tiles that it is in
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")
    key = ["lang", "block", "tile_a", "tile_b"]
    tiled = [F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b")]
    counts = facts.select("lang", block, "source", "term", "n", "tile", others).select("lang", "block", *tiled, "source", "term", "n")
    widths = facts.where("first").groupBy("lang", block).agg(F.count("*").alias("width"))
    members = groups.select("lang", "source", "total", "terms", "tile", others).select("lang", "source", "total", "terms", *tiled, (F.col("tile") > F.col("other")).alias("side"))
    members = members.join(widths, "lang")
    value = counts.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(_pairs, PARTS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("terms = 0")
    bare = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    paired = value.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return paired.unionByName(telling)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_P = f"1 + ({SCALE} * ({{n}} + 1)) // ({{total}} + V)"
OP13_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(found) AS term FROM base
), kept AS (
  SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS V, sum(n) AS total FROM kept GROUP BY lang
), grp AS (
  SELECT lang, source, coalesce(max(V), 0) AS V, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM base) LEFT JOIN langs USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), priced AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST({_P.format(n="coalesce(c.n, 0)", total="g.total")} AS BIGINT) AS p
  FROM grp g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, term, CAST({_P.format(n="n", total="total")} AS BIGINT) AS q FROM (SELECT k.*, V, total FROM kept k JOIN langs USING (lang))
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), telling AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM priced JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling))
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
