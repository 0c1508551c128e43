"""Exact top-k inner products by MaxScore over posting lists of quantised vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

#: Vectors of a shard and queries of a group, at most about so many.
SHARD_ROWS, GROUP_QUERIES = 65_536, 16_384
#: Shards are not made smaller than this to occupy more tasks.
LEAST_ROWS = 2_048
#: The first bar of a query comes from so many documents at the heads of the lists of so many of its terms.
HEAD, STRONGEST = 32, 8
#: Terms that are probed between two looks at which documents still compete.
STEP = 4


def usable(vector: Column) -> Column:
    """False for null vectors and those with null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of zero-padded doubles."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    sizes = np.diff(array.offsets.to_numpy())
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Postings:
    """The posting lists of a shard, one per term: the documents that hold the term, with their weights.

    ``docs`` and ``weights`` are in document order, ``ranked`` lists the documents by
    rising weight. A list that holds most documents keeps the weights of all, zeros
    among them, and has ``docs`` None.
    """

    def __init__(self, matrix: np.ndarray):
        self.size, self.width = matrix.shape
        self.docs: list[np.ndarray | None] = []
        self.weights: list[np.ndarray] = []
        self.ranked: list[np.ndarray] = []
        self.low, self.high = np.zeros(self.width), np.zeros(self.width)
        for term in range(self.width):
            held = np.flatnonzero(matrix[:, term])
            if 2 * len(held) > self.size:
                held = np.arange(self.size)
            weights = np.ascontiguousarray(matrix[held, term])
            self.docs.append(None if len(held) == self.size else held)
            self.weights.append(weights)
            self.ranked.append(held[np.argsort(weights, kind="stable")])
            if len(held):
                # a document that is not in the list adds nothing
                absent = [] if len(held) == self.size else [0.0]
                self.low[term], self.high[term] = min([weights.min(), *absent]), max([weights.max(), *absent])

    def traverse(self, term: int, weight: float, score: np.ndarray) -> None:
        """Add the term's contributions to all documents of its list."""
        docs = self.docs[term]
        if docs is None:
            score += weight * self.weights[term]
        else:
            score[docs] += weight * self.weights[term]

    def probe(self, term: int, some: np.ndarray) -> np.ndarray:
        """The weights of ``some`` documents, 0 for those not in the list."""
        docs, weights = self.docs[term], self.weights[term]
        if docs is None:
            return weights[some]
        if not len(docs):
            return np.zeros(len(some))
        at = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
        return np.where(docs[at] == some, weights[at], 0.0)


def maxscore(query: np.ndarray, own: int, postings: Postings, docs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc ids, scores)`` of the ``k`` best documents of one query, by falling score, then id.

    A term adds between its least and its greatest contribution, the products of the
    query's weight with the ends of its list. The bar, which the k-th best reaches for
    certain, is first set by scoring in full the documents at the heads of the lists of
    the query's strongest terms. Terms are ordered by the width of their interval; those
    of the smallest widths are non-essential as long as a document with the least of all
    other terms cannot reach the bar through them. The lists of the essential terms are
    traversed; then the others are probed, widest first, for the documents that can still
    reach the bar.
    """
    ends = query * postings.high, query * postings.low
    upper, lower = np.maximum(*ends), np.minimum(*ends)
    order = np.argsort(lower - upper, kind="stable")
    order = order[upper[order] > lower[order]]
    flat = float(lower.sum())  # what every document scores at least
    spread = (upper - lower)[order]
    # what the terms from a place on can add to ``flat`` at most
    rest = np.concatenate([np.cumsum(spread[::-1])[::-1], [0.0]])

    heads = [postings.ranked[t][-HEAD:] if query[t] > 0 else postings.ranked[t][:HEAD] for t in order[:STRONGEST]]
    seen = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
    seen = seen[ids[seen] != own]
    scores = docs[seen] @ query
    bar = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf

    essential = int(np.searchsorted(-(flat + rest), -bar, side="right"))  # the first place from which the rest stays below the bar
    score = np.full(postings.size, flat - lower[order[:essential]].sum())
    for term in order[:essential]:
        postings.traverse(term, query[term], score)
    alive = np.arange(postings.size)
    for place in range(essential, len(order) + STEP, STEP):
        still = score + rest[min(place, len(order))] >= bar
        # while most documents compete, whole lists are cheaper to read than their places
        if 2 * np.count_nonzero(still) < len(still) or place >= len(order):
            alive, score = alive[still], score[still]
        for term in order[place : place + STEP]:
            score -= lower[term]
            if len(alive) == postings.size:
                postings.traverse(term, query[term], score)
            else:
                score += query[term] * postings.probe(term, alive)
    alive, score = alive[ids[alive] != own], score[ids[alive] != own]
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[best]], score[best]


_FOUND = pa.schema([("query_id", pa.int64()), ("query_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        width = max(1, max(np.diff(c.offsets.to_numpy()).max(initial=0) for t in (docs, queries) for c in t["w"].chunks))
        ids, weights = docs["vec_id"].to_numpy(), matrix(docs["w"], width)
        postings = Postings(weights)
        asked, numbers = queries["vec_id"].to_numpy(), queries["no"].to_numpy()
        found = [maxscore(q, own, postings, weights, ids, k) for q, own in zip(matrix(queries["w"], width), asked, strict=True)]
        times = [len(f[0]) for f in found]
        columns = [np.repeat(asked, times), np.repeat(numbers, times), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)]
        return pa.table(columns, schema=_FOUND)

    return run


def top_k_inner_products(
    spark: SparkSession,
    vectors: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    every: int = 50,
    shard_rows: int = SHARD_ROWS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors of each query, all if fewer.

    Components become ``floor(scale * x)``. Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all rows with another vec_id than the
    query's. Ties go to the smaller vec_id.

    * Null vectors and ids, and vectors with null or non-finite components, take no
      part; shorter vectors count as padded with zeros.
    * Repeated candidate rows take a rank each; repeated query rows are answered each.
    * An empty table, or one vector alone, gives an empty result.
    * Scores are exact while their terms' sums stay below 2**53 in size.

    Queries in groups meet vectors in shards; a task builds the posting lists of one
    shard and runs MaxScore over them for each query of one group, with a split of terms
    of its own. Each shard's k best per query are merged at the end.
    """
    quantised = F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", quantised.alias("w"))
    rows = materialize(spark, rows, "maxscore-vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism * 2, n // LEAST_ROWS))
    groups = max(1, -(-n_asked // group_queries))
    to_all = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    # dealt by row, so that repeated ids do not gather in one shard
    docs = rows.select("vec_id", "w", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")).select("*", to_all(groups).alias("grp"))
    queries = asked.withColumn("no", F.monotonically_increasing_id()).withColumn("grp", F.pmod(F.xxhash64("vec_id", "no"), F.lit(groups)).cast("int")).withColumn("shard", to_all(shards))
    pair = ["shard", "grp"]
    best = docs.groupBy(*pair).cogroup(queries.groupBy(*pair)).applyInArrow(_search(k), "query_id long, query_no long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner_products(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(d.w AS DOUBLE[])) AS BIGINT) AS score
  FROM good q, good d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
