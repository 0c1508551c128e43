"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, hot_join, materialize, released
from tidemark.llm.components import connected_components, local_components
from tidemark.llm.vector_search import matrix, usable

#: A pair just at the threshold is in no common bucket with at most this chance.
MISS = 1e-5
#: A table has so many more hyperplanes than would give each vector a bucket of its own:
#: vectors that are not near-duplicates then seldom share a bucket, and those that share
#: none are not sent anywhere.
SPARE_BITS, LEAST_BITS, MOST_BITS = 3, 6, 31
#: A larger bucket is cut into parts of about so many rows, which meet two by two.
PART_ROWS = 2_048
#: Buckets of at most so many rows are compared many at a time.
SMALL = 24
#: Tables of at most so many narrow rows are broadcast.
BROADCAST_ROWS = 200_000


def table_plan(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes per table and tables, for ``rows`` vectors of one label."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, rows))) + SPARE_BITS))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def _normal(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of huge components would overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


_SIGNED = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int32()))])


def _sign(bits: int, tables: int, seed: int):
    """Each vector's bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(bits)).astype(np.float64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                widths = batch.column(1).to_numpy()
                for width in np.unique(widths):
                    own = batch.filter(pa.array(widths == width))
                    if width not in planes:
                        planes[width] = np.random.default_rng([seed, int(width)]).standard_normal((int(width), bits * tables))
                    unit = _normal(matrix(pa.chunked_array([own.column(2)]), int(width)))
                    signs = (unit @ planes[width] > 0).reshape(len(unit), tables, bits)
                    keys = pa.array((signs @ powers).astype(np.int32).ravel())
                    offsets = pa.array(np.arange(0, (len(unit) + 1) * tables, tables, dtype=np.int32))
                    yield pa.record_batch([own.column(0), pa.ListArray.from_arrays(offsets, keys)], schema=_SIGNED)

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
SLOT = ["slot", "part_a", "part_b"]


def _pairs(threshold: float):
    """Links of the pairs in each run of rows with equal ``SLOT`` columns.

    A pair that meets in several tables counts in the first of them. Per vector the
    number of linked vectors comes out, and a link to the smallest vector of its
    component among those compared: as many rows as there are vectors, not pairs.
    """

    def small(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows within each of the runs that end at ``edges``."""
        sizes = np.diff(edges)
        after = np.repeat(edges[1:], sizes) - np.arange(edges[0], edges[-1]) - 1
        left = np.repeat(np.arange(edges[0], edges[-1]), after)
        return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)

    def large(unit: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(left), 512):
            i, j = np.nonzero(unit[left[start : start + 512]] @ unit[right].T >= threshold)
            yield left[start + i], right[j]

    def work(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The links of whole runs; ``edges`` are their ends."""
        if not (np.diff(edges) > 1).any():
            return
        tbl, nodes, n = (table[c].to_numpy() for c in ("tbl", "node", "n"))
        widths = table["width"].to_numpy()
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

        def links(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            for earlier in range(int(tbl[i].max(initial=0))):
                apart = (keys[i, earlier] != keys[j, earlier]) | (tbl[i] <= earlier)
                i, j = i[apart], j[apart]
            if not len(i):
                return
            own, place = np.unique(nodes[np.concatenate([i, j])], return_inverse=True)
            a, b = place[: len(i)], place[len(i) :]
            counts = np.bincount(a, n[j], len(own)) + np.bincount(b, n[i], len(own))
            yield pa.record_batch([own, own[local_components(len(own), a, b)], counts.astype(np.int64)], schema=_LINKS)

        sizes = np.diff(edges)
        few = (sizes > 1) & (sizes <= SMALL) & (table["part_a"].to_numpy()[edges[:-1]] == table["part_b"].to_numpy()[edges[:-1]])
        # neighbouring small runs together, some thousand rows at a time
        own = np.flatnonzero(few)
        for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own]) // 4_096)) + 1) if len(own) else []:
            rows = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in some])
            ends = np.concatenate([[0], np.cumsum(sizes[some])])
            i, j = small(ends)
            width = int(widths[rows].max())
            unit = _normal(matrix(table["v"].take(pa.array(rows)), width))
            close = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            yield from links(rows[i[close]], rows[j[close]])
        for k in np.flatnonzero((sizes > 1) & ~few):
            rows = np.arange(edges[k], edges[k + 1])
            part, part_a, part_b = table["part"].to_numpy()[rows], table["part_a"][rows[0]].as_py(), table["part_b"][rows[0]].as_py()
            unit = _normal(matrix(table["v"].slice(rows[0], len(rows)), int(widths[rows[0]])))
            for i, j in large(unit, np.flatnonzero(part == part_a), np.flatnonzero(part == part_b)):
                once = i < j if part_a == part_b else slice(None)
                yield from links(rows[i[once]], rows[j[once]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            differs = np.zeros(table.num_rows - 1, bool)
            for name in SLOT:
                values = table[name].to_numpy()
                differs |= values[1:] != values[:-1]
            edges = np.concatenate([[0], np.flatnonzero(differs) + 1])
            yield from work(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1])
        if held is not None:
            yield from work(held, np.array([0, held.num_rows]))

    return run


def near_duplicate_vectors(
    spark: SparkSession,
    vectors: DataFrame,
    threshold: float = 0.98,
    seed: int = 7,
    miss: float = MISS,
    part_rows: int = PART_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Two vectors link if their labels are equal and not null, they have as many
    components, and their cosine in double precision is ``threshold`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest vec_id reachable, ``kept`` marks that row.

    Exact copies are one class from the start, told by a hash of 128 bits. A table hashes
    a class to the signs of its products with random hyperplanes; there are so many that
    classes which are no near-duplicates seldom share a bucket, and the number of tables
    follows from ``miss``, the chance that a pair at the threshold meets nowhere. Buckets
    are counted by (bucket, class) alone; vectors go only to buckets of two classes or
    more. A bucket of any size is compared whole, in parts that meet two by two.

    * Vectors that are null, empty, zero, or hold null or non-finite components, and
      vectors with a null label or vec_id, link with nothing: 0 links, a component of
      their own.
    * Repeated rows link with each other. Rows with equal vec_id and different vectors
      have the links of their own vector; in the components they are one node. A null
      vec_id keeps a null component.
    * An empty table gives an empty result; other columns are not read.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    plain = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.transform(F.col("embedding").cast(kind), lambda x: F.when(x == 0, zero).otherwise(x)).alias("v"),
    )
    fine = F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    plain = plain.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = plain.where("fine").withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "v", "label")})
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(spark, classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_plan(largest, threshold, miss)

    start = classes.select("node", F.size("v").alias("width"), "v").repartition(spark.sparkContext.defaultParallelism * 2, "node")
    signed = materialize(spark, start.mapInArrow(released(_sign(bits, tables, seed)), "node long, keys array<int>"), "near-signed")
    # labels and widths are part of a bucket's name
    named = signed.join(classes.select("node", F.xxhash64("label", F.size("v")).alias("home")), "node")
    slots = named.select("node", "home", F.posexplode("keys").alias("tbl", "bucket")).select("node", "tbl", F.xxhash64("home", "tbl", "bucket").alias("slot"))
    sizes = slots.groupBy("slot").agg(F.count("*").alias("rows")).where("rows > 1").select("slot", F.ceil(F.col("rows") / part_rows).cast("int").alias("parts"))
    sizes = materialize(spark, sizes, "near-buckets")
    live = hot_join(spark, slots, sizes, ["slot"], ["node"], broadcast_rows).where("parts is not null")
    live = live.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    live = live.select("node", "slot", "tbl", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    whole = classes.select("node", "n", F.size("v").alias("width"), "v").join(signed, "node")
    dealt = live.join(whole, "node").repartition(*SLOT).sortWithinPartitions(*SLOT)
    links = materialize(spark, dealt.mapInArrow(released(_pairs(threshold)), "a long, b long, n long"), "near-links")
    discard(spark, signed, sizes)

    # rows of a class of several find it by its hash; a single row is its class
    several = classes.where("n > 1").select("h1", "h2", "node")
    repeated = hot_join(spark, rows.select("vec_id", "h1", "h2"), materialize(spark, several, "near-several"), ["h1", "h2"], ["vec_id"], broadcast_rows)
    repeated = repeated.where("node is not null").select("vec_id", "node")
    members = materialize(spark, classes.where("n = 1").select(F.col("id").alias("vec_id"), "node").unionByName(repeated), "near-members")
    # classes that share a vec_id are one node of the graph
    shared = members.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = members.join(shared, "vec_id").where("node <> a").select(F.col("node").alias("b"), "a").distinct()
    joined = connected_components(spark, links.where("a <> b").select("a", "b").unionByName(same.select("a", "b"))).withColumnRenamed("node", "a")
    least = classes.select(F.col("node").alias("a"), "id").join(joined, "a").groupBy("component").agg(F.min("id").alias("component_id"))
    joined = joined.join(least, "component").select(F.col("a").alias("node"), "component_id")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    figures = classes.select("node", "id", "n").join(counts, "node", "left").join(joined, "node", "left")
    figures = figures.where("links is not null or component_id is not null or n > 1")
    figures = figures.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    found = hot_join(spark, members, materialize(spark, figures, "near-figures"), ["node"], ["vec_id"], broadcast_rows)
    none = F.lit(0).cast("long")
    found = found.select("vec_id", F.coalesce("n_links", none).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = plain.where("not fine").select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM fine
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN counted USING (vec_id)
"""
