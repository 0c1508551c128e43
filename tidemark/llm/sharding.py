"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

#: Buckets of a shard whose rows are numbered apart from each other.
BUCKETS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..len(weights)-1 that wins ``key``.

    Each shard draws a uniform number from the hash of (key, shard) alone and
    scores ``-ln(u) / weight``; the lowest score wins, ties to the lower shard.
    A shard that is added can therefore only take keys into itself.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        score = -F.log((bits + F.lit(1)) * F.lit(2.0**-53)) / F.lit(float(weight))
        scores.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return F.least(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    weights: Sequence[float] | None = None,
    grown_weight: float | None = None,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Assign every row of ``docs`` to a weighted shard and number the rows of each shard.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; other
    columns of ``docs`` are not read, so extra or clashing names do no harm.
    ``grown_shard`` is the shard if one more (of ``grown_weight``) is added.

    * Null text counts as empty (size 1, checksum 0); null keys share one shard.
    * Rows with equal keys share a shard, and each gets a slot of its own; rows
      equal in all three values are interchangeable among their slots.
    * An empty table gives an empty result.

    Rows equal in id, size and checksum are counted together, before they are shuffled,
    and take neighbouring slots. Slots come from two levels: classes of rows are numbered
    inside hash buckets of a shard, and bucket counts give each bucket's offset, so no
    task holds a whole shard or a whole group of equal rows.
    """
    weights = list(weights or [1.0] * shards)
    grown = [*weights, grown_weight or sum(weights) / len(weights)]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        rendezvous(F.coalesce(F.col("doc_id"), F.lit(0)), weights).alias("shard"),
        rendezvous(F.coalesce(F.col("doc_id"), F.lit(0)), grown).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(buckets)).alias("bucket"),
    )
    classes = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    classes = materialize(docs.sparkSession, classes, "shard-classes")  # read twice
    counts = classes.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x buckets rows
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = classes.withColumn("place", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    numbered = numbered.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("place") + F.col("one")).alias("slot"), "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
