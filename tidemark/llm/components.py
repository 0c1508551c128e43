"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, shuffled

#: Joins of more links than these are shuffled, whatever the size of their files.
BROADCAST_LINKS = 100_000


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60, broadcast_links: int = BROADCAST_LINKS) -> DataFrame:
    """``node, component`` for every end of ``edges`` (columns ``a``, ``b``, long).

    ``component`` is the smallest node reachable. Alternating large-star and
    small-star steps, each of which hangs a node's neighbours on the smallest of
    them, until nothing changes; a round's edges are written before the next reads
    them. Minima are aggregated before they are shuffled, and a node with very many
    neighbours meets them in a join whose large partitions can be split, so no task
    holds a whole neighbourhood; with more than ``broadcast_links`` links no table of
    them is broadcast. Self-links and repeated links do no harm.
    """
    nodes = materialize(spark, edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc-edges")
    state, before, last = nodes.where("v <> u"), None, None
    count = nodes.count()
    apart = lambda table: shuffled(table, count, broadcast_links)
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node moves to the smallest of its neighbourhood
        both = state.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(state.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("m", "n").alias("m"))
        large = both.where("o > n").join(apart(least), "n").select(F.col("o").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: every smaller neighbour, and the node itself, moves to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(apart(least), "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        state = materialize(spark, small.where("v <> u").distinct(), "cc-round")
        if last is not None:
            discard(spark, last)
        last = state
        # equal sets of links have equal sums
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = nodes.select(F.col("v").alias("node")).unionByName(nodes.select(F.col("u").alias("node"))).distinct()
    return ends.join(apart(state.select(F.col("v").alias("node"), F.col("u").alias("m"))), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def local_components(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``count`` places is linked to, by the links ``left[i] - right[i]``."""
    label = np.arange(count)
    while len(left):
        least = np.minimum(label[left], label[right])
        new = label.copy()
        # the roots of both ends take the smaller label, then every place jumps to its root's
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label
