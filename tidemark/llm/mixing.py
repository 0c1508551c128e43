"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import free_name, materialize, released

#: Words as the contract counts them, ``[^\\x20\\x09-\\x0D]+``, with the characters that
#: they do hold named, which Java matches faster.
WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]+"
#: Rows that a leaf of a source's reduction tree holds at most on average, and how many nodes meet in one.
LEAF_ROWS, FAN_IN = 4096, 32
#: The targets of at most so many sources (some 10 MB) are broadcast.
BROADCAST_SOURCES = 100_000
#: Probabilities this near to 0 or 1 count as integral.
EPSILON = 1e-12


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], ceiling: float, group: str = "source", size: str = "source_size") -> DataFrame:
    """Target size of each source: its weight's share of all sizes, at most ``ceiling`` times its own.

    ``sizes`` has one row per source. Sources by code point, null last, take
    ``weights`` in turn. What a capped source cannot take is shared by weight
    among the others until none is above its cap; the result is the water level
    ``L`` with ``target = min(ceiling * size, L * weight)``, found by sorting the
    sources by the level at which they fill up. One row per source, so the
    ordered windows here see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col(group).isNull(), F.col(group))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_place"), F.lit(len(weights))).cast("int") + 1)
    ranked = sizes.withColumn("_place", F.row_number().over(by_name) - 1).withColumn("_weight", weight)
    ranked = ranked.withColumn("_cap", F.col(size) * F.lit(float(ceiling)))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    ranked = ranked.select(
        "*",
        F.sum(F.col(size).cast("double")).over(everything).alias("_total"),
        F.sum("_weight").over(everything).alias("_weights"),
        F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)).alias("_filled"),
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0)).alias("_gone"),
    )
    # the level if exactly the sources before this one are full
    level = (F.col("_total") - F.col("_filled")) / (F.col("_weights") - F.col("_gone"))
    ranked = ranked.withColumn("_level", level)
    # the first source that is not full at its own level sets the level of all after it
    holds = F.when(F.col("_cap") / F.col("_weight") >= F.col("_level"), F.col("_level"))
    ranked = ranked.withColumn("_level", F.min(F.struct(F.when(holds.isNull(), F.lit(1)).otherwise(F.lit(0)).alias("_no"), F.col("_gone").alias("_at"), F.col("_level").alias("_is"))).over(everything)["_is"])
    return ranked.select(*sizes.columns, F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))


def pivot(sizes: Sequence[int], parts: Sequence[float], draws: Sequence[float]) -> np.ndarray:
    """Pivotal rounding of one node: the probabilities afterwards, of which one at most is fractional.

    Documents come by falling size. The longest that is still fractional is settled first: one
    draw says whether it becomes 1 or 0, and its words come from, or go to, the shorter ones
    after it, pair by pair, until it is integral. With probability ``p`` of its own it takes
    ``(1 - p) r`` words from a partner when it rises and gives ``p r`` words when it falls, so
    the partner's expectation stays; ``r`` is as large as the partner can bear both ways, and
    all ``r`` of its partners make up its size. Each step thus keeps all expectations and the
    node's expected words. What cannot be settled so, for want of partners, is among the
    shortest; these are paired two at a time (``pair_up``), and one may be left fractional.
    A document longer than what all shorter ones of its node can bear is left to that, too.
    """
    s, p = np.asarray(sizes, np.float64), np.array(parts, np.float64)
    count, i = len(p), 0
    while i < count:
        if not EPSILON < p[i] < 1 - EPSILON:
            i += 1
            continue
        own, stop, width = p[i], i + 1, 16
        while True:  # as many partners as it needs
            stop = min(count, i + 1 + width)
            q, size = p[i + 1 : stop], s[i + 1 : stop]
            bear = np.minimum(q * size / (1 - own), (1 - q) * size / own)
            total = np.cumsum(bear)
            if stop == count or total[-1] >= s[i]:
                break
            width *= 4
        if not len(total) or total[-1] < s[i]:
            break
        last = int(np.searchsorted(total, s[i]))
        share = bear[: last + 1]
        share[last] -= total[last] - s[i]
        rises = draws[i] < own
        q = q[: last + 1] + (-(1 - own) if rises else own) * share / size[: last + 1]
        whole = np.rint(q)
        p[i + 1 : i + 2 + last] = np.where(np.abs(q - whole) <= EPSILON, whole, q)
        p[i] = 1.0 if rises else 0.0
        i += 1
    return pair_up(s, p, draws[count:])


def pair_up(s: np.ndarray, p: np.ndarray, draws: Sequence[float]) -> np.ndarray:
    """Two at a time, the one still fractional and the next: words move from one to the other until one is integral."""
    held = -1
    for i in np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON)).tolist():
        if held < 0:
            held = i
            continue
        own, size = s[held], s[i]
        up, down = min((1 - p[held]) * own, p[i] * size), min(p[held] * own, (1 - p[i]) * size)
        words = up if draws[i] * (up + down) < down else -down
        for k, q in ((held, p[held] + words / own), (i, p[i] - words / size)):
            # the bound that was reached is met exactly
            p[k] = round(q) if abs(q - round(q)) <= EPSILON else q
        held = next((k for k in (held, i) if 0 < p[k] < 1), -1)
    return p


def _round(seed: int, depth: int, last: bool):
    """``pivot`` over the runs of rows of a source's node; at the root, what is left is drawn.

    The draws of a node are those of a generator seeded by the node, one for each step.
    """

    def settle(rows: pa.Table) -> pa.Table:
        source, node = rows["source"][0].as_py(), rows["node"][0].as_py()
        name = -1 if source is None else zlib.crc32(source.encode())
        draws = np.random.default_rng([seed % 2**64, depth, node, name + 1]).random(2 * rows.num_rows + 1)
        part = pivot(rows["size"].to_numpy(), rows["part"].to_numpy(), draws)
        if last:
            open_one = (part > EPSILON) & (part < 1 - EPSILON)
            part = np.where(open_one, draws[-1] < part, part)
        done = (part <= EPSILON) | (part >= 1 - EPSILON)
        more = rows["more"].to_numpy() + (part > 1 - EPSILON)
        new = {"part": np.where(done, 0.0, part), "more": more, "done": done}
        for column, values in new.items():
            at = rows.schema.get_field_index(column)
            rows = rows.set_column(at, rows.schema.field(at), pa.array(values, rows.schema.field(at).type))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            differs = np.zeros(table.num_rows - 1, bool)
            for name in ("source", "node"):
                codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                differs |= codes[1:] != codes[:-1]
            edges = np.concatenate([[0], np.flatnonzero(differs) + 1])
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                yield from settle(table.slice(start, stop - start)).to_batches()
            held = table.slice(edges[-1])
        if held is not None:
            yield from settle(held).to_batches()

    return run


def pivotal_copies(spark: SparkSession, rows: DataFrame, seed: int, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Whole copies for classes of equal rows, by pivotal rounding over a tree of nodes.

    ``rows`` has doc_id, tag, source, size, the number ``n`` of equal rows, the copies
    ``part`` (0 or more) expected of each and the number ``classes`` of its source. Adds
    ``more``, the copies of the class beyond ``floor(part)`` for each row. ``n`` rows with a
    fraction ``f`` have ``floor(n f)`` of them for certain, and what is left is the class's
    probability.

    A source's classes are dealt to leaves by hash, ``leaf_rows`` to each on average; a leaf
    leaves one fractional class at most, and ``fan_in`` leaves meet in each node of the next
    level up to one root per source. Each level's rows are written before the next reads
    them. No text is carried along.
    """
    leaves = F.ceil(F.col("classes") / leaf_rows)
    nodes = rows.agg(F.max(leaves)).first()[0] or 1
    mass = F.when(F.col("size") > 0, (F.col("part") - F.floor("part")) * F.col("n")).otherwise(F.lit(0.0))
    names = rows.columns
    level = rows.withColumn("_whole", F.floor("part").cast("long")).withColumn("more", F.floor(mass + EPSILON).cast("long")).withColumn("part", F.greatest(mass - F.col("more"), F.lit(0.0)))
    level = level.withColumn("done", F.col("part") <= EPSILON)
    level = level.withColumn("node", F.pmod(F.xxhash64("doc_id", "tag", F.lit(seed)), leaves))
    settled, decided = level.where("done"), []
    level = level.where("not done")
    depth = 0
    while True:
        dealt = level.repartition("source", "node").sortWithinPartitions("source", "node", F.desc("size"), "tag", "doc_id")
        level = materialize(spark, dealt.mapInArrow(released(_round(seed, depth, nodes == 1)), dealt.schema), f"mix-{depth}")
        decided.append(level.where("done"))
        if nodes == 1:
            break
        nodes = -(-nodes // fan_in)
        depth += 1
        level = level.where("not done").withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
    for more in decided:
        settled = settled.unionByName(more)
    return settled.drop("node", "done", "part").withColumnRenamed("_whole", "part").select(*names, "more")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have none, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def mixed_classes(spark: SparkSession, docs: DataFrame, tag: Column, weights: Sequence[float], max_copies: int, seed: int) -> DataFrame:
    """The classes of equal rows of ``docs`` with their copies; see ``mix_sources``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"))
    rows = materialize(spark, rows.groupBy("doc_id", "tag", "source", "size").agg(F.count("*").alias("n")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count("*").alias("classes"))
    targets = materialize(spark, source_targets(sizes, weights, float(max_copies)), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)  # else a shuffled join, whose large partitions AQE splits
    rows = rows.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select("r.*", "t.source_size", "t.target", "t.classes")
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.least(expected, F.lit(float(max_copies)))).otherwise(F.lit(0.0)))
    return pivotal_copies(spark, rows, seed)


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_copies: int = 3,
    seed: int = 20,
) -> DataFrame:
    """How many copies of each row of ``docs`` a mix by source weights takes.

    Returns ``doc_id, size, source, source_size, target, copies, taken``. ``size`` counts
    words, ``taken`` is ``copies * size``. Every row of a source expects
    ``target / source_size`` copies; pivotal rounding turns that into whole copies. All
    pairings keep a source's expected words, so what it takes differs from its target by
    less than the size of the one document that is left fractional at its root, which is
    among its shortest unless a document outweighs what all shorter ones can bear (``pivot``).

    * Null or empty texts have size 0 and are taken 0 times; a source without
      words has target 0.
    * Null sources form one group, which sorts last.
    * Rows equal in doc_id, source and text are one class, whose copies are dealt among
      them; other rows are rounded each on their own. Draws depend on the rows and
      ``seed`` only, so reruns agree.
    * An empty table gives an empty result. Clashing extra columns are ignored.
    """
    classes = mixed_classes(spark, docs, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), weights, max_copies, seed)
    rows = classes.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("copies", F.col("part") + (F.col("_place") < F.col("more")).cast("long"))
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), max_copies: int = 3, seed: int = 20) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with the columns of ``docs``.

    The mix is decided over ids, hashes and sizes, as in ``mix_sources``, whose cases it
    shares: rows without words go, an empty table stays empty, rows equal in all columns
    are one class. The texts then meet their copies in one join.
    """
    tag, key, times = (free_name(docs, n) for n in ("_tag", "_key", "_times"))
    classes = mixed_classes(spark, docs, row_hash(docs), weights, max_copies, seed)
    total = F.col("part") * F.col("n") + F.col("more")
    taken = materialize(spark, classes.select(F.col("tag").alias(tag), F.col("doc_id").alias(key), total.alias(times), "n").where(F.col(times) > 0), "mix-taken")
    marked = docs.withColumn(tag, row_hash(docs))

    def copies(rows: DataFrame, several: bool) -> DataFrame:
        wanted = (taken.where("n > 1") if several else taken.where("n = 1")).drop("n").withColumnRenamed(tag, f"{tag}t")
        met = rows.join(wanted, (F.col(tag) == F.col(f"{tag}t")) & F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
        if several:  # one of the equal rows stands for all of them
            met = met.dropDuplicates([tag, key])
        return met.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(times)).drop(times)

    out = copies(marked, False)
    return out if taken.where("n > 1").isEmpty() else out.unionByName(copies(marked, True))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(spark, docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
