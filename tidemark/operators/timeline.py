"""Joins in time: as-of, trailing ranges, samples at offsets.

All of them put both sides on one timeline and sort it once, per time bucket, so
that a long series is shared by many tasks and nothing is paired row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    values: dict[str, str],
    by: Sequence[str] = (),
    max_gap: int | None = None,
    shift: int = 0,
    tie: Sequence[str] = (),
    span: int = 86_400,
) -> DataFrame:
    """``left`` with the latest ``right`` values at or before ``left_ts - shift``.

    ``values`` maps right columns to their new names. Rows of ``right`` older than
    ``max_gap`` seconds give null, as does an empty ``right``. Of rows with equal
    times the one with the greatest ``tie`` columns counts. Times are long seconds.

    The timeline is cut into buckets of ``span`` seconds. Inside a bucket the last
    right row is carried on; a row before the first of its bucket takes the last one
    of the earlier buckets, which is found over one row per bucket.
    """
    keys = list(by)
    ours = [F.col(c) for c in left.columns]
    probe = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*ours).alias("_row"), (F.col(left_ts) - shift).cast("long").alias("_t"), F.lit(1).alias("_side"))
    picked = F.struct(F.col(right_ts).cast("long").alias("_ts"), *[F.col(c).alias(n) for c, n in values.items()])
    seen = right.where(F.col(right_ts).isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(right_ts).cast("long").alias("_t"),
        F.struct(*[F.col(c) for c in tie] or [F.lit(0).alias("none")]).alias("_tie"),
        picked.alias("_seen"),
        F.lit(0).alias("_side"),
    )
    ks = [f"_k{i}" for i in range(len(keys))]
    line = probe.unionByName(seen, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_t") / span))
    inside = Window.partitionBy(*ks, "_bucket").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_here", F.last("_seen", ignorenulls=True).over(inside))
    ends = line.groupBy(*ks, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_tie", "_seen"))).alias("_end"))
    before = Window.partitionBy(*ks).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"{k}e") for k in ks], F.col("_bucket").alias("_at"), F.last("_end", ignorenulls=True).over(before)["_seen"].alias("_before"))
    same = F.col("_bucket") == F.col("_at")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}e"))
    found = line.where("_side = 1").join(ends, same, "left").withColumn("_found", F.coalesce("_here", "_before"))
    fresh = F.lit(True) if max_gap is None else (F.col("_t") - F.col("_found._ts")) <= max_gap
    return found.select("_row.*", *[F.when(fresh, F.col(f"_found.{n}")).alias(n) for n in values.values()])


class Trailing:
    """Aggregates of bars in ``[cs - w, cs)`` for spine rows, several ``w`` from one sort.

    ``select`` gets the spine's columns with any aggregates built by ``over``.
    """

    def __init__(self, spine: DataFrame, bars: DataFrame, spine_ts: str, bar_ts: str, longest: int):
        self.columns = spine.columns
        bar = F.struct(*[F.col(c) for c in bars.columns])
        own = F.floor(F.col("_t") / longest)
        probes = spine.select(F.struct(*spine.columns).alias("_row"), F.col(spine_ts).cast("long").alias("_t")).withColumn("_bucket", own)
        # a frame reaches back one bucket at most, so each bar serves its own bucket and the next
        events = bars.where(F.col(bar_ts).isNotNull()).select(F.col(bar_ts).cast("long").alias("_t"), bar.alias("bar"))
        events = events.withColumn("_bucket", F.explode(F.array(own, own + 1)))
        self.line = probes.unionByName(events, allowMissingColumns=True)
        self.ts = F.when(F.col("bar").isNotNull(), F.col("_t"))
        self.made: dict[str, Column] = {}

    @staticmethod
    def frame(w: int):
        return Window.partitionBy("_bucket").orderBy("_t").rangeBetween(-w, -1)

    def first(self, value: Column, w: int) -> Column:
        return F.min_by(value, self.ts).over(self.frame(w))

    def last(self, value: Column, w: int) -> Column:
        return F.max_by(value, self.ts).over(self.frame(w))

    def over(self, aggregate: Column, w: int) -> Column:
        return aggregate.over(self.frame(w))

    def with_bars(self, **columns: Column) -> Trailing:
        """Columns computed on the timeline before the frames, such as lags."""
        self.line = self.line.withColumns(columns)
        return self

    def select(self, columns: dict[str, Column]) -> DataFrame:
        line = self.line.select("*", *[c.alias(f"_f_{n}") for n, c in columns.items()])
        return line.where("_row is not null").select("_row.*", *[F.col(f"_f_{n}").alias(n) for n in columns])


ENTRY_OFFSETS = (30, 45, 60, 75, 90, 120, 150, 180, 240, 270)
ENTRY_LOOKBACK = 5


def sample_entries(
    spine: DataFrame,
    prints: DataFrame,
    offsets: Sequence[int] = ENTRY_OFFSETS,
    lookback: int = ENTRY_LOOKBACK,
    sides: Sequence[tuple[str, str]] = (("up", "up_token"), ("dn", "down_token")),
    order: Sequence[str] = ("ord",),
    kind: str | None = "BUY",
) -> DataFrame:
    """Entry prices per side and offset: the latest print in ``[cs + X - lookback, cs + X]``.

    ``spine`` has cid, cs and the sides' token columns, ``prints`` cid, asset, ts,
    price, side. Adds ``p_intra_<X>_<side>`` and its staleness in seconds, null
    without a print. Of prints at one time the first in ``order`` counts.
    """
    tokens = F.explode(F.array(*[F.struct(F.lit(name).alias("leg"), F.col(col).alias("asset")) for name, col in sides])).alias("s")
    probes = spine.select("cid", "cs", tokens).select("cid", "cs", "s.*").withColumn("x", F.explode(F.array(*[F.lit(x) for x in offsets])))
    bought = prints if kind is None else prints.where(F.col("side") == kind)
    # a print can serve every target of its market within the lookback: met by window bucket
    width = lookback + 1
    target = F.col("cs") + F.col("x")
    probes = probes.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(target / width), F.floor((target - lookback) / width)))))
    bought = bought.select("cid", "asset", F.col("ts").cast("long").alias("ts"), "price", *order).withColumn("bucket", F.floor(F.col("ts") / width))
    met = probes.join(bought, ["cid", "asset", "bucket"]).where((F.col("ts") <= target) & (F.col("ts") >= target - lookback))
    rank = F.struct("ts", *[-F.col(o) for o in order])
    best = met.groupBy("cid", "cs", "leg", "x").agg(F.max_by("price", rank).alias("price"), F.max("ts").alias("ts"))
    best = best.withColumn("stale", (F.col("cs") + F.col("x") - F.col("ts")).cast("double"))
    wide = []
    for x in offsets:
        for name, _ in sides:
            here = (F.col("x") == x) & (F.col("leg") == name)
            wide.append(F.max(F.when(here, F.col("price"))).alias(f"p_intra_{x}_{name}"))
            wide.append(F.max(F.when(here, F.col("stale"))).alias(f"p_intra_{x}_{name}_staleness_s"))
    return spine.select("cid", "cs").join(best.groupBy("cid", "cs").agg(*wide), ["cid", "cs"], "left")


def dense_index(df: DataFrame, ts: str, span: int, name: str = "idx", tie: Sequence[str] = ()) -> DataFrame:
    """Row numbers 0.. by ``ts`` without a global sort: numbers inside time buckets, plus bucket offsets."""
    bucketed = df.withColumn("_b", F.floor(F.col(ts) / span))
    counts = bucketed.groupBy("_b").count()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_b").orderBy(ts, *tie)
    return bucketed.withColumn(name, F.row_number().over(inside) - 1).join(counts, "_b").withColumn(name, F.col(name) + F.col("_first")).drop("_b", "_first")


def in_buckets(df: DataFrame, ts: str, reach: int, rows: int = 20_000, span: int = 86_400 * 30) -> DataFrame:
    """``df`` in buckets of ``rows`` rows by ``ts``, for windows that reach back ``reach`` rows.

    Adds ``_idx``, the row's number, ``_bucket``, and ``_own``: each bucket also holds the
    last rows of the one before, which have ``_own`` false there and are to be dropped once
    the windows over ``_idx`` within ``_bucket`` are computed. ``ts`` is unique.
    """
    reach = reach + 1
    rows = max(rows, reach)
    indexed = dense_index(df, ts, span, "_idx")
    own = F.floor(F.col("_idx") / rows)
    late = F.col("_idx") % rows >= rows - reach
    dealt = indexed.withColumn("_bucket", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    return dealt.withColumn("_own", own == F.col("_bucket"))
