"""Rolling scores over the last rows: z-score, percentile rank, lag."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import WindowSpec

from tidemark.operators.timeline import in_buckets


@dataclass(frozen=True)
class Rolling:
    suffix: str
    op: str
    window: int
    least: int


# A day and a week of five-minute rows, and the least values of each.
STANDARD = (Rolling("zs24h", "zs", 288, 50), Rolling("zs7d", "zs", 2016, 200), Rolling("rank24h", "rank", 288, 50), Rolling("lag1", "lag", 1, 1))


def zscore(value: Column, ordered: WindowSpec, window: int, least: int) -> Column:
    """Against the ``window`` rows before, without the row itself; sample deviation."""
    past = ordered.rowsBetween(-window, -1)
    spread = F.nullif(F.stddev_samp(value).over(past), F.lit(0.0))
    return F.when(F.count(value).over(past) >= least, F.try_divide(value - F.avg(value).over(past), spread))


def percentile_rank(value: Column, ordered: WindowSpec, window: int, least: int, past: int | None = None) -> Column:
    """Share of the last ``window`` values (the row's own included) below it, ties counting half.

    ``past`` sets the rows before the row instead; the realtime twin uses ``window``.
    """
    frame = F.collect_list(value).over(ordered.rowsBetween(-(window - 1 if past is None else past), 0))
    below, same = F.size(F.filter(frame, lambda v: v < value)), F.size(F.filter(frame, lambda v: v == value))
    return F.when(value.isNotNull() & (F.size(frame) >= least), (below + (same + F.lit(1)) / F.lit(2)) / F.size(frame))


def zscore_of(current: Column, past: Column, least: int) -> Column:
    """The z-score of one value against an array of past values, null entries ignored."""
    known = F.filter(past, lambda v: v.isNotNull())
    n = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
    square = F.aggregate(known, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    spread = F.nullif(F.sqrt(F.try_divide(square, n - F.lit(1))), F.lit(0.0))
    return F.when(current.isNotNull() & (n >= least), F.try_divide(current - mean, spread))


def rank_of(current: Column, past: Column, least: int) -> Column:
    """The percentile rank of one value among past values and itself."""
    known = F.filter(past, lambda v: v.isNotNull())
    n = F.size(known) + 1
    below, same = F.size(F.filter(known, lambda v: v < current)), F.size(F.filter(known, lambda v: v == current)) + 1
    return F.when(current.isNotNull() & (n >= least), (below + (same + F.lit(1)) / F.lit(2)) / n)


def parse_transform(name: str) -> tuple[str, Rolling] | None:
    """``base__zs24h`` to its base and spec; None for other names, lags included."""
    base, _, suffix = name.rpartition("__")
    spec = next((r for r in STANDARD if r.suffix == suffix and r.op != "lag"), None)
    return (base, spec) if base and spec else None


def transformable(df: DataFrame, columns: Sequence[str], least_rows: int = 1000, least_values: int = 50) -> DataFrame:
    """``column, n, n_distinct, ok`` for numeric columns: one pass over ``df``."""
    numeric = [c for c, t in df.dtypes if c in columns and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    if not numeric:
        return df.sparkSession.createDataFrame([], "column string, n long, n_distinct long, ok boolean")
    clean = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in numeric]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("v")) for c, v in zip(numeric, clean, strict=True)])).alias("x")).select("x.*")
    counts = long.groupBy("column").agg(F.count("v").alias("n"), F.count_distinct("v").alias("n_distinct"))
    return counts.withColumn("ok", (F.col("n") >= least_rows) & (F.col("n_distinct") >= least_values))


def select_transformable(df: DataFrame, columns: Sequence[str], **limits: int) -> list[str]:
    """The columns that are worth transforming: an action over ``df``, a row per column."""
    ok = {r["column"] for r in transformable(df, columns, **limits).where("ok").collect()}
    return [c for c in columns if c in ok]


def rolling_score(x: pd.Series, spec: Rolling) -> pd.Series:
    """One score of each value of a series in order."""
    if spec.op == "lag":
        return x.shift(spec.window)
    if spec.op == "rank":
        return x.rolling(spec.window, min_periods=spec.least).rank(pct=True)
    past = x.rolling(spec.window, min_periods=spec.least, closed="left")
    spread = past.std()
    return (x - past.mean()) / spread.where(spread > 0)


def rolling_features(df: DataFrame, ts: str, columns: Sequence[str], specs: Sequence[Rolling] = STANDARD, rows: int = 20_000, span: int = 86_400 * 30) -> DataFrame:
    """``df`` with ``<column>__<suffix>`` for all columns and specs, in one pass of Arrow batches.

    The rows, numbered by ``ts``, are cut into buckets of ``rows``; each bucket also
    gets the last rows of the one before as far as the longest window reaches, so all
    buckets can be computed apart. ``ts`` is unique.
    """
    dealt = in_buckets(df, ts, max(s.window for s in specs), rows, span)
    schema = StructType([*df.schema.fields, *[StructField(f"{c}__{s.suffix}", DoubleType()) for c in columns for s in specs]])
    names = df.columns
    kept = dealt.select(*[F.col(f"`{n}`") for n in names], "_bucket", "_idx", "_own")

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by("_idx")
        own = part["_own"].combine_chunks()
        new = [part[n].filter(own) for n in names]
        for c in columns:
            x = part[c].cast(pa.float64()).to_pandas()
            for s in specs:
                # missing values become nulls
                new.append(pa.array(rolling_score(x, s), pa.float64(), from_pandas=True).filter(own))
        return pa.table(new, names=schema.names)

    return kept.groupBy("_bucket").applyInArrow(work, schema)


def rolling_moments(value: Column, ordered: WindowSpec, window: int = 100) -> dict[str, Column]:
    """``mean``, ``sd`` (sample) and ``t`` = mean / sd * sqrt(n) over the last ``window`` rows, the row's own included."""
    frame = ordered.rowsBetween(-(window - 1), 0)
    mean, sd, n = F.avg(value).over(frame), F.stddev_samp(value).over(frame), F.count(value).over(frame)
    return {"mean": mean, "sd": sd, "t": F.when(n > 1, F.try_divide(mean * F.sqrt(n), F.nullif(sd, F.lit(0.0))))}
