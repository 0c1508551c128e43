"""The feature build: sources to sub-tables to the wide feature table."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import millis_to_seconds
from tidemark.operators.bars import WINDOWS, bar_features
from tidemark.operators.rolling import rolling_features, select_transformable
from tidemark.operators.timeline import ENTRY_LOOKBACK, ENTRY_OFFSETS, asof, sample_entries
from tidemark.operators.upsert import exists, insert_replace, known_keys, swap_write, write_incremental
from tidemark.sources.tables import complete_columns, read_optional, read_table, schema

# Twice each gauge's own cadence; an older value is a gap.
GAP_FUNDING, GAP_INTEREST, GAP_RATIO = 57_600, 600, 7_200
ENTRY_COLUMNS = [f"p_intra_{x}_{s}{end}" for x in ENTRY_OFFSETS for s in ("up", "dn") for end in ("", "_staleness_s")]


def gauge_features(spine: DataFrame, funding: DataFrame, interest: DataFrame, ratios: dict[str, DataFrame], gaps: Sequence[int] = (GAP_FUNDING, GAP_INTEREST, GAP_RATIO), unit: int = 1) -> DataFrame:
    """Funding now and its day's change, interest changes over 1 h and 4 h, three ratios.

    Each gauge has ``ts`` (seconds) and ``value``. ``unit`` stretches the shifts.
    """
    gauges = {"funding": funding, "interest": interest, **{f"ratio {n}": g for n, g in ratios.items()}}
    right = None
    for name, gauge in gauges.items():
        part = gauge.select(F.lit(name).alias("gauge"), F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"))
        right = part if right is None else right.unionByName(part)
    asked = [("fund_8h_now", "funding", 0, gaps[0]), ("_fund_ago", "funding", 86_400, gaps[0])]
    asked += [(n, "interest", shift, gaps[1]) for n, shift in (("_oi", 0), ("_oi_1h", 3_600), ("_oi_4h", 14_400))]
    asked += [(n, f"ratio {n}", 0, gaps[2]) for n in ratios]
    # all probes of all gauges share one timeline, and so one sort
    probe = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).alias("gauge"), F.lit(s * unit).alias("shift"), F.lit(gap).alias("gap")) for n, g, s, gap in asked]))
    probes = spine.select("cid", "cs", probe.alias("p")).select("cid", "cs", "p.*").withColumn("at", F.col("cs") - F.col("shift"))
    found = asof(probes, right, "at", "ts", {"value": "value", "ts": "seen"}, by=["gauge"])
    fresh = F.when(F.col("at") - F.col("seen") <= F.col("gap"), F.col("value"))
    wide = found.groupBy("cid", "cs").agg(*[F.max(F.when(F.col("name") == n, fresh)).alias(n) for n, *_ in asked])
    out = spine.select("cid", "cs").join(wide, ["cid", "cs"], "left")

    def change(now: str, ago: str) -> Column:
        return F.try_divide(F.col(now) - F.col(ago), F.nullif(F.col(ago), F.lit(0.0)))

    out = out.withColumn("fund_chg_24h", F.col("fund_8h_now") - F.col("_fund_ago"))
    out = out.withColumn("oi_chg_pct_1h", change("_oi", "_oi_1h")).withColumn("oi_chg_pct_4h", change("_oi", "_oi_4h"))
    return out.select("cid", "cs", "fund_8h_now", "fund_chg_24h", "oi_chg_pct_1h", "oi_chg_pct_4h", *ratios)


def merge(spine: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Labelled rows of the spine with all parts' columns, by cs; rows without features stay."""
    out = spine.where(F.col("up_won").isNotNull())
    for part in parts:
        new = [c for c in part.columns if c not in out.columns]
        out = out.join(part.select("cid", "cs", *new), ["cid", "cs"], "left")
    return out.orderBy("cs")


#: Trades are read from so long before a candle's start until so long after, the end excluded.
PANEL_BEFORE, PANEL_AFTER = 300, 330


def entry_panel(
    spine: DataFrame, trades: DataFrame, old: DataFrame | None = None, offsets: Sequence[int] = ENTRY_OFFSETS, lookback: int = ENTRY_LOOKBACK,
    before: int = PANEL_BEFORE, after: int = PANEL_AFTER, fetched_at: int = 0, order: Sequence[str] = ("tx_hash", "price"),
) -> DataFrame:
    """The entry-price panel ``old`` with the markets of ``spine`` put in or replaced, one row per cid.

    ``spine`` has cid, cs and the two tokens; ``trades`` the stored columns. Only trades of
    the market's own window ``[cs - before, cs + after)`` count. Of trades at one time the
    first in ``order`` counts, as numbers; strings go by their hash. A market without any
    trade has a row of nulls, so it is not asked for again.
    """
    here = trades.join(spine.select("cid", "cs"), "cid").where((F.col("ts") >= F.col("cs") - before) & (F.col("ts") < F.col("cs") + after))
    ranks = [F.xxhash64(c).alias(c) if dict(trades.dtypes)[c] == "string" else F.col(c) for c in order if c != "price"]
    here = here.select("cid", "asset", "ts", "price", "side", *ranks)
    new = sample_entries(spine, here, offsets, lookback, order=order).withColumn("fetched_at", F.lit(fetched_at).cast("long"))
    return new if old is None else insert_replace(old, new, ["cid"], ["cs"])


class Build:
    """Builders over a folder of stored tables, run in their fixed order."""

    ORDER = ("bars", "panel", "entries", "gauges", "transforms", "merge")
    INCREMENTAL = ("bars", "panel", "entries")

    def __init__(self, spark: SparkSession, raw: str, out: str):
        self.spark, self.raw, self.out = spark, raw, out
        self.builders: dict[str, Callable[[bool], None]] = {n: getattr(self, f"build_{n}") for n in self.ORDER}

    def spine(self) -> DataFrame:
        events = read_table(self.spark, f"{self.raw}/events.parquet", ["cid", "candle_start", "era", "up_won", "up_token", "down_token"])
        return events.withColumnRenamed("candle_start", "cs")

    def part(self, name: str) -> str:
        return f"{self.out}/features_{name}.parquet"

    def build_bars(self, incremental: bool) -> None:
        bars = read_table(self.spark, f"{self.raw}/bars.parquet").withColumn("ts", millis_to_seconds(F.col("open_ts_ms")))
        spine = self.spine().select("cid", "cs")
        if incremental:
            spine = spine.join(known_keys(self.spark, self.part("bars")), "cs", "left_anti")
            first = spine.agg(F.min("cs")).first()[0]
            # the new candles see no bars before their longest window; stored times are in milliseconds
            bars = bars.where(F.col("open_ts_ms") >= (first - max(WINDOWS)) * 1000 if first is not None else F.lit(False))
        write_incremental(self.spark, bar_features(spine, bars), self.part("bars"), incremental=incremental)

    def build_panel(self, incremental: bool) -> None:
        """Entry prices of landed trades; without any, the stored panel stays as it is."""
        if not exists(self.spark, f"{self.raw}/trades.parquet"):
            return
        path = f"{self.raw}/ep_panel.parquet"
        spine, old = self.spine().select("cid", "cs", "up_token", "down_token"), None
        if exists(self.spark, path):
            old = self.spark.read.parquet(path)
            if incremental:
                spine = spine.join(old.select("cid"), "cid", "left_anti")
        trades = read_table(self.spark, f"{self.raw}/trades.parquet").dropDuplicates()
        swap_write(self.spark, entry_panel(spine, trades, old), path)

    def build_entries(self, incremental: bool) -> None:
        panel = read_optional(self.spark, f"{self.raw}/ep_panel.parquet", "cid string")
        panel = complete_columns(panel, ["cid", *ENTRY_COLUMNS])
        swap_write(self.spark, self.spine().select("cid", "cs").join(panel, "cid", "left"), self.part("entries"))

    def gauge(self, table: str, ts: str, value: str) -> DataFrame:
        df = read_optional(self.spark, f"{self.raw}/{table}.parquet", schema(table))
        return df.select(millis_to_seconds(F.col(ts)).alias("ts"), F.col(value).alias("value"))

    def build_gauges(self, incremental: bool) -> None:
        ratios = {
            "ls_top_acct_ratio": self.gauge("top_account_ratio", "ts_ms", "long_short_ratio"),
            "ls_top_pos_ratio": self.gauge("top_position_ratio", "ts_ms", "long_short_ratio"),
            "ls_global_acct_ratio": self.gauge("global_account_ratio", "ts_ms", "long_short_ratio"),
        }
        found = gauge_features(self.spine(), self.gauge("funding", "funding_ts_ms", "funding_rate"), self.gauge("open_interest_5m", "ts_ms", "sum_open_interest"), ratios)
        swap_write(self.spark, found, self.part("gauges"))

    def stored(self, names: Sequence[str]) -> list[DataFrame]:
        return [self.spark.read.parquet(self.part(n)) for n in names if exists(self.spark, self.part(n))]

    def build_transforms(self, incremental: bool) -> None:
        base = self.spine().select("cid", "cs")
        for part in self.stored(("bars", "entries", "gauges")):
            base = base.join(part.select("cid", "cs", *[c for c in part.columns if c not in base.columns]), ["cid", "cs"], "left")
        columns = select_transformable(base, [c for c in base.columns if c not in ("cid", "cs")])
        found = rolling_features(base.select("cid", "cs", *columns), "cs", columns).drop(*columns)
        swap_write(self.spark, found, self.part("transforms"))

    def build_merge(self, incremental: bool) -> None:
        spine = self.spine().select("cid", "cs", "era", "up_won")
        swap_write(self.spark, merge(spine, self.stored(("bars", "entries", "gauges", "transforms"))), f"{self.out}/features.parquet")

    def run(self, sources: Sequence[str] = (), incremental: bool = False) -> list[str]:
        unknown = set(sources) - set(self.ORDER)
        if unknown:
            raise ValueError(f"no such builders: {sorted(unknown)}")
        chosen = [n for n in self.ORDER if not sources or n in sources]
        for name in chosen:
            self.builders[name](incremental and name in self.INCREMENTAL)
        return chosen


def main(argv: Sequence[str] | None = None) -> None:
    from tidemark.session import session

    args = argparse.ArgumentParser(description="Build feature tables.")
    args.add_argument("--raw", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--source", action="append", default=[], choices=Build.ORDER)
    args.add_argument("--incremental", action="store_true")
    found = args.parse_args(argv)
    Build(session("tidemark-features"), found.raw, found.out).run(found.source, found.incremental)


if __name__ == "__main__":
    main()
