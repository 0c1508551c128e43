"""Features of the bars before an event: changes, flow, range, run length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.timeline import Trailing

# Trailing windows in seconds.
WINDOWS = (60, 300, 900, 1800, 3600)
# The features' names.
FEATURES = (
    *(f"bn_chg_pct_pre_{w}" for w in WINDOWS),
    *(f"bn_rv_{w}" for w in (300, 900, 1800)),
    *(f"bn_{n}_pre_{w}" for n in ("taker_buy_ratio", "cvd", "avg_trade_size") for w in (60, 300, 900)),
    "bn_vol_zscore_pre_60",
    *(f"bn_{n}_pre_{w}" for n in ("hl_range", "clv", "cvd_chgdn", "cvd_chgup") for w in (300, 900)),
    "bn_secs_since_low_900",
    "bn_secs_since_high_900",
    "bn_run_len",
)
BAR = ["ts", "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "n_trades"]


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def bar_features(spine: DataFrame, bars: DataFrame, unit: int = 1, spine_ts: str = "cs") -> DataFrame:
    """``spine`` with all 29 features of the bars in ``[cs - w, cs)``.

    ``unit`` stretches the windows, for bars longer than a minute: a window named 60
    then holds ``60 * unit`` seconds. Windows without bars give nulls.
    """
    t = Trailing(spine, bars.select(*BAR), spine_ts, "ts", max(WINDOWS) * unit)
    # each bar's return on the bar before; a frame leaves out the return into its first bar
    previous = F.lag("bar.close").over(Window.partitionBy("_bucket", F.col("bar").isNull()).orderBy("_t"))
    t = t.with_bars(_r=F.ln(F.try_divide(_positive(F.col("bar.close")), _positive(previous))))
    so_far = Window.partitionBy("_bucket").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    t = t.with_bars(_sign=F.signum(F.col("bar.close") - F.col("bar.open")), _no=F.when(F.col("bar").isNotNull(), F.count("bar").over(so_far)))
    bar = lambda name: F.col(f"bar.{name}")
    made: dict[str, Column] = {}
    for name in WINDOWS:
        w = name * unit
        first, last = t.first(bar("open"), w), t.last(bar("close"), w)
        change = F.try_divide(last - first, F.nullif(first, F.lit(0.0)))
        made[f"bn_chg_pct_pre_{name}"] = change
        if name in (300, 900, 1800):
            lead = F.coalesce(t.first(F.col("_r"), w), F.lit(0.0))
            known = F.count(F.col("_r"))
            n = t.over(known, w) - F.when(t.first(F.col("_r"), w).isNotNull(), 1).otherwise(0)
            total = t.over(F.sum(F.col("_r")), w) - lead
            square = t.over(F.sum(F.col("_r") * F.col("_r")), w) - lead * lead
            variance = F.greatest(F.try_divide(square - F.try_divide(total * total, n), n - 1), F.lit(0.0))
            made[f"bn_rv_{name}"] = F.when(n >= 2, F.sqrt(variance) * F.sqrt(n))
        if name in (60, 300, 900):
            volume, taker = t.over(F.sum(bar("volume")), w), t.over(F.sum(bar("taker_buy_volume")), w)
            made[f"bn_taker_buy_ratio_pre_{name}"] = F.try_divide(taker, _positive(volume))
            cvd = made[f"bn_cvd_pre_{name}"] = F.lit(2.0) * taker - volume
            made[f"bn_avg_trade_size_pre_{name}"] = F.try_divide(t.over(F.sum(bar("quote_volume")), w), _positive(t.over(F.sum(bar("n_trades")), w)))
        if name == 60:
            long = 3600 * unit
            spread = _positive(t.over(F.stddev_pop(bar("volume")), long))
            score = F.try_divide(t.over(F.avg(bar("volume")), w) - t.over(F.avg(bar("volume")), long), spread)
            made["bn_vol_zscore_pre_60"] = F.when(t.over(F.count(bar("ts")), long) >= 5, score)
        if name in (300, 900):
            high, low = t.over(F.max(bar("high")), w), t.over(F.min(bar("low")), w)
            made[f"bn_hl_range_pre_{name}"] = F.try_divide(high - low, F.nullif(first, F.lit(0.0)))
            made[f"bn_clv_pre_{name}"] = F.try_divide(last - low, _positive(high - low))
            made[f"bn_cvd_chgdn_pre_{name}"] = F.when(change < 0, cvd)
            made[f"bn_cvd_chgup_pre_{name}"] = F.when(change > 0, cvd)
        if name == 900:
            # of equal extremes the latest bar counts
            lowest, highest = (t.over(F.max(F.when(F.col("bar").isNotNull(), F.struct(x, t.ts.alias("at")))), w)["at"] for x in ((-bar("low")).alias("x"), bar("high").alias("x")))
            made["bn_secs_since_low_900"] = (F.col("_t") - lowest).cast("double")
            made["bn_secs_since_high_900"] = (F.col("_t") - highest).cast("double")
        if name == 3600:
            # bars after the last one of any other sign; the frame's bars all of one sign count whole
            made["_sign"] = t.last(F.col("_sign"), w)
            made["_bars"], made["_last"] = t.over(F.count(bar("ts")), w), t.over(F.max("_no"), w)
            for s, side in ((1, "_up"), (-1, "_dn")):
                made[side] = t.over(F.max(F.when(F.col("_sign") != s, F.col("_no"))), w)
    found = t.select(made)
    broken = F.when(F.col("_sign") > 0, F.col("_up")).when(F.col("_sign") < 0, F.col("_dn"))
    length = F.when(F.col("_sign") == 0, F.lit(0)).otherwise(F.coalesce(F.col("_last") - broken, F.col("_bars")))
    return found.withColumn("bn_run_len", F.col("_sign") * length).drop("_sign", "_bars", "_last", "_up", "_dn")
