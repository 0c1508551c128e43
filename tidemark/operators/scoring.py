"""Scores of a ledger of hits per factor, and how factors overlap."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.pricing import DRIFT, backtest_friction
from tidemark.sources.folders import stored

# The gates of selection and of graduation.
GATES = {
    "nev_min": 0.10,
    "hits_share": 0.02,
    "hits_min": 50,
    "net_base_min": 0.08,
    "week_hits": 10,
    "weeks_min": 4,
    "sign_share": 0.65,
    "price_low": 0.35,
    "price_high": 0.65,
    "jaccard_max": 0.75,
    "live_nev": 0.05,
    "live_t": 1.65,
    "cap_hits": 800,
    "cap_weeks": 10,
}
WILSON_Z = 1.0
CHEAP = 5


def pay(win: Column, price: Column, drift: float = DRIFT) -> Column:
    return win / (price + F.lit(drift)) - F.lit(1.0)


def nev(win: Column, price: Column, drift: float = DRIFT) -> Column:
    """Aggregate: mean payoff less the fee on the mean price."""
    return F.avg(pay(win, price, drift)) - backtest_friction(F.avg(price))


def base1(rate: Column, price: Column) -> Column:
    return F.try_divide(rate, price) - F.lit(1.0)


def net_base(rate: Column, price: Column) -> Column:
    return base1(rate, price) - backtest_friction(price)


def wilson_lower(rate: Column, n: Column, z: float = WILSON_Z) -> Column:
    """Lower Wilson bound of a share; fewer than one case count as one."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    z2 = z * z
    margin = F.lit(z) * F.sqrt(rate * (F.lit(1.0) - rate) / n + F.lit(z2) / (F.lit(4.0) * n * n))
    return (rate + F.lit(z2) / (F.lit(2.0) * n) - margin) / (F.lit(1.0) + F.lit(z2) / n)


def net_base_wilson(rate: Column, n: Column, price: Column) -> Column:
    return net_base(wilson_lower(rate, n), price)


def eff_n(win: Column, price: Column, drift: float = DRIFT) -> Column:
    """Aggregate: the number of winners that carry the payoff; null without winners."""
    p = F.when(win > 0.5, F.lit(1.0) / (price + F.lit(drift)) - F.lit(1.0))
    total = F.sum(p)
    return total * total / F.greatest(F.sum(p * p), F.lit(1e-12))


def valid_fraction(hits: Column, raw: Column) -> Column:
    return F.try_divide(hits.cast("double"), raw.cast("double"))


def scorecard(ledger: DataFrame, by: Sequence[str], win: str = "win", price: str = "price") -> DataFrame:
    """Per factor: hits, win share, mean price and all one-pass metrics."""
    w, p = F.col(win).cast("double"), F.col(price)
    known = ledger.where(F.col(win).isNotNull() & F.col(price).isNotNull())
    sums = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(w).alias("wr"), F.avg(p).alias("ep"), nev(w, p).alias("nev"), eff_n(w, p).alias("eff_n"))
    return sums.select(
        "*",
        base1(F.col("wr"), F.col("ep")).alias("base1"),
        net_base(F.col("wr"), F.col("ep")).alias("net_base"),
        wilson_lower(F.col("wr"), F.col("n")).alias("wilson_lower"),
        net_base_wilson(F.col("wr"), F.col("n"), F.col("ep")).alias("net_base_wilson"),
    )


def drop_cheapest_nev(ledger: DataFrame, by: Sequence[str], ties: Sequence[str], win: str = "win", price: str = "price", k: int = CHEAP) -> DataFrame:
    """``nev`` without the ``k`` cheapest winners; null with ``k`` winners or fewer.

    The sums over all rows come from one aggregate; the cheapest winners, of which each
    task keeps ``k`` per factor, are then taken out of them.
    """
    w, p = F.col(win).cast("double"), F.col(price)
    known = ledger.where(F.col(win).isNotNull() & F.col(price).isNotNull())
    sums = known.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(w > 0.5).alias("_won"), F.sum(pay(w, p)).alias("_pay"), F.sum(p).alias("_price"))
    cheapest = Window.partitionBy(*by).orderBy(price, *ties)
    out = known.where(w > 0.5).withColumn("_rank", F.row_number().over(cheapest)).where(F.col("_rank") <= k)
    out = out.groupBy(*by).agg(F.sum(pay(w, p)).alias("_pay_out"), F.sum(p).alias("_price_out"))
    left = F.col("_n") - k
    score = (F.col("_pay") - F.col("_pay_out")) / left - backtest_friction((F.col("_price") - F.col("_price_out")) / left)
    return sums.join(out, list(by), "left").select(*by, F.when(F.col("_won") > k, score).alias(f"drop{k}_nev"))


def walk_forward(ledger: DataFrame, by: Sequence[str], week: str = "week", win: str = "win", price: str = "price", least: int = GATES["week_hits"]) -> DataFrame:
    """Share of weeks with ``least`` hits or more whose ``nev`` is above 0, and their number."""
    known = ledger.where(F.col(win).isNotNull() & F.col(price).isNotNull())
    weeks = known.groupBy(*by, week).agg(F.count("*").alias("n"), nev(F.col(win).cast("double"), F.col(price)).alias("nev"))
    counted = F.col("n") >= least
    return weeks.groupBy(*by).agg(
        F.try_divide(F.count_if(counted & (F.col("nev") > 0)).cast("double"), F.count_if(counted).cast("double")).alias("wf_sign_frac"),
        F.count_if(counted).alias("n_weeks"),
    )


def stream_corr(streams: DataFrame, a: str, b: str, by: Sequence[str] = (), drop: int = 0, ties: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of two columns over all rows; 0 if either is constant.

    ``drop`` leaves out the rows with the greatest absolute share in the covariance.
    """
    rows = streams.select(*by, *ties, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a is not null and _b is not null")
    if drop:
        group = list(by)
        means = rows.groupBy(*group).agg(F.struct(F.avg("_a").alias("a"), F.avg("_b").alias("b")).alias("_mean"))
        rows = rows.join(means, group) if by else rows.withColumn("_mean", means.scalar())
        share = F.abs((F.col("_a") - F.col("_mean.a")) * (F.col("_b") - F.col("_mean.b"))).alias("_share")
        rows = rows.select(*group, *ties, "_a", "_b", share)
        order = [F.desc("_share"), *ties]
        if by:
            most = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= drop)
        else:
            most = rows.orderBy(*order).limit(drop)
        # the last of the dropped rows, in order, parts them from the rest
        here = F.struct((-F.col("_share")).alias("s"), *ties)
        last = most.groupBy(*group).agg(F.max(here).alias("_last"))
        rows = rows.join(last, group) if by else rows.withColumn("_last", last.scalar())
        rows = rows.where(here > F.col("_last"))
    spread = F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_pop("_a", "_b"), spread), F.lit(0.0)).alias("corr"))


def lenses(cards: DataFrame, total: Column | int) -> DataFrame:
    """Each gate of selection as a boolean, and how many of them hold."""
    g = GATES
    checks = {
        "ok_nev": F.col("nev") > g["nev_min"],
        "ok_hits": F.col("n") >= F.greatest(F.lit(float(g["hits_min"])), F.lit(g["hits_share"]) * total),
        "ok_base": F.col("net_base") > g["net_base_min"],
        "ok_weeks": (F.col("n_weeks") >= g["weeks_min"]) & (F.col("wf_sign_frac") >= g["sign_share"]),
        "ok_price": F.col("ep").between(g["price_low"], g["price_high"]),
    }
    found = cards.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    return found.withColumn("n_ok", sum((F.col(n).cast("int") for n in checks), F.lit(0)))


def graduation(board: DataFrame, weeks: str = "n_weeks") -> DataFrame:
    """``verdict``: graduate, kill at the cap without having passed, or wait."""
    g = GATES
    passed = (F.col("pap_nev") >= g["live_nev"]) & (F.col("pap_t") > g["live_t"])
    capped = (F.col("n_pap") >= g["cap_hits"]) | (F.col(weeks) >= g["cap_weeks"])
    return board.withColumn("verdict", F.when(F.coalesce(passed, F.lit(False)), "graduate").when(F.coalesce(capped, F.lit(False)), "kill").otherwise("wait"))


#: Overlaps among factors that are not decided yet, of which one task decides the rest.
FEW_OVERLAPS = 100_000


def leaders(cards: DataFrame, pairs: DataFrame, most: float = GATES["jaccard_max"], factor: str = "factor", few: int = FEW_OVERLAPS) -> DataFrame:
    """``factor, leader`` by greedy choice: the best net base first, and each factor of the
    same direction that overlaps a chosen one by more than ``most`` folds into the best of them.

    The choice is sequential, but only along overlaps, so it goes in rounds over all
    factors at once: a factor leads once all better factors that it overlaps have
    folded, and folds once one of them leads. A round decides at least the best factor
    of each group that is left; its state is written before the next one reads it. Once
    ``few`` overlaps are left, one task goes through them by rank.
    """
    spark = cards.sparkSession
    rank = F.struct(F.coalesce(F.nanvl(-F.col("net_base_wilson"), F.lit(float("inf"))), F.lit(float("inf"))).alias("at"), F.col(factor).cast("string").alias("name"))
    card = cards.select(F.col(factor).alias("f"), "direction", rank.alias("rank"))
    close = pairs.where(F.col("jaccard") > most).select("a", "b")
    close = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    close = close.join(card.select(F.col("f").alias("a"), F.col("direction").alias("d"), F.col("rank").alias("r")), "a")
    close = close.join(card.select(F.col("f").alias("b"), F.col("direction").alias("better_d"), F.col("rank").alias("better_r")), "b")
    # for each factor the better ones that it could fold into
    close = close.where("d = better_d and better_r < r").select(F.col("a").alias("f"), "r", F.col("b").alias("better"), "better_r")
    close = stored(spark, close, "close")
    alone = card.select("f").join(close.select("f").distinct(), "f", "left_anti").select("f", F.col("f").alias("leader"))
    waiting = close.select("f").distinct().select("f", F.lit(None).cast(card.schema["f"].dataType).alias("leader"))
    state = stored(spark, alone.unionByName(waiting), "leaders")
    while left := close.count():
        known = state.select(F.col("f").alias("better"), F.col("leader").alias("of"))
        met = close.join(known, "better")
        if left <= few:
            kind = card.schema["f"].dataType.simpleString()
            flat = met.select("f", "r.at", "r.name", "better", F.col("better_r.at").alias("better_at"), F.col("better_r.name").alias("better_name"), "of")
            decided = flat.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_decide, f"f {kind}, turn {kind}")
        else:
            seen = met.groupBy("f").agg(
                F.min(F.when(F.col("of") == F.col("better"), F.struct("better_r", "better"))).alias("chosen"),
                F.min(F.when(F.col("of").isNull(), F.col("better_r"))).alias("unknown"),
            )
            settled = F.col("unknown").isNull() | (F.col("chosen.better_r") < F.col("unknown"))
            turn = F.when(settled & F.col("chosen").isNotNull(), F.col("chosen.better")).when(F.col("unknown").isNull(), F.col("f"))
            decided = seen.select("f", turn.alias("turn"))
        state = stored(spark, state.join(decided, "f", "left").select("f", F.coalesce("leader", "turn").alias("leader")), "leaders")
        close = stored(spark, close.join(state.where("leader is null").select("f"), "f", "left_semi"), "close")
    return state.select(F.col("f").alias(factor), "leader")


def _decide(part: pa.Table) -> pa.Table:
    """The turn of each factor, by rank, from the overlaps that are left and the leaders known so far."""
    over: dict[tuple, list[tuple]] = {}
    leads = set()
    for row in part.to_pylist():
        over.setdefault((row["at"], row["name"], row["f"]), []).append((row["better_at"], row["better_name"], row["better"]))
        if row["of"] == row["better"]:
            leads.add(row["better"])
    turns = []
    for *_, f in sorted(over):
        better = min((b for b in over[(*_, f)] if b[2] in leads), default=None)
        turns.append((f, f if better is None else better[2]))
        if better is None:
            leads.add(f)
    kind = part.schema.field("f").type
    return pa.table({"f": pa.array([t[0] for t in turns], kind), "turn": pa.array([t[1] for t in turns], kind)})
