"""Engine operators against plain Python, and their edge cases."""

import json
import math
import random
import threading
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import factors, parsing, pricing
from tidemark.operators import candidates, ledger, rolling, scoring, upsert
from tidemark.operators.bars import bar_features
from tidemark.operators.timeline import ENTRY_OFFSETS, asof, dense_index, sample_entries
from tidemark.plans.features import Build
from tidemark.sources import pages, tables
from tidemark.sources.cache import coalesce
from tidemark.streaming import live
from tidemark.sources.folders import work_dir
from tidemark.streaming.run import drain, read_files

# --- factor expressions

KNOWN = ["p", "q", "p__zs24h", "bn_x"]


@pytest.mark.parametrize("text", ["p<0.5", " p  >= -1.5e-3  &  q ==1", "p != q", "p__zs24h>1 & q<2 & p<9", "p__zs7d < q__rank2h", "p__lag3__abs>0", "q__sign==1"])
def test_factors_accepted(text):
    f = factors.parse(text, KNOWN)
    assert factors.parse(f.text, KNOWN) == f and factors.canonicalize(f.text) == f.text


@pytest.mark.parametrize("text", ["", "  ", "nope<1", "p", "p<", "p<.5", "p<+1", "p|q<1", "p<1 & q<1 & p<2 & q<2", "p__zs5h<1", "p__zs<1", "p__abs3<1", "p__lag<1", "p__lag3h<1", "p__boom<1", "1<p"])
def test_factors_rejected(text):
    with pytest.raises(factors.FactorError):
        factors.parse(text, KNOWN)


def test_factor_masks(spark):
    rows = [(0, 0.4, 0.0), (1, 0.5, 1.0), (2, 0.3, 1.0), (3, 0.6, 0.0), (4, None, 1.0), (5, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "cs long, p double, q double")

    def mask(text):
        return [r["hit"] for r in df.orderBy("cs").select(factors.compile_factor(factors.parse(text, df.columns)).alias("hit")).collect()]

    assert mask("p<.5".replace(".5", "0.445") + " & q==1") == [False, False, True, False, False, False]
    assert mask("p<q") == [False, True, True, False, False, False]
    for c in ("<", "<=", ">", ">=", "=="):
        assert mask(f"p{c}0.5")[4:] == [False, False]
    assert mask("p!=0.5") == [True, False, True, True, True, True]
    assert factors.parse("p<q & bn_x>1", KNOWN).columns == {"p", "q", "bn_x"}


def test_realtime_plan():
    assert factors.realtime_plan(factors.parse("bn_x>1", KNOWN)) == {"bn_x"}
    assert factors.needs_source(factors.parse("bn_x>1", KNOWN), ["bn_", "basis_"])
    for text in ("p<1", "bn_x__lag1>0"):
        with pytest.raises(NotImplementedError):
            factors.realtime_plan(factors.parse(text, KNOWN))


# --- timelines


@pytest.mark.parametrize("span", [7, 86_400])
def test_asof_against_search(spark, span):
    rng = random.Random(1)
    right = [(rng.randrange(60), i, float(i), rng.choice("ab")) for i in range(40)]
    left = [(t, k) for t in range(-3, 70) for k in "abc"]
    r = spark.createDataFrame(right, "ts long, ord long, v double, k string")
    probes = spark.createDataFrame(left, "t long, k string")
    for gap, shift in ((None, 0), (5, 0), (5, 11)):
        found = {(x["t"], x["k"]): x["v2"] for x in asof(probes, r, "t", "ts", {"v": "v2"}, by=["k"], max_gap=gap, shift=shift, tie=["ord"], span=span).collect()}
        for t, k in left:
            seen = [(ts, o, v) for ts, o, v, kk in right if kk == k and ts <= t - shift]
            best = max(seen, default=None)
            assert found[t, k] == (best[2] if best and (gap is None or t - shift - best[0] <= gap) else None)


def test_asof_empty_right(spark):
    left = spark.createDataFrame([(1,)], "t long")
    assert asof(left, spark.createDataFrame([], "ts long, v double"), "t", "ts", {"v": "v"}).collect()[0]["v"] is None


def _bar_row(bars, cs):
    out = {}
    for w in (60, 300, 900, 1800, 3600):
        seg = [b for b in bars if cs - w <= b[0] < cs]
        if not seg:
            continue
        first, last = seg[0][1], seg[-1][4]
        change = (last - first) / first if first else None
        out[f"bn_chg_pct_pre_{w}"] = change
        volume, taker, quote, n = (sum(b[i] for b in seg) for i in (5, 7, 6, 8))
        if w in (60, 300, 900):
            out[f"bn_taker_buy_ratio_pre_{w}"] = taker / volume if volume > 0 else None
            out[f"bn_cvd_pre_{w}"] = 2 * taker - volume
            out[f"bn_avg_trade_size_pre_{w}"] = quote / n if n > 0 else None
        if w in (300, 900, 1800):
            r = [math.log(b[4] / a[4]) for a, b in zip(seg, seg[1:], strict=False)]
            out[f"bn_rv_{w}"] = float(np.std(r, ddof=1)) * math.sqrt(len(r)) if len(r) >= 2 else None
        if w == 60:
            long = [b[5] for b in bars if cs - 3600 <= b[0] < cs]
            sd = float(np.std(long))
            out["bn_vol_zscore_pre_60"] = (np.mean([b[5] for b in seg]) - np.mean(long)) / sd if len(long) >= 5 and sd > 0 else None
        if w in (300, 900):
            hi, lo = max(b[2] for b in seg), min(b[3] for b in seg)
            out[f"bn_hl_range_pre_{w}"] = (hi - lo) / first if first else None
            out[f"bn_clv_pre_{w}"] = (last - lo) / (hi - lo) if hi > lo else None
            cvd = out[f"bn_cvd_pre_{w}"]
            out[f"bn_cvd_chgdn_pre_{w}"] = cvd if change is not None and change < 0 else None
            out[f"bn_cvd_chgup_pre_{w}"] = cvd if change is not None and change > 0 else None
        if w == 900:
            out["bn_secs_since_low_900"] = cs - max(b[0] for b in seg if b[3] == lo)
            out["bn_secs_since_high_900"] = cs - max(b[0] for b in seg if b[2] == hi)
        if w == 3600:
            signs = [(b[4] > b[1]) - (b[4] < b[1]) for b in seg]
            run = 0
            for s in reversed(signs):
                if s != signs[-1]:
                    break
                run += 1
            out["bn_run_len"] = signs[-1] * run
    return out


def test_bar_features_against_plain_python(spark):
    rng = random.Random(2)
    bars, price = [], 100.0
    for t in range(0, 5 * 3600, 60):
        if rng.random() < 0.1 or 6000 < t < 9000:
            continue
        step = rng.choice([-1, -0.5, 0, 0.5, 1])
        volume = rng.choice([0.0, 1.5, 4.0])
        bars.append((t, price, price + rng.choice([1, 2]), price - rng.choice([1, 2]), price + step, volume, volume * price, volume / 4, rng.choice([0, 3])))
        price += step
    schema = "ts long, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_volume double, n_trades long"
    spine = [(f"c{cs}", cs) for cs in range(0, 6 * 3600, 300)]
    found = bar_features(spark.createDataFrame(spine, "cid string, cs long"), spark.createDataFrame(bars, schema))
    assert len(found.columns) == 2 + 29
    rows = found.collect()
    assert len(rows) == len(spine)
    for r in rows:
        wanted = _bar_row(bars, r["cs"])
        for name in found.columns[2:]:
            if wanted.get(name) is None:
                assert r[name] is None, (r["cs"], name)
            else:
                assert r[name] == pytest.approx(wanted[name], rel=1e-9, abs=1e-9), (r["cs"], name)


def test_entry_samples(spark):
    spine = spark.createDataFrame([("c", 1000, "U", "D"), ("none", 1000, "U", "D")], "cid string, cs long, up_token string, down_token string")
    prints = [("c", "U", 1025, 0.1, "BUY", 1), ("c", "U", 1024, 0.2, "BUY", 2), ("c", "U", 1030, 0.3, "SELL", 3), ("c", "D", 1045, 0.4, "BUY", 4), ("c", "D", 1045, 0.5, "BUY", 5), ("c", "X", 1030, 0.9, "BUY", 6)]
    found = sample_entries(spine, spark.createDataFrame(prints, "cid string, asset string, ts long, price double, side string, ord long"))
    assert len(found.columns) == 2 + 4 * len(ENTRY_OFFSETS)
    rows = {r["cid"]: r for r in found.collect()}
    assert (rows["c"]["p_intra_30_up"], rows["c"]["p_intra_30_up_staleness_s"]) == (0.1, 5.0)
    assert (rows["c"]["p_intra_45_dn"], rows["c"]["p_intra_45_dn_staleness_s"]) == (0.4, 0.0)
    assert rows["c"]["p_intra_60_dn"] is None and rows["none"]["p_intra_30_up"] is None


# --- rolling


def test_rolling_against_pandas_and_native(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(rng.normal(size=900)).round(1)
    x[200:290] = 1.0
    x[rng.random(900) < 0.1] = np.nan
    df = spark.createDataFrame([(i * 300, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "cs long, x double")
    specs = [rolling.Rolling("zs", "zs", 48, 10), rolling.Rolling("rank", "rank", 48, 10), rolling.Rolling("lag1", "lag", 1, 1)]
    one = rolling.rolling_features(df, "cs", ["x"], specs, rows=100, span=10_000).orderBy("cs").toPandas()
    whole = rolling.rolling_features(df, "cs", ["x"], specs).orderBy("cs").toPandas()
    w = Window.orderBy("cs")
    native = df.select("cs", rolling.zscore(F.col("x"), w, 48, 10).alias("z"), rolling.percentile_rank(F.col("x"), w, 48, 10).alias("r")).orderBy("cs").toPandas()
    past = x.rolling(48, min_periods=10, closed="left")
    z = (x - past.mean()) / past.std().where(past.std() > 1e-9)
    for got in (one["x__zs"], whole["x__zs"], native["z"]):
        keep = z.notna() & (x.shift(1).rolling(48).std() != 0)
        assert np.allclose(got[keep].astype(float), z[keep], atol=1e-6)
    rank = x.rolling(48, min_periods=10).rank(pct=True)
    for got in (one["x__rank"], native["r"]):
        assert (got.isna() == rank.isna()).all() and np.allclose(got.astype(float), rank, equal_nan=True)
    assert one["x__lag1"].astype(float).equals(x.shift(1))


def test_scalar_twins(spark):
    row = spark.createDataFrame([(2.0, [1.0, None, 2.0, 3.0])], "x double, past array<double>")
    z, r, short = row.select(rolling.zscore_of(F.col("x"), F.col("past"), 3), rolling.rank_of(F.col("x"), F.col("past"), 3), rolling.zscore_of(F.col("x"), F.col("past"), 4)).first()
    assert z == 0.0 and r == pytest.approx((1 + 1.5) / 4) and short is None
    assert rolling.parse_transform("a__b__zs24h")[0] == "a__b" and rolling.parse_transform("a__lag1") is None


def test_dense_index(spark):
    times = random.Random(4).sample(range(100_000), 500)
    df = spark.createDataFrame([(t,) for t in times], "ts long")
    found = {r["ts"]: r["idx"] for r in dense_index(df, "ts", 977).collect()}
    assert [found[t] for t in sorted(times)] == list(range(500))


# --- money and scores


def test_pricing(spark):
    one = spark.range(1)
    got = one.select(
        pricing.fee_ratio(F.lit(0.4)).alias("fee"), pricing.gross_ratio(F.lit(True), F.lit(0.4)).alias("win"), pricing.gross_ratio(F.lit(False), F.lit(0.4)).alias("loss"),
        pricing.friction_breakdown(F.lit(0.4), "backtest")["total"].alias("total"), pricing.order_size(F.lit(9.0), F.lit(0.1)).alias("small"),
        pricing.order_size(F.lit(100.0), F.lit(0.05)).alias("size"), pricing.price_limit(F.lit(0.98), F.lit(0.03)).alias("cap"), pricing.gross_ratio(F.lit(None).cast("boolean"), F.lit(0.4)).alias("open"),
    ).first()
    assert got["fee"] == pytest.approx(0.042) and got["win"] == pytest.approx(1.5) and got["loss"] == -1 and got["total"] == pytest.approx(0.07 * 0.585)
    assert got["small"] is None and got["size"] == 5.0 and got["cap"] == 0.99 and got["open"] is None
    with pytest.raises(ValueError):
        pricing.friction_breakdown(F.lit(0.4), "live")


def test_scores_at_their_edges(spark):
    rows = [("a", i, 1, 0.4 + i / 100, i // 10) for i in range(5)] + [("b", i, i % 2, 0.4 + i / 100, i // 10) for i in range(19)] + [("c", 0, 0, 0.5, 0)]
    df = spark.createDataFrame(rows, "factor string, id long, win int, price double, week int")
    drop = {r["factor"]: r["drop5_nev"] for r in scoring.drop_cheapest_nev(df, ["factor"], ["id"]).collect()}
    assert drop["a"] is None and drop["c"] is None and drop["b"] is not None
    walk = {r["factor"]: (r["wf_sign_frac"], r["n_weeks"]) for r in scoring.walk_forward(df, ["factor"]).collect()}
    assert walk["a"] == (None, 0) and walk["b"][1] == 1
    cards = {r["factor"]: r for r in scoring.scorecard(df, ["factor"]).collect()}
    assert cards["c"]["eff_n"] is None and cards["a"]["eff_n"] == pytest.approx(5, rel=0.02)


def test_overlap_and_correlation(spark):
    fires = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(2, 8)] + [("c", 99)], "factor string, cs long")
    found = {(r["a"], r["b"]): r for r in candidates.overlaps(fires).collect()}
    assert found["a", "b"]["jaccard"] == 0.25 and found["a", "b"]["containment_ab"] == 0.5 and set(found) == {("a", "b")}
    assert candidates.overlaps(fires, least=0.3).count() == 0 and candidates.overlaps(fires, least=0.25).count() == 1
    x = spark.createDataFrame([(i, float(i), float(i * i % 7), 1.0) for i in range(30)], "i long, a double, b double, k double")
    assert scoring.stream_corr(x, "a", "k").first()["corr"] == 0
    a, b = np.arange(30.0), np.array([i * i % 7 for i in range(30)], float)
    assert scoring.stream_corr(x, "a", "b").first()["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    keep = np.argsort(-np.abs((a - a.mean()) * (b - b.mean())), kind="stable")[3:]
    assert scoring.stream_corr(x, "a", "b", drop=3, ties=["i"]).first()["corr"] == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1])


def test_leaders(spark):
    cards = spark.createDataFrame([("a", "UP", 3.0), ("b", "UP", 2.0), ("c", "DOWN", 1.0), ("d", "UP", 0.5)], "factor string, direction string, net_base_wilson double")
    pairs = spark.createDataFrame([("a", "b", 0.8), ("a", "c", 0.9), ("b", "d", 0.9)], "a string, b string, jaccard double")
    assert sorted(map(tuple, scoring.leaders(cards, pairs).collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


@pytest.mark.parametrize("seed", range(3))
def test_leaders_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i:02}" for i in range(40)]
    cards = [(n, rng.choice(["UP", "DOWN"]), rng.choice([None, float("nan"), 1.0, 2.0, rng.random()][2 * (rng.random() < 0.7) :])) for n in names]
    cards = [(n, d, None if b is None or b != b else b) for n, d, b in cards]
    pairs = [(x, y, rng.random()) for i, x in enumerate(names) for y in names[i + 1 :] if rng.random() < 0.15]
    close = {frozenset(p[:2]) for p in pairs if p[2] > 0.5}
    chosen, wanted = [], {}
    for n, d, _ in sorted(cards, key=lambda c: (c[2] is None, -(c[2] or 0), c[0])):
        wanted[n] = next((c for c, e in chosen if e == d and frozenset((c, n)) in close), n)
        if wanted[n] == n:
            chosen.append((n, d))
    frames = spark.createDataFrame(cards, "factor string, direction string, net_base_wilson double"), spark.createDataFrame(pairs, "a string, b string, jaccard double")
    for few in (0, 20, 100_000):  # in rounds to the end, or the rest in one task
        assert dict(map(tuple, scoring.leaders(*frames, most=0.5, few=few).collect())) == wanted


def test_plans_have_no_single_task_windows_over_rows_and_no_nested_loops(spark):
    folder = "/root/testdata/sf0.001"
    from tidemark.plans import catalogue

    for name in ("stream_corr_drop_k", "dsl_transforms", "roll_zs_native", "roll_rank_native", "jaccard", "containment", "drop5_nev", "dashboard_agg", "realtime_row", "trigger_append", "roll_zs7d"):
        plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        # a window without a key may run over the counts of time buckets, a row each, not over rows
        bare = [line for line in plan.splitlines() if "Window [" in line and line.rstrip().count("], [") == 1 and "windowspecdefinition(_b#" not in line]
        assert not bare, (name, bare)


def test_transforms_in_buckets(spark):
    rng = np.random.default_rng(5)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=700)]
    df = spark.createDataFrame([(i * 300, v) for i, v in enumerate(x)], "cs long, x double")
    texts = ["x__zs2h > 0.5 & x > x__lag3", "x__rank2h__lag2 <= 0.4", "x__abs > 1"]
    found = {(r["cs"], r["factor"]): r["hit"] for r in factors.hits(df, texts, ["cs"], "cs", rows=60, span=9_000).collect()}
    whole = df.select("cs", *[factors.compile_factor(factors.parse(t, df.columns), ["cs"]).alias(str(i)) for i, t in enumerate(texts)]).collect()
    assert len(found) == 3 * 700
    for r in whole:
        assert [found[r["cs"], factors.canonicalize(t)] for t in texts] == [r[str(i)] for i in range(3)]
    with pytest.raises(factors.FactorError):
        factors.hits(df, texts, ["cs"])


# --- ledger

ROSTER = "expr string, label string, direction string, status string, slippage_cap double, bankroll_frac double, entry_offset_s int"


def test_roster(spark):
    good = [("p<1", "b", "UP", "paper", 0.03, None, 0), ("q>1", "a", "DOWN", "live", 0.1, 0.05, 60), ("p>9", None, "UP", "killed", 0.9, None, 0)]
    assert [r["label"] for r in ledger.load_roster(spark.createDataFrame(good, ROSTER), KNOWN).collect()] == ["a", "b"]
    for bad in [("p<1", None, "UP", "paper", 0.03, None, 0), ("p<1", "x", "LEFT", "paper", 0.03, None, 0), ("p<1", "x", "UP", "paper", 0.5, None, 0), ("p<1", "x", "UP", "live", 0.03, None, 0), ("z<1", "x", "UP", "paper", 0.03, None, 0)]:
        with pytest.raises(ValueError):
            ledger.load_roster(spark.createDataFrame([bad], ROSTER), KNOWN)


def _ledger(spark, rows):
    kinds = tables.schema("ledger")
    return spark.createDataFrame([tuple(r.get(n) for n in kinds.names) for r in rows], kinds)


def test_settlement_is_idempotent(spark):
    rows = [dict(id=i, condition_id=f"m{i}", direction="UP" if i % 2 else "DOWN", status="open", candle_start_s=0 if i < 4 else 10**6, entry_price_paper=0.4) for i in range(6)]
    outcomes = spark.createDataFrame([("m0", 1), ("m1", 1), ("m2", None), ("m4", 1)], "condition_id string, up_won int")
    once = ledger.settle(_ledger(spark, rows), outcomes, 1000)
    found = {r["id"]: r for r in once.collect()}
    assert {i for i, r in found.items() if r["status"] == "settled"} == {0, 1}
    assert found[0]["pnl_ratio_paper"] == -1 and found[1]["pnl_ratio_paper"] == pytest.approx(1.5) and found[1]["pnl_ratio_paper_net"] == pytest.approx(1.5 - 0.042)
    again = ledger.settle(once, outcomes, 5000)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    assert ledger.due(_ledger(spark, rows), 359).count() == 0 and ledger.due(_ledger(spark, rows), 360).count() == 4


def test_triggers_fire_once(spark):
    old = _ledger(spark, [dict(id=1, expr="a", candle_start_s=300)])
    hits = spark.createDataFrame([("a", 300, True), ("b", 300, True), ("b", 300, True), ("c", 300, False), ("b", 0, True)], "expr string, candle_start_s long, hit boolean")
    assert sorted((r["expr"], r["candle_start_s"]) for r in ledger.new_triggers(hits, old, now=550).collect()) == [("b", 300)]
    spine, roster = spark.createDataFrame([(0,), (300,)], "cs long"), spark.createDataFrame([("a", "UP", 60)], "expr string, direction string, entry_offset_s int")
    assert [r["cs"] for r in live.triggers(spine, roster, F.lit(365)).collect()] == [300]


def test_triggers_are_reserved_then_filled_in(spark):
    old = _ledger(spark, [dict(id=7, expr="a", candle_start_s=300, status="open")])
    hits = spark.createDataFrame([("a", 300, True, 0.4, "UP"), ("b", 600, True, 0.5, "UP"), ("b", 300, True, 0.6, "DOWN"), ("c", 300, False, 0.1, "UP")], "expr string, candle_start_s long, hit boolean, book_ask_up double, direction string")
    new = ledger.reserve_triggers(old, hits, 700)
    assert new.schema.names == old.schema.names
    assert sorted((r["id"], r["expr"], r["candle_start_s"], r["status"], r["book_ask_up"], r["opened_at_s"], r["order_id"]) for r in new.collect()) == [(8, "b", 300, "open", 0.6, 700, None), (9, "b", 600, "open", 0.5, 700, None)]
    whole = ledger.append_triggers(old, hits, 700)
    assert ledger.reserve_triggers(whole, hits, 800).count() == 0
    filled = upsert.update_by_id(whole, spark.createDataFrame([(8, "o1", 0.61)], "id long, order_id string, entry_price_live double"))
    assert {r["id"]: r["order_id"] for r in filled.collect()} == {7: None, 8: "o1", 9: None}
    assert [r["id"] for r in ledger.reserve_triggers(old.limit(0), hits, 700).orderBy("id").collect()] == [1, 2, 3]


def test_dashboard_brings_no_history_to_one_task(spark):
    """With statistics that speak against a broadcast, too: no join by expr is shuffled, and rows are cut off before they are sorted."""
    kind = "expr string, id long, settled_at_s long, status string, up_won int, pnl_ratio_paper_net double, pnl_ratio_live_net double, pnl_usd_live_net double, entry_price_paper double, entry_price_live double"
    rows = spark.createDataFrame([("a", i, i, "settled", 1, 0.1, 0.1, 1.0, 0.5, 0.5) for i in range(200)], kind)
    roster = spark.createDataFrame([("A", "a", "UP", "paper")], "label string, expr string, direction string, status string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        board = ledger.dashboard(rows, roster)
        plan = board._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin [expr") == 2 and "MapInArrow" in plan


def test_newest_rows_of_a_task():
    rng = np.random.default_rng(1)
    n = 200_000
    rows = pd.DataFrame({"expr": rng.choice(["a", "b", "c"], n), "settled_at_s": rng.choice([None, *range(500)], n), "id": rng.permutation(n)})
    rows.loc[0, "expr"] = "once"
    batches = pa.Table.from_pandas(rows.astype({"settled_at_s": "Int64"}), preserve_index=False).to_batches(max_chunksize=10_000)
    found = pa.Table.from_batches(list(ledger._newest(50)(iter(batches)))).to_pandas()
    wanted = rows.sort_values(["settled_at_s", "id"], ascending=False).groupby("expr").head(50)
    assert len(found) == 151 and set(found["id"]) == set(wanted["id"])


def test_dashboard_is_a_view(spark):
    rows = [dict(id=i, expr="e", status="settled", settled_at_s=i, up_won=i % 2, pnl_ratio_paper_net=float(i), entry_price_paper=0.5) for i in range(60)]
    roster = spark.createDataFrame([("e", "lab", "UP", "paper"), ("x", "dead", "UP", "killed")], "expr string, label string, direction string, status string")
    ledger.create_dashboard(_ledger(spark, rows), roster, "board_of_test")
    r = spark.sql("SELECT * FROM board_of_test").collect()
    assert len(r) == 1 and r[0]["n_fired"] == 60 and r[0]["nev50"] == sum(range(10, 60)) / 50 and r[0]["wr"] == 0.5 and r[0]["n_live"] == 0


def test_realtime_row(spark):
    bars = [(t, 1.0 + (t // 60) % 7, 9.0, 0.5, 2.0 + (t // 60) % 5, 1.0, 2.0, 0.5, 3) for t in range(0, 30_000, 60)]
    bars = spark.createDataFrame(bars, "ts long, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_volume double, n_trades long")
    history = spark.createDataFrame([("bn_chg_pct_pre_60", i * 300, float(i % 11)) for i in range(97)], "feature_name string, cs long, value double")
    row, new = live.realtime_row("bn_chg_pct_pre_60__zs24h > -99 & bn_chg_pct_pre_60__rank24h <= 1 & bn_cvd_pre_60 <= 0", 29_100, history, bars)
    r = row.first()
    wanted = bar_features(spark.createDataFrame([(29_100,)], "cs long"), bars).first()
    past = [float(i % 11) for i in range(97)]
    assert r["bn_chg_pct_pre_60"] == wanted["bn_chg_pct_pre_60"] and r["hit"] is True
    assert r["bn_chg_pct_pre_60__zs24h"] == pytest.approx((r["bn_chg_pct_pre_60"] - np.mean(past)) / np.std(past, ddof=1))
    assert {n["feature_name"]: n["value"] for n in new.collect()} == {n: wanted[n] for n in ("bn_chg_pct_pre_60", "bn_cvd_pre_60")}
    short, _ = live.realtime_row("bn_chg_pct_pre_60__zs7d > 0", 29_100, history, bars)
    assert short.first()["hit"] is False and short.first()["bn_chg_pct_pre_60__zs7d"] is None
    for text in ("fund_8h_now > 0", "bn_chg_pct_pre_60__lag1 > 0"):
        with pytest.raises((NotImplementedError, factors.FactorError)):
            live.realtime_row(text, 29_100, history, bars)


def test_feed_helpers(spark):
    bars = spark.createDataFrame([(0,), (60,), (120,)], "ts long")
    assert [r["ts"] for r in live.closed_bars(bars, 150).collect()] == [0, 60]
    spine = spark.createDataFrame([(0, "u0", "d0"), (300, "u1", "d1"), (600, "u2", None), (900, "u3", "d3")], "cs long, up_token string, down_token string")
    assert sorted(r["asset_id"] for r in live.wanted_tokens(spine, 450).collect()) == ["d1", "u1", "u2"]
    items = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, x long")
    found = {r["id"]: r for r in live.sweep(items, lambda row: str(6 // row["x"])).collect()}
    assert len(found) == 9 and found[1]["result"] == "6" and not found[3]["done"] and found[3]["error_msg"].startswith("ZeroDivisionError")


# --- tables


def test_a_cut_off_replacement_is_put_in_place(spark):
    path = work_dir(spark, "swap")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    move = lambda a, b: fs.rename(spark._jvm.org.apache.hadoop.fs.Path(a), spark._jvm.org.apache.hadoop.fs.Path(b))
    upsert.swap_write(spark, spark.range(3), path)
    spark.range(5).write.parquet(f"{path}.new")
    move(path, f"{path}.old")
    assert upsert.exists(spark, path) and spark.read.parquet(path).count() == 5
    assert not upsert.exists(spark, f"{path}-none")


def test_incremental_tables(spark):
    path = work_dir(spark, "table")
    new = lambda rows: spark.createDataFrame(rows, "cs long, v string")
    assert upsert.known_keys(spark, path).count() == 0
    upsert.write_incremental(spark, new([(2, "a"), (1, "a")]), path)
    upsert.write_incremental(spark, new([(2, "b"), (3, "b")]), path)
    assert [tuple(r) for r in spark.read.parquet(path).orderBy("cs").collect()] == [(1, "a"), (2, "b"), (3, "b")]
    upsert.write_incremental(spark, new([(9, "c")]), path, incremental=False)
    assert upsert.known_keys(spark, path).collect()[0]["cs"] == 9


def test_migrations(spark):
    done = []
    m = upsert.Migrations(spark, work_dir(spark, "log"))
    for v in (2, 1):
        m.add(v, lambda v=v: done.append(v), lambda v=v: done.append(-v))
    assert m.status() == [(1, False), (2, False)] and m.up() == [1, 2] and m.up() == [] and done == [1, 2]
    assert m.down() == 2 and m.applied() == [1] and done[-1] == -2 and m.up() == [2]


def test_optional_tables(spark):
    assert tables.read_optional(spark, work_dir(spark, "none"), "a long").columns == ["a"]
    df = spark.createDataFrame([(1, float("nan"))], "cs long, x double")
    assert tables.nan_to_null(df).first()["x"] is None
    assert tables.complete_columns(df, ["y", "x"]).first() == (None, pytest.approx(float("nan"), nan_ok=True))


# --- parsing


def test_event_and_fill_parsing(spark):
    market = {"conditionId": "m", "closed": True, "clobTokenIds": '["1","2"]', "outcomePrices": '["0.5","0.5"]'}
    cases = [market, {**market, "clobTokenIds": ["1" * 77, "2"]}, {**market, "closed": False}, {**market, "clobTokenIds": '["1"]'}, {**market, "outcomePrices": "bad"}, {**market, "outcomePrices": '["x","1"]'}]
    rows = [(i, json.dumps({"markets": [c]})) for i, c in enumerate(cases)] + [(6, '{"markets":[]}'), (7, "{"), (8, None)]
    found = [r["m"] for r in spark.createDataFrame(rows, "i long, raw string").orderBy("i").select(parsing.parse_event(F.col("raw")).alias("m")).collect()]
    assert found[0]["up_won"] == 1 and found[1]["up_token"] == "1" * 77 and found[2]["up_won"] is None and found[3] is None
    assert found[4]["up_won"] is None and found[5]["up_won"] is None and found[6:] == [None, None, None]
    fills = [{"success": True, "makingAmount": "5.0", "takingAmount": "9.5", "orderID": "o", "transactionsHashes": ["t"]}, {"success": True, "takingAmount": "0"}, {"success": False, "errorMsg": "no"}]
    got = [r["f"] for r in spark.createDataFrame([(json.dumps(f),) for f in fills], "raw string").coalesce(1).select(parsing.parse_fill(F.col("raw")).alias("f")).collect()]
    assert got[0]["success"] and got[0]["fill_price"] == pytest.approx(5 / 9.5) and got[0]["tx_hash"] == "t"
    assert not got[1]["success"] and got[1]["error_msg"] == "zero fill" and not got[2]["success"] and got[2]["error_msg"] == "no"


def test_book_feed(spark):
    frames = [
        (1, json.dumps([{"event_type": "book", "asset_id": "x", "timestamp": "9", "bids": [{"price": "0.1"}, {"price": "0.2"}], "asks": [{"price": "0.3"}, {"price": "0.4"}]}, {"event_type": "other"}])),
        (2, json.dumps({"event_type": "price_change", "timestamp": "5", "price_changes": [{"asset_id": "x", "best_bid": "0.25"}, {"asset_id": "y", "best_ask": "0.9"}, {"best_bid": "1"}]})),
        (3, "not json"), (4, json.dumps({"event_type": "book", "asset_id": "z", "timestamp": "1"})),
    ]
    quotes = live.quotes(spark.createDataFrame(frames, "seq long, frame string"))
    found = {r["asset_id"]: (r["best_bid"], r["best_ask"], r["ts_ms"]) for r in live.latest_by_arrival(quotes, "asset_id", ["best_bid", "best_ask", "ts_ms"], "seq").collect()}
    assert found == {"x": (0.25, None, 5), "y": (None, 0.9, 5), "z": (None, None, 1)}


def test_snapshots(spark):
    log = spark.createDataFrame([("U", 1, 10, 0.1, 0.2), ("U", 2, 20, 0.3, 0.4), ("D", 3, 15, 0.5, 0.6)], "asset_id string, seq long, ts long, best_bid double, best_ask double")
    due = spark.createDataFrame([(19, "U", "D"), (20, "U", "D"), (5, "U", "D")], "due_s long, up_token string, down_token string")
    found = {r["due_s"]: (r["book_bid_up"], r["book_ask_dn"]) for r in live.snapshot(due, log).collect()}
    assert found == {19: (0.1, 0.6), 20: (0.3, 0.6), 5: (None, None)}


# --- sources


def test_landed_pages(spark, tmp_path):
    def land(folder, number, rows):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"{number}.json").write_text(json.dumps(rows))

    bar = lambda t: [t, "1", "2", "0.5", "1.5", "10", "15", 3, "4", "6", 0]
    land("bars/a", 0, [bar(t) for t in range(0, 4)] + [["bad"], [None, *bar(1)[1:]], ["x", *bar(1)[1:]]])
    land("bars/a", 1, [bar(3), bar(4)])
    land("bars/a", 2, [bar(4)])  # no progress: the folder ends
    land("bars/a", 3, [bar(9)])
    found = pages.read_feed(spark, "bars", str(tmp_path / "bars"), page_size="2")
    assert sorted(r["open_ts_ms"] for r in found.collect()) == [0, 1, 2, 3, 4]
    assert [r["open_ts_ms"] for r in pages.read_feed(spark, "bars", str(tmp_path / "bars"), page_size="2", after="3").collect()] == [4]
    trade = lambda i: {"cid": "m", "ts": i, "side": "BUY", "price": 0.5, "size": 1, "asset": "x", "proxy_wallet": "w", "tx_hash": str(i)}
    for p in range(6):
        land("trades/m", p, [trade(p * 2), trade(p * 2 + 1)])
    assert pages.read_feed(spark, "trades", str(tmp_path / "trades"), page_size="2").count() == 8


def test_feeds_resume_skip_and_log(spark, tmp_path):
    def land(folder, number, content):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / f"{number}.json").write_text(content if isinstance(content, str) else json.dumps(content))

    rate = lambda t: {"funding_ts_ms": t, "funding_rate": "0.1", "mark_price": "1", "fetched_at": 0}
    land("funding/w0", 0, [rate(1), rate(2)])
    land("funding/w1", 0, {"status": 400, "msg": "no such window"})
    land("funding/w1", 1, [rate(77)])
    land("funding/w2", 0, [rate(5), rate(6)])
    land("funding/w2", 1, "cut off")
    land("funding/w3", 0, {"data": [rate(9)]})
    log, options = str(tmp_path / "failures"), {"page_size": "2", "tries": "1"}
    found = pages.read_feed(spark, "funding", str(tmp_path / "funding"), failures=log, **options)
    assert sorted(r["funding_ts_ms"] for r in found.collect()) == [1, 2, 5, 6, 9]
    assert [(r["folder"], r["page"]) for r in pages.failures(spark, log).collect()] == [("w2", "1.json")]
    with pytest.raises(Exception, match="Expecting value"):
        pages.read_feed(spark, "funding", str(tmp_path / "funding"), **options).collect()
    stored = str(tmp_path / "stored")
    found.where("funding_ts_ms <= 5").write.parquet(stored)
    assert sorted(r["funding_ts_ms"] for r in pages.read_feed(spark, "funding", str(tmp_path / "funding"), stored, failures=log, **options).collect()) == [6, 9]
    assert pages.failures(spark, str(tmp_path / "none")).count() == 0
    day = 86_400
    assert pages.windows("funding", 0, 60 * day) == [(0, 25 * day), (25 * day, 50 * day), (50 * day, 60 * day)]
    events = spark.createDataFrame([("up-300",), ("up-301",), ("down-600",), ("up-x",)], "slug string")
    assert [r["slug"] for r in pages.candle_markets(events, "up-").collect()] == ["up-300"]


def test_retry_waits():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert pages.with_retry(flaky, 5, sleep=waits.append) == "ok" and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        pages.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=waits.append)
    assert max(pages.backoff(20)) == pages.LONGEST_WAIT


def test_coalesce():
    calls, now = [], [0.0]

    @coalesce(1.0, clock=lambda: now[0])
    def fetch(x):
        calls.append(x)
        time.sleep(0.05)
        if x == "bad":
            raise KeyError(x)
        return x * 2

    threads = [threading.Thread(target=fetch, args=("a",)) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert calls == ["a"] and fetch("b") == "bb" and fetch("a") == "aa" and calls == ["a", "b"]
    now[0] = 2.0
    fetch("a")
    assert calls.count("a") == 2
    for _ in range(2):
        with pytest.raises(KeyError):
            fetch("bad")
    assert calls.count("bad") == 2


# --- the whole build, and streams


def test_feature_build(spark):
    raw, out = work_dir(spark, "raw"), work_dir(spark, "built")
    events = [(f"c{i}", f"s-{i}", i * 300, i * 300 + 300, "u", "d", None if i == 3 else i % 2, 0, "v2", "{}") for i in range(40)]
    spark.createDataFrame(events, tables.schema("events")).write.parquet(f"{raw}/events.parquet")
    bars = [(t * 1000, 1.0 + t % 7, 9.0, 0.5, 2.0 + t % 5, 1.0, 2.0, 3, 0.5, 1.0, 0) for t in range(0, 12_000, 60)]
    spark.createDataFrame(bars, tables.schema("bars")).write.parquet(f"{raw}/bars.parquet")
    spark.createDataFrame([(0, 0.01, 1.0, 0)], tables.schema("funding")).write.parquet(f"{raw}/funding.parquet")
    trades = [("c2", 630, "BUY", 0.4, 1.0, "u", "w", "t1"), ("c2", 629, "BUY", 0.3, 1.0, "u", "w", "t2"), ("c2", 930, "BUY", 0.9, 1.0, "d", "w", "t3"), ("c2", 630, "SELL", 0.8, 1.0, "u", "w", "t4")]
    spark.createDataFrame(trades * 2, tables.schema("trades")).write.parquet(f"{raw}/trades.parquet")
    build = Build(spark, raw, out)
    assert build.run() == list(Build.ORDER)
    panel = spark.read.parquet(f"{raw}/ep_panel.parquet")
    assert panel.count() == 40 and panel.where("cid = 'c2'").first()["p_intra_30_up"] == 0.4 and panel.where("p_intra_270_dn is not null").count() == 0
    found = spark.read.parquet(f"{out}/features.parquet")
    assert found.count() == 39 and {"bn_run_len", "p_intra_30_up", "fund_8h_now", "ls_top_acct_ratio", "era"} <= set(found.columns)
    assert found.where("cs = 600").first()["fund_8h_now"] == 0.01
    assert build.run(["merge", "bars"], incremental=True) == ["bars", "merge"]
    assert spark.read.parquet(f"{out}/features.parquet").count() == 39
    with pytest.raises(ValueError):
        build.run(["nothing"])


def test_stream_with_expiring_state(spark):
    folder = work_dir(spark, "quotes")
    spark.createDataFrame([("a", 1, 0.1, 0.2), ("a", 3, 0.5, 0.6), ("a", 2, 0.3, 0.4), ("b", 4, 0.7, 0.8)], "asset_id string, seq long, best_bid double, best_ask double").write.parquet(folder)
    stream = spark.readStream.schema("asset_id string, seq long, best_bid double, best_ask double").parquet(folder)
    found = {r["asset_id"]: r["best_bid"] for r in drain(live.latest_with_expiry(stream), "update", ["asset_id"], endless=True, longest=60).collect()}
    assert found == {"a": 0.5, "b": 0.7}


def test_candles_of_a_drained_table(spark):
    rows = [(f"2024-01-01 {h:02}:{m:02}:00", kind, 1.0) for h in (0, 1, 5) for m in (0, 30, 59) for kind in "ab"]
    table = spark.createDataFrame(rows, "at string, kind string, value double").select(F.col("at").cast("timestamp_ntz").alias("at"), "kind", "value")
    folder = work_dir(spark, "parts")
    # part files, and the latest hour in the first one read
    for hour in (5, 0, 1):
        table.where(F.hour("at") == hour).repartition(2).write.mode("append").parquet(f"{folder}/t.parquet")
    stream = read_files(spark, folder, "t", files_per_batch=1)
    found = drain(live.candles(stream, "at", 3_600, late=None, by=["kind"]), "update", ["start", "kind"], "candles").collect()
    assert sorted((r["start"].hour, r["kind"], r["n"], r["total"]) for r in found) == [(h, k, 3, 3.0) for h in (0, 1, 5) for k in "ab"]


def test_history(spark):
    old = spark.createDataFrame([("f", i, float(i)) for i in range(10)], "feature_name string, cs long, value double")
    new = spark.createDataFrame([("f", 9, 90.0), ("f", 10, None)], "feature_name string, cs long, value double")
    found = live.extend_history(old, new, rows=5)
    assert sorted((r["cs"], r["value"]) for r in found.collect() if r["value"] is not None) == [(6, 6.0), (7, 7.0), (8, 8.0), (9, 90.0)]
    assert live.history_arrays(found, 10, 3).first()["past"] == [7.0, 8.0, 90.0]
