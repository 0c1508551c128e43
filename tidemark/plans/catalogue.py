"""Queries over the test tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import factors, parsing, pricing
from tidemark.operators import ledger as book
from tidemark.operators import candidates, scoring, upsert
from tidemark.operators.bars import bar_features
from tidemark.operators.rolling import STANDARD, Rolling, percentile_rank, rank_of, rolling_features, rolling_moments, transformable, zscore, zscore_of
from tidemark.operators.timeline import ENTRY_OFFSETS, asof, dense_index, in_buckets, sample_entries
from tidemark.plans import adapters as a
from tidemark.plans.features import entry_panel, gauge_features, merge
from tidemark.sources import pages
from tidemark.sources.buckets import BucketedTable
from tidemark.sources.folders import work_dir
from tidemark.sources.tables import complete_columns, constraint_violations, schema
from tidemark.streaming import live, stateful
from tidemark.streaming.run import date_in_order, drain, read_files, state_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison; keys as they are, and means of products more finely, as they often end in a five."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), 9 if "avg_trade" in c else digits).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in df.columns])


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


# --- scans, projections, filters


@query("scan_project", "SELECT l_orderkey AS id, l_linenumber AS line, CAST(epoch(l_shipdate) AS BIGINT) AS shipped_s, (l_orderkey * 1000 + 999) // 1000 AS from_ms FROM lineitem")
def scan_project(spark, d):
    x = a.table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), parsing.epoch_seconds(F.col("l_shipdate")).alias("shipped_s"), parsing.millis_to_seconds(F.col("l_orderkey") * 1000 + 999).alias("from_ms"))


@query("filter_range", f"WITH {a.EVENTS_SQL} SELECT event_id, t FROM ev WHERE t >= 1704067200 + 86400 AND t < 1704067200 + 3 * 86400")
def filter_range(spark, d):
    t0 = 1_704_067_200
    return a.events(spark, d).where((F.col("t") >= t0 + 86_400) & (F.col("t") < t0 + 3 * 86_400)).select("event_id", "t")


@query("filter_closed_range", f"WITH {a.EVENTS_SQL} SELECT event_id, t FROM ev WHERE t % 3600 BETWEEN 25 AND 30")
def filter_closed_range(spark, d):
    return a.events(spark, d).where((F.col("t") % 3600).between(25, 30)).select("event_id", "t")


@query("filter_in_notnull", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL AND o_orderpriority LIKE '1%' AND o_orderkey % 5 = 0")
def filter_in_notnull(spark, d):
    x = a.table(spark, d, "orders")
    return x.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").isNotNull() & F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 5 == 0)).select("o_orderkey", "o_orderstatus")


@query("winners_filter", f"WITH {a.LEDGER_SQL} SELECT l.id, l.expr FROM ledger l JOIN roster r USING (expr) WHERE l.entry_price_live IS NOT NULL AND ((r.direction = 'UP' AND l.up_won = 1) OR (r.direction = 'DOWN' AND l.up_won = 0))")
def winners_filter(spark, d):
    rows = a.ledger(spark, d).join(a.roster(spark, d).select("expr", "direction"), "expr")
    rows = rows.withColumn("tx_hash_live", F.when(F.col("entry_price_live").isNotNull(), "tx")).withColumn("redeem_tx", F.lit(None).cast("string"))
    return book.winners(rows).select("id", "expr")


@query("case_legs", f"WITH {a.BARS_SQL} SELECT ts, round(CASE WHEN close < open THEN 2 * taker_buy_volume - volume END, 6) AS down_leg, round(CASE WHEN close > open THEN 2 * taker_buy_volume - volume END, 6) AS up_leg FROM bars")
def case_legs(spark, d):
    cvd = 2 * F.col("taker_buy_volume") - F.col("volume")
    return rounded(a.bars(spark, d).select("ts", F.when(F.col("close") < F.col("open"), cvd).alias("down_leg"), F.when(F.col("close") > F.col("open"), cvd).alias("up_leg")))


@query("any_present_count", "SELECT CAST(count(*) FILTER (coalesce(CASE WHEN l_discount > 0.05 THEN l_tax END, CASE WHEN l_quantity > 25 THEN l_quantity END) IS NOT NULL) AS BIGINT) AS n_present, count(*) AS n FROM lineitem")
def any_present_count(spark, d):
    x = a.table(spark, d, "lineitem")
    cols = [F.when(F.col("l_discount") > 0.05, F.col("l_tax")), F.when(F.col("l_quantity") > 25, F.col("l_quantity"))]
    return x.agg(F.count_if(F.coalesce(*cols).isNotNull()).alias("n_present"), F.count("*").alias("n"))


@query("row_guard", "SELECT CAST(count(*) FILTER (k IS NOT NULL AND k % 2 = 0) AS BIGINT) AS n_good, CAST(count(*) FILTER (k IS NULL OR k % 2 <> 0) AS BIGINT) AS n_dead FROM (SELECT TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def row_guard(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    good, dead = upsert.parse_guard(a.events(spark, d), {"k": F.when(k % 2 == 0, k)})
    marked = good.select(F.lit(1).alias("ok")).unionByName(dead.select(F.lit(0).alias("ok")))
    return marked.agg(F.count_if(F.col("ok") == 1).alias("n_good"), F.count_if(F.col("ok") == 0).alias("n_dead"))


@query(
    "checked_write",
    "WITH k AS (SELECT TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events) "
    "SELECT count(*) AS rows_in, count(*) FILTER (k IS NOT NULL AND k % 2 = 0) AS rows_good, count(*) FILTER (k IS NULL OR k % 2 <> 0) AS rows_dead, min(t) FILTER (k % 2 = 0) AS first_s, max(t) FILTER (k % 2 = 0) AS last_s, "
    "count(*) FILTER (k % 2 = 0 AND NOT value > 10) AS failed_value, count(*) FILTER (k % 2 = 0 AND NOT k < 90) AS failed_k FROM k",
)
def checked_write(spark, d):
    """Rejected rows, times and violated constraints, counted in the pass that writes."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    found = upsert.write_checked(a.events(spark, d), work_dir(spark, "checked"), {"k": F.when(k % 2 == 0, k)}, {"value": "value > 10", "k": "k < 90"}, "t")
    return spark.createDataFrame([found], ", ".join(f"{n} long" for n in found))


# --- joins


@query(
    "left_join_merge",
    f"WITH {a.SPINE_SQL}, {a.GAUGE_SQL.format(name='g', kind='click')}, part AS (SELECT 'c' || CAST(ts - ts % 18000 AS VARCHAR) AS cid, ts - ts % 18000 AS cs, max(value) AS top FROM g GROUP BY ALL) "
    "SELECT s.cid, s.cs, s.up_won, top FROM spine s LEFT JOIN part USING (cid, cs) WHERE up_won IS NOT NULL",
)
def left_join_merge(spark, d):
    cs = F.col("ts") - F.col("ts") % a.CANDLE
    part = a.gauge(spark, d, "click").groupBy(F.concat(F.lit("c"), cs.cast("string")).alias("cid"), cs.alias("cs")).agg(F.max("value").alias("top"))
    return merge(a.spine(spark, d), [part])


@query("inner_roster_ledger", f"WITH {a.LEDGER_SQL} SELECT label, count(*) AS n, CAST(sum(up_won) AS BIGINT) AS ups FROM ledger JOIN roster USING (expr) WHERE roster.status IN ('paper', 'live') GROUP BY label")
def inner_roster_ledger(spark, d):
    armed = book.load_roster(a.roster(spark, d).withColumn("slippage_cap", F.lit(0.03)).withColumn("bankroll_frac", F.lit(0.05)))
    joined = a.ledger(spark, d).join(armed.select("expr", "label"), "expr")
    return joined.groupBy("label").agg(F.count("*").alias("n"), F.sum("up_won").cast("long").alias("ups"))


@query("anti_incremental", f"WITH {a.SPINE_SQL} SELECT cid, cs FROM spine WHERE cs NOT IN (SELECT cs FROM spine WHERE (cs // 18000) % 3 = 0)")
def anti_incremental(spark, d):
    known = a.spine(spark, d).where((F.col("cs") / a.CANDLE).cast("long") % 3 == 0).select("cs")
    return a.spine(spark, d).join(known, "cs", "left_anti").select("cid", "cs")


def _asof_sql(gap: int | None, shift: int) -> str:
    ok = "TRUE" if gap is None else f"s.cs - {shift} - g.ts <= {gap}"
    return f"WITH {a.SPINE_SQL}, {a.GAUGE_SQL.format(name='g', kind='purchase')} SELECT s.cs, CASE WHEN {ok} THEN g.value END AS value FROM spine s ASOF LEFT JOIN g ON s.cs - {shift} >= g.ts"


for _name, _gap, _shift in (("asof_backward", None, 0), ("asof_max_gap", 600, 0), ("asof_shifted", 7_200, 86_400)):

    def _asof(spark, d, gap=_gap, shift=_shift):
        return asof(a.spine(spark, d).select("cs"), a.gauge(spark, d, "purchase"), "cs", "ts", {"value": "value"}, max_gap=gap, shift=shift)

    query(_name, _asof_sql(_gap, _shift))(_asof)


@query(
    "gauge_features",
    f"""WITH {a.SPINE_SQL}, {a.GAUGE_SQL.format(name='fund', kind='purchase')}, {a.GAUGE_SQL.format(name='oi', kind='click')}, {a.GAUGE_SQL.format(name='ls', kind='signup')},
f AS (SELECT s.cid, s.cs, CASE WHEN s.cs - g.ts <= 57600 THEN value END AS v FROM spine s ASOF LEFT JOIN fund g ON s.cs >= g.ts),
f1 AS (SELECT s.cs, CASE WHEN s.cs - 86400 - g.ts <= 57600 THEN value END AS v FROM spine s ASOF LEFT JOIN fund g ON s.cs - 86400 >= g.ts),
o AS (SELECT s.cs, CASE WHEN s.cs - g.ts <= 7200 THEN value END AS v FROM spine s ASOF LEFT JOIN oi g ON s.cs >= g.ts),
o1 AS (SELECT s.cs, CASE WHEN s.cs - 3600 - g.ts <= 7200 THEN value END AS v FROM spine s ASOF LEFT JOIN oi g ON s.cs - 3600 >= g.ts),
o4 AS (SELECT s.cs, CASE WHEN s.cs - 14400 - g.ts <= 7200 THEN value END AS v FROM spine s ASOF LEFT JOIN oi g ON s.cs - 14400 >= g.ts),
l AS (SELECT s.cs, CASE WHEN s.cs - g.ts <= 7200 THEN value END AS v FROM spine s ASOF LEFT JOIN ls g ON s.cs >= g.ts)
SELECT f.cid, f.cs, round(f.v, 6) AS fund_8h_now, round(f.v - f1.v, 6) AS fund_chg_24h, round((o.v - o1.v) / nullif(o1.v, 0), 6) AS oi_chg_pct_1h,
  round((o.v - o4.v) / nullif(o4.v, 0), 6) AS oi_chg_pct_4h, round(l.v, 6) AS ls_top_acct_ratio
FROM f JOIN f1 USING (cs) JOIN o USING (cs) JOIN o1 USING (cs) JOIN o4 USING (cs) JOIN l USING (cs)""",
)
def gauge_query(spark, d):
    g = {k: a.gauge(spark, d, k) for k in ("purchase", "click", "signup")}
    return rounded(gauge_features(a.spine(spark, d), g["purchase"], g["click"], {"ls_top_acct_ratio": g["signup"]}, gaps=(57_600, 7_200, 7_200)))


# --- trailing bar features

_SEG = "SELECT s.cs, b.* FROM spine s JOIN bars b ON b.ts >= s.cs - {w} AND b.ts < s.cs"


def _bars(spark, d, *names: str) -> DataFrame:
    return rounded(bar_features(a.spine(spark, d).select("cs"), a.bars(spark, d), a.UNIT).select("cs", *names))


def _segment(columns: dict[str, str], w: int) -> str:
    """Aggregates of the bars of one window, for every spine row."""
    listed = ", ".join(f"round({e}, {9 if 'avg_trade' in n else 6}) AS {n}" for n, e in columns.items())
    return f"WITH {a.SPINE_SQL}, seg AS ({_SEG.format(w=w * a.UNIT)}), agg AS (SELECT cs, {listed} FROM seg GROUP BY cs) SELECT s.cs, {', '.join(columns)} FROM spine s LEFT JOIN agg USING (cs)"


_FIRST, _LAST = "first(open ORDER BY ts)", "last(close ORDER BY ts)"
_CHG = f"({_LAST} - {_FIRST}) / nullif({_FIRST}, 0)"
_CVD = "(2 * sum(taker_buy_volume) - sum(volume))"
for _w in (60, 300, 900, 1800, 3600):
    _cols = {f"bn_chg_pct_pre_{_w}": _CHG}
    if _w in (60, 300, 900):
        _cols |= {f"bn_taker_buy_ratio_pre_{_w}": "sum(taker_buy_volume) / nullif(sum(volume), 0)", f"bn_cvd_pre_{_w}": _CVD, f"bn_avg_trade_size_pre_{_w}": "sum(quote_volume) / nullif(sum(n_trades), 0)"}
    if _w in (300, 900):
        _cols |= {
            f"bn_hl_range_pre_{_w}": f"(max(high) - min(low)) / nullif({_FIRST}, 0)",
            f"bn_clv_pre_{_w}": f"({_LAST} - min(low)) / nullif(max(high) - min(low), 0)",
            f"bn_cvd_chgdn_pre_{_w}": f"CASE WHEN {_CHG} < 0 THEN {_CVD} END",
            f"bn_cvd_chgup_pre_{_w}": f"CASE WHEN {_CHG} > 0 THEN {_CVD} END",
        }

    def _trailing(spark, d, names=tuple(_cols)):
        return _bars(spark, d, *names)

    query(f"range_bars_{_w}", _segment(_cols, _w))(_trailing)

for _w in (300, 900, 1800):
    _sql = f"""WITH {a.SPINE_SQL}, seg AS ({_SEG.format(w=_w * a.UNIT)}), r AS (SELECT cs, ln(close / lag(close) OVER (PARTITION BY cs ORDER BY ts)) AS r FROM seg),
agg AS (SELECT cs, CASE WHEN count(r) >= 2 THEN round(stddev_samp(r) * sqrt(count(r)), 6) END AS bn_rv_{_w} FROM r GROUP BY cs) SELECT s.cs, bn_rv_{_w} FROM spine s LEFT JOIN agg USING (cs)"""

    def _rv(spark, d, name=f"bn_rv_{_w}"):
        return _bars(spark, d, name)

    query(f"range_rv_{_w}", _sql)(_rv)


@query(
    "range_vol_zscore",
    f"""WITH {a.SPINE_SQL}, s1 AS (SELECT cs, avg(volume) AS v FROM ({_SEG.format(w=3600)}) GROUP BY cs),
s2 AS (SELECT cs, count(*) AS n, avg(volume) AS m, stddev_pop(volume) AS sd FROM ({_SEG.format(w=216000)}) GROUP BY cs)
SELECT s.cs, CASE WHEN n >= 5 THEN round((v - m) / nullif(sd, 0), 6) END AS bn_vol_zscore_pre_60 FROM spine s LEFT JOIN s1 USING (cs) LEFT JOIN s2 USING (cs)""",
)
def range_vol_zscore(spark, d):
    return _bars(spark, d, "bn_vol_zscore_pre_60")


@query(
    "range_since_extreme",
    f"""WITH {a.SPINE_SQL}, seg AS ({_SEG.format(w=54000)}), m AS (SELECT cs, min(low) AS lo, max(high) AS hi FROM seg GROUP BY cs),
agg AS (SELECT cs, CAST(cs - max(ts) FILTER (low = lo) AS DOUBLE) AS l, CAST(cs - max(ts) FILTER (high = hi) AS DOUBLE) AS h FROM seg JOIN m USING (cs) GROUP BY cs)
SELECT s.cs, l AS bn_secs_since_low_900, h AS bn_secs_since_high_900 FROM spine s LEFT JOIN agg USING (cs)""",
)
def range_since_extreme(spark, d):
    return _bars(spark, d, "bn_secs_since_low_900", "bn_secs_since_high_900")


@query(
    "run_length",
    f"""WITH {a.SPINE_SQL}, seg AS (SELECT cs, ts, sign(close - open) AS s FROM ({_SEG.format(w=216000)})), e AS (SELECT cs, last(s ORDER BY ts) AS s1 FROM seg GROUP BY cs),
b AS (SELECT cs, s1, max(ts) FILTER (s <> s1) AS br FROM seg JOIN e USING (cs) GROUP BY cs, s1),
agg AS (SELECT cs, CAST(any_value(s1) * count(*) FILTER (br IS NULL OR ts > br) AS DOUBLE) AS n FROM seg JOIN b USING (cs) GROUP BY cs)
SELECT sp.cs, n AS bn_run_len FROM spine sp LEFT JOIN agg USING (cs)""",
)
def run_length(spark, d):
    return _bars(spark, d, "bn_run_len")


# --- rolling


def _in_bucket():
    return Window.partitionBy("_bucket").orderBy("_idx")


def _hours(spark, d) -> DataFrame:
    return a.bars(spark, d).select("ts", F.col("close").alias("x"))


def _zs_sql(window: int, least: int, name: str) -> str:
    over = f"(ORDER BY ts ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return f"WITH {a.BARS_SQL} SELECT ts, CASE WHEN count(close) OVER {over} >= {least} THEN round((close - avg(close) OVER {over}) / nullif(stddev_samp(close) OVER {over}, 0), 5) END AS {name} FROM bars"


@query("roll_zs24", _zs_sql(288, 50, "x__zs24h"))
def roll_zs24(spark, d):
    return rounded(rolling_features(_hours(spark, d), "ts", ["x"], [Rolling("zs24h", "zs", 288, 50)]).select("ts", "x__zs24h"), digits=5)


# over all events, a series longer than its window
_ZS7D = "(ORDER BY event_id ROWS BETWEEN 2016 PRECEDING AND 1 PRECEDING)"


@query("roll_zs7d", f"SELECT event_id AS ts, CASE WHEN count(value) OVER {_ZS7D} >= 200 THEN round((value - avg(value) OVER {_ZS7D}) / nullif(stddev_samp(value) OVER {_ZS7D}, 0), 5) END AS x__zs7d FROM events")
def roll_zs7d(spark, d):
    x = a.table(spark, d, "events").select(F.col("event_id").alias("ts"), F.col("value").alias("x"))
    return rounded(rolling_features(x, "ts", ["x"], [Rolling("zs7d", "zs", 2016, 200)], span=4_096).select("ts", "x__zs7d"), digits=5)


@query("roll_zs_native", _zs_sql(288, 50, "z"))
def roll_zs_native(spark, d):
    x = in_buckets(_hours(spark, d), "ts", 288)
    return rounded(x.withColumn("z", zscore(F.col("x"), _in_bucket(), 288, 50)).where("_own").select("ts", "z"), digits=5)


_RANK = f"""WITH {a.BARS_SQL}, n AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS i FROM bars)
SELECT p.ts, CASE WHEN count(*) >= 50 THEN round((count(*) FILTER (q.close < p.close) + (count(*) FILTER (q.close = p.close) + 1) / 2.0) / count(*), 6) END AS {{name}}
FROM n p JOIN n q ON q.i BETWEEN p.i - {{past}} AND p.i GROUP BY p.ts"""


@query("roll_rank24", _RANK.format(name="x__rank24h", past=287))
def roll_rank24(spark, d):
    return rounded(rolling_features(_hours(spark, d), "ts", ["x"], [Rolling("rank24h", "rank", 288, 50)]).select("ts", "x__rank24h"))


@query("roll_rank_native", _RANK.format(name="pct", past=287))
def roll_rank_native(spark, d):
    x = in_buckets(_hours(spark, d), "ts", 288)
    return rounded(x.withColumn("pct", percentile_rank(F.col("x"), _in_bucket(), 288, 50)).where("_own").select("ts", "pct"))


_OVER100 = "(ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


@query("roll_moments", f"WITH {a.BARS_SQL} SELECT ts, round(avg(close) OVER {_OVER100}, 6) AS mean, round(stddev_samp(close) OVER {_OVER100}, 6) AS sd, CASE WHEN count(close) OVER {_OVER100} > 1 THEN round(avg(close) OVER {_OVER100} * sqrt(count(close) OVER {_OVER100}) / nullif(stddev_samp(close) OVER {_OVER100}, 0), 5) END AS t FROM bars")
def roll_moments(spark, d):
    x = in_buckets(_hours(spark, d), "ts", 100).withColumns(rolling_moments(F.col("x"), _in_bucket(), 100)).where("_own")
    return rounded(x.select("ts", "mean", "sd", F.round("t", 5).alias("t")))


@query("realtime_scores", f"""WITH {a.BARS_SQL}, cut AS (SELECT max(ts) AS now FROM bars), p AS (SELECT close FROM bars, cut WHERE ts < now ORDER BY ts DESC LIMIT 288), c AS (SELECT close AS x FROM bars, cut WHERE ts = now)
SELECT round((x - (SELECT avg(close) FROM p)) / (SELECT stddev_samp(close) FROM p), 6) AS zs,
  round(((SELECT count(*) FROM p WHERE close < x) + ((SELECT count(*) FROM p WHERE close = x) + 2) / 2.0) / ((SELECT count(*) FROM p) + 1), 6) AS rank FROM c""")
def realtime_scores(spark, d):
    history = _hours(spark, d).select(F.lit("x").alias("feature_name"), F.col("ts").alias("cs"), F.col("x").alias("value"))
    now = history.agg(F.max("cs")).first()[0]
    past = live.history_arrays(history, now, 288)
    current = history.where(F.col("cs") == now).withColumn("past", past.select("past").scalar())
    return rounded(current.select(zscore_of(F.col("value"), F.col("past"), 50).alias("zs"), rank_of(F.col("value"), F.col("past"), 50).alias("rank")))


@query("lag1", f"WITH {a.BARS_SQL} SELECT ts, lag(close) OVER (ORDER BY ts) AS x__lag1 FROM bars")
def lag1(spark, d):
    return in_buckets(_hours(spark, d), "ts", 1).withColumn("x__lag1", F.lag("x").over(_in_bucket())).where("_own").select("ts", "x__lag1")


@query("dense_index", f"WITH {a.BARS_SQL} SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS idx FROM bars")
def dense_index_query(spark, d):
    return dense_index(_hours(spark, d), "ts", 86_400).select("ts", "idx")


@query(
    "transformable_profile",
    "SELECT 'l_quantity' AS \"column\", count(l_quantity) AS n, count(DISTINCT l_quantity) AS n_distinct, count(l_quantity) >= 1000 AND count(DISTINCT l_quantity) >= 50 AS ok FROM lineitem "
    "UNION ALL SELECT 'l_discount', count(l_discount), count(DISTINCT l_discount), count(l_discount) >= 1000 AND count(DISTINCT l_discount) >= 50 FROM lineitem",
)
def transformable_profile(spark, d):
    return transformable(a.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"])


# --- samples, bars, sets


_ENTRY = ["p_intra_{x}_{s}", "p_intra_{x}_{s}_staleness_s"]
# all ten offsets; an hour stands for a minute
_OFFSETS, _BACK = tuple(x * a.UNIT for x in ENTRY_OFFSETS), 5 * a.UNIT


def _ep_sql(known: str = "{}") -> str:
    sides = {"up": "click", "dn": "view"}
    parts, outs = [], []
    for x in _OFFSETS:
        for s, kind in sides.items():
            parts.append(
                f"e_{x}_{s} AS (SELECT s.cs, last(value ORDER BY t, -event_id) AS p, CAST(s.cs + {x} - max(t) AS DOUBLE) AS st FROM spine s JOIN ev ON event_type = '{kind}' AND t - t % 18000 = s.cs AND t BETWEEN s.cs + {x - _BACK} AND s.cs + {x} GROUP BY s.cs)"
            )
            outs.append(f"{known.format(f'e_{x}_{s}.p')} AS p_intra_{x}_{s}, {known.format(f'e_{x}_{s}.st')} AS p_intra_{x}_{s}_staleness_s")
    joins = " ".join(f"LEFT JOIN e_{x}_{s} ON e_{x}_{s}.cs = s.cs" for x in _OFFSETS for s in sides)
    return f"WITH {a.SPINE_SQL}, {', '.join(parts)} SELECT s.cid, s.cs, {', '.join(outs)} FROM spine s {joins}"


@query("ep_sample", _ep_sql())
def ep_sample(spark, d):
    probes = a.spine(spark, d).select("cid", "cs", F.lit("click").alias("up_token"), F.lit("view").alias("down_token"))
    return sample_entries(probes, a.prints(spark, d), _OFFSETS, _BACK)


@query("ep_etl", _ep_sql("CASE WHEN s.up_won IS NOT NULL THEN {} END"))
def ep_etl(spark, d):
    """Trades of decided candles into a panel that has all candles without prices."""
    spine = a.spine(spark, d).select("cid", "cs", F.lit("click").alias("up_token"), F.lit("view").alias("down_token"), "up_won")
    prints = a.prints(spark, d)
    old = entry_panel(spine.drop("up_won"), prints.limit(0), offsets=_OFFSETS, order=["ord"])
    return entry_panel(spine.where("up_won is not null").drop("up_won"), prints, old, _OFFSETS, _BACK, 300 * a.UNIT, 330 * a.UNIT, order=["ord"]).drop("fetched_at")


@query("ohlc_bars", f"WITH {a.BARS_SQL} SELECT ts, open, high, low, close, {r6('volume', 'quote_volume', 'taker_buy_volume')}, n_trades FROM bars")
def ohlc_bars(spark, d):
    return rounded(a.bars(spark, d))


@query("tumbling_count", f"WITH {a.EVENTS_SQL} SELECT t - t % 300 AS cs, count(*) AS n FROM ev GROUP BY 1")
def tumbling_count(spark, d):
    return a.events(spark, d).groupBy(parsing.candle_start(F.col("t")).alias("cs")).agg(F.count("*").alias("n"))


@query("dedup_keep_last", f"WITH {a.EVENTS_SQL} SELECT user_id, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1")
def dedup_keep_last(spark, d):
    return upsert.keep_last(a.events(spark, d), ["user_id"], ["t", "event_id"]).select("user_id", "event_id", "t")


# the whole table: the days before the middle one are stored, those from it on are new
_KEYED = "keyed AS (SELECT event_id, CAST(user_id AS VARCHAR) || ':' || event_type || ':' || CAST(t // 3600 % 24 AS VARCHAR) AS k, t >= 1704067200 + 15 * 86400 AS fresh FROM ev)"
_OLD = f"{a.EVENTS_SQL}, {_KEYED}, old AS (SELECT k, max(event_id) AS v FROM keyed WHERE NOT fresh GROUP BY 1), new AS (SELECT k, event_id AS v FROM keyed WHERE fresh)"


def _old_new(spark, d) -> tuple[DataFrame, DataFrame]:
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", (F.floor(F.col("t") / 3_600) % 24).cast("string"))
    x = a.events(spark, d).select(key.alias("k"), F.col("event_id").alias("v"), (F.col("t") >= 1_704_067_200 + 15 * 86_400).alias("fresh"))
    return x.where("not fresh").groupBy("k").agg(F.max("v").alias("v")), x.where("fresh").select("k", "v")


@query("upsert_ignore", f"WITH {_OLD} SELECT k, v FROM old UNION ALL SELECT k, min(v) FROM new WHERE k NOT IN (SELECT k FROM old) GROUP BY k")
def upsert_ignore(spark, d):
    return upsert.insert_ignore(*_old_new(spark, d), ["k"], ["v"])


@query("upsert_replace", f"WITH {_OLD} SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, max(v) FROM new GROUP BY k")
def upsert_replace(spark, d):
    return upsert.insert_replace(*_old_new(spark, d), ["k"], ["v"])


@query("concat_dedup", f"WITH {_OLD}, n AS (SELECT k, max(v) AS v, CAST(max(v) % 7 AS BIGINT) AS w FROM new GROUP BY k) SELECT k, v, NULL::BIGINT AS w FROM old WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, v, w FROM n")
def concat_dedup(spark, d):
    old, new = _old_new(spark, d)
    new = new.groupBy("k").agg(F.max("v").alias("v")).withColumn("w", F.col("v") % 7)
    return upsert.merge_incremental(old, new, "k")


@query("update_by_id", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'settled' ELSE o_orderstatus END AS status, o_totalprice AS total FROM orders")
def update_by_id(spark, d):
    x = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return upsert.update_by_id(x, x.where("id % 4 = 0").select("id", F.lit("settled").alias("status")))


@query("topk_per_group", f"WITH {a.TRADES_SQL} SELECT factor, id, settled_at_s, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY settled_at_s DESC, id DESC) AS rn FROM trades) WHERE rn <= 50")
def topk_per_group(spark, d):
    latest = Window.partitionBy("factor").orderBy(F.desc("settled_at_s"), F.desc("id"))
    return a.trades(spark, d).withColumn("rn", F.row_number().over(latest)).where("rn <= 50").select("factor", "id", "settled_at_s", "rn")


@query("last50_avg", f"WITH {a.LEDGER_SQL}, r AS (SELECT expr, pnl_ratio_paper_net AS pr, row_number() OVER (PARTITION BY expr ORDER BY settled_at_s DESC, id DESC) AS rn FROM ledger) SELECT expr, round(avg(CASE WHEN rn <= 50 THEN pr END), 6) AS nev50 FROM r GROUP BY expr")
def last50_avg(spark, d):
    latest = Window.partitionBy("expr").orderBy(F.desc("settled_at_s"), F.desc("id"))
    ranked = a.ledger(spark, d).withColumn("rn", F.row_number().over(latest)).where("rn <= 50")
    return rounded(ranked.groupBy("expr").agg(F.avg("pnl_ratio_paper_net").alias("nev50")))


@query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(spark, d):
    return a.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("conditional_counts", "SELECT l_returnflag, count(*) AS n, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS n_high, round(avg(CASE WHEN l_tax > 0.04 THEN l_quantity END), 6) AS mean_taxed, round(stddev_pop(l_quantity), 6) AS spread, CAST(min(epoch(l_shipdate)) AS BIGINT) AS first_s, CAST(max(epoch(l_shipdate)) AS BIGINT) AS last_s FROM lineitem GROUP BY 1")
def conditional_counts(spark, d):
    t = parsing.epoch_seconds(F.col("l_shipdate"))
    return rounded(
        a.table(spark, d, "lineitem").groupBy("l_returnflag").agg(
            F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_high"), F.avg(F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))).alias("mean_taxed"),
            F.stddev_pop("l_quantity").alias("spread"), F.min(t).alias("first_s"), F.max(t).alias("last_s"),
        )
    )


@query("cursor_max", "SELECT coalesce(CAST(max(epoch(ts)) // 1 AS BIGINT) + 60, 0) AS next_s FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def cursor_max(spark, d):
    return a.events(spark, d).agg(F.coalesce(F.max("t") + 60, F.lit(0)).cast("long").alias("next_s"))


_UTC = "strftime(TIMESTAMP '1970-01-01' + to_seconds({}), '%Y-%m-%d %H:%M')"


@query("time_report", f"WITH {a.EVENTS_SQL}, r AS (SELECT count(*) AS n, min(t) AS first_s, max(t) AS last_s FROM ev) SELECT *, {_UTC.format('first_s')} AS first_utc, {_UTC.format('last_s')} AS last_utc FROM r")
def time_report(spark, d):
    return upsert.time_report(a.events(spark, d), "t")


# --- parsing


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return a.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _raw_event() -> Column:
    closed, price = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.when(F.col("event_id") % 3 == 0, "1").otherwise("0")
    text = F.concat(F.lit('{"slug":"x-'), F.col("event_id").cast("string"), F.lit('","markets":[{"conditionId":"m'), F.col("event_id").cast("string"), F.lit('","closed":'), closed,
                    F.lit(',"clobTokenIds":"[\\"11\\",\\"22\\"]","outcomePrices":"[\\"'), price, F.lit('\\",\\"0.5\\"]"}]}'))
    return F.when(F.col("event_id") % 5 == 0, F.lit('{"markets":[]}')).otherwise(text)


@query("settle_from_json", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'm' || CAST(event_id AS VARCHAR) END AS condition_id, CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS up_won FROM events")
def settle_from_json(spark, d):
    m = parsing.parse_event(_raw_event())
    return a.table(spark, d, "events").select("event_id", m["condition_id"].alias("condition_id"), m["up_won"].alias("up_won"))


@query(
    "event_lookup",
    "WITH found AS (SELECT 'x-' || CAST(event_id AS VARCHAR) AS slug, 'm' || CAST(event_id AS VARCHAR) AS condition_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS up_won FROM events WHERE event_id % 5 <> 0), "
    "asked AS (SELECT 'x-' || CAST(event_id AS VARCHAR) AS slug FROM events UNION ALL SELECT 'y-' || CAST(event_id AS VARCHAR) FROM events) SELECT slug, condition_id, up_won FROM asked LEFT JOIN found USING (slug)",
)
def event_lookup(spark, d):
    """Events by slug from what has been landed of them; a slug that is not there gives none."""
    raw = a.table(spark, d, "events").select(parsing.parse_event(_raw_event()).alias("m"), F.concat(F.lit("x-"), F.col("event_id").cast("string")).alias("slug"))
    store = BucketedTable(spark, work_dir(spark, "events"))
    store.create(raw.select("slug", "m.condition_id", "m.up_won").where("condition_id is not null"), ["slug"], buckets=16)
    asked = a.table(spark, d, "events").select(F.explode(F.array(*[F.concat(F.lit(x), F.col("event_id").cast("string")) for x in ("x-", "y-")])).alias("slug"))
    return store.find(asked)


@query("fill_parse", "SELECT event_id, event_id % 3 <> 0 AND event_id % 4 <> 0 AS success, CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 THEN round(CAST(5.0 AS DOUBLE) / (event_id % 4 * 2.5), 6) END AS fill_price FROM events")
def fill_parse(spark, d):
    raw = F.concat(F.lit('{"success":'), F.when(F.col("event_id") % 3 != 0, "true").otherwise("false"), F.lit(',"makingAmount":"5.0","takingAmount":"'), (F.col("event_id") % 4 * 2.5).cast("string"), F.lit('"}'))
    fill = parsing.parse_fill(raw)
    return rounded(a.table(spark, d, "events").select("event_id", fill["success"].alias("success"), fill["fill_price"].alias("fill_price")))


@query("candle_slug", f"WITH {a.EVENTS_SQL} SELECT event_id, 'updown-5m-' || CAST(t - t % 300 AS VARCHAR) AS slug, t - t % 300 AS cs FROM ev")
def candle_slug(spark, d):
    slug = parsing.candle_slug("updown-5m-", parsing.candle_start(F.col("t")))
    return a.events(spark, d).select("event_id", slug.alias("slug"), parsing.slug_start(slug).alias("cs"))


# --- factors


def _frame(spark, d) -> DataFrame:
    t = a.table(spark, d, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cs"), F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("disc"), F.col("l_tax").alias("tax"))


_FRAME = "f AS (SELECT l_orderkey * 10 + l_linenumber AS cs, l_quantity AS q, CASE WHEN l_linenumber <> 3 THEN l_discount END AS disc, l_tax AS tax FROM lineitem)"
_FACTORS = {
    "dsl_single": ("q < 12.5", "q < 12.5"),
    "dsl_and": ("disc<=0.04 & tax > 2e-2 & q>=30", "coalesce(disc <= 0.04, FALSE) AND tax > 0.02 AND q >= 30"),
    "dsl_col_vs_col": ("disc > tax", "coalesce(disc > tax, FALSE)"),
    "dsl_neq_missing": ("disc != 0.05", "disc IS NULL OR disc <> 0.05"),
}
for _name, (_text, _cond) in _FACTORS.items():

    def _factor(spark, d, text=_text):
        x = _frame(spark, d)
        return x.select("cs", factors.compile_factor(factors.parse(text, x.columns)).alias("hit"))

    query(_name, f"WITH {_FRAME} SELECT cs, {_cond} AS hit FROM f")(_factor)


@query("dsl_roster_long", f"WITH {_FRAME} " + " UNION ALL ".join(f"SELECT '{factors.canonicalize(t)}' AS factor, CAST(count(*) FILTER ({c}) AS BIGINT) AS n_hit, count(*) AS n_raw FROM f" for t, c in _FACTORS.values()))
def dsl_roster_long(spark, d):
    long = factors.hits(_frame(spark, d), [t for t, _ in _FACTORS.values()], ["cs"])
    return long.groupBy("factor").agg(F.count_if("hit").alias("n_hit"), F.count("*").alias("n_raw"))


@query("dsl_transforms", f"WITH {a.BARS_SQL}, n AS (SELECT ts, close, lag(close, 3) OVER (ORDER BY ts) AS l3, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS sd FROM bars WINDOW w AS (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) SELECT ts, coalesce(CASE WHEN n >= 4 THEN (close - m) / nullif(sd, 0) END > 0.5, FALSE) AND coalesce(close > l3, FALSE) AS hit FROM n")
def dsl_transforms(spark, d):
    return factors.hits(_hours(spark, d), ["x__zs2h > 0.5 & x > x__lag3"], ["ts"], "ts").select("ts", "hit")


# every pair of a quantity and a tax threshold
_MANY = [(f"q < {q} & tax >= {t / 100}", f"q < {q} AND tax >= {t / 100}") for q in range(2, 52) for t in range(9)]


@query(
    "dsl_large_roster",
    f"WITH {_FRAME}, cuts AS (SELECT qs.range AS lim, ts.range / 100 AS t FROM range(2, 52) qs, range(9) ts) "
    "SELECT 'q<' || CAST(lim AS VARCHAR) || ' & tax>=' || CAST(t AS VARCHAR) AS factor, count(*) AS n_hit FROM f JOIN cuts ON q < lim AND tax >= t GROUP BY ALL",
)
def dsl_large_roster(spark, d):
    """450 factors over 59 distinct predicates, each of which is evaluated once a row."""
    found = factors.roster_hits(_frame(spark, d), [t for t, _ in _MANY], ["cs"])
    return found.groupBy("factor").agg(F.count("*").alias("n_hit"))


# --- prices


@query("fee_friction", f"WITH {a.TRADES_SQL} SELECT id, round(0.07 * (1 - price), 6) AS paper, round(0.07 * (1 - price - 0.015), 6) AS backtest, round(0.07 * (1 - price - 0.015) - 0.07 * (1 - price), 6) AS delta FROM trades")
def fee_friction(spark, d):
    parts = pricing.friction_breakdown(F.col("price"), "backtest")
    return rounded(a.trades(spark, d).select("id", pricing.paper_friction(F.col("price")).alias("paper"), pricing.backtest_friction(F.col("price")).alias("backtest"), parts["drift_fee_delta"].alias("delta")))


_CATEGORIES = list(pricing.FEE_RATES)


@query(
    "category_fees",
    f"WITH {a.TRADES_SQL}, rates AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', CAST({r} AS DOUBLE))" for i, (c, r) in enumerate(pricing.FEE_RATES.items())) + ") v(i, c, r)) "
    f"SELECT id, c AS category, round(r * (1 - price), 6) AS fee FROM trades JOIN rates ON l_suppkey % {len(_CATEGORIES)} = i",
)
def category_fees(spark, d):
    """The fee of each bet by its market's category, here dealt by supplier."""
    named = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("l_suppkey") % len(_CATEGORIES) + 1).cast("int"))
    t = a.trades(spark, d).withColumn("category", named)
    return rounded(t.select("id", "category", pricing.fee_ratio(F.col("price"), pricing.category_rate(F.col("category"))).alias("fee")))


@query("pnl_ratio", f"WITH {a.TRADES_SQL} SELECT id, round(CASE WHEN win = 1 THEN (1 - price) / price ELSE -1 END, 6) AS gross, round(CASE WHEN win = 1 THEN (1 - price) / price ELSE -1 END - 0.07 * (1 - price), 6) AS net FROM trades")
def pnl_ratio(spark, d):
    won = F.col("win") == 1
    return rounded(a.trades(spark, d).select("id", pricing.gross_ratio(won, F.col("price")).alias("gross"), pricing.net_ratio(won, F.col("price")).alias("net")))


@query("order_sizing", "SELECT o_orderkey, CASE WHEN round_even(o_totalprice * 0.001 + 0.003, 2) >= 1.0 THEN round(round_even(o_totalprice * 0.001 + 0.003, 2), 6) END AS size_usd FROM orders")
def order_sizing(spark, d):
    return rounded(a.table(spark, d, "orders").select("o_orderkey", pricing.order_size(F.col("o_totalprice") * 0.001 + 0.003, F.lit(1.0)).alias("size_usd")))


# --- scores

_PAY = "win / (price + 0.015) - 1"
_NEV = f"avg({_PAY}) - 0.07 * (1 - (avg(price) + 0.015))"


@query("nev", f"WITH {a.TRADES_SQL} SELECT factor, count(*) AS n, round(avg(win), 6) AS wr, round(avg(price), 6) AS ep, round({_NEV}, 6) AS nev FROM trades GROUP BY factor")
def nev(spark, d):
    return rounded(scoring.scorecard(a.trades(spark, d), ["factor"]).select("factor", "n", "wr", "ep", "nev"))


_WILSON = "((wr + 1 / (2 * n) - sqrt(wr * (1 - wr) / n + 1 / (4 * n * n))) / (1 + 1 / n))"


@query(
    "net_base_wilson",
    f"WITH {a.TRADES_SQL}, g AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n, avg(win) AS wr, avg(price) AS ep FROM trades GROUP BY 1) SELECT l_suppkey, round(wr / ep - 1, 6) AS base1, round(wr / ep - 1 - 0.07 * (1 - ep - 0.015), 6) AS net_base, round({_WILSON}, 6) AS wilson_lower, round({_WILSON} / ep - 1 - 0.07 * (1 - ep - 0.015), 6) AS net_base_wilson FROM g",
)
def net_base_wilson(spark, d):
    return rounded(scoring.scorecard(a.trades(spark, d), ["l_suppkey"]).select("l_suppkey", "base1", "net_base", "wilson_lower", "net_base_wilson"))


@query("eff_n", f"WITH {a.TRADES_SQL} SELECT factor, round(power(sum(p), 2) / greatest(sum(p * p), 1e-12), 3) AS eff_n FROM (SELECT factor, CASE WHEN win = 1 THEN 1 / (price + 0.015) - 1 END AS p FROM trades) GROUP BY factor")
def eff_n(spark, d):
    return rounded(scoring.scorecard(a.trades(spark, d), ["factor"]).select("factor", "eff_n"), digits=3)


@query(
    "drop5_nev",
    f"WITH {a.TRADES_SQL}, r AS (SELECT *, CASE WHEN win = 1 THEN row_number() OVER (PARTITION BY l_suppkey, win ORDER BY price, id) END AS rk FROM trades), k AS (SELECT l_suppkey, count(rk) AS w, round({_NEV.replace('avg(', 'avg(')}, 6) AS v FROM r WHERE rk IS NULL OR rk > 5 GROUP BY 1), c AS (SELECT l_suppkey, count(rk) AS w FROM r GROUP BY 1) "
    "SELECT c.l_suppkey, CASE WHEN c.w > 5 THEN v END AS drop5_nev FROM c LEFT JOIN k USING (l_suppkey)",
)
def drop5_nev(spark, d):
    return rounded(scoring.drop_cheapest_nev(a.trades(spark, d), ["l_suppkey"], ["id"]))


@query("wf_sign_frac", f"WITH {a.TRADES_SQL}, w AS (SELECT factor, week, count(*) AS n, {_NEV} AS v FROM trades GROUP BY 1, 2) SELECT factor, round(count(*) FILTER (n >= 10 AND v > 0) / CAST(nullif(count(*) FILTER (n >= 10), 0) AS DOUBLE), 6) AS wf_sign_frac, CAST(count(*) FILTER (n >= 10) AS BIGINT) AS n_weeks FROM w GROUP BY 1")
def wf_sign_frac(spark, d):
    return rounded(scoring.walk_forward(a.trades(spark, d), ["factor"]))


@query("valid_fraction", f"WITH {a.LEDGER_SQL} SELECT expr, round(count(pnl_ratio_paper_net) / CAST(count(*) AS DOUBLE), 6) AS valid_fraction FROM ledger GROUP BY 1")
def valid_fraction(spark, d):
    found = a.ledger(spark, d).groupBy("expr").agg(scoring.valid_fraction(F.count("pnl_ratio_paper_net"), F.count("*")).alias("valid_fraction"))
    return rounded(found)


_FIRES = f"WITH {a.TRADES_SQL}, fires AS (SELECT DISTINCT factor AS f, l_suppkey * 1000 + week AS k FROM trades), z AS (SELECT f, count(*) AS n FROM fires GROUP BY 1), b AS (SELECT x.f AS a, y.f AS b, count(*) AS n FROM fires x JOIN fires y ON x.k = y.k AND x.f < y.f GROUP BY 1, 2), p AS (SELECT b.a, b.b, za.n AS n_a, zb.n AS n_b, b.n AS n_both FROM b JOIN z za ON b.a = za.f JOIN z zb ON b.b = zb.f)"


def _fires(spark, d) -> DataFrame:
    return a.trades(spark, d).select("factor", (F.col("l_suppkey") * 1000 + F.col("week")).alias("cs"))


@query("jaccard", f"{_FIRES} SELECT a, b, n_both, round(n_both / CAST(n_a + n_b - n_both AS DOUBLE), 6) AS jaccard FROM p")
def jaccard(spark, d):
    return rounded(candidates.overlaps(_fires(spark, d)).select("a", "b", "n_both", "jaccard"))


@query("containment", f"{_FIRES} SELECT a, b, round(n_both / CAST(n_a AS DOUBLE), 6) AS containment_ab, round(n_both / CAST(n_b AS DOUBLE), 6) AS containment_ba FROM p")
def containment(spark, d):
    return rounded(candidates.overlaps(_fires(spark, d)).select("a", "b", "containment_ab", "containment_ba"))


_STREAMS = f"WITH {a.TRADES_SQL}, s AS (SELECT week, coalesce(sum(CASE WHEN factor = 'AF' THEN {_PAY} END), 0) AS x, coalesce(sum(CASE WHEN factor = 'AO' THEN {_PAY} END), 0) AS y FROM trades GROUP BY week)"


def _streams(spark, d) -> DataFrame:
    p = scoring.pay(F.col("win"), F.col("price"))
    leg = lambda f: F.coalesce(F.sum(F.when(F.col("factor") == f, p)), F.lit(0.0))
    return a.trades(spark, d).groupBy("week").agg(leg("AF").alias("x"), leg("AO").alias("y"))


@query("stream_corr", f"{_STREAMS} SELECT round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS corr FROM s")
def stream_corr(spark, d):
    return rounded(scoring.stream_corr(_streams(spark, d), "x", "y"))


@query("stream_corr_drop_k", f"{_STREAMS}, r AS (SELECT *, row_number() OVER (ORDER BY abs((x - (SELECT avg(x) FROM s)) * (y - (SELECT avg(y) FROM s))) DESC, week) AS rk FROM s) SELECT round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS corr FROM r WHERE rk > 5")
def stream_corr_drop_k(spark, d):
    return rounded(scoring.stream_corr(_streams(spark, d), "x", "y", drop=5, ties=["week"]))


@query(
    "gates_lenses",
    f"WITH {a.TRADES_SQL}, c AS (SELECT factor, count(*) AS n, avg(win) AS wr, avg(price) AS ep, {_NEV} AS nev FROM trades GROUP BY 1), w AS (SELECT factor, week, count(*) AS n, {_NEV} AS v FROM trades GROUP BY 1, 2), f AS (SELECT factor, count(*) FILTER (n >= 10 AND v > 0) / CAST(nullif(count(*) FILTER (n >= 10), 0) AS DOUBLE) AS sf, count(*) FILTER (n >= 10) AS nw FROM w GROUP BY 1) "
    "SELECT factor, nev > 0.10 AS ok_nev, n >= greatest(50, 0.02 * (SELECT count(*) FROM trades)) AS ok_hits, wr / ep - 1 - 0.07 * (1 - ep - 0.015) > 0.08 AS ok_base, coalesce(nw >= 4 AND sf >= 0.65, FALSE) AS ok_weeks, ep BETWEEN 0.35 AND 0.65 AS ok_price FROM c JOIN f USING (factor)",
)
def gates_lenses(spark, d):
    t = a.trades(spark, d)
    cards = scoring.scorecard(t, ["factor"]).join(scoring.walk_forward(t, ["factor"]), "factor")
    return scoring.lenses(cards, t.agg(F.count("*")).scalar()).select("factor", "ok_nev", "ok_hits", "ok_base", "ok_weeks", "ok_price")


# the choice one factor after the other, over factors by supplier and flag
_LEADERS = f"""WITH RECURSIVE {a.TRADES_SQL}, named AS (SELECT *, factor || ':' || CAST(l_suppkey % 40 AS VARCHAR) AS name FROM trades),
g AS (SELECT name, any_value(direction) AS direction, CAST(count(*) AS DOUBLE) AS n, avg(win) AS wr, avg(price) AS ep FROM named GROUP BY 1),
cards AS (SELECT name, direction, row_number() OVER (ORDER BY {_WILSON} / ep - 1 - 0.07 * (1 - ep - 0.015) DESC, name) AS i FROM g),
fires AS (SELECT DISTINCT name AS f, week AS k FROM named), z AS (SELECT f, count(*) AS n FROM fires GROUP BY 1),
both_ AS (SELECT x.f AS a, y.f AS b, count(*) AS n FROM fires x JOIN fires y ON x.k = y.k AND x.f <> y.f GROUP BY 1, 2),
near AS (SELECT a, b FROM both_ JOIN z za ON za.f = a JOIN z zb ON zb.f = b WHERE both_.n / CAST(za.n + zb.n - both_.n AS DOUBLE) > {{most}}),
better AS (SELECT c.i, any_value(c.name) AS name, list(o.name ORDER BY o.i) FILTER (o.name IS NOT NULL) AS over FROM cards c LEFT JOIN near ON near.a = c.name LEFT JOIN cards o ON o.name = near.b AND o.direction = c.direction AND o.i < c.i GROUP BY c.i),
greedy AS (SELECT 0 AS i, []::VARCHAR[] AS chosen UNION ALL
  SELECT b.i, CASE WHEN len(list_filter(coalesce(b.over, []), lambda x: list_contains(g.chosen, x))) > 0 THEN g.chosen ELSE list_append(g.chosen, b.name) END FROM greedy g JOIN better b ON b.i = g.i + 1),
final AS (SELECT chosen FROM greedy ORDER BY i DESC LIMIT 1)
SELECT name AS factor, coalesce(list_filter(coalesce(over, []), lambda x: list_contains(chosen, x))[1], name) AS leader FROM better, final"""
_MOST = 0.4


@query("leader_dedup", _LEADERS.format(most=_MOST))
def leader_dedup(spark, d):
    t = a.trades(spark, d).withColumn("factor", F.concat_ws(":", "factor", (F.col("l_suppkey") % 40).cast("string")))
    pairs = candidates.overlaps(t.select("factor", F.col("week").alias("cs")), least=_MOST)
    return scoring.leaders(scoring.scorecard(t, ["factor", "direction"]), pairs, most=_MOST)


# the last trades of a factor as a sorted list
_BOARD = """armed AS (SELECT label, expr, direction, status = 'live' AS live FROM roster WHERE status IN ('paper', 'live')
), per AS (
  SELECT label, expr, direction, live, count(*) AS n_fired, count(pnl_ratio_paper_net) AS n_pap,
    count(*) FILTER (pnl_ratio_paper_net IS NOT NULL AND up_won = CASE direction WHEN 'UP' THEN 1 ELSE 0 END) AS hits,
    avg(pnl_ratio_paper_net) AS m, stddev_samp(pnl_ratio_paper_net) AS sd, avg(entry_price_paper) AS e, stddev_pop(entry_price_paper) AS e_sd, avg(entry_price_live) AS le,
    list(pnl_ratio_paper_net ORDER BY settled_at_s DESC, id DESC)[1:50] AS newest, count(pnl_ratio_live_net) AS n_live, avg(pnl_ratio_live_net) AS lm,
    sum(pnl_usd_live_net) AS usd, avg(pnl_ratio_paper_net - pnl_ratio_live_net) AS gap, max(settled_at_s) AS last_settle_s
  FROM ledger JOIN armed USING (expr) WHERE ledger.status = 'settled' GROUP BY ALL
), board AS (
  SELECT label, expr, direction, live, n_fired, n_pap, CASE WHEN n_pap > 0 THEN round(hits / CAST(n_pap AS DOUBLE), 3) END AS wr, round(m, 4) AS pap_nev,
    CASE WHEN n_pap > 1 AND sd > 0 THEN round(m / sd * sqrt(n_pap), 2) END AS pap_t, round(e, 4) AS pap_ep, round(coalesce(e_sd, 0), 4) AS ep_std, round(le, 4) AS live_ep,
    round(list_avg(newest), 4) AS nev50, n_live, round(lm, 4) AS live_nev, round(usd, 2) AS live_usd, round(gap, 4) AS drift, last_settle_s FROM per
)"""


@query("dashboard_agg", f"WITH {a.LEDGER_SQL}, {_BOARD} SELECT * FROM board")
def dashboard_agg(spark, d):
    return book.create_dashboard(a.ledger(spark, d), a.roster(spark, d))


@query("graduation", f"WITH {a.LEDGER_SQL}, {_BOARD}, w AS (SELECT factor AS expr, count(DISTINCT week) AS weeks FROM trades GROUP BY 1) SELECT label, weeks AS n_weeks, CASE WHEN coalesce(pap_nev >= 0.05 AND pap_t > 1.65, FALSE) THEN 'graduate' WHEN n_pap >= 800 OR weeks >= 10 THEN 'kill' ELSE 'wait' END AS verdict FROM board JOIN w USING (expr)")
def graduation(spark, d):
    weeks = a.trades(spark, d).groupBy(F.col("factor").alias("expr")).agg(F.count_distinct("week").alias("n_weeks"))
    board = book.dashboard(a.ledger(spark, d), a.roster(spark, d)).join(weeks, "expr")
    return scoring.graduation(board).select("label", "n_weeks", "verdict")


@query(
    "trigger_append",
    """WITH hits AS (SELECT DISTINCT o_orderpriority AS expr, CAST(epoch(o_orderdate) AS BIGINT) AS candle_start_s FROM orders WHERE o_orderstatus <> 'F'),
old AS (SELECT o_orderkey AS id, o_orderpriority AS expr, CAST(epoch(o_orderdate) AS BIGINT) AS candle_start_s, 'settled' AS status, CAST(NULL AS BIGINT) AS opened_at_s FROM orders WHERE o_orderstatus = 'F'),
fresh AS (SELECT h.* FROM hits h ANTI JOIN old o ON h.expr = o.expr AND h.candle_start_s = o.candle_start_s)
SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY candle_start_s, expr), expr, candle_start_s, 'open', 1800000000 FROM fresh""",
)
def trigger_append(spark, d):
    o = a.table(spark, d, "orders")
    start = parsing.epoch_seconds(F.col("o_orderdate"))
    old = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("expr"), start.alias("candle_start_s"), F.lit("settled").alias("status"), F.lit(None).cast("long").alias("opened_at_s"))
    hits = o.where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("expr"), start.alias("candle_start_s"), F.lit(True).alias("hit"))
    return book.append_triggers(old, hits, 1_800_000_000)


_REALTIME = "bn_chg_pct_pre_300__zs24h > -1 & bn_cvd_pre_300 < 1e9"


@query(
    "realtime_row",
    f"""WITH {a.SPINE_SQL}, seg AS ({_SEG.format(w=300 * a.UNIT)}), f AS (SELECT s.cs, {_CHG} AS chg, {_CVD} AS cvd FROM spine s LEFT JOIN seg USING (cs) GROUP BY s.cs),
latest AS (SELECT * FROM f ORDER BY cs DESC LIMIT 1), past AS (SELECT f.chg FROM f, latest WHERE f.cs < latest.cs AND f.chg IS NOT NULL ORDER BY f.cs DESC LIMIT 288),
z AS (SELECT cs, chg, cvd, CASE WHEN (SELECT count(*) FROM past) >= 50 THEN (chg - (SELECT avg(chg) FROM past)) / (SELECT stddev_samp(chg) FROM past) END AS z FROM latest)
SELECT cs, round(chg, 6) AS bn_chg_pct_pre_300, round(cvd, 6) AS bn_cvd_pre_300, round(z, 5) AS bn_chg_pct_pre_300__zs24h, coalesce(z > -1, FALSE) AND coalesce(cvd < 1e9, FALSE) AS hit FROM z""",
)
def realtime_row(spark, d):
    bars, spine = a.bars(spark, d), a.spine(spark, d).select("cs")
    now = spine.agg(F.max("cs")).first()[0]
    names = ("bn_chg_pct_pre_300", "bn_cvd_pre_300")
    past = bar_features(spine, bars, a.UNIT).select("cs", F.explode(F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).alias("value")) for n in names])).alias("x"))
    row, _ = live.realtime_row(_REALTIME, now, past.select("x.feature_name", "cs", "x.value"), bars, a.UNIT)
    return rounded(row.withColumn("bn_chg_pct_pre_300__zs24h", F.round("bn_chg_pct_pre_300__zs24h", 5)))


_CUTS = [i / 10 for i in range(1, 10)]


@query("threshold_grid", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS cut, round(quantile_cont({c}, {q}), 6) AS threshold FROM lineitem" for c in ("l_quantity", "l_extendedprice") for q in _CUTS))
def threshold_grid(spark, d):
    return rounded(candidates.thresholds(a.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], _CUTS), "cut")


@query("point_lookup", "WITH asked AS (SELECT min(o_orderkey) AS asked FROM orders UNION ALL SELECT max(o_orderkey) FROM orders UNION ALL SELECT max(o_orderkey) + 1 FROM orders) SELECT asked, o_orderstatus, o_totalprice FROM asked LEFT JOIN orders ON o_orderkey = asked")
def point_lookup(spark, d):
    """Three keys of a stored table, the last of which is not there; each opens one bucket."""
    orders = a.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = BucketedTable(spark, work_dir(spark, "orders"))
    store.create(orders, ["o_orderkey"], buckets=32)
    least, most = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    keys = [least, most, most + 1]
    asked = spark.createDataFrame([(k,) for k in keys], "asked long")
    return asked.join(store.lookup(*[(k,) for k in keys]), F.col("asked") == F.col("o_orderkey"), "left").drop("o_orderkey")


_SCANNED = ("l_quantity", "l_extendedprice", "l_tax")


@query(
    "threshold_scan",
    f"""WITH rows_ AS (SELECT l_quantity, l_extendedprice, l_tax, (CAST(epoch(l_shipdate) AS BIGINT) + 259200) // 604800 AS week, CAST(0.35 AS DOUBLE) + CAST(3.0 AS DOUBLE) * l_discount AS price, CAST(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS DOUBLE) AS win FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
long AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS v, week, price, win FROM rows_" for c in _SCANNED)}),
cuts AS (SELECT name, unnest({_CUTS}::DOUBLE[]) AS cut, unnest(quantile_cont(v, {_CUTS})) AS threshold FROM long GROUP BY name),
hits AS (SELECT name, cut, threshold, op, week, price, win FROM long JOIN cuts USING (name), (SELECT unnest(['<', '>']) AS op) WHERE (op = '<' AND v < threshold) OR (op = '>' AND v > threshold)),
weeks AS (SELECT name, cut, op, count(*) FILTER (n >= 10 AND v > 0) / CAST(nullif(count(*) FILTER (n >= 10), 0) AS DOUBLE) AS sf, count(*) FILTER (n >= 10) AS nw FROM (SELECT name, cut, op, week, count(*) AS n, {_NEV} AS v FROM hits GROUP BY ALL) GROUP BY ALL),
g AS (SELECT name, cut, threshold, op, CAST(count(*) AS DOUBLE) AS n, avg(win) AS wr, avg(price) AS ep, {_NEV} AS nev, sum(CASE WHEN win = 1 THEN {_PAY} END) AS p1, sum(CASE WHEN win = 1 THEN ({_PAY}) * ({_PAY}) END) AS p2 FROM hits GROUP BY ALL)
SELECT name AS "column", cut, round(threshold, 6) AS threshold, op, CAST(n AS BIGINT) AS n, round(wr, 6) AS wr, round(ep, 6) AS ep, round(nev, 6) AS nev, round(p1 * p1 / greatest(p2, 1e-12), 3) AS eff_n, round(wr / ep - 1 - 0.07 * (1 - ep - 0.015), 6) AS net_base, round({_WILSON} / ep - 1 - 0.07 * (1 - ep - 0.015), 6) AS net_base_wilson, round(sf, 6) AS wf_sign_frac, CAST(nw AS BIGINT) AS n_weeks,
  nev > 0.10 AS ok_nev, n >= greatest(50, 0.02 * (SELECT count(*) FROM rows_)) AS ok_hits, wr / ep - 1 - 0.07 * (1 - ep - 0.015) > 0.08 AS ok_base, coalesce(nw >= 4 AND sf >= 0.65, FALSE) AS ok_weeks, ep BETWEEN 0.35 AND 0.65 AS ok_price
FROM g JOIN weeks USING (name, cut, op)""",
)
def threshold_scan(spark, d):
    """All one-threshold factors over three columns, scored and gated, from one pass."""
    found = candidates.threshold_scan(a.trades(spark, d, *_SCANNED), _SCANNED, _CUTS).drop("n_ok")
    return rounded(found.withColumn("eff_n", F.round("eff_n", 3)), "cut")


_NAMED_STREAMS = f"""WITH {a.TRADES_SQL}, named AS (SELECT factor || ':' || CAST(l_suppkey % 40 AS VARCHAR) AS f, week, {_PAY} AS v FROM trades),
w AS (SELECT DISTINCT week FROM named), fs AS (SELECT DISTINCT f FROM named), sums AS (SELECT f, week, sum(v) AS v FROM named GROUP BY ALL), s AS (SELECT f, week, coalesce(v, 0) AS v FROM fs CROSS JOIN w LEFT JOIN sums USING (f, week)),
means AS (SELECT f, avg(v) AS m FROM s GROUP BY f),
ranked AS (SELECT x.f AS a, y.f AS b, x.v AS x, y.v AS y, row_number() OVER (PARTITION BY x.f, y.f ORDER BY abs((x.v - p.m) * (y.v - q.m)) DESC, x.week) AS rk FROM s x JOIN s y ON x.week = y.week AND x.f < y.f JOIN means p ON p.f = x.f JOIN means q ON q.f = y.f)
SELECT a, b, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS corr, round(coalesce((covar_pop(x, y) FILTER (rk > 5)) / nullif((stddev_pop(x) FILTER (rk > 5)) * (stddev_pop(y) FILTER (rk > 5)), 0), 0), 6) AS corr_drop5 FROM ranked GROUP BY a, b"""


@query("stream_corr_matrix", _NAMED_STREAMS)
def stream_corr_matrix(spark, d):
    """The weekly payoff streams of all pairs of some 160 factors, with all weeks and without each pair's five weightiest."""
    t = a.trades(spark, d).select(F.concat_ws(":", "factor", (F.col("l_suppkey") % 40).cast("string")).alias("factor"), "week", scoring.pay(F.col("win"), F.col("price")).alias("value"))
    found = candidates.correlations(t).join(candidates.correlations(t, drop=5).withColumnRenamed("corr", "corr_drop5"), ["a", "b"])
    return rounded(found)


@query("constraint_check", "SELECT 'price' AS \"check\", CAST(count(*) FILTER (NOT l_extendedprice > 5000) AS BIGINT) AS \"rows\" FROM lineitem UNION ALL SELECT 'flag', CAST(count(*) FILTER (NOT l_returnflag IN ('A', 'N')) AS BIGINT) FROM lineitem")
def constraint_check(spark, d):
    return constraint_violations(a.table(spark, d, "lineitem"), {"price": "l_extendedprice > 5000", "flag": "l_returnflag IN ('A', 'N')"})


# --- streams, each with its batch twin as SQL


@query("stream_latest_state", "SELECT event_type, last(event_id ORDER BY event_id) AS event_id, last(value ORDER BY event_id) AS value FROM events GROUP BY 1")
def stream_latest_state(spark, d):
    stream = _pieces(a.table(spark, d, "events"), "event_id")
    return drain(live.latest_by_arrival(stream, "event_type", ["event_id", "value"], "event_id"), "update", ["event_type"], "latest")


def _pieces(rows: DataFrame, order: str, batches: int = 3, spread: int = 4) -> DataFrame:
    """Rows as a stream in ``order``, ``spread`` files to a batch, written in one pass."""
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession, "pieces")
    rows.repartitionByRange(batches * spread, order).sortWithinPartitions(order).write.parquet(f"{folder}/rows.parquet")
    date_in_order(spark, f"{folder}/rows.parquet")
    return read_files(spark, folder, "rows", files_per_batch=spread)


@query("stream_dedup", "SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS k, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events) GROUP BY 1")
def stream_dedup(spark, d):
    """Each (user, type) once a day; the state of a day expires while the stream goes on."""
    stream = _pieces(a.table(spark, d, "events"), "event_id").withColumn("at", F.col("ts").cast("timestamp")).withColumn("day", F.date_trunc("day", "ts"))
    fresh = live.once(stream, ["user_id", "event_type", "day"], "at", "1 day").select("user_id", "event_type")
    found = drain(fresh, "append", name="once")
    return found.groupBy(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("k")).agg(F.count("*").alias("n"))


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling(spark, d):
    stream = _pieces(a.table(spark, d, "events"), "event_id")
    found = drain(live.candles(stream, "ts", 3_600, late=None, by=["event_type"]), "update", ["start", "event_type"], "candles")
    return found.withColumn("total", F.round("total", 6))


@query("stream_settle", "SELECT CAST(count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS BIGINT) AS n_settled, CAST(count(*) FILTER (NOT (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0)) AS BIGINT) AS n_open FROM orders")
def stream_settle(spark, d):
    folder = work_dir(spark, "settle")
    rows = a.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("condition_id"), F.lit("UP").alias("direction"), F.lit("open").alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(10**9).cast("long").alias("candle_start_s"), F.lit(0.5).alias("entry_price_paper"),
    )
    kinds = schema("ledger")
    rows = complete_columns(rows, kinds.names, "string").select(*[F.col(f.name).cast(f.dataType) for f in kinds])
    ledger = BucketedTable(spark, f"{folder}/ledger")
    ledger.create(rows, ["condition_id"], buckets=16)
    stream = _pieces(a.table(spark, d, "orders"), "o_orderkey").select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("condition_id"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(1)).alias("up_won"))
    live.settle_batches(stream, ledger, 10_000, f"{folder}/checkpoint").start().awaitTermination()
    done = ledger.read()
    return done.agg(F.count_if(F.col("status") == "settled").alias("n_settled"), F.count_if(F.col("status") == "open").alias("n_open"))


@query(
    "stream_subscriptions",
    f"WITH {a.SPINE_SQL}, rolls AS (SELECT DISTINCT t - t % 18000 AS start FROM ev) SELECT start, side || CAST(cs AS VARCHAR) AS asset_id FROM rolls JOIN spine ON cs IN (start, start + 18000), (SELECT unnest(['u', 'd']) AS side)",
)
def stream_subscriptions(spark, d):
    """What a feed subscribes to when each candle begins: its tokens and the next one's."""
    token = lambda x: F.concat(F.lit(x), F.col("cs").cast("string"))
    spine = a.spine(spark, d).select("cs", token("u").alias("up_token"), token("d").alias("down_token"))
    ticks = _pieces(a.events(spark, d).select(F.col("t").alias("now_s")), "now_s")
    return drain(live.subscriptions(ticks, spine, a.CANDLE), name="rolls")


@query(
    "stream_bars",
    f"""WITH {a.EVENTS_SQL}, b AS (SELECT event_type, t - t % 3600 AS ts, first(value ORDER BY t, event_id) AS open, last(value ORDER BY t, event_id) AS close, sum(value) AS volume, count(*) AS n_trades FROM ev GROUP BY 1, 2)
SELECT event_type AS market, ts * 1000 AS open_ts_ms, open, close, round(volume, 6) AS volume, n_trades FROM b WHERE ts < (SELECT max(ts) FROM b x WHERE x.event_type = b.event_type)""",
)
def stream_bars(spark, d):
    """Bars of a live paged feed, a folder per event type: each once and complete, the last one still forming."""
    folder = work_dir(spark, "feed")
    a.land_bars(spark, d, folder)
    kind = "open_ts_ms long, open double, close double, volume double, n_trades long, market string"
    stream = pages.follow_feed(spark, "bars", folder, columns=kind, name_column="market", batch_pages="8")
    return rounded(drain(stream, name="bars", growing=True))


# a factor per user; every fourth event announces a candle that has been over for one candle already
_ANNOUNCED = f"WITH {a.EVENTS_SQL}, said AS (SELECT 'f' || CAST(user_id AS VARCHAR) AS expr, t AS now_s, 60 * (user_id % 200) AS off, t - t % 18000 - CASE WHEN event_id % 4 = 0 THEN 36000 ELSE 0 END AS cs FROM ev)"


def _announced(spark, d) -> DataFrame:
    e = a.events(spark, d)
    start = F.col("t") - F.col("t") % a.CANDLE - F.when(F.col("event_id") % 4 == 0, 2 * a.CANDLE).otherwise(0)
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("expr"), start.alias("cs"), F.lit("UP").alias("direction"), (60 * (F.col("user_id") % 200)).alias("entry_offset_s"), F.col("t").alias("now_s"))


def _fired_before(spark, d) -> DataFrame:
    """What the ledger of an earlier run holds: the candles of the first three days."""
    return _announced(spark, d).where(F.col("now_s") < 1_704_067_200 + 3 * 86_400).select("expr", "cs").distinct()


@query(
    "stream_triggers",
    f"""{_ANNOUNCED}, fired AS (SELECT DISTINCT expr, cs FROM said WHERE now_s < 1704067200 + 3 * 86400)
SELECT DISTINCT expr, cs, 'UP' AS direction, cs + off AS due_s FROM said ANTI JOIN fired USING (expr, cs) WHERE now_s <= cs + 18000 AND cs + off <= (SELECT max(now_s) FROM said)""",
)
def stream_triggers(spark, d):
    """Announced pairs fire once each at their time, by timers; pairs of the ledger and late ones never."""
    with state_store(spark):
        return drain(stateful.timed_triggers(_pieces(_announced(spark, d), "now_s"), _fired_before(spark, d), a.CANDLE, "0 seconds"), name="triggers")


_SIDES = {"up": "click", "dn": "view"}


@query(
    "stream_asof",
    f"WITH {a.SPINE_SQL}, " + ", ".join(f"{a.GAUGE_SQL.format(name=s, kind=k)}" for s, k in _SIDES.items())
    + ", due AS (SELECT cs, cs + 9000 AS at FROM spine), " + ", ".join(f"{s}q AS (SELECT d.cs, q.ts AS ts_{s}, q.value AS bid_{s} FROM due d ASOF LEFT JOIN {s} q ON d.at >= q.ts)" for s in _SIDES)
    + " SELECT cs, ts_up, bid_up, ts_dn, bid_dn FROM upq JOIN dnq USING (cs)",
)
def stream_asof(spark, d):
    """Both sides' quotes as they stood when each candle's trigger was due, from one stream of quotes and one of triggers."""
    events = a.events(spark, d)
    quotes = events.where(F.col("event_type").isin(*_SIDES.values())).select(F.col("event_type").alias("key"), F.col("t").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("bid"))
    due = a.spine(spark, d).select((F.col("cs") + 9_000).alias("ts"), F.col("cs").cast("string").alias("probe"), F.explode(F.array(*map(F.lit, _SIDES.values()))).alias("key"))
    # a last row without a side, far enough on for all probes to be answered
    end = events.agg((F.max("t") + 2 * 86_400).alias("ts")).select(F.lit("end").alias("key"), "ts", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("bid"))
    with state_store(spark):
        found = drain(stateful.asof_stream(_pieces(due, "ts"), _pieces(quotes.unionByName(end), "ts"), ["bid"], "1 day"), name="asof")
    sides = [F.max(F.when(F.col("key") == k, F.col(c))).alias(f"{n}_{s}") for s, k in _SIDES.items() for c, n in (("quote_ts", "ts"), ("bid", "bid"))]
    return found.groupBy(F.col("probe").cast("long").alias("cs")).agg(*sides)


_OVER288 = "(ORDER BY ts ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING)"


@query(
    "stream_rolling",
    f"""WITH {a.BARS_SQL}, n AS (SELECT ts, close, row_number() OVER (ORDER BY ts) AS i FROM bars),
ranks AS (SELECT p.ts, CASE WHEN count(*) >= 50 THEN round((count(*) FILTER (q.close < p.close) + (count(*) FILTER (q.close = p.close) + 1) / 2.0) / count(*), 6) END AS rank24h FROM n p JOIN n q ON q.i BETWEEN p.i - 287 AND p.i GROUP BY p.ts)
SELECT 'close' AS feature_name, ts AS cs, close AS value, CASE WHEN count(close) OVER {_OVER288} >= 50 THEN round((close - avg(close) OVER {_OVER288}) / nullif(stddev_samp(close) OVER {_OVER288}, 0), 5) END AS zs24h, rank24h FROM bars JOIN ranks USING (ts)""",
)
def stream_rolling(spark, d):
    """Scores of a stream of bars against the history that it has built up so far."""
    bars = a.bars(spark, d).select(F.lit("close").alias("feature_name"), F.col("ts").alias("cs"), F.col("close").alias("value"))
    specs = [s for s in STANDARD if s.suffix in ("zs24h", "rank24h")]
    with state_store(spark):
        found = drain(stateful.rolling_stream(_pieces(bars, "cs", spread=1), specs), name="rolling")
    return rounded(found.withColumn("zs24h", F.round("zs24h", 5)), "value")


@query("book_quotes", "SELECT event_type AS asset_id, last(event_id ORDER BY event_id) AS ts_ms, last(value ORDER BY event_id) AS best_bid FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def book_quotes(spark, d):
    e = a.table(spark, d, "events").withColumn("id", F.col("event_id").cast("string")).withColumn("v", F.col("value").cast("string"))
    book_msg = F.concat(F.lit('{"event_type":"book","asset_id":"'), F.col("event_type"), F.lit('","timestamp":"'), F.col("id"), F.lit('","bids":[{"price":"0"},{"price":"'), F.col("v"), F.lit('"}],"asks":[]}'))
    change = F.concat(F.lit('[{"event_type":"price_change","timestamp":"'), F.col("id"), F.lit('","price_changes":[{"asset_id":"'), F.col("event_type"), F.lit('","best_bid":"'), F.col("v"), F.lit('"}]}]'))
    frames = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, book_msg).when(F.col("event_id") % 4 == 3, F.lit("not json")).otherwise(change).alias("frame"))
    return live.latest_by_arrival(live.quotes(frames), "asset_id", ["ts_ms", "best_bid"], "seq")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard over the ledger."""
    return dashboard_agg(spark, folder)
