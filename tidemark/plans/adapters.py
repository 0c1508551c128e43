"""The star-schema test tables seen as bars, candles, gauges, prints and a ledger.

An hour stands for a minute: bars are hourly and a candle lasts five of them.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import epoch_seconds
from tidemark.functions.pricing import fee_ratio, gross_ratio
from tidemark.operators.bars import BAR
from tidemark.sources.folders import filesystem, qualified

HOUR, CANDLE, UNIT = 3_600, 18_000, 60


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", epoch_seconds(F.col("ts")).alias("t"), "user_id", "event_type", "value", "props")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct("t", "event_id")
    found = events(spark, folder).groupBy((F.col("t") - F.col("t") % HOUR).alias("ts")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"),
        F.sum(F.col("value") * F.col("value")).alias("quote_volume"),
        F.coalesce(F.sum(F.when(F.col("event_type").isin("purchase", "click"), F.col("value"))), F.lit(0.0)).alias("taker_buy_volume"),
        F.count("*").alias("n_trades"),
    )
    return found.select(*BAR)


def spine(spark: SparkSession, folder: str) -> DataFrame:
    cs = F.col("t") - F.col("t") % CANDLE
    place = (F.col("cs") / CANDLE).cast("long")
    found = events(spark, folder).select(cs.alias("cs")).distinct()
    won = F.when(place % 7 != 0, (place % 2).cast("int"))
    return found.select(F.concat(F.lit("c"), F.col("cs").cast("string")).alias("cid"), "cs", won.alias("up_won"))


def gauge(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One event type as an irregular gauge; of events of one second the last counts."""
    found = events(spark, folder).where(F.col("event_type") == kind)
    return found.groupBy(F.col("t").alias("ts")).agg(F.max_by("value", "event_id").alias("value"))


def prints(spark: SparkSession, folder: str) -> DataFrame:
    """Events as prints of their candle's market; the event type is the asset."""
    found = events(spark, folder)
    cid = F.concat(F.lit("c"), (F.col("t") - F.col("t") % CANDLE).cast("string"))
    return found.select(cid.alias("cid"), F.col("event_type").alias("asset"), F.col("t").alias("ts"), F.col("value").alias("price"), F.lit("BUY").alias("side"), F.col("event_id").alias("ord"))


def trades(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Line items as settled bets: a price from the discount, an outcome from the order, and ``more`` of their columns."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat("l_returnflag", "l_linestatus").alias("factor"),
        F.when(F.col("l_returnflag") == "R", "DOWN").otherwise("UP").alias("direction"),
        epoch_seconds(F.col("l_shipdate")).alias("settled_at_s"),
        F.floor((epoch_seconds(F.col("l_shipdate")) + 259_200) / 604_800).alias("week"),
        (F.lit(0.35) + F.lit(3.0) * F.col("l_discount")).alias("price"),
        (F.col("o_orderstatus") != "F").cast("int").alias("win"),
        "l_orderkey",
        "l_suppkey",
        *more,
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    won = F.col("win") == 1
    up = F.when(F.col("direction") == "UP", F.col("win")).otherwise(F.lit(1) - F.col("win"))
    live = F.col("l_orderkey") % 2 == 0
    net = gross_ratio(won, F.col("price")) - fee_ratio(F.col("price"))
    found = trades(spark, folder).withColumn("net", net)
    return found.select(
        "id",
        F.col("factor").alias("expr"),
        "settled_at_s",
        F.lit("settled").alias("status"),
        up.alias("up_won"),
        F.col("price").alias("entry_price_paper"),
        F.when(live, F.col("price") + F.lit(0.01)).alias("entry_price_live"),
        F.when(F.col("id") % 11 != 0, F.col("net")).alias("pnl_ratio_paper_net"),
        F.when(live, F.col("net") - F.lit(0.02)).alias("pnl_ratio_live_net"),
        F.when(live, (F.col("net") - F.lit(0.02)) * F.lit(1.7)).alias("pnl_usd_live_net"),
    )


def roster(spark: SparkSession, folder: str) -> DataFrame:
    found = trades(spark, folder).select("factor", "direction").distinct()
    status = F.when(F.col("factor") == "NO", "killed").when(F.col("factor") == "AF", "live").otherwise("paper")
    return found.select(F.concat(F.lit("f_"), F.col("factor")).alias("label"), F.col("factor").alias("expr"), "direction", status.alias("status"))


def land_bars(spark: SparkSession, folder: str, path: str, page_rows: int = 50) -> None:
    """The hourly bars of each event type as pages of a feed, a folder per type.

    A page begins with the last two bars of the one before and ends with one that is still
    forming, of half its volume.
    """
    order = F.struct("t", "event_id")
    found = events(spark, folder).groupBy("event_type", (F.col("t") - F.col("t") % HOUR).alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("n")
    )
    root = qualified(spark, path)

    def write(part: pa.Table) -> pa.Table:
        rows = part.sort_by("ts").to_pylist()
        files, where = filesystem(f"{root}/{rows[0]['event_type']}")
        files.create_dir(where, recursive=True)
        for number, at in enumerate(range(0, len(rows), page_rows)):
            page = [[r["ts"] * 1_000, r["open"], r["close"], r["volume"], r["n"]] for r in rows[max(0, at - 2) : at + page_rows]]
            page[-1][3] /= 2
            with files.open_output_stream(f"{where}/{number}.json") as f:
                f.write(json.dumps(page).encode())
        return pa.table({"pages": [number + 1]})

    found.groupBy("event_type").applyInArrow(write, "pages long").agg(F.sum("pages")).collect()


EVENTS_SQL = "ev AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id, event_type, value, props FROM events)"
BARS_SQL = f"""{EVENTS_SQL}, bars AS (
  SELECT t - t % 3600 AS ts, first(value ORDER BY t, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY t, event_id) AS close,
    sum(value) AS volume, sum(value * value) AS quote_volume,
    coalesce(sum(CASE WHEN event_type IN ('purchase', 'click') THEN value END), 0.0) AS taker_buy_volume, count(*) AS n_trades
  FROM ev GROUP BY 1)"""
SPINE_SQL = f"""{BARS_SQL}, spine AS (
  SELECT 'c' || CAST(cs AS VARCHAR) AS cid, cs, CASE WHEN (cs // 18000) % 7 <> 0 THEN CAST((cs // 18000) % 2 AS INTEGER) END AS up_won
  FROM (SELECT DISTINCT t - t % 18000 AS cs FROM ev))"""
GAUGE_SQL = """{name} AS (SELECT t AS ts, last(value ORDER BY event_id) AS value FROM ev WHERE event_type = '{kind}' GROUP BY 1)"""
TRADES_SQL = """trades AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus AS factor, CASE WHEN l_returnflag = 'R' THEN 'DOWN' ELSE 'UP' END AS direction,
    CAST(epoch(l_shipdate) AS BIGINT) AS settled_at_s, (CAST(epoch(l_shipdate) AS BIGINT) + 259200) // 604800 AS week,
    CAST(0.35 AS DOUBLE) + CAST(3.0 AS DOUBLE) * l_discount AS price, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS win, l_orderkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LEDGER_SQL = f"""{TRADES_SQL}, netted AS (
  SELECT *, CASE WHEN win = 1 THEN (1 - price) / price ELSE -1 END - CAST(0.07 AS DOUBLE) * (1 - price) AS net FROM trades
), ledger AS (
  SELECT id, factor AS expr, settled_at_s, 'settled' AS status, CASE WHEN direction = 'UP' THEN win ELSE 1 - win END AS up_won, price AS entry_price_paper,
    CASE WHEN l_orderkey % 2 = 0 THEN price + CAST(0.01 AS DOUBLE) END AS entry_price_live, CASE WHEN id % 11 <> 0 THEN net END AS pnl_ratio_paper_net,
    CASE WHEN l_orderkey % 2 = 0 THEN net - CAST(0.02 AS DOUBLE) END AS pnl_ratio_live_net,
    CASE WHEN l_orderkey % 2 = 0 THEN (net - CAST(0.02 AS DOUBLE)) * CAST(1.7 AS DOUBLE) END AS pnl_usd_live_net
  FROM netted
), roster AS (
  SELECT DISTINCT 'f_' || factor AS label, factor AS expr, direction, CASE factor WHEN 'NO' THEN 'killed' WHEN 'AF' THEN 'live' ELSE 'paper' END AS status FROM trades)"""
