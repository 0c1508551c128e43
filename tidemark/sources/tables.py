"""Stored tables: scans, optional ones, schemas, missing values."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.operators.upsert import exists

log = logging.getLogger(__name__)

# The stored tables' columns.
SCHEMAS = {
    "events": "cid string, slug string, candle_start long, candle_end long, up_token string, down_token string, up_won int, fetched_at long, era string, raw_event string",
    "bars": "open_ts_ms long, open double, high double, low double, close double, volume double, quote_volume double, n_trades long, taker_buy_volume double, taker_buy_quote_volume double, fetched_at long",
    "funding": "funding_ts_ms long, funding_rate double, mark_price double, fetched_at long",
    "open_interest": "ts_ms long, sum_open_interest double, sum_open_interest_value double, fetched_at long",
    "open_interest_5m": "ts_ms long, sum_open_interest double, sum_oi_value double, ingested_at long",
    "top_account_ratio": "ts_ms long, long_account double, short_account double, long_short_ratio double, fetched_at long",
    "top_position_ratio": "ts_ms long, long_account double, short_account double, long_short_ratio double, fetched_at long",
    "global_account_ratio": "ts_ms long, long_account double, short_account double, long_short_ratio double, fetched_at long",
    "trades": "cid string, ts long, side string, price double, size double, asset string, proxy_wallet string, tx_hash string",
    "roster": "expr string, label string, fam string, base string, transform string, tail string, thresh double, n_legs int, direction string, entry_offset_s int, slippage_cap double, bankroll_frac double, status string, armed_at long",
    "feature_history": "feature_name string, cs long, value double",
    "ledger": (
        "id long, expr string, direction string, slug string, condition_id string, up_token string, down_token string, candle_start_s long, entry_offset_s long,"
        " opened_at_s long, settled_at_s long, book_bid_up double, book_ask_up double, book_bid_dn double, book_ask_dn double, book_ts_ms_up long, book_ts_ms_dn long,"
        " entry_price_paper double, pnl_ratio_paper double, pnl_ratio_paper_net double, order_id string, order_status_live string, tx_hash_live string,"
        " entry_price_live double, size_usd_live double, shares_live double, fee_usd_live double, pnl_ratio_live double, pnl_ratio_live_net double,"
        " pnl_usd_live double, pnl_usd_live_net double, redeem_tx string, pnl_ratio_drift_live_paper double, status string, up_won int, error_msg string"
    ),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: NaN compares differently in Spark."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    df = nan_to_null(df.select(*columns) if columns else df)
    return df.orderBy(*order) if order else df


def read_optional(spark: SparkSession, path: str, empty: str | StructType) -> DataFrame:
    """The table, or an empty one of the given schema where nothing is stored."""
    if exists(spark, path):
        return read_table(spark, path)
    log.warning("no table at %s", path)
    return spark.createDataFrame([], empty)


def column_names(spark: SparkSession, path: str, without: Sequence[str] = ("cid", "cs", "era", "up_won")) -> list[str]:
    """A stored table's columns, from its schema alone: what factors may name."""
    return [c for c in spark.read.parquet(path).columns if c not in without]


def complete_columns(df: DataFrame, names: Sequence[str], kind: str = "double") -> DataFrame:
    """``names`` in order, those that ``df`` lacks as null."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(kind).alias(n) for n in names])


def constraint_violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """``check, rows`` for SQL conditions; a null condition holds, as in CHECK constraints."""
    counts = df.agg(*[F.count_if(F.expr(f"NOT ({c})")).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks])).alias("x")).select("x.*")
