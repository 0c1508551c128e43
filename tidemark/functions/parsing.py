"""Tolerant decoding of JSON payloads, candle names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDLE_SECONDS = 300

MARKET = "struct<conditionId:string,closed:boolean,clobTokenIds:string,outcomePrices:string>"
EVENT = f"struct<slug:string,markets:array<{MARKET}>>"
FILL = "struct<success:boolean,status:string,orderID:string,makingAmount:string,takingAmount:string,transactionsHashes:array<string>,errorMsg:string>"
MESSAGE = (
    "struct<event_type:string,asset_id:string,timestamp:string,bids:array<struct<price:string>>,asks:array<struct<price:string>>,"
    "price_changes:array<struct<asset_id:string,best_bid:string,best_ask:string>>>"
)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone (UTC), whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


def millis_to_seconds(ms: Column) -> Column:
    """Integer division, as the stored times demand."""
    return ((ms - F.pmod(ms, F.lit(1000))) / 1000).cast("long")


def candle_start(t: Column, seconds: int = CANDLE_SECONDS) -> Column:
    return (t - F.pmod(t, F.lit(seconds))).cast("long")


def candle_slug(prefix: str, cs: Column) -> Column:
    return F.concat(F.lit(prefix), cs.cast("string"))


def slug_start(slug: Column) -> Column:
    """The start time that ends a slug; null where it does not end in digits."""
    return F.element_at(F.split(slug, "-"), -1).try_cast("long")


def string_list(value: Column) -> Column:
    """A JSON array of strings or numbers, or a string that holds one; null if neither."""
    return F.from_json(value, "array<string>")


def parse_event(raw: Column) -> Column:
    """condition_id, up_token, down_token, closed, up_won of an event's first market.

    Null without a market or with fewer than two tokens. ``up_won`` is known only of
    closed markets with two outcome prices, of which the first is a number.
    """
    market = F.try_element_at(F.from_json(raw, EVENT)["markets"], F.lit(1))
    tokens = string_list(market["clobTokenIds"])
    prices = string_list(market["outcomePrices"])
    first = F.try_element_at(prices, F.lit(1)).try_cast("double")
    closed = F.coalesce(market["closed"], F.lit(False))
    won = F.when(closed & (F.size(prices) >= 2) & first.isNotNull(), (first >= 0.5).cast("int"))
    found = F.struct(
        F.coalesce(market["conditionId"], F.lit("")).alias("condition_id"),
        F.try_element_at(tokens, F.lit(1)).alias("up_token"),
        F.try_element_at(tokens, F.lit(2)).alias("down_token"),
        closed.alias("closed"),
        won.alias("up_won"),
    )
    return F.when(market.isNotNull() & (F.size(tokens) >= 2), found)


def parse_fill(raw: Column) -> Column:
    """An order response: success only with shares received; price is paid over received."""
    d = F.from_json(raw, FILL)
    paid = F.coalesce(d["makingAmount"].try_cast("double"), F.lit(0.0))
    shares = F.coalesce(d["takingAmount"].try_cast("double"), F.lit(0.0))
    good = F.coalesce(d["success"], F.lit(False)) & (shares > 0)
    said = F.nullif(F.lower(d["status"]), F.lit(""))
    zero = F.coalesce(d["success"], F.lit(False)) & (shares <= 0)
    return F.struct(
        good.alias("success"),
        F.when(good, F.coalesce(said, F.lit("matched"))).when(zero, F.lit("failed")).otherwise(F.coalesce(said, F.lit("failed"))).alias("status"),
        d["orderID"].alias("order_id"),
        F.when(good, F.try_element_at(d["transactionsHashes"], F.lit(1))).alias("tx_hash"),
        F.when(good, paid).alias("paid"),
        F.when(good, shares).alias("shares"),
        F.when(good, F.try_divide(paid, shares)).alias("fill_price"),
        F.when(zero, F.coalesce(F.nullif(d["errorMsg"], F.lit("")), F.lit("zero fill"))).otherwise(F.coalesce(d["errorMsg"], F.lit(""))).alias("error_msg"),
    )


def book_updates(frame: Column) -> Column:
    """The quotes of a feed frame: an array of (asset_id, best_bid, best_ask, ts_ms, source).

    A frame is one message or a list of them. Books quote their last bid and first
    ask; price changes carry quotes per asset. Other messages and bad JSON give none.
    """
    many = F.from_json(frame, f"array<{MESSAGE}>")
    one = F.from_json(frame, MESSAGE)
    messages = F.when(F.ltrim(frame).startswith("["), many).otherwise(F.array(one))

    def quotes(m: Column) -> Column:
        ts = m["timestamp"].try_cast("long")

        def quote(asset: Column, bid: Column, ask: Column, source: str) -> Column:
            return F.struct(
                asset.alias("asset_id"), bid.try_cast("double").alias("best_bid"), ask.try_cast("double").alias("best_ask"), ts.alias("ts_ms"), F.lit(source).alias("source")
            )

        book = F.array(quote(m["asset_id"], F.try_element_at(m["bids"], F.lit(-1))["price"], F.try_element_at(m["asks"], F.lit(1))["price"], "book"))
        changes = F.transform(m["price_changes"], lambda c: quote(c["asset_id"], c["best_bid"], c["best_ask"], "price_change"))
        return F.when(m["event_type"] == "book", book).when(m["event_type"] == "price_change", changes)

    found = F.flatten(F.filter(F.transform(messages, quotes), lambda q: q.isNotNull()))
    return F.coalesce(F.filter(found, lambda q: q["asset_id"].isNotNull() & (q["asset_id"] != "")), F.array().cast("array<struct<asset_id:string,best_bid:double,best_ask:double,ts_ms:bigint,source:string>>"))
