"""Live operators: latest quotes, triggers once each, candles, settlement, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions import factors
from tidemark.functions.parsing import book_updates
from tidemark.operators import ledger as book
from tidemark.operators.bars import FEATURES, WINDOWS, bar_features
from tidemark.operators.rolling import STANDARD, rank_of, zscore_of
from tidemark.operators.upsert import insert_replace
from tidemark.sources.buckets import BucketedTable


def quotes(frames: DataFrame, frame: str = "frame", seq: str = "seq") -> DataFrame:
    """The quotes of feed frames, with ``seq`` (frame, place in it): the order of arrival."""
    found = frames.select(F.col(seq).alias("_seq"), F.posexplode(book_updates(F.col(frame))).alias("_place", "q"))
    return found.select("q.*", F.struct("_seq", "_place").alias("seq"))


def latest_by_arrival(stream: DataFrame, key: str, values: Sequence[str], seq: Column | str) -> DataFrame:
    """Per key the values that arrived last; event time plays no part. Use with update mode."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*values), seq if isinstance(seq, Column) else F.col(seq)).alias("_v")).select(key, "_v.*")


class LatestQuote(StatefulProcessor):
    """Keyed latest values whose state expires after a time without updates."""

    def __init__(self, ttl_ms: int = 600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("quote", "seq long, best_bid double, best_ask double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        for part in rows:
            for r in part.sort_values("seq").itertuples():
                if last is None or r.seq >= last[0]:
                    last = (int(r.seq), float(r.best_bid), float(r.best_ask))
        if last is not None:
            self.state.update(last)
            yield pd.DataFrame({"asset_id": [key[0]], "seq": [last[0]], "best_bid": [last[1]], "best_ask": [last[2]]})

    def close(self) -> None:
        pass


def latest_with_expiry(stream: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """Like ``latest_by_arrival`` over asset_id, seq, best_bid, best_ask; needs the RocksDB state store."""
    schema = StructType.fromDDL("asset_id string, seq long, best_bid double, best_ask double")
    return stream.groupBy("asset_id").transformWithStateInPandas(LatestQuote(ttl_ms), schema, "Update", "processingTime")


def candles(stream: DataFrame, ts: str, seconds: int = 300, late: str | None = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Counts and sums of ``value`` per tumbling candle.

    In append mode a candle is given out once it is closed, ``late`` behind the latest
    row; those still open when the stream ends are not, nor are rows that come later.
    With ``late`` None nothing closes: in update mode every candle is given out as it
    stands, from all of its rows in whatever order they come.
    """
    w = F.window(ts, f"{seconds} seconds")
    rows = stream if late is None else stream.withWatermark(ts, late)
    found = rows.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "total")


def once(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark; its state goes when the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def triggers(spine: DataFrame, roster: DataFrame, now: Column, candle: int = 300) -> DataFrame:
    """Factor and candle pairs that are due at ``now``: past their offset, their candle not over.

    The candles that run at ``now``, one or two of them, are one value to the factors.
    """
    running = spine.where((F.col("cs") <= now) & (now <= F.col("cs") + candle)).agg(F.collect_list(F.struct(*spine.columns)))
    armed = roster.select("expr", "direction", "entry_offset_s", F.explode(running.scalar()).alias("_candle")).select("expr", "direction", "entry_offset_s", "_candle.*")
    due = F.col("cs") + F.col("entry_offset_s")
    return armed.where(due <= now).withColumn("due_s", due)


def snapshot(trigger: DataFrame, quote_log: DataFrame) -> DataFrame:
    """Triggers with both sides' quotes as they stood when due: as-of by arrival time."""
    from tidemark.operators.timeline import asof

    found = trigger
    for side, token in (("up", "up_token"), ("dn", "down_token")):
        quoted = quote_log.withColumnRenamed("asset_id", token)
        found = asof(found, quoted, "due_s", "ts", {"best_bid": f"book_bid_{side}", "best_ask": f"book_ask_{side}"}, by=[token], tie=["seq"])
    return found


def settle_batches(outcomes: DataFrame, ledger: BucketedTable, now: int, checkpoint: str):
    """A query that settles a stored ledger from a stream of outcomes; running it again changes nothing.

    The ledger lies in buckets by condition_id. A batch reads and rewrites the buckets of
    its decided outcomes and no others; readers have the version before it until it is done.
    """

    def put(batch: DataFrame, _: int) -> None:
        ledger.merge(batch.where("up_won is not null"), lambda old, new: book.settle(old, new, now))

    return outcomes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put)


def extend_history(history: DataFrame, new: DataFrame, rows: int = 2016) -> DataFrame:
    """(feature_name, cs) values put in or replaced; the last ``rows`` of each feature stay."""
    from pyspark.sql.window import Window

    merged = insert_replace(history, new, ["feature_name", "cs"], ["cs"])
    latest = Window.partitionBy("feature_name").orderBy(F.desc("cs"))
    return merged.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= rows).drop("_rn")


def history_arrays(history: DataFrame, cs: int, rows: int) -> DataFrame:
    """``feature_name, past``: the last ``rows`` known values before ``cs``, oldest first."""
    from pyspark.sql.window import Window

    latest = Window.partitionBy("feature_name").orderBy(F.desc("cs"))
    past = history.where((F.col("cs") < cs) & F.col("value").isNotNull()).withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= rows)
    return past.groupBy("feature_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("cs", "value"))), lambda x: x["value"]).alias("past"))


def realtime_row(text: str, cs: int, history: DataFrame, bars: DataFrame, unit: int = 1) -> tuple[DataFrame, DataFrame]:
    """One factor at one candle: ``(row, new history)``.

    The row has cs, the bar features that the factor reads, its transforms and ``hit``.
    Features come from the bars before ``cs``; z-scores and ranks from the last values in
    ``history`` (feature_name, cs, value) before it, each over its own window. Raises for
    columns that bars and history cannot give. The new history holds the features' values
    at ``cs``, for ``extend_history``.
    """
    factor = factors.parse(text, FEATURES)
    needed = sorted(factors.realtime_plan(factor))
    spark = bars.sparkSession
    spine = spark.range(1).select(F.lit(cs).cast("long").alias("cs"))
    recent = bars.where((F.col("ts") >= cs - max(WINDOWS) * unit) & (F.col("ts") < cs))
    row = bar_features(spine, recent, unit).select("cs", *needed)
    new = row.select("cs", F.explode(F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).cast("double").alias("value")) for n in needed])).alias("x")).select("x.feature_name", "cs", "x.value")
    longest = max(s.window for s in STANDARD)
    past = history_arrays(history.where(F.col("feature_name").isin(needed)), cs, longest)
    wide = past.agg(F.struct(*[F.max(F.when(F.col("feature_name") == n, F.col("past"))).alias(n) for n in needed]))
    row = row.withColumn("_past", wide.scalar())
    specs = {(s.op, s.suffix.removeprefix(s.op)): s for s in STANDARD if s.op != "lag"}
    none = F.array().cast("array<double>")

    def value(atom: factors.Atom) -> Column:
        found = F.col(atom.column)
        for step in atom.steps:
            spec = specs[step]
            held = F.coalesce(F.col("_past")[atom.column], none)
            rows = spec.window - (1 if spec.op == "rank" else 0)  # a rank's window holds the row itself
            held = F.slice(held, F.greatest(F.size(held) - rows + 1, F.lit(1)), F.lit(rows))
            found = (zscore_of if spec.op == "zs" else rank_of)(found, held, spec.least)
        return found

    made, predicates = {}, []
    for p in factor.predicates:
        sides = []
        for atom in (p.left, p.right):
            if isinstance(atom, factors.Atom):
                name = "__".join([atom.column, *(f"{op}{arg}" for op, arg in atom.steps)])
                made[name] = value(atom)
                atom = factors.Atom(name)
            sides.append(atom)
        predicates.append(factors.Predicate(sides[0], p.comparator, sides[1]))
    row = row.withColumns({n: c for n, c in made.items() if n not in needed}).withColumn("hit", factors.compile_factor(factors.Factor(factor.text, tuple(predicates))))
    return row.drop("_past"), new


def closed_bars(bars: DataFrame, now: int, seconds: int = 60) -> DataFrame:
    """Bars whose minute is over at ``now``: a live feed's last bar is still forming."""
    return bars.where(F.col("ts") + seconds <= now)


def wanted_tokens(spine: DataFrame, now: int, candle: int = 300) -> DataFrame:
    """``asset_id`` of the running candle's tokens and the next one's: what a feed subscribes to after each roll."""
    start = now - now % candle
    soon = spine.where(F.col("cs").isin(start, start + candle))
    return soon.select(F.explode(F.array("up_token", "down_token")).alias("asset_id")).where("asset_id is not null").distinct()


def subscriptions(ticks: DataFrame, spine: DataFrame, candle: int = 300) -> DataFrame:
    """``start, asset_id``: at each roll of the candle, what a feed subscribes to from then on.

    ``ticks`` is a stream with ``now_s``, the clock's time; the first tick of a candle gives
    the tokens of that candle and of the next one, as ``spine`` (cs, up_token, down_token)
    has them. A candle's state goes two candles later.
    """
    start = (F.col("now_s") - F.col("now_s") % candle).alias("start")
    rolls = ticks.select(start, F.timestamp_seconds("now_s").alias("at"))
    rolls = once(rolls, ["start"], "at", f"{2 * candle} seconds").select("start", F.explode(F.array("start", F.col("start") + candle)).alias("cs"))
    return rolls.join(spine, "cs").select("start", F.explode(F.array_distinct(F.array_compact(F.array("up_token", "down_token")))).alias("asset_id"))


def sweep(items: DataFrame, act: Callable[[dict], str | None], key: str = "id") -> DataFrame:
    """``key, done, result, error_msg``: ``act`` on each row by itself, where the rows are.

    One that raises is logged in its row and does not stop the others.
    """
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append((row[key], True, act(row), None))
                except Exception as e:  # whatever one item does
                    out.append((row[key], False, None, f"{type(e).__name__}: {e}"))
            names = [key, "done", "result", "error_msg"]
            kinds = [batch.schema.field(key).type, pa.bool_(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return items.mapInArrow(run, f"{key} {kind}, done boolean, result string, error_msg string")


def sweep_every(items: Callable[[], DataFrame], act: Callable[[dict], str | None], log: str, checkpoint: str, every: str = "30 minutes", key: str = "id"):
    """A query that sweeps again and again: ``items()`` as they then are, through ``sweep``, into ``log``.

    Each sweep's results lie under its own number, so a sweep that is repeated after a
    failure is logged once. Start it with ``.start()``; a first sweep runs at once.
    """

    def run(_: DataFrame, number: int) -> None:
        sweep(items(), act, key).write.mode("overwrite").parquet(f"{log}/sweep={number}")

    clock = SparkSession.active().readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(run)
