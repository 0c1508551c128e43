"""Operators on a stream that keep state and timers per key: triggers, as-of joins, rolling scores.

All use ``transformWithState``: state and timers are in the checkpoint, so a restarted
query goes on where it was. They need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.parsing import CANDLE_SECONDS
from tidemark.operators.rolling import STANDARD, Rolling, rolling_score

#: Candles after which the state of a trigger goes.
KEPT_CANDLES = 2
#: Buckets of factors: a call of the processor and its reads of state take milliseconds each, so factors share them.
TRIGGER_BUCKETS = 512
#: Quotes of a piece of state.
PIECE = 1 << 16


class TriggerTimer(StatefulProcessor):
    """Per bucket of factors their candles: waiting with the time when each is due, or done.

    A candle that is first announced when it is over is late and never fires; candles of the
    initial state have fired before. A candle is forgotten ``KEPT_CANDLES`` candles after its
    end; what announces it after that is late in any case. A bucket has one state and one
    timer, for whatever is next, so a batch reads and writes them once, however many
    factors there are.
    """

    held = pa.schema([("expr", pa.string()), ("cs", pa.int64()), ("due_s", pa.int64()), ("direction", pa.string()), ("done", pa.bool_())])

    def __init__(self, candle: int, event_time: bool):
        self.candle, self.event_time = candle, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("candles", "candles binary, timer_ms long")

    def _load(self) -> tuple[pd.DataFrame, int | None]:
        """``expr, cs, due_s, direction, done`` of the candles and the timer that is set."""
        if not self.state.exists():
            return self.held.empty_table().to_pandas(), None
        candles, timer = self.state.get()
        return _unpacked(candles), timer

    def _store(self, candles: pd.DataFrame, timer: int | None) -> None:
        """Put the state back, with a timer for the next candle that is due or to be forgotten."""
        if candles.empty:
            self.state.clear()
            return
        wanted = int((candles["due_s"] * 1000).where(~candles["done"].astype(bool), self._forget(candles["cs"])).min())
        if timer is None or wanted < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
            timer = wanted
        self.state.update((_packed(candles, self.held), timer))

    def _forget(self, cs: pd.Series) -> pd.Series:
        return (cs + self.candle * (1 + KEPT_CANDLES)) * 1000

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        candles, timer = self._load()
        fired = initialState[["expr", "cs"]].assign(due_s=0, direction=None, done=True)
        self._store(_joined(candles, fired), timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        candles, timer = self._load()
        said = pd.concat(list(rows)).sort_values("now_s", kind="stable").drop_duplicates(["expr", "cs"])
        if not self.event_time:
            said["now_s"] = int(timerValues.getCurrentProcessingTimeInMs()) // 1000
        said = said[said["now_s"] <= said["cs"] + self.candle]
        due = said["cs"] + said["entry_offset_s"]
        said = said.assign(due_s=due, done=due <= said["now_s"])[self.held.names]
        line = _joined(candles, said)
        fresh = line.iloc[len(candles) :]
        self._store(line, timer)
        yield from self._fired(fresh[fresh["done"].astype(bool)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        candles, _ = self._load()
        now = int(timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        done = candles["done"].astype(bool)
        fires = ~done & (candles["due_s"] * 1000 <= now)
        left = candles.assign(done=done | fires)
        self._store(left[~left["done"] | (self._forget(left["cs"]) > now)], None)
        yield from self._fired(candles[fires].sort_values(["expr", "cs"]))

    def _fired(self, candles: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(candles):
            yield candles[["expr", "cs", "direction", "due_s"]]

    def close(self) -> None:
        pass


def _joined(candles: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    """``candles`` and those of ``more`` that are not among them."""
    line = pd.concat([x for x in (candles, more) if len(x)] or [candles], ignore_index=True)
    return line.drop_duplicates(["expr", "cs"], ignore_index=True)


def _packed(frame: pd.DataFrame, kind: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, kind, preserve_index=False).replace_schema_metadata()
    with pa.ipc.new_stream(sink, kind) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(content: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(content)).read_all().to_pandas()


def timed_triggers(announced: DataFrame, fired: DataFrame | None = None, candle: int = CANDLE_SECONDS, late: str | None = None, buckets: int = TRIGGER_BUCKETS) -> DataFrame:
    """``expr, cs, direction, due_s``: each pair of factor and candle once, when it is due.

    ``announced`` is a stream of expr, cs, direction, entry_offset_s and ``now_s``, the
    clock's time: rows say that the factor is armed for a candle, as often as one likes.
    With ``late`` (an interval) time is that of the rows: ``now_s`` has a watermark of that
    delay, and a pair fires when the watermark is past it. Without, it is the machine's.
    ``fired`` (expr, cs), such as a ledger's recent rows, starts a new query as if those had
    fired; a restarted query knows its own. Factors are dealt to ``buckets`` keys by hash; a
    key's state is a few candles of each of its factors.
    """
    schema = StructType.fromDDL("expr string, cs long, direction string, due_s long")
    rows = announced.where("expr is not null and cs is not null and entry_offset_s is not null and now_s is not null")
    rows = rows.select("expr", F.col("cs").cast("long").alias("cs"), "direction", F.col("entry_offset_s").cast("long").alias("entry_offset_s"), F.col("now_s").cast("long").alias("now_s"))
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_seconds("now_s")).withWatermark("at", late)
    bucket = F.pmod(F.xxhash64("expr"), F.lit(buckets)).cast("int")
    seed = None if fired is None else fired.select("expr", F.col("cs").cast("long").alias("cs")).dropna().distinct().withColumn("bucket", bucket).groupBy("bucket")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        TriggerTimer(candle, late is not None), schema, "Append", "ProcessingTime" if late is None else "EventTime", initialState=seed
    )


class AsOf(StatefulProcessor):
    """Per key the quotes that a later probe can still ask for, and the probes that are not yet due.

    Both are held packed, many to a piece of state; of quotes of one second only the one that counts.
    """

    asked = pa.schema([("ts", pa.int64()), ("probe", pa.string())])

    def __init__(self, values: Sequence[str]):
        self.values = list(values)
        self.kind = [("ts", "<i8"), ("seq", "<i8"), *[(f"v{i}", "<f8") for i in range(len(self.values))]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getListState("quotes", "quotes binary")
        self.probes = handle.getListState("probes", "first long, probes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quotes, probes = [], []
        for part in rows:
            asked = part["probe"].notna()
            said = part[~asked]
            new = np.empty(len(said), self.kind)
            for name, column in zip(new.dtype.names, ("ts", "seq", *self.values), strict=True):
                new[name] = said[column].to_numpy(new.dtype[name])
            quotes.append(self._line([new]))
            probes.append(part.loc[asked, ["ts", "probe"]])
        probes = pd.concat(probes)
        first = self._first()
        if len(probes):
            earliest = int(probes["ts"].min())
            self.probes.appendValue((earliest, _packed(probes, self.asked)))
            self._wake(earliest, first)
            first = earliest if first is None else min(first, earliest)
        if any(map(len, quotes)):
            known = self._line([*self._held(), *quotes])
            # all quotes up to the watermark are here: of them only the last before the first open probe can be asked for
            settled = timerValues.getCurrentWatermarkInMs() // 1000
            settled = settled if first is None else min(settled, first)
            known = known[max(0, int(np.searchsorted(known["ts"], settled, "right")) - 1) :]
            self.quotes.put([(known[at : at + PIECE].tobytes(),) for at in range(0, len(known), PIECE)])
        return iter(())

    def _held(self) -> list[np.ndarray]:
        return [np.frombuffer(bytes(piece), self.kind) for (piece,) in self.quotes.get()] if self.quotes.exists() else []

    def _line(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Quotes in order, the last of each second; of equal ones that which came last."""
        line = np.concatenate([np.empty(0, self.kind), *pieces])
        line = line[np.lexsort((line["seq"], line["ts"]))]
        return line[np.append(line["ts"][1:] != line["ts"][:-1], np.ones(min(1, len(line)), bool))]

    def _first(self) -> int | None:
        return min(first for first, _ in self.probes.get()) if self.probes.exists() else None

    def _wake(self, ts: int, before: int | None) -> None:
        """The key's one timer is for its earliest open probe."""
        if before is None or ts < before:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            self.handle.registerTimer(ts * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        pieces = [_unpacked(probes) for _, probes in self.probes.get()] if self.probes.exists() else []
        waiting = pd.concat([self.asked.empty_table().to_pandas(), *pieces], ignore_index=True)
        due, later = waiting[waiting["ts"] <= now].sort_values(["ts", "probe"]), waiting[waiting["ts"] > now]
        if len(later):
            first = int(later["ts"].min())
            self.probes.put([(first, _packed(later, self.asked))])
            self.handle.registerTimer(first * 1000)
        else:
            self.probes.clear()
        if len(due):
            known = self._line(self._held())
            at = np.searchsorted(known["ts"], due["ts"].to_numpy("int64"), "right") - 1
            # a probe before all quotes finds an empty one
            known = np.append(known, np.array([(0, 0, *[np.nan] * len(self.values))], self.kind))
            found = due.assign(key=key[0], quote_ts=pd.array(known["ts"][at], "Int64"), **{v: known[f"v{i}"][at] for i, v in enumerate(self.values)})
            found.loc[at < 0, "quote_ts"] = pd.NA
            yield found[["key", "ts", "probe", "quote_ts", *self.values]]

    def close(self) -> None:
        pass


def asof_stream(probes: DataFrame, quotes: DataFrame, values: Sequence[str], late: str) -> DataFrame:
    """``key, ts, probe, quote_ts`` and ``values`` of the last quote of the key at or before ``ts``.

    A stream-stream as-of join. ``probes`` has key, ts (seconds) and probe (its id), ``quotes``
    key, ts, seq and the double ``values``; of quotes of one second that of the greatest seq
    counts. A probe is answered when the watermark, ``late`` behind the latest row of either
    stream, is past it, and so no earlier quote is missing, whatever order the rows came in;
    rows that come later than that are left out. Null values where no quote is there. State
    holds the quotes since the earliest open probe and one before them.
    """
    picked = [F.col(v).cast("double").alias(v) for v in values]
    none = [F.lit(None).cast("double").alias(v) for v in values]
    line = quotes.where("key is not null and ts is not null").select("key", F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"), *picked, F.lit(None).cast("string").alias("probe"))
    asked = probes.where("key is not null and ts is not null").select("key", F.col("ts").cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), *none, F.col("probe").cast("string").alias("probe"))
    line = line.unionByName(asked).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    schema = StructType.fromDDL("key string, ts long, probe string, quote_ts long, " + ", ".join(f"{v} double" for v in values))
    return line.groupBy("key").transformWithStateInPandas(AsOf(values), schema, "Append", "EventTime")


class RollingScores(StatefulProcessor):
    """Per feature its last values, as many as the longest window needs, and scores of new ones.

    A batch's scores come from one pass over the held and the new values, in which moments
    are added and removed and ranks kept in a skip list (pandas' rolling), not from a
    window per row.
    """

    def __init__(self, specs: Sequence[Rolling]):
        self.specs = list(specs)
        self.rows = max(s.window for s in self.specs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "cs long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([part[["cs", "value"]] for part in rows])
        held = pd.DataFrame(list(self.past.get()) if self.past.exists() else [], columns=["cs", "value"]).astype({"cs": "int64", "value": "float64"})
        # a later value of the same time takes the place of an earlier one
        line = pd.concat([held, new]).drop_duplicates("cs", keep="last").sort_values("cs", ignore_index=True)
        fresh = line["cs"].isin(new["cs"])
        out = line[fresh].assign(feature_name=key[0])[["feature_name", "cs", "value"]]
        for s in self.specs:
            out[s.suffix] = rolling_score(line["value"], s)[fresh]
        last = line.iloc[-self.rows :]
        self.past.put([(int(cs), None if pd.isna(v) else float(v)) for cs, v in last.itertuples(index=False)])
        yield out

    def close(self) -> None:
        pass


def rolling_stream(values: DataFrame, specs: Sequence[Rolling] = STANDARD) -> DataFrame:
    """``feature_name, cs, value`` of a stream with a column of scores per spec, as ``rolling_features`` gives them.

    A feature's values come in the order of cs; one that comes later is scored against what
    is held of the time before it and does not change scores that have been given out. A
    value whose cs has been there before replaces it. State is the last values of each
    feature, as many as the longest window has.
    """
    schema = StructType([*StructType.fromDDL("feature_name string, cs long, value double").fields, *[StructField(s.suffix, DoubleType()) for s in specs]])
    rows = values.where("feature_name is not null and cs is not null").select("feature_name", F.col("cs").cast("long").alias("cs"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("feature_name").transformWithStateInPandas(RollingScores(specs), schema, "Append", "None")
