"""Streams with state, keyed tables with versions, mining over many columns: against batch and brute force."""

import itertools
import json
import math
import os
import random
import shutil
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import factors
from tidemark.operators import candidates, scoring, upsert
from tidemark.operators.rolling import Rolling, rolling_score
from tidemark.operators.timeline import asof
from tidemark.sources import pages
from tidemark.sources.buckets import BucketedTable
from tidemark.sources.folders import work_dir
from tidemark.streaming import live, stateful
from tidemark.streaming.run import drain, state_store

CANDLE = 300


def _stream(spark, rows, schema, batches):
    """``rows`` as a stream, a file to a batch, in the order given."""
    folder = work_dir(spark, "rows")
    for i, part in enumerate(np.array_split(np.arange(len(rows)), batches)):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(f"{folder}/{i}")
    paths = [f"{folder}/{i}" for i in range(batches)]
    return folder, paths


def _follow(spark, folder, paths, schema):
    """A stream over what lies in ``folder``/in, to which ``paths`` are moved one by one."""
    target = f"{folder}/in/rows.parquet"
    plain = target.removeprefix("file:")
    os.makedirs(plain, exist_ok=True)
    at = int(time.time()) - 1_000
    for i, path in enumerate(paths):
        for name in os.listdir(path.removeprefix("file:")):
            if name.endswith(".parquet"):
                shutil.move(f"{path.removeprefix('file:')}/{name}", f"{plain}/{i:04d}-{name}")
                os.utime(f"{plain}/{i:04d}-{name}", (at + i, at + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(target)


SAID = "expr string, cs long, direction string, entry_offset_s long, now_s long"


def _wanted(said, fired, clock):
    """Pairs that fire up to ``clock``, from all announcements in the order of their times."""
    first = {}
    for expr, cs, _, offset, now in sorted(said, key=lambda r: r[4]):
        first.setdefault((expr, cs), (now, cs + offset))
    return {(e, cs, due) for (e, cs), (now, due) in first.items() if (e, cs) not in fired and now <= cs + CANDLE and due <= clock}


def test_triggers_by_timers_fire_once_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    said = []
    for now in range(10_000, 16_000, 20):
        start = now - now % CANDLE
        for e in rng.sample("abcdef", 2):
            cs = rng.choice([start, start, start + CANDLE, start - 2 * CANDLE])
            said.append((e, cs, "UP", 40 * "abcdef".index(e), now))
    fired = {("a", 10_200), ("b", 10_500), ("c", 0)}
    folder, paths = _stream(spark, said, SAID, 6)
    seed = spark.createDataFrame(sorted(fired), "expr string, cs long")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(some):
        stream = _follow(spark, folder, some, SAID)
        plan = stateful.timed_triggers(stream, seed, CANDLE, "0 seconds")
        with state_store(spark):
            plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(paths[:3])
    run(paths[3:])  # the same query, started again
    rows = [(r["expr"], r["cs"], r["due_s"]) for r in spark.read.parquet(out).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _wanted(said, fired, said[-1][4])


def test_triggers_on_the_machine_s_clock(spark):
    now = int(time.time())
    said = [("past", now - 10, "UP", 5, 0), ("soon", now - 10, "DOWN", 12, 0), ("late", now - 2 * CANDLE, "UP", 5, 0), ("far", now, "UP", 250, 0)]
    folder, paths = _stream(spark, said, SAID, 1)
    stream = _follow(spark, folder, paths, SAID)
    folder = work_dir(spark, "out")
    with state_store(spark):
        query = stateful.timed_triggers(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="1 second").start()
        found, end = set(), time.monotonic() + 90
        while time.monotonic() < end and len(found) < 2:
            time.sleep(1)
            try:
                found = {r["expr"] for r in spark.read.parquet(f"{folder}/out").collect()}
            except Exception:  # nothing written yet
                pass
        query.stop()
    assert found == {"past", "soon"}


@pytest.mark.parametrize("seed", range(2))
def test_asof_of_streams_is_asof_of_tables(spark, seed):
    """Rows of both sides in shuffled micro-batches, displaced by less than the watermark."""
    rng = random.Random(seed)
    quotes = [(rng.choice("xyz"), rng.randrange(0, 5_000), i, rng.choice([None, round(rng.random(), 3)])) for i in range(300)]
    probes = [(rng.choice("xyzw"), rng.randrange(0, 5_000), f"p{i}") for i in range(120)]
    shuffled = [sorted(rows, key=lambda r: r[1] + rng.randrange(600)) for rows in (quotes, probes)]
    shuffled[0].append(("end", 20_000, 0, None))
    kinds = ("key string, ts long, seq long, bid double", "key string, ts long, probe string")
    sides = []
    for rows, kind in zip(shuffled, kinds, strict=True):
        sides.append(_follow(spark, *_stream(spark, rows, kind, 4), kind))
    with state_store(spark):
        found = {(r["probe"]): (r["quote_ts"], r["bid"]) for r in drain(stateful.asof_stream(sides[1], sides[0], ["bid"], "700 seconds")).collect()}
    q = spark.createDataFrame(quotes, kinds[0]).withColumn("t", F.col("ts"))
    wanted = asof(spark.createDataFrame(probes, kinds[1]), q, "ts", "ts", {"t": "quote_ts", "bid": "bid"}, by=["key"], tie=["seq"])
    assert found == {r["probe"]: (r["quote_ts"], r["bid"]) for r in wanted.collect()}


class _Held:
    """A value or list state, a handle and a clock in one, for a processor without a stream."""

    def __init__(self):
        self.lists, self.rows = {}, None

    def getValueState(self, name, kind):
        return self.lists.setdefault(name, _Held())

    getListState = getValueState

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows

    def put(self, rows):
        self.rows = rows

    update = put

    def appendValue(self, row):
        self.rows = [*(self.rows or []), row]

    def registerTimer(self, at):
        self.timer = at

    def getCurrentWatermarkInMs(self):
        return 0


def test_factors_of_a_bucket_share_a_state():
    held, processor = _Held(), stateful.TriggerTimer(CANDLE, True)
    processor.init(held)
    said = pd.DataFrame([("a", 0, "UP", 5, 10), ("b", 0, "DOWN", 5, 10), ("b", 0, "DOWN", 5, 12), ("c", 0, None, 50, 10)], columns=["expr", "cs", "direction", "entry_offset_s", "now_s"])
    found = pd.concat(processor.handleInputRows((3,), iter([said[:2], said[2:]]), held))
    assert sorted(found[["expr", "direction", "due_s"]].itertuples(index=False, name=None)) == [("a", "UP", 5), ("b", "DOWN", 5)]
    assert held.timer == 50_000 and not list(processor.handleInputRows((3,), iter([said]), held))


def test_quotes_are_held_in_pieces():
    held, processor = _Held(), stateful.AsOf(["bid"])
    processor.init(held)
    n = 100_000
    quotes = pd.DataFrame({"ts": np.arange(n) // 2, "seq": np.arange(n), "bid": np.arange(n) / 4, "probe": None})
    probe = pd.DataFrame({"ts": [7], "seq": [0], "bid": [None], "probe": ["p"]})
    list(processor.handleInputRows(("k",), iter([quotes[: n // 2], quotes[n // 2 :], probe]), held))
    assert len(held.lists["quotes"].rows) <= 2 and len(held.lists["probes"].rows) == 1


def test_rolling_scores_of_a_stream(spark):
    specs = [Rolling("zs9", "zs", 9, 4), Rolling("rank7", "rank", 7, 3), Rolling("lag1", "lag", 1, 1)]
    rng = random.Random(3)
    values = {n: [None if rng.random() < 0.1 else rng.choice([1.0, 2.0, rng.random()]) for _ in range(60)] for n in ("a", "b")}
    rows = [(n, t, v) for t in range(60) for n in values for v in [values[n][t]]]
    schema = "feature_name string, cs long, value double"
    with state_store(spark):
        found = drain(stateful.rolling_stream(_follow(spark, *_stream(spark, rows, schema, 5), schema), specs)).toPandas()
    assert len(found) == 120
    for n, listed in values.items():
        x = pd.Series(listed, dtype="float64")
        got = found[found.feature_name == n].sort_values("cs")
        for s in specs:
            np.testing.assert_allclose(got[s.suffix].to_numpy(float), rolling_score(x, s).to_numpy(float), rtol=1e-9)


def test_live_pages_resume_replay_and_hold_back(spark, tmp_path):
    feed, checkpoint = tmp_path / "feed", tmp_path / "checkpoint"
    bar = lambda t, volume=1.0: [t, 1, 1, 1, 1, volume, 1, 1, 1, 1, 0]

    def land(market, number, content):
        (feed / market).mkdir(parents=True, exist_ok=True)
        (feed / market / f"{number}.json").write_text(json.dumps(content))

    def run(name):
        out = str(tmp_path / name)
        stream = pages.follow_feed(spark, "bars", str(feed), batch_pages="2").select("open_ts_ms", "volume")
        query = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}")).option("checkpointLocation", str(checkpoint)).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        try:
            return sorted((r["open_ts_ms"], r["volume"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect())
        except Exception as e:
            assert "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e)
            return []

    minute = 60_000
    land("m", 0, [bar(0), bar(minute), bar(2 * minute, 0.5)])
    land("m", 1, [bar(minute), bar(2 * minute), bar(3 * minute, 0.5)])
    land("m", 2, {"data": [bar(3 * minute, 0.7)], "fetched_at": 3 * minute + 10})  # nothing new is closed
    land("m", 3, {"status": 400})
    land("m", 4, {"data": [bar(2 * minute), bar(3 * minute), bar(4 * minute)], "fetched_at": 5 * minute})  # no bar is forming
    land("n", 0, [bar(7 * minute), bar(8 * minute, 0.5)])
    first = run("one")
    assert first == [(0, 1.0), (minute, 1.0), (2 * minute, 1.0), (3 * minute, 1.0), (4 * minute, 1.0), (7 * minute, 1.0)]
    assert run("two") == []  # started again, nothing comes twice
    land("m", 5, [bar(4 * minute), bar(5 * minute), bar(6 * minute, 0.5)])
    land("n", 1, [bar(8 * minute), bar(9 * minute, 0.5)])
    assert run("three") == [(5 * minute, 1.0), (8 * minute, 1.0)]
    # a batch that was planned but not committed is read again, the same
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    while (checkpoint / "commits" / str(last)).exists():
        planned = json.loads((checkpoint / "offsets" / str(last)).read_text().splitlines()[-1])
        before = json.loads((checkpoint / "offsets" / str(last - 1)).read_text().splitlines()[-1]) if last else None
        if planned != before:
            break
        last -= 1
    for folder in ("commits", "offsets"):
        for p in list((checkpoint / folder).iterdir()):
            number = p.name.strip(".").removesuffix(".crc")
            if number.isdigit() and int(number) > (last - 1 if folder == "commits" else last):
                p.unlink()
    assert run("four") == [(5 * minute, 1.0), (8 * minute, 1.0)]


def test_pages_that_stay_unreadable_are_logged(spark, tmp_path):
    (tmp_path / "feed" / "m").mkdir(parents=True)
    (tmp_path / "feed" / "m" / "0.json").write_text("cut off")
    reader = pages.PageStreamReader(pages.StructType.fromDDL("open_ts_ms long"), {"path": f"file://{tmp_path}/feed", "tries": "1", "cursor": "open_ts_ms"})
    part = reader.partitions({}, reader.latestOffset())[0]
    with pytest.raises(ValueError):
        list(reader.read(part))
    reader.failures = f"file://{tmp_path}/log"
    assert list(reader.read(part)) == [] and pages.failures(spark, str(tmp_path / "log")).first()["page"] == "0.json"


def test_sweeps_go_on(spark, tmp_path):
    log = str(tmp_path / "log")
    items = lambda: spark.createDataFrame([(1,), (2,)], "id long")

    def act(row):
        if row["id"] == 2:
            raise KeyError("no")
        return "ok"

    query = live.sweep_every(items, act, log, str(tmp_path / "checkpoint"), "1 second").start()
    end = time.monotonic() + 60
    while time.monotonic() < end and not (query.lastProgress and query.lastProgress["batchId"] >= 2):
        time.sleep(0.3)
    query.stop()
    found = spark.read.parquet(log)
    assert found.select("sweep").distinct().count() >= 2
    assert {(r["id"], r["done"], r["result"]) for r in found.collect()} == {(1, True, "ok"), (2, False, None)}


# --- keyed tables


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_buckets_are_rewritten_where_keys_change(spark):
    store = BucketedTable(spark, work_dir(spark, "store"))
    store.create(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), ["k"], buckets=8)
    with pytest.raises(FileExistsError):
        store.create(spark.range(1), ["id"])
    before = store.version()[1]["files"]
    touched = store.merge(spark.createDataFrame([(3, "b"), (500, "b")], "k long, v string"), lambda old, new: upsert.insert_replace(old, new, ["k"], ["v"]))
    after = store.version()[1]["files"]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    found = {r["k"]: r["v"] for r in store.read().collect()}
    assert len(found) == 201 and found[3] == found[500] == "b" and found[4] == "a"
    assert store.read(1).count() == 200  # the version before is still there
    assert _rows(store.lookup((3,), (7,), (9_999,))) == [(3, "b"), (7, "a")]
    assert len(store.lookup((3,)).inputFiles()) == 1 and store.lookup().count() == 0
    assert _rows(store.find(spark.createDataFrame([(3,), (9_999,), (3,)], "k long"))) == [(3, "b"), (3, "b"), (9_999, None)]
    assert store.merge(spark.createDataFrame([], "k long, v string"), lambda old, new: old) == []
    with pytest.raises(ValueError, match="other buckets"):
        store.merge(spark.createDataFrame([(3, "b")], "k long, v string"), lambda old, new: spark.range(50).select(F.col("id").alias("k"), F.lit("c").alias("v")))
    assert store.version()[0] == 2
    # all rows of a bucket may go, and old folders once nobody names them
    store.merge(store.read().where("v = 'b'"), lambda old, new: old.join(new, "k", "left_anti"))
    assert store.read().count() == 199
    gone = store.vacuum(keep=1)
    assert gone and store.read().count() == 199 and store.versions() == [3]


def test_a_cut_off_change_leaves_the_version_before(spark):
    store = BucketedTable(spark, work_dir(spark, "store"))
    store.create(spark.range(20).select(F.col("id").alias("k"), F.lit(0).alias("v")), ["k"], buckets=4)
    plain = store.path.removeprefix("file:")
    change = spark.createDataFrame([(1, 5)], "k long, v int")

    def fail(old, new):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        store.merge(change, fail)
    with open(f"{plain}/versions/00000002.json", "w") as f:
        f.write('{"key": ["k"], "buck')  # its writer ended here
    assert store.version()[0] == 1 and store.read().where("v <> 0").count() == 0
    put = lambda old, new: upsert.insert_replace(old, new, ["k"], ["v"])
    store.merge(change, put)
    assert store.version()[0] == 3 and store.lookup((1,)).first()["v"] == 5
    # two writers from one version: the second one fails
    base, content = store.version()
    store.merge(spark.createDataFrame([(2, 6)], "k long, v int"), put)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(base, content)


def test_checks_in_passing(spark, tmp_path):
    rows = spark.createDataFrame([("1", 10, 5.0), ("x", 20, 5.0), ("3", 30, None), ("4", 5, -1.0)], "raw string, t long, v double")
    found = upsert.write_checked(rows, str(tmp_path / "out"), {"n": F.col("raw").try_cast("long")}, {"v": "v > 0"}, "t")
    assert found == {"rows_in": 4, "rows_good": 3, "rows_dead": 1, "first_s": 5, "last_s": 30, "failed_v": 1}
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert [(r["raw"], r["error_msg"]) for r in stored.where("dead = 'true'").collect()] == [("x", "no value: n")] and stored.where("dead = 'false'").count() == 3


# --- mining


def test_quantiles_by_digits(spark):
    rng = random.Random(6)
    cols = {
        "a": [rng.gauss(0, 1) for _ in range(501)],
        "b": [rng.choice([-3.5, 0.0, -0.0, 7.0]) for _ in range(501)],
        "c": [rng.choice([1e300, -1e300, 5e-324, rng.random()]) for _ in range(501)],
        "d": [None if i % 3 else float(i) for i in range(501)],
        "e": [None] * 501,
    }
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(5)
    cuts = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = candidates.quantiles(df, list(cols), cuts)
    for c in "abcd":
        known = [v for v in cols[c] if v is not None]
        with np.errstate(over="ignore", invalid="ignore"):
            np.testing.assert_allclose(found[c], np.quantile(known, cuts), rtol=1e-12)
    assert found["e"] == [None] * 6
    keys = candidates.sortable(np.array([-np.inf, -1e10, -1.0, -5e-324, 0.0, 5e-324, 2.0, np.inf, np.nan]))
    assert (np.diff(keys.astype(object)) > 0).all()
    np.testing.assert_array_equal(candidates.unsortable(keys[:-1]), [-np.inf, -1e10, -1.0, -5e-324, 0.0, 5e-324, 2.0, np.inf])


def test_threshold_scan_is_one_filter_each(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, 1]), round(rng.uniform(0.3, 0.6), 2), i // 100, rng.choice([None, float(rng.randrange(6))]), rng.random()) for i in range(600)]
    rows += [(None, 0.5, 0, 1.0, 1.0), (1, None, 0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "win int, price double, week long, x double, y double")
    cuts = [0.2, 0.5, 0.8]
    found = candidates.threshold_scan(t, ["x", "y"], cuts).collect()
    assert len(found) == 12
    for r in found:
        hit = t.where(f"{r['column']} {r['op']} {r['threshold']!r}")
        card = scoring.scorecard(hit.withColumn("g", F.lit(1)), ["g"]).first()
        weeks = scoring.walk_forward(hit.withColumn("g", F.lit(1)), ["g"]).first()
        if card is None:
            assert r["n"] == 0
            continue
        for name in ("n", "wr", "ep", "nev", "eff_n", "net_base", "net_base_wilson"):
            assert r[name] == pytest.approx(card[name], rel=1e-9), name
        assert r["n_weeks"] == weeks["n_weeks"] and r["wf_sign_frac"] == pytest.approx(weeks["wf_sign_frac"])
        assert r["ok_hits"] == (r["n"] >= 50) and r["ok_price"] == (0.35 <= r["ep"] <= 0.65)


@pytest.mark.parametrize("seed", range(2))
def test_threshold_scan_rounds_mean_prices_the_same_in_any_order(spark, seed):
    """Means of 32 prices in cents that end in a five at the seventh digit."""
    rng = random.Random(seed)
    rows, wanted = [], {}
    for x in range(20):
        cents = [rng.randrange(11) for _ in range(31)]
        cents.append(2 * rng.randrange(5) + (sum(cents) + 1) % 2)  # an odd sum
        wanted[x] = (35 * 32 + 3 * sum(cents)) * 10_000 / 32
        rows += [(1, 0.35 + 3.0 * (c / 100), 0, *[0.0 if i == x else None for i in range(20)]) for c in cents]
        rows += [(1, 0.5, 0, *[1.0 if i == x else None for i in range(20)])] * 40
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "win int, price double, week long, " + ", ".join(f"x{i} double" for i in range(20))).repartition(3)
    found = candidates.threshold_scan(t, [f"x{i}" for i in range(20)], [1.0]).where("op = '<'").select("column", F.round("ep", 6).alias("ep")).collect()
    assert {r["column"]: r["ep"] for r in found} == {f"x{x}": math.floor(v + 0.5) / 1e6 for x, v in wanted.items()}


@pytest.mark.parametrize("options", [{}, {"tile": 3, "block_fires": 40}])
def test_overlaps_against_sets(spark, options):
    rng = random.Random(4)
    sets = {f"f{i}": {rng.randrange(60) for _ in range(rng.randrange(1, 40))} for i in range(40)}
    for i in range(40):
        sets[f"f{i}"].add(1_000)  # a key at which all fire
    rows = [(f, k) for f, ks in sets.items() for k in ks] + [("f0", 1_000), (None, 3), ("f1", None)]
    found = candidates.overlaps(spark.createDataFrame(rows, "factor string, cs long"), **options).collect()
    assert len(found) == 40 * 39 // 2
    for r in found:
        a, b = sets[r["a"]], sets[r["b"]]
        assert r["a"] < r["b"] and (r["n_a"], r["n_b"], r["n_both"]) == (len(a), len(b), len(a & b))
        assert r["jaccard"] == pytest.approx(len(a & b) / len(a | b)) and r["containment_ab"] == pytest.approx(len(a & b) / len(a))
    assert candidates.overlaps(spark.createDataFrame([], "factor string, cs long")).collect() == []


def test_pairs_of_a_block_are_listed_in_parts():
    """A block of 2,000,000 fires, of ten factors to a key: the memory of all its pairs at once would be many times its own."""
    n = 1 << 21
    k, place = np.arange(n) // 10, np.arange(n) % 10
    zero = np.zeros(n, np.int32)
    part = pa.table({"block": zero, "tile_a": zero, "tile_b": zero, "side": zero, "place": place.astype(np.int32), "k": k})
    tracemalloc.start()
    found = candidates._products(part)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.array([np.frombuffer(c, np.int64) for c in found["counts"].to_pylist()])
    both = np.bincount(place)
    np.testing.assert_array_equal(counts, np.minimum(*np.meshgrid(both, both)))
    assert most < 300 << 20, most


@pytest.mark.parametrize("drop, tile", [(0, 256), (3, 256), (3, 4)])
def test_correlations_of_all_pairs(spark, drop, tile):
    rng = np.random.default_rng(drop)
    dense = rng.normal(size=(11, 30)) * (rng.random((11, 30)) < 0.5)
    dense[10] = 0
    rows = [(f"s{i}", int(w) * 7, float(v) / 2) for i in range(11) for w, v in enumerate(dense[i]) if v or i == 10 for _ in range(2)]
    found = {(r["a"], r["b"]): r["corr"] for r in candidates.correlations(spark.createDataFrame(rows, "factor string, week long, value double"), drop=drop, tile=tile).collect()}
    assert len(found) == 55
    for i, k in itertools.combinations(range(11), 2):
        x, y = dense[i], dense[k]
        keep = np.argsort(-np.abs((x - x.mean()) * (y - y.mean())), kind="stable")[drop:]
        x, y = x[keep], y[keep]
        wanted = 0 if not x.std() or not y.std() else np.corrcoef(x, y)[0, 1]
        pair = tuple(sorted((f"s{i}", f"s{k}")))
        assert found[pair] == pytest.approx(wanted, abs=1e-9)


def test_ten_thousand_factors(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 9 == 0 else float(rng.randrange(100)), rng.choice([None, float("nan"), float(rng.randrange(100))]), float(rng.randrange(100))) for i in range(300)]
    frame = spark.createDataFrame(rows, "k long, p double, q double, r double")
    texts = [f"p < {i} & q >= {j}" for i in range(100) for j in range(100)]
    texts += ["p != q", "p==q", "r__lag1 > r & p<=50", "r__abs > 10 & q != 3 & p < r"]
    found = factors.roster_hits(frame, [*texts, "p<5  &  q>=5"], ["k"], "k").groupBy("factor").agg(F.count("*").alias("n"), F.sum("k").alias("s"))
    found = {r["factor"]: (r["n"], r["s"]) for r in found.collect()}
    some = [*texts[::397], *texts[-4:]]
    one_by_one = factors.hits(frame, some, ["k"], "k").where("hit").groupBy("factor").agg(F.count("*").alias("n"), F.sum("k").alias("s"))
    wanted = {r["factor"]: (r["n"], r["s"]) for r in one_by_one.collect()}
    assert {f: found.get(f) for f in map(factors.canonicalize, some)} == {f: wanted.get(f) for f in map(factors.canonicalize, some)}
    assert sum(n for n, _ in found.values()) > 100_000 and math.isfinite(len(found))
