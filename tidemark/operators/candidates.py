"""Mining over many columns or factors at once: exact quantiles, threshold scans, overlaps, correlations.

Each works on blocks of bounded size in numpy within tasks and adds them up by Spark, so
that the number of columns, candidates or pairs decides the work of a pass, not the number
of passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.pricing import DRIFT, backtest_friction
from tidemark.operators.scoring import GATES, lenses, net_base, wilson_lower
from tidemark.sources.folders import stored

#: Bits of a value that a pass over the data decides.
DIGIT = 16
#: Counts that a task holds before it hands them on.
HELD = 1 << 20


# --- exact quantiles


def sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0 is 0, NaN comes last."""
    bits = (v + 0.0).view(np.uint64)
    return bits ^ np.where(bits >> np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63))


def unsortable(keys: np.ndarray) -> np.ndarray:
    bits = keys ^ np.where(keys >> np.uint64(63), np.uint64(1 << 63), np.uint64(0xFFFFFFFFFFFFFFFF))
    return bits.view(np.float64)


def _histogram(names: Sequence[str], known: list[np.ndarray], depth: int):
    """Counts of the next digit of the values that begin with one of a column's ``known`` digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[list[np.ndarray]] = [[] for _ in names]
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            for i, parts in enumerate(keys):
                if parts:
                    distinct, n = np.unique(np.concatenate(parts), return_counts=True)
                    prefix, digit = distinct >> np.uint64(DIGIT), distinct & np.uint64((1 << DIGIT) - 1)
                    columns = [pa.array([i] * len(n), pa.int32()), pa.array(prefix.view(np.int64)), pa.array(digit.astype(np.int32)), pa.array(n)]
                    yield pa.record_batch(columns, names=["c", "prefix", "digit", "n"])
                    parts.clear()

        for batch in batches:
            for i, column in enumerate(batch.columns):
                found = sortable(column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                if depth:
                    prefix = found >> np.uint64(64 - DIGIT * depth)
                    at = np.minimum(np.searchsorted(known[i], prefix), len(known[i]) - 1)
                    found = found[known[i][at] == prefix] if len(known[i]) else found[:0]
                if len(found):
                    keys[i].append(found >> np.uint64(64 - DIGIT * (depth + 1)))
                    held += len(found)
            if held >= HELD:
                yield from close()
                held = 0
        yield from close()

    return run


def quantiles(df: DataFrame, columns: Sequence[str], cuts: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, between neighbours in proportion; null for a column without values.

    By radix selection: values are read as integers of the same order, and each of four
    passes counts, for all columns and cuts together, the next sixteen bits of those values
    that agree with a wanted one so far. No task holds a column's values; the driver gets a
    row per column and rank.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = rows.agg(*[F.count(f"c{i}") for i in range(len(columns))]).first()
    # (column, rank) of each neighbour of each cut, and the digits known of it
    ranks = sorted({(i, r) for i, n in enumerate(sizes) if n for q in cuts for r in (int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1))))})
    open_ = {key: (0, key[1]) for key in ranks}  # digits so far, rank among the values with these
    for depth in range(64 // DIGIT):
        known = [np.array(sorted({open_[k][0] for k in ranks if k[0] == i}), np.uint64) for i in range(len(columns))]
        counts = rows.mapInArrow(_histogram(columns, known, depth), "c int, prefix long, digit int, n long").groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n"))
        up_to = Window.partitionBy("c", "prefix").orderBy("digit")  # 65,536 digits at most
        counts = counts.withColumn("end", F.sum("n").over(up_to))
        wanted = spark.createDataFrame([(c, r, *_signed(*open_[c, r])) for c, r in ranks], "c int, r long, prefix long, at long")
        met = counts.join(F.broadcast(wanted), ["c", "prefix"]).where("at < end and at >= end - n").select("c", "r", "prefix", "digit", (F.col("at") - F.col("end") + F.col("n")).alias("at"))
        for x in met.collect():
            open_[x["c"], x["r"]] = ((x["prefix"] % (1 << 64)) << DIGIT | x["digit"], x["at"])
    value = {k: float(unsortable(np.array([digits], np.uint64))[0]) for k, (digits, _) in open_.items()}

    def between(i: int, n: int, q: float) -> float | None:
        if not n:
            return None
        at = q * (n - 1)
        low, high = value[i, int(np.floor(at))], value[i, int(np.ceil(at))]
        return low if low == high else float(low + (high - low) * (at - np.floor(at)))

    return {c: [between(i, n, q) for q in cuts] for i, (c, n) in enumerate(zip(columns, sizes, strict=True))}


def _signed(digits: int, rank: int) -> tuple[int, int]:
    return (digits - (1 << 64) if digits >= 1 << 63 else digits), rank


def thresholds(df: DataFrame, columns: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """``column, cut, threshold``: exact quantiles of each column, for enumerating one-predicate factors."""
    found = quantiles(df, columns, cuts)
    rows = [(c, float(q), v) for c, values in found.items() for q, v in zip(cuts, values, strict=True) if v is not None]
    return df.sparkSession.createDataFrame(rows, "column string, cut double, threshold double")


# --- one-pass threshold scan

#: What is added up over the rows that a candidate hits; a price is its whole ticks and what is left of it.
SUMS = ("n", "wins", "pay", "ticks", "rest", "won_pay", "won_square")
#: Ticks of a price of 1, and the greatest error of a price that was worked out in doubles.
TICKS, NOISE = 1e6, 1e-12


def in_ticks(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole ticks, whose sums are exact in any order, and the rest, which is 0 for a price that has no more digits.

    Means of such prices often end in a five; sums of doubles would round it as the order of the rows has it.
    """
    ticks = np.round(price * TICKS)
    rest = price - ticks / TICKS
    return ticks, np.where(np.abs(rest) < NOISE, 0.0, rest)


def _binned(names: Sequence[str], edges: list[np.ndarray]):
    """Sums by column, bin and week of a task's rows (win, price, week, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # week: sums by (column, bin)
        widths = [2 * len(e) + 1 for e in edges]
        first = np.concatenate([[0], np.cumsum(widths)])

        def close() -> Iterator[pa.RecordBatch]:
            of = np.repeat(np.arange(len(names)), widths)
            for week, sums in held.items():
                at = np.flatnonzero(sums[0])
                columns = [pa.array(of[at].astype(np.int32)), pa.array((at - first[of[at]]).astype(np.int32)), pa.array([week] * len(at), pa.int64()), *[pa.array(s[at]) for s in sums]]
                yield pa.record_batch(columns, names=["c", "bin", "week", *SUMS])
            held.clear()

        for batch in batches:
            win, price, week = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            pay = win / (price + DRIFT) - 1.0
            won = np.where(win > 0.5, 1.0 / (price + DRIFT) - 1.0, 0.0)
            weights = [np.ones(len(win)), win, pay, *in_ticks(price), won, won * won]
            weeks, of_week = np.unique(week, return_inverse=True)
            for i, column in enumerate(batch.columns[3:]):
                v = column.to_numpy(zero_copy_only=False).astype(np.float64)
                known = ~np.isnan(v)
                # twice the place of an edge plus one if the value is that edge, else between
                bins = np.searchsorted(edges[i], v, "left") + np.searchsorted(edges[i], v, "right")
                cell = of_week[known] * widths[i] + bins[known]
                found = [np.bincount(cell, weight[known], len(weeks) * widths[i]).reshape(-1, widths[i]) for weight in weights]
                for w, name in enumerate(weeks.tolist()):
                    sums = held.setdefault(name, np.zeros((len(SUMS), first[-1])))
                    for s, more in zip(sums, found, strict=True):
                        s[first[i] : first[i + 1]] += more[w]
            if len(held) * first[-1] * len(SUMS) > 16 * HELD:
                yield from close()
        yield from close()

    return run


def threshold_scan(rows: DataFrame, columns: Sequence[str], cuts: Sequence[float], win: str = "win", price: str = "price", week: str = "week") -> DataFrame:
    """Scores and gates of all factors ``column < threshold`` and ``column > threshold`` at the columns' quantiles.

    Returns ``column, cut, threshold, op, n, wr, ep, nev, eff_n, net_base, net_base_wilson,
    wf_sign_frac, n_weeks`` and the gates of ``lenses``. After the quantiles one pass puts
    each value into a bin between (or at) thresholds and adds up its bet by bin and week;
    what a candidate hits are the bins below or above it, so running sums over the bins
    give all candidates. Null values hit nothing, rows without win or price do not count;
    a quantile that repeats gives one candidate per cut.
    """
    # read once for the quantiles' passes and the scan
    rows = stored(rows.sparkSession, rows.select(win, price, week, *[f"`{c}`" for c in columns]), "scanned")
    found = quantiles(rows, columns, cuts)
    edges = [np.unique([v for v in found[c] if v is not None]).astype(np.float64) for c in columns]
    known = rows.where(F.col(win).isNotNull() & F.col(price).isNotNull())
    read = known.select(F.col(win).cast("double").alias("w"), F.col(price).cast("double").alias("p"), F.col(week).cast("long").alias("k"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    kinds = ", ".join(f"{s} double" for s in SUMS)
    sums = read.mapInArrow(_binned(columns, edges), f"c int, bin int, week long, {kinds}").groupBy("c", "bin", "week").agg(*[F.sum(s).alias(s) for s in SUMS])
    asked = [[(q, v, int(np.searchsorted(edges[i], v))) for q, v in zip(cuts, found[c], strict=True) if v is not None] for i, c in enumerate(columns)]

    def scan(part: pa.Table) -> pa.Table:
        i = part["c"][0].as_py()
        weeks, of_week = np.unique(part["week"].to_numpy(), return_inverse=True)
        dense = np.zeros((len(SUMS), 2 * len(edges[i]) + 1, len(weeks)))
        dense[:, part["bin"].to_numpy(), of_week] = np.array([part[s].to_numpy() for s in SUMS])
        below = np.cumsum(dense, axis=1)
        above = np.cumsum(dense[:, ::-1], axis=1)[:, ::-1]
        out = []
        for cut, threshold, place in asked[i]:
            for op, at in (("<", below[:, 2 * place]), (">", above[:, 2 * place + 2] if 2 * place + 2 < dense.shape[1] else np.zeros((len(SUMS), len(weeks))))):
                hit = np.flatnonzero(at[0])
                hit = hit if len(hit) else np.zeros(1, int)  # a candidate without hits has a row, too
                out.append(pa.table([pa.repeat(x, len(hit)) for x in (columns[i], cut, threshold, op)] + [pa.array(weeks[hit])] + [pa.array(a) for a in at[:, hit]], names=["column", "cut", "threshold", "op", "week", *SUMS]))
        return pa.concat_tables(out)

    weekly = sums.groupBy("c").applyInArrow(scan, f"column string, cut double, threshold double, op string, week long, {kinds}")
    key = ["column", "cut", "threshold", "op"]
    ep = F.try_divide("ticks", F.col("n") * TICKS) + F.try_divide("rest", "n")
    week_nev = F.try_divide("pay", "n") - backtest_friction(ep)
    counted = F.col("n") >= GATES["week_hits"]
    by_week = [F.count_if(counted & (week_nev > 0)).alias("good"), F.count_if(counted).alias("n_weeks")]
    cards = weekly.groupBy(*key).agg(*[F.sum(s).alias(s) for s in SUMS], *by_week)
    wr, n = F.try_divide("wins", "n"), F.col("n")
    cards = cards.select(
        *key, n.cast("long").alias("n"), wr.alias("wr"), ep.alias("ep"), (F.try_divide("pay", "n") - backtest_friction(ep)).alias("nev"),
        F.when(F.col("wins") > 0, F.col("won_pay") * F.col("won_pay") / F.greatest("won_square", F.lit(1e-12))).alias("eff_n"),
        net_base(wr, ep).alias("net_base"), net_base(wilson_lower(wr, n), ep).alias("net_base_wilson"),
        F.try_divide(F.col("good").cast("double"), F.col("n_weeks").cast("double")).alias("wf_sign_frac"), "n_weeks",
    )
    return lenses(cards, known.agg(F.count("*")).scalar())


# --- overlaps of factors as products of bit blocks

#: Factors of a tile and fires of a block of keys, on average; keys at which more factors of a tile fire are multiplied as bits.
TILE, BLOCK_FIRES, DENSE = 1_024, 1 << 19, 24
#: Keys of a product, and fires whose pairs are listed at once.
KEYS_AT_ONCE, FIRES_AT_ONCE = 4_096, 1 << 16


def _products(part: pa.Table) -> pa.Table:
    """Common keys of all pairs of factors of two tiles within a block of keys, a row of counts per factor of the first."""
    side, place = part["side"].to_numpy(), part["place"].to_numpy()
    _, key = np.unique(part["k"].to_numpy(), return_inverse=True)
    same, width = part["tile_a"][0] == part["tile_b"][0], int(place.max()) + 1
    counts = np.zeros((width, width), np.int64)
    sides = [np.ones(len(side), bool) if same else side == i for i in (0, 1)]
    dense = np.max([np.bincount(key[x], minlength=int(key.max()) + 1) for x in sides], axis=0) > DENSE
    # few factors at a key: its pairs one by one
    left, right = (_by_key(key, place, x & ~dense[key]) for x in sides)
    for at in range(0, len(left[0]), FIRES_AT_ONCE):
        keys, places = (x[at : at + FIRES_AT_ONCE] for x in left)
        start = np.searchsorted(right[0], keys)
        times = np.searchsorted(right[0], keys, "right") - start
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(places.astype(np.int64) * width, times) + right[1][np.repeat(start, times) + within]
        counts += np.bincount(pairs, minlength=width * width).reshape(width, width)
    # many: rows of bits, multiplied some keys at a time
    number = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), KEYS_AT_ONCE):
        bits = []
        for x in sides:
            here = x & dense[key] & (number[key] >= at) & (number[key] < at + KEYS_AT_ONCE)
            m = np.zeros((width, KEYS_AT_ONCE), np.float32)
            m[place[here], number[key[here]] - at] = 1
            bits.append(m)
        counts += (bits[0] @ bits[1].T).astype(np.int64)
    rows = np.flatnonzero(counts.any(axis=1))
    tiles = [pa.repeat(part[n][0], len(rows)) for n in ("tile_a", "tile_b")]
    return pa.table([*tiles, pa.array(rows.astype(np.int32)), pa.array([counts[r].tobytes() for r in rows], pa.binary())], names=["tile_a", "tile_b", "place_a", "counts"])


def _by_key(key: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, place = key[which], place[which]
    order = np.argsort(key, kind="stable")
    return key[order], place[order]


def _added(part: pa.Table) -> pa.Table:
    """The counts of a factor over all blocks, a row per factor that it meets."""
    rows = [np.frombuffer(c, np.int64) for c in part["counts"].to_pylist()]
    total = np.zeros(max(map(len, rows)), np.int64)
    for r in rows:
        total[: len(r)] += r
    if part["tile_a"][0] == part["tile_b"][0]:  # each pair once
        total[: part["place_a"][0].as_py() + 1] = 0
    at = np.flatnonzero(total)
    same = [pa.repeat(part[n][0], len(at)) for n in ("tile_a", "tile_b", "place_a")]
    return pa.table([*same, pa.array(at.astype(np.int32)), pa.array(total[at])], names=["tile_a", "tile_b", "place_a", "place_b", "n_both"])


def _tiled(names: DataFrame, name: str, size: int, most: int) -> DataFrame:
    """``names`` with ``tile``, by hash, and ``place`` in it; ``size`` names in all, ``most`` to a tile on average."""
    tile = F.pmod(F.xxhash64(name), F.lit(max(1, -(-size // most)))).cast("int")
    return names.withColumn("tile", tile).withColumn("place", F.row_number().over(Window.partitionBy("tile").orderBy(name)) - 1)


def overlaps(fires: DataFrame, factor: str = "factor", key: str = "cs", least: float = 0.0, tile: int = TILE, block_fires: int = BLOCK_FIRES) -> DataFrame:
    """``a, b, n_a, n_b, n_both, jaccard, containment_ab, containment_ba`` of factors that overlap, a < b.

    ``fires`` has a row per factor and key that fires. Only pairs with a common key and a
    jaccard of ``least`` or more are there; all others overlap by 0 or less than asked.
    Keys are cut into blocks and factors into tiles. A task counts the common keys of two
    tiles in a block: pair by pair at keys where few factors fire, by a product of rows of
    bits elsewhere. It hands on a row of counts per factor, so a key at which all factors
    fire costs no rows of its own.
    """
    spark = fires.sparkSession
    fires = stored(spark, fires.select(F.col(factor).alias("f"), F.col(key).alias("k")).where("f is not null and k is not null").distinct(), "fires")
    sizes = fires.groupBy("f").agg(F.count("*").alias("n"))
    size, total = sizes.agg(F.count("*"), F.sum("n")).first()
    card = stored(spark, _tiled(sizes, "f", size, tile), "factors")
    tiles, blocks = max(1, -(-size // tile)), max(1, -(-(total or 0) // block_fires))
    placed = fires.join(card.select("f", "tile", "place"), "f").select(F.xxhash64("k").alias("k"), "tile", "place").withColumn("block", F.pmod("k", F.lit(blocks)).cast("int"))
    if tiles > 1:
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    else:
        placed = placed.withColumn("other", F.lit(0))
    placed = placed.select("block", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "place", "k")
    kind = "tile_a int, tile_b int, place_a int"
    counts = placed.groupBy("block", "tile_a", "tile_b").applyInArrow(_products, f"{kind}, counts binary")
    both = counts.groupBy("tile_a", "tile_b", "place_a").applyInArrow(_added, f"{kind}, place_b int, n_both long")
    for x in "ab":
        both = both.join(card.select(F.col("f").alias(x), F.col("n").alias(f"n_{x}"), F.col("tile").alias(f"tile_{x}"), F.col("place").alias(f"place_{x}")), [f"tile_{x}", f"place_{x}"])
    # a tile before another need not hold the smaller names
    turned = F.col("a") > F.col("b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    found = both.select(swap("a", "b"), swap("b", "a"), swap("n_a", "n_b"), swap("n_b", "n_a"), "n_both")
    ratio = lambda x: F.coalesce(F.try_divide(F.col("n_both").cast("double"), x.cast("double")), F.lit(0.0))
    found = found.select(
        "*",
        ratio(F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("jaccard"),
        ratio(F.col("n_a")).alias("containment_ab"),
        ratio(F.col("n_b")).alias("containment_ba"),
    )
    return found.where(F.col("jaccard") >= least)


# --- correlations of all factor streams

#: Streams of a tile, on average.
STREAM_TILE = 256


def _correlations(drop: int, weeks: int):
    def run(part: pa.Table) -> pa.Table:
        side, place = part["side"].to_numpy(), part["place"].to_numpy()
        same, width = part["tile_a"][0] == part["tile_b"][0], int(place.max()) + 1
        dense = [np.zeros((width, weeks)) for _ in range(2)]
        for i in (0, 1):
            here = np.ones(len(side), bool) if same else side == i
            dense[i][place[here], part["week"].to_numpy()[here]] = part["value"].to_numpy()[here]
        there = [np.unique(place if same else place[side == i]) for i in (0, 1)]
        out = []
        for a in there[0]:
            b = there[1][there[1] > a] if same else there[1]
            if len(b):
                out.append((np.full(len(b), a), b, pearson(dense[0][a], dense[1][b], drop)))
        first, second, corr = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        tiles = [pa.repeat(part[n][0], len(first)) for n in ("tile_a", "tile_b")]
        return pa.table([*tiles, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(corr)], names=["tile_a", "tile_b", "place_a", "place_b", "corr"])

    return run


def pearson(x: np.ndarray, ys: np.ndarray, drop: int = 0) -> np.ndarray:
    """Correlation of ``x`` with each row of ``ys`` without the ``drop`` places of the greatest
    absolute share in their covariance, of equal shares the first; 0 if either is constant."""
    keep = np.ones(ys.shape, bool)
    if drop:
        share = np.abs((x - x.mean()) * (ys - ys.mean(axis=1, keepdims=True)))
        np.put_along_axis(keep, np.argsort(-share, axis=1, kind="stable")[:, :drop], False, axis=1)
    n = np.maximum(keep.sum(axis=1, keepdims=True), 1)
    dx, dy = (np.where(keep, v - np.where(keep, v, 0).sum(axis=1, keepdims=True) / n, 0) for v in (np.broadcast_to(x, ys.shape), ys))
    both, spread = (dx * dy).sum(axis=1), np.sqrt((dx * dx).sum(axis=1) * (dy * dy).sum(axis=1))
    return np.divide(both, spread, out=np.zeros(len(ys)), where=spread > 0)


def correlations(streams: DataFrame, factor: str = "factor", week: str = "week", value: str = "value", drop: int = 0, tile: int = STREAM_TILE) -> DataFrame:
    """``a, b, corr`` of the weekly streams of all pairs of factors, a < b.

    ``streams`` has any number of rows per factor and week, whose values add up; a week
    without rows is 0, and all weeks that any factor has count. ``drop`` leaves out the weeks
    with the greatest absolute share in the covariance, for each pair its own, of equal
    shares the earlier. A task has two tiles of factors, a row of weeks each; a stream is
    as long as there are weeks.
    """
    spark = streams.sparkSession
    sums = streams.where(F.col(factor).isNotNull() & F.col(week).isNotNull()).groupBy(F.col(factor).alias("f"), F.col(week).alias("w")).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("value"))
    sums = stored(spark, sums, "streams")
    weeks = sums.select("w").distinct()
    weeks = weeks.withColumn("week", F.row_number().over(Window.orderBy("w")) - 1)  # a row per week
    names = sums.select("f").distinct()
    size, length = names.count(), weeks.count()
    tiles = max(1, -(-size // tile))
    card = stored(spark, _tiled(names, "f", size, tile), "factors")
    placed = sums.join(weeks, "w").join(card, "f").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    placed = placed.select(F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "place", "week", "value")
    found = placed.groupBy("tile_a", "tile_b").applyInArrow(_correlations(drop, length), "tile_a int, tile_b int, place_a int, place_b int, corr double")
    for x in "ab":
        found = found.join(card.select(F.col("f").alias(x), F.col("tile").alias(f"tile_{x}"), F.col("place").alias(f"place_{x}")), [f"tile_{x}", f"place_{x}"])
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "corr")
