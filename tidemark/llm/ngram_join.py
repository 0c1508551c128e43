"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

The product of the incidence matrix with its transpose holds the overlap of every
two documents. It is never formed whole:

1. Column blocks. Documents' n-grams are dealt to blocks of n-grams. A block finds
   which of its columns hold more than one document; single ones add to no overlap.
2. Size-derived bounds on rows. A link needs an overlap of at least 0.75 of either
   size, so a row with fewer shared n-grams is discarded. Of the others, ordered by
   rising frequency, two rows that link share one of their first ``size - need + 1``
   n-grams, so rows only meet where they share such a prefix n-gram.
3. Row blocks. Rows meet in blocks, where overlap counts are accumulated over chunks of
   columns, and pairs whose overlap and remaining n-grams stay below the bound of their
   sizes are discarded. Where the rows that share prefix n-grams, directly or through
   others, are few, they are one block. Where they are many, each meets the first row
   of its n-grams, which joins most true groups; then the rows of those n-grams that
   still belong to several groups meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, hot_join, materialize, released, shuffled
from tidemark.llm.components import connected_components, local_components

#: N-grams of a batch of documents that are dealt to column blocks at a time.
BATCH_GRAMS = 1 << 20
#: Frequencies are counted up to here; a batch with so many documents of an n-gram sends a mark in their place.
CAP = 64
#: N-grams are told apart by so many bits of their hash.
BITS = 48
#: Rows, and n-grams, of a row block; rows that meet one other row in a task.
BLOCK_ROWS, BLOCK_GRAMS, STAR_ROWS = 256, 1 << 20, 64
#: An n-gram of at most so many rows gives its pairs.
FEW_ROWS = 16
#: A column block holds about so many n-grams, as far as no more than so many blocks do.
COLUMN_GRAMS, MOST_COLUMNS = 4 << 20, 65_536
#: Bytes of text that a word takes at least, on average, for the number of n-grams to expect.
WORD_BYTES = 4
#: Columns of a dense chunk; rarer columns are accumulated pair by pair.
CHUNK, DENSE = 4_096, 8
#: Tables of at most so many narrow rows are broadcast.
BROADCAST_ROWS = 100_000
HOT = 0xFFFFFFFF


class _Hashes(dict):
    """Word to hash; holds a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(hashes: dict, text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of all runs of ``words`` words, sorted; a shorter text is one run."""
    found = np.array(list(map(hashes.__getitem__, text.lower().split())), np.uint64)
    count = len(found)
    if not count:
        return found
    length = min(count, words)
    grams = found[: count - length + 1].copy()
    for i in range(1, length):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + found[i : count - length + 1 + i]
    grams += np.uint64(length * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        grams ^= grams >> np.uint64(shift)
        grams *= np.uint64(factor)
    return np.unique(grams ^ (grams >> np.uint64(33)))


def need(size, threshold: int):
    """The least overlap that a link of a row of this size needs."""
    return -(-threshold * size // 100)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; leading planes of zeros are left out."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(values).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(content: bytes) -> np.ndarray:
    width, count = content[0], int.from_bytes(content[1:5], "little")
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[5:]), np.uint8).reshape(width, count).T
    return out.view("<u8").ravel()


# kinds of rows that go through the column blocks
GRAMS, ROWS, MARKED = 0, 1, 2
DEALT = "block int, kind int, batch long, a binary, b binary, c binary, d binary"
_DEALT = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DEALT)], schema=_DEALT)


def _deal(words: int, blocks: int, batch_grams: int):
    """Batches of documents: a table of their rows, and their n-grams dealt to column blocks.

    Equal sets within a batch are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        hashes = _Hashes()
        docs, nulls, of, sizes, keys, sets, held = [], [], [], [], [], [], 0
        index: dict[bytes, int] = {}

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, docs, nulls, of, sizes, keys, sets, held, index
            key = np.frombuffer(b"".join(keys), "<u8") if keys else np.zeros(0, "<u8")
            row = np.array([sizes, key[0::2], key[1::2]], np.uint64)
            ids = np.array(docs, "<i8").view("<u8")
            spread = number % blocks
            table = (spread, ROWS, number, squeeze(ids), squeeze(np.array(nulls)), squeeze(np.array(of)), squeeze(row.ravel()))
            yield _dealt([table])
            codes = np.concatenate(sets) & np.uint64((1 << BITS) - 1) if sets else np.zeros(0, np.uint64)
            rows = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
            block, code = codes % np.uint64(blocks), codes // np.uint64(blocks)
            order = np.argsort(block << np.uint64(BITS) | code, kind="stable")
            block, code, rows, codes = block[order], code[order], rows[order], codes[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
            count = np.diff(np.concatenate([first, [len(codes)]])) if len(codes) else first
            often = np.repeat(count >= CAP, count)
            if often.any():
                yield _dealt([(spread, MARKED, number, squeeze(codes[often]), squeeze(rows[often]), None, None)])
                sent = ~often
                sent[first[count >= CAP]] = True
                rows = np.where(often, np.uint64(HOT), rows)[sent]
                block, code = block[sent], code[sent]
            edges = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
            out = []
            for b in range(blocks):
                own = slice(edges[b], edges[b + 1])
                if edges[b] < edges[b + 1]:
                    out.append((b, GRAMS, number, squeeze(np.diff(code[own], prepend=np.uint64(0))), squeeze(rows[own]), None, None))
            yield _dealt(out)
            number += 1
            docs, nulls, of, sizes, keys, sets, held, index = [], [], [], [], [], [], 0, {}

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(hashes, text.as_py(), words)
                key = xxhash.xxh3_128_digest(found.tobytes())
                if key not in index:
                    index[key] = len(index)
                    sizes.append(len(found))
                    keys.append(key)
                    sets.append(found)
                    held += len(found)
                docs.append(doc or 0)
                nulls.append(doc is None)
                of.append(index[key])
                held += 4
                if held >= batch_grams:
                    yield from close()
        if docs:
            yield from close()

    return run


def _columns(blocks: int):
    """Column blocks: of each block's n-grams, those of more than one row, with their frequency."""

    def work(block: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, rows = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        source = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        order = np.argsort(code, kind="stable")
        code, rows, source = code[order], rows[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        count = np.add.reduceat(np.where(rows == HOT, CAP, 1), first)
        often = np.repeat(np.minimum(count, CAP), np.diff(np.concatenate([first, [len(code)]])))
        shared = (often > 1) & (rows != HOT)
        code, rows, source, often = code[shared], rows[shared], source[shared], often[shared]
        order = np.argsort(source, kind="stable")
        code, rows, source, often = code[order], rows[order], source[order], often[order]
        edges = np.searchsorted(source, np.arange(len(held) + 1))
        out = []
        for i, (batch, _, _) in enumerate(held):
            own = slice(edges[i], edges[i + 1])
            if edges[i] < edges[i + 1]:
                out.append((block, GRAMS, batch, squeeze(code[own] * np.uint64(blocks) + np.uint64(block)), squeeze(rows[own]), squeeze(often[own]), None))
        return _dealt(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != GRAMS:
                    yield _dealt([tuple(row.values())])
                    continue
                if row["block"] != current and held:
                    yield work(current, held)
                    held = []
                current = row["block"]
                held.append((row["batch"], np.cumsum(unsqueeze(row["a"]), dtype=np.uint64), unsqueeze(row["b"])))
        if held:
            yield work(current, held)

    return run


LIVE = "row long, key_a long, key_b long, size long, grams binary"
_LIVE = pa.schema([("row", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("size", pa.int64()), ("grams", pa.binary())])


def _live(threshold: int):
    """Rows with enough shared n-grams for a link, and those n-grams by rising frequency."""

    def work(batch: int, table: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes, key_a, key_b = table.reshape(3, -1)
        code, rows, often = (np.concatenate([p[i] for p in parts]) for i in range(3))
        shared = np.bincount(rows.astype(np.int64), minlength=len(sizes))
        alive = (shared >= need(sizes.astype(np.int64), threshold)) & (sizes > 0)
        keep = alive[rows.astype(np.int64)]
        code, rows, often = code[keep], rows[keep], often[keep]
        order = np.lexsort((code, often, rows))
        code, rows = code[order], rows[order]
        some = np.flatnonzero(alive)
        edges = np.searchsorted(rows, np.append(some, len(sizes)))
        grams = [code[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.record_batch(
            [pa.array((batch << 24) + some), pa.array(key_a[some].view(np.int64)), pa.array(key_b[some].view(np.int64)), pa.array(sizes[some].astype(np.int64)), pa.array(grams, pa.binary())],
            schema=_LIVE,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table, parts = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != current:
                    if parts:
                        yield work(current, table, parts)
                    current, table, parts = row["batch"], None, []
                if row["kind"] == ROWS:
                    table = unsqueeze(row["d"])
                else:
                    code = unsqueeze(row["a"])
                    parts.append((code, unsqueeze(row["b"]), unsqueeze(row["c"]) if row["c"] else np.full(len(code), CAP, np.uint64)))
        if parts:
            yield work(current, table, parts)

    return run


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, nulls, of = unsqueeze(row["a"]).view("<i8"), unsqueeze(row["b"]).astype(bool), unsqueeze(row["c"]).astype(np.int64)
            sizes, key_a, key_b = unsqueeze(row["d"]).reshape(3, -1)
            yield pa.record_batch([pa.array(ids, mask=nulls), sizes[of].view(np.int64), key_a[of].view(np.int64), key_b[of].view(np.int64)], schema=_DOCS)


_PREFIX = pa.schema([("gram", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _prefixes(threshold: int):
    """A row per prefix n-gram first met in this task, and links from the rows that meet it again.

    Thus a task sends each n-gram once, whatever number of its rows hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        for batch in batches:
            grams, ends_a, ends_b = [], [], []
            for row, size, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(content, "<u8")
                prefix = codes[: len(codes) - need(size, threshold) + 1].tolist()
                met = set()
                for code in prefix:
                    centre = first.setdefault(code, row)
                    if centre == row:
                        grams.append(code)
                        ends_a.append(row)
                        ends_b.append(None)
                    else:
                        met.add(centre)
                for centre in met:
                    grams.append(None)
                    ends_a.append(row)
                    ends_b.append(centre)
            yield pa.record_batch([pa.array(grams, pa.int64()), pa.array(ends_a, pa.int64()), pa.array(ends_b, pa.int64())], schema=_PREFIX)
            if len(first) > 2_000_000:
                first.clear()

    return run


_POSTING = pa.schema([("gram", pa.int64()), ("row", pa.int64())])


def _postings(threshold: int):
    """A row per prefix n-gram of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, contents = (c.to_pylist() for c in batch.columns)
            codes = [np.frombuffer(c, "<i8") for c in contents]
            prefixes = [c[: len(c) - need(size, threshold) + 1] for c, size in zip(codes, sizes, strict=True)]
            if prefixes:
                yield pa.record_batch([np.concatenate(prefixes), np.repeat(rows, [len(p) for p in prefixes])], schema=_POSTING)

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows with equal integer ``keys``, run by run."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        differs = np.zeros(table.num_rows - 1, bool)
        for name in keys:
            values = table[name].to_numpy()
            differs |= values[1:] != values[:-1]
        edges = np.concatenate([[0], np.flatnonzero(differs) + 1])
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(start, stop - start)
        held = table.slice(edges[-1])
    if held is not None:
        yield held


def overlaps(left: list[np.ndarray], right: list[np.ndarray], bound: np.ndarray) -> np.ndarray:
    """The product of two blocks of rows: overlap counts of ``left[i]`` and ``right[j]``.

    Columns are taken from rare to frequent, in chunks. A count is exact wherever it
    reaches ``bound[i, j]``; the product ends early once no pair's count and the
    n-grams that both rows have left can reach it.
    """
    shape = (len(left), len(right))
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    code = np.concatenate([*left, *right])
    row = np.concatenate([np.repeat(np.arange(shape[0]), sizes_l), np.repeat(np.arange(shape[1]), sizes_r)])
    on_left = np.arange(len(code)) < sizes_l.sum()
    _, column = np.unique(code, return_inverse=True)
    width = column.max(initial=-1) + 1
    n_left, n_right = np.bincount(column[on_left], minlength=width), np.bincount(column[~on_left], minlength=width)
    pairs = n_left * n_right
    total = np.zeros(shape, np.int64)
    ranks = np.argsort(pairs, kind="stable")
    place = np.empty(width, np.int64)
    place[ranks] = np.arange(width)
    ordered = pairs[ranks]
    start = int(np.searchsorted(ordered, 1))  # columns of one side only
    dense = int(np.searchsorted(ordered, DENSE * DENSE))
    column = place[column]
    by_column = np.argsort(column, kind="stable")
    column, row, on_left = column[by_column], row[by_column], on_left[by_column]
    edges = np.searchsorted(column, np.arange(width + 1))
    left_row, right_row = np.where(on_left, row, -1), np.where(on_left, -1, row)
    rest_l = np.bincount(row[on_left & (column >= start)], minlength=shape[0])
    rest_r = np.bincount(row[~on_left & (column >= start)], minlength=shape[1])
    if start < dense:  # rare columns: every pair of the column counts once
        own = slice(edges[start], edges[dense])
        c, l, r = column[own], left_row[own], right_row[own]
        of_l, of_r = l >= 0, r >= 0
        # the right entries of column c stand together; each left entry meets them in turn
        cl, rl, cr, rr = c[of_l], l[of_l], c[of_r], r[of_r]
        lo, hi = np.searchsorted(cr, cl), np.searchsorted(cr, cl, side="right")
        for step in range(0, len(cl), 1 << 16):
            n = (hi - lo)[step : step + (1 << 16)]
            i = np.repeat(rl[step : step + (1 << 16)], n)
            j = rr[np.repeat(lo[step : step + (1 << 16)], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            total += np.bincount(i * shape[1] + j, minlength=shape[0] * shape[1]).reshape(shape)
        rest_l -= np.bincount(rl, minlength=shape[0])
        rest_r -= np.bincount(rr, minlength=shape[1])
    for first in range(dense, width, CHUNK):
        if not (total + np.minimum(rest_l[:, None], rest_r[None, :]) >= bound).any():
            break
        last = min(width, first + CHUNK)
        own = slice(edges[first], edges[last])
        c, l, r = column[own] - first, left_row[own], right_row[own]
        a, b = np.zeros((shape[0], last - first), np.float32), np.zeros((shape[1], last - first), np.float32)
        a[l[l >= 0], c[l >= 0]] = 1
        b[r[r >= 0], c[r >= 0]] = 1
        total += (a @ b.T).astype(np.int64)
        rest_l -= np.bincount(l[l >= 0], minlength=shape[0])
        rest_r -= np.bincount(r[r >= 0], minlength=shape[1])
    return total


PAIR = ["unit", "part_a", "part_b"]
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _product(threshold: int):
    """Links within a run of two row blocks of a unit: each row and the smallest it is linked to.

    Rows of equal ``label`` are known to be linked and are not compared.
    """

    def work(table: pa.Table) -> pa.RecordBatch | None:
        part_a, part_b = table["part_a"][0].as_py(), table["part_b"][0].as_py()
        ids, sizes, part, label = (table[c].to_numpy() for c in ("row", "size", "part", "label"))
        grams = [np.frombuffer(g, "<u8") for g in table["grams"].to_pylist()]
        left, right = np.flatnonzero(part == part_a), np.flatnonzero(part == part_b)
        if not len(left) or not len(right):
            return None
        size_l, size_r = sizes[left][:, None], sizes[right][None, :]
        bound = -(-threshold * (size_l + size_r) // (100 + threshold))
        # no overlap reaches the bound of sizes that are too far apart
        bound = np.where(threshold * np.maximum(size_l, size_r) <= 100 * np.minimum(size_l, size_r), bound, np.iinfo(np.int64).max)
        bound = np.where(label[left][:, None] == label[right][None, :], np.iinfo(np.int64).max, bound)
        found = overlaps([grams[i] for i in left], [grams[i] for i in right], bound)
        i, j = np.nonzero(found >= bound)
        i, j = left[i], right[j]
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order[local_components(len(ids), rank[i], rank[j])]][rank]
        moved = np.flatnonzero(root != ids)
        return pa.record_batch([ids[moved], root[moved]], schema=_EDGES) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, PAIR):
            if table.num_rows > 1 and (found := work(table)) is not None:
                yield found

    return run


def zero_part(name: str) -> Column:
    return F.lit(0).alias(name)


def _meet(kept: DataFrame, placed: DataFrame, threshold: int, broadcast_rows: int) -> DataFrame:
    """Links ``a, b`` of the rows that ``placed`` (unit, part_a, part_b, part, row, label) brings together."""
    blocked = shuffled(placed, kept.count(), broadcast_rows).join(kept.select("row", "size", "grams"), "row").select(*PAIR, "part", "row", "label", "size", "grams")
    return blocked.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(released(_product(threshold)), "a long, b long")


def _stars(spark: SparkSession, kept: DataFrame, pairs: DataFrame, threshold: int, broadcast_rows: int) -> DataFrame:
    """Links among the ``pairs`` (a, b): each ``b`` meets its ``a`` in parts of ``STAR_ROWS`` rows."""
    counts = materialize(spark, pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts")), "jaccard-centres")
    centres = counts.select(F.col("b").alias("unit"), zero_part("part_a"), F.explode(F.sequence(F.lit(1), "parts")).alias("part_b"), zero_part("part"), F.col("b").alias("row"))
    part = (F.pmod(F.xxhash64("a"), F.col("parts")) + 1).cast("int")
    others = hot_join(spark, pairs, counts, ["b"], ["a"], broadcast_rows).select(F.col("b").alias("unit"), zero_part("part_a"), part.alias("part_b"), part.alias("part"), F.col("a").alias("row"))
    return materialize(spark, _meet(kept, centres.unionByName(others).withColumn("label", F.col("row")), threshold, broadcast_rows), "jaccard-star-links")


def _large_links(spark: SparkSession, kept: DataFrame, rows: DataFrame, stars: DataFrame, threshold: int, block_rows: int, broadcast_rows: int) -> DataFrame:
    """Links that join the rows ``rows`` (row, unit) of large components as all links between them do.

    ``stars`` has each row with the first rows of its prefix n-grams. In two rounds each
    row meets one of them that is not of its group yet, which joins most true groups.
    Then rows of different groups that share a prefix n-gram meet: where few rows share
    it, pair by pair, and else in row blocks. A large group has blocks of its own, which
    do not meet each other; the rest of a component is dealt to blocks by group, and two
    blocks meet only if they share an n-gram. So a chain of accidental neighbours costs
    as much as it has links, and a large group as much as it has rows.
    """
    # tables of a row per row of these components
    n_rows = rows.count()
    small = lambda table: F.broadcast(table) if n_rows <= broadcast_rows else shuffled(table, n_rows, broadcast_rows)
    kept = materialize(spark, kept.join(small(rows.select("row")), "row", "left_semi"), "jaccard-large-rows")
    sized = kept.select("row", "size", (F.length("grams") / 8).alias("held"))
    side = lambda n: small(sized.select(F.col("row").alias(n), F.col("size").alias(f"size_{n}"), F.col("held").alias(f"held_{n}")))
    fit = (threshold * F.greatest("size_a", "size_b") <= 100 * F.least("size_a", "size_b")) & (
        F.least("held_a", "held_b") * (100 + threshold) >= threshold * (F.col("size_a") + F.col("size_b"))
    )
    first = materialize(spark, stars.join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b"), "jaccard-stars")
    links, tried = None, None
    labels = rows.select("row", F.col("row").alias("label"))
    of = lambda name: small(labels.select(F.col("row").alias(name), F.col("label").alias(f"label_{name}")))
    for _ in range(2):
        open_pairs = first if tried is None else first.join(small(tried), ["a", "b"], "left_anti")
        open_pairs = open_pairs.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b")
        tried = materialize(spark, open_pairs.groupBy("a").agg(F.min("b").alias("b")), "jaccard-tried")
        new = _stars(spark, kept, tried, threshold, broadcast_rows)
        links = new if links is None else links.unionByName(new)
        # rows of one label are linked; rows that are linked may still have several, and are compared again then
        moved = new.groupBy("a").agg(F.min("b").alias("b")).join(of("b"), "b").select(F.col("a").alias("row"), F.col("label_b").alias("new"))
        labels = materialize(spark, labels.join(small(moved), "row", "left").select("row", F.coalesce("new", "label").alias("label")), "jaccard-labels")
        labels = materialize(spark, labels.withColumnRenamed("label", "b").join(of("b"), "b").select("row", F.col("label_b").alias("label")), "jaccard-labels")

    postings = kept.select("row", "size", "grams").mapInArrow(released(_postings(threshold)), "gram long, row long")
    postings = materialize(spark, postings.join(small(labels), "row"), "jaccard-postings")
    several = postings.groupBy("gram").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram", "rows")
    mixed = materialize(spark, postings.join(shuffled(several, postings.count(), broadcast_rows), "gram"), "jaccard-mixed")
    few, many = mixed.where(F.col("rows") <= FEW_ROWS), mixed.where(F.col("rows") > FEW_ROWS)
    a, b = (few.select("gram", F.col("row").alias(n), F.col("label").alias(f"l{n}")) for n in "ab")
    pairs = a.join(shuffled(b, mixed.count(), broadcast_rows), "gram").where("a > b and la <> lb").select("a", "b").distinct()
    pairs = materialize(spark, pairs.join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b"), "jaccard-few-pairs")
    links = links.unionByName(_stars(spark, kept, pairs, threshold, broadcast_rows))

    # blocks: those of a large group by itself, and those of the other rows of a component
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= block_rows)
    sizes = materialize(spark, sizes.select("label", F.ceil(F.col("n") / block_rows).alias("parts")), "jaccard-groups")
    placed = hot_join(spark, labels.join(small(rows.select("row", "unit")), "row"), sizes, ["label"], ["row"], broadcast_rows)
    rest = materialize(spark, placed.where("parts is null").groupBy("unit").agg(F.ceil(F.count("*") / block_rows).alias("rest")), "jaccard-others")
    placed = hot_join(spark, placed, rest, ["unit"], ["row"], broadcast_rows)
    own = F.xxhash64(F.lit(1), "label", F.pmod(F.xxhash64("row"), F.col("parts")))
    other = F.xxhash64(F.lit(2), "unit", F.pmod(F.xxhash64("label"), F.col("rest")))
    pure = F.when(F.col("parts").isNotNull(), F.col("label"))
    placed = materialize(spark, placed.select("row", "label", F.when(F.col("parts").isNotNull(), own).otherwise(other).alias("block"), pure.alias("pure")), "jaccard-blocks")
    held = materialize(spark, many.select("gram", "row").join(small(placed.select("row", "block", "pure")), "row").select("gram", "block", "pure").distinct(), "jaccard-held")
    x, y = (held.select("gram", F.col("block").alias(f"part_{n}"), F.col("pure").alias(f"pure_{n}")) for n in "ab")
    same = F.coalesce(F.col("pure_a") == F.col("pure_b"), F.lit(False))
    met = x.join(shuffled(y, held.count(), broadcast_rows), "gram").where((F.col("part_a") <= F.col("part_b")) & ~same).select("part_a", "part_b").distinct()
    met = materialize(spark, met, "jaccard-block-pairs")
    sides = met.select("part_a", "part_b", F.explode(F.array_distinct(F.array("part_a", "part_b"))).alias("block"))
    blocked = sides.join(small(placed.select("row", "label", "block")), "block").select(F.lit(0).cast("long").alias("unit"), "part_a", "part_b", F.col("block").alias("part"), "row", "label")
    last = materialize(spark, _meet(kept, blocked, threshold, broadcast_rows), "jaccard-rest")
    discard(spark, kept, first, postings, mixed, held)
    return links.unionByName(last)


def jaccard_components(
    spark: SparkSession,
    docs: DataFrame,
    words: int = 5,
    threshold: int = 75,
    batch_grams: int = BATCH_GRAMS,
    block_rows: int = BLOCK_ROWS,
    block_grams: int = BLOCK_GRAMS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A text's set holds its distinct runs of ``words`` words (A-Z lower-cased, words
    between ASCII white space); a text of fewer words is one run. Rows link when
    ``100 * intersection >= threshold * union``; ``component_id`` is the smallest
    doc_id reachable. N-grams are compared by 48 bits of a 64-bit hash.

    * Null texts and texts without words have an empty set and link with nothing.
    * Rows with equal sets link, so repeated rows share a component. Rows with a null
      doc_id take part and get the smallest known doc_id of their component.
    * An empty table gives an empty result; only doc_id and text are read.

    No list of pairs is made. Equal sets are one row; a frequent n-gram reaches its
    column block once per batch of documents; rows meet in blocks whose products send at
    most a link per row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    expected = (rows.agg(F.sum(F.length("t"))).first()[0] or 0) // WORD_BYTES
    blocks = min(MOST_COLUMNS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // COLUMN_GRAMS)))
    dealt = rows.mapInArrow(released(_deal(words, blocks, batch_grams)), DEALT).repartition("block").sortWithinPartitions("block")
    columns = materialize(spark, dealt.mapInArrow(released(_columns(blocks)), DEALT), "jaccard-columns")
    by_batch = columns.select("batch", "kind", "a", "b", "c", F.when(F.col("kind") == ROWS, F.col("d")).alias("d"))
    by_batch = by_batch.repartition("batch").sortWithinPartitions("batch")
    live = materialize(spark, by_batch.mapInArrow(released(_live(threshold)), LIVE), "jaccard-live")
    found = columns.where(F.col("kind") == ROWS).select("a", "b", "c", "d").mapInArrow(_documents, "doc_id long, n_shingles long, key_a long, key_b long")
    found = materialize(spark, found, "jaccard-docs")
    # one row for each set
    first = live.groupBy("key_a", "key_b").agg(F.min("row").alias("row")).select("row")
    kept = materialize(spark, live.join(shuffled(first, live.count(), broadcast_rows), "row", "left_semi"), "jaccard-rows")
    discard(spark, columns, live)

    prefixes = materialize(spark, kept.select("row", "size", "grams").mapInArrow(released(_prefixes(threshold)), "gram long, a long, b long"), "jaccard-prefixes")
    met = prefixes.where("gram is not null").select("gram", "a")
    centre = met.groupBy("gram").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = met.join(shuffled(centre, prefixes.count(), broadcast_rows), "gram").where("a <> b").select("a", "b").unionByName(prefixes.where("gram is null").select("a", "b")).distinct()
    stars = materialize(spark, stars, "jaccard-neighbours")
    discard(spark, prefixes)
    candidates = connected_components(spark, stars, broadcast_links=broadcast_rows).withColumnRenamed("component", "unit")
    held = (F.length("grams") / 8).alias("n")
    n_kept = kept.count()
    sized = shuffled(kept.select("row", held), n_kept, broadcast_rows)
    placed = materialize(spark, sized.join(candidates.withColumnRenamed("node", "row"), "row"), "jaccard-candidates")
    weights = placed.groupBy("unit").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    large = materialize(spark, weights.where((F.col("rows") > block_rows) | ((F.col("n") > block_grams) & (F.col("rows") > 2))).select("unit", F.lit(True).alias("large")), "jaccard-large")
    placed = hot_join(spark, placed, large, ["unit"], ["row"], broadcast_rows)
    one = placed.where("large is null").select("unit", zero_part("part_a"), zero_part("part_b"), zero_part("part"), "row", F.col("row").alias("label"))
    links = materialize(spark, _meet(kept, one, threshold, broadcast_rows), "jaccard-links")
    if not large.isEmpty():
        links = links.unionByName(_large_links(spark, kept, placed.where("large").select("row", "unit"), stars, threshold, block_rows, broadcast_rows))
    joined = connected_components(spark, links, broadcast_links=broadcast_rows)

    sets = found.where("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    keys = shuffled(kept.select(F.col("row").alias("node"), "key_a", "key_b"), n_kept, broadcast_rows)
    linked = joined.join(keys, "node").select("component", "key_a", "key_b")
    sets = sets.join(shuffled(linked, n_kept, broadcast_rows), ["key_a", "key_b"], "left")
    least = sets.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    known = sets.join(shuffled(least, n_kept, broadcast_rows), "component", "left").where("component is not null or n > 1")
    known = materialize(spark, known.select("key_a", "key_b", F.coalesce("component_id", "least").alias("component_id")), "jaccard-sets")
    discard(spark, kept, stars)
    out = hot_join(spark, found, known, ["key_a", "key_b"], ["doc_id"], broadcast_rows)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """One row of each component of ``docs``, with the columns of ``docs``.

    That of the smallest doc_id stays; ids that are null come last, and of rows with one
    id that of the smallest hash. What counts is the row: where a doc_id has several
    texts, each stays or goes by its own. Of rows equal in id and text one stays. Rows
    without words are nobody's copies and all stay. Rows are told apart by a 64-bit hash
    of id and text; an empty table stays empty.
    """
    tag = free_name(docs, "_tag")
    marked = docs.withColumn(tag, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    named = marked.select(F.col(tag).alias("doc_id"), "text")
    found = jaccard_components(spark, named, **options).where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    found = materialize(spark, found.withColumnRenamed("doc_id", "tag"), "jaccard-found")
    n_found = found.count()
    apart = lambda table: shuffled(table, n_found, broadcast_ids)
    several = found.where("tag <> component_id").select("component_id").distinct()
    members = found.join(apart(several), "component_id", "left_semi")
    ids = marked.select(F.col(tag).alias("tag"), F.col("doc_id").cast("long").alias("id")).join(apart(members.select("tag")), "tag", "left_semi")
    ranked = members.join(apart(ids.groupBy("tag").agg(F.min("id").alias("id"))), "tag")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag"))["tag"].alias("tag")
    gone = materialize(spark, members.join(apart(ranked.groupBy("component_id").agg(best)), "tag", "left_anti").select(F.col("tag").alias(tag)), "jaccard-gone")
    repeated = materialize(spark, found.where("n > 1").join(apart(gone), F.col("tag") == F.col(tag), "left_anti").select(F.col("tag").alias(tag)), "jaccard-repeated")
    small = lambda table: F.broadcast(table) if (n := table.count()) <= broadcast_ids else shuffled(table, n, broadcast_ids)  # noqa: E731 -- some 30 MB
    stay = marked.join(small(gone), tag, "left_anti")
    if not repeated.isEmpty():
        stay = stay.join(small(repeated), tag, "left_anti").unionByName(stay.join(small(repeated), tag, "left_semi").dropDuplicates([tag]))
    return stay.select(*docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM overlap o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o.n >= 75 * (x.n + y.n - o.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
