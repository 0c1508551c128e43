"""BPE encoding and decoding over a table of distinct words.

Texts are split into words once. Blocks of documents keep, per document, the
positions of its words in the block's own word list; the word lists are brought
together by word and each distinct word is encoded once. The ids of the distinct
words are joined with a table of (id, piece), which decodes them. Ids and decoded
words go back to every block that lists the word, by position.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Rows, filesystem, free_name, materialize, plain_text, released, shared_dir
from tidemark.llm.vocabulary import default_vocabulary, encode_words, split_words, tokenizer

#: A block is closed once its texts hold so many characters.
BLOCK_CHARS = 32 << 20
#: Words are dealt to parts of about so many listed words, and to at most so many parts.
PART_WORDS, MOST_PARTS = 200_000, 8_192
#: Distinct words of a part that are known at a time; beyond, it starts anew.
KNOWN_WORDS = 1_000_000
#: A larger vocabulary is not broadcast.
MOST_PIECES = 2_000_000

BLOCK = "block long, n_words long, words binary"
_BLOCK = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary())])


def squeeze(content: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(content)


def unsqueeze(content: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(content)


class _Places(dict):
    """Word to its place in the order of first meeting."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def block_path(root: str, block: int) -> str:
    return f"{root}/block-{block}"


def _blocks(folder: str, block_chars: int):
    """Blocks of documents: word list by falling frequency, and each document's places in it.

    The word list is the block's row; documents and places stay in a file of the block in
    ``folder``. Places are kept as byte planes (lowest bytes together, and so on), which
    squeeze well as most places are small. Words hold no line feed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId() << 32, TaskContext.get().taskAttemptId()
        files, root = filesystem(folder)
        table = _Places()
        docs, sizes, places, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, docs, sizes, places, held, table
            met = np.concatenate(places) if places else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(met, minlength=len(table)), kind="stable")
            rank = np.empty(len(table), "<u4")
            rank[order] = np.arange(len(table), dtype="<u4")
            planes = rank[met].view(np.uint8).reshape(-1, 4)
            words = list(table)
            content = [np.array([len(docs)], "<u8").tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(), np.array(sizes, "<u8").tobytes()]
            packed = [squeeze(b"".join(content)), *(squeeze(planes[:, i].tobytes()) for i in range(4))]
            path = block_path(root, number)
            with files.open_output_stream(f"{path}.{attempt}.tmp") as f:
                for part in packed:
                    f.write(len(part).to_bytes(8, "little") + part)
            files.move(f"{path}.{attempt}.tmp", path)  # a repeated task puts an equal block in its place
            row = [number, len(words), squeeze("\n".join([words[i] for i in order.tolist()]).encode())]
            number += 1
            table = _Places()
            docs, sizes, places, held = [], [], [], 0
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = np.array(list(map(table.__getitem__, split_words(text))), "<u4")
                docs.append(doc)
                sizes.append(len(found))
                places.append(found)
                held += len(text) + 16
                if held >= block_chars:
                    yield close()
        if docs:
            yield close()

    return run


def read_block(content: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """A block's documents, the number of words of each, and the places of all words."""
    parts, at = [], 0
    for _ in range(5):
        size = int.from_bytes(content[at : at + 8], "little")
        parts.append(unsqueeze(content[at + 8 : at + 8 + size]))
        at += 8 + size
    count = int(np.frombuffer(parts[0], "<u8", 1)[0])
    docs = np.frombuffer(parts[0], "<i8", count, 8).tolist()
    nulls = np.frombuffer(parts[0], np.uint8, count, 8 + 8 * count)
    sizes = np.frombuffer(parts[0], "<u8", count, 8 + 9 * count).tolist()
    places = np.stack([np.frombuffer(p, np.uint8) for p in parts[1:]], axis=1).view("<u4").ravel()
    return [None if gone else d for d, gone in zip(docs, nulls, strict=True)], sizes, places


_LISTED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])


def _deal(parts: int):
    """Each block's words, dealt to ``parts`` by their hash, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = unsqueeze(packed.as_py()).split(b"\n")
                if words == [b""]:
                    continue
                part = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in range(parts):
                    own = order[edges[p] : edges[p + 1]]
                    if len(own):
                        steps = np.diff(own, prepend=0).astype("<u4")
                        out.append({"part": p, "block": block, "places": squeeze(steps.tobytes()), "words": squeeze(b"\n".join([words[i] for i in own.tolist()]))})
                yield pa.RecordBatch.from_pylist(out, schema=_LISTED)

    return run


TOKENS = "grp long, no int, id long, block long, places binary, numbers binary"
_TOKENS = pa.schema([("grp", pa.int64()), ("no", pa.int32()), ("id", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("numbers", pa.binary())])


def _encode(vocabulary: str, known_words: int):
    """Encodes each distinct word of a part once; the rows of a part follow each other.

    Each block's row, with the numbers of its words, comes behind a row for every id of
    the words that are new in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        current, group = None, -1
        for batch in batches:
            for part, block, places, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current or len(known) > known_words:
                    known, current, group = {}, part, group + 1
                words = unsqueeze(words).split(b"\n")
                new = [w for w in words if w not in known]
                first = len(known)
                known.update(zip(new, range(first, first + len(new)), strict=True))
                ids = encode_words(vocabulary, [w.decode() for w in new])
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
                no = np.repeat(np.arange(first, first + len(new), dtype=np.int32), [len(i) // 4 for i in ids])
                for start in range(0, len(flat), 1 << 16):
                    own = slice(start, start + (1 << 16))
                    some = [np.full(len(no[own]), group), no[own], flat[own]]
                    yield pa.record_batch([*map(pa.array, some), *(pa.nulls(len(no[own]), f.type) for f in list(_TOKENS)[3:])], schema=_TOKENS)
                numbers = squeeze(np.fromiter(map(known.__getitem__, words), "<u4", len(words)).tobytes())
                values = [group, None, None, block, places, numbers]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _TOKENS, strict=True)], schema=_TOKENS)

    return run


WORDS = "block long, places binary, lengths binary, ids binary, sizes binary, texts binary"
_WORDS = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("places", "lengths", "ids", "sizes", "texts"))])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's row again, with the ids of its words and their pieces, put together in the order of the rows."""
    group, ids, texts = None, [], []
    held: list[tuple] = []

    def settle() -> None:
        """Takes in the words whose rows have come."""
        if not held:
            return
        no, flat = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        pieces = [p for h in held for p in h[2]]
        held.clear()
        if no[0] < len(ids) or (no[1:] < no[:-1]).any():
            raise RuntimeError("the join with the pieces has changed the order of the rows")
        edges = np.concatenate([[0], np.flatnonzero(no[1:] != no[:-1]) + 1, [len(no)]]).tolist()
        content = flat.astype("<u4").tobytes()
        for number, start, stop in zip(no[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            fill = number - len(ids)  # words without ids
            ids.extend([b""] * fill)
            texts.extend([b""] * fill)
            ids.append(content[4 * start : 4 * stop])
            texts.append(" ".join(pieces[start:stop]).encode())

    for batch in batches:
        groups, blocks = batch.column(0).to_numpy(), batch.column(3)
        marks = np.flatnonzero(np.asarray(blocks.is_valid())).tolist()
        at = 0
        for stop in [*marks, batch.num_rows]:
            if stop > at:
                if groups[at] != group:
                    settle()
                    group, ids, texts = groups[at], [], []
                some = batch.slice(at, stop - at)
                held.append((some.column(1).to_numpy(), some.column(2).to_numpy(), some.column(6).to_pylist()))
            if stop < batch.num_rows:
                settle()
                if groups[stop] != group:
                    group, ids, texts = groups[stop], [], []
                row = batch.slice(stop, 1)
                numbers = np.frombuffer(unsqueeze(row.column(5)[0].as_py()), "<u4").tolist()
                fill = max(numbers, default=-1) + 1 - len(ids)
                ids.extend([b""] * fill)
                texts.extend([b""] * fill)
                packed = []
                for table in (ids, texts):
                    own = [table[n] for n in numbers]
                    packed += [np.array([len(x) for x in own], "<u4").tobytes(), b"".join(own)]
                packed[1] = np.frombuffer(packed[1], np.uint8).reshape(-1, 4).T.tobytes()  # byte planes
                yield pa.record_batch([row.column(3), row.column(4), *(pa.array([squeeze(p)], pa.binary()) for p in packed)], schema=_WORDS)
            at = stop + 1


ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _cut(sizes: bytes, content: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    return [content[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _unplaned(planes: bytes) -> bytes:
    return np.frombuffer(unsqueeze(planes), np.uint8).reshape(4, -1).T.tobytes()


def _documents(folder: str):
    """The documents of each block with the ids of their words, and the texts that the ids decode to.

    The rows of a block, of all parts, follow each other.
    """

    def work(block: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        with files.open_input_stream(block_path(root, block)) as f:
            docs, sizes, places = read_block(f.read())
        steps = [np.cumsum(np.frombuffer(unsqueeze(r["places"]), "<u4")).tolist() for r in rows]
        ids: list[bytes] = [b""] * sum(map(len, steps))
        texts: list[bytes] = [b""] * len(ids)
        for row, step in zip(rows, steps, strict=True):
            for place, own, text in zip(step, _cut(unsqueeze(row["lengths"]), _unplaned(row["ids"])), _cut(unsqueeze(row["sizes"]), unsqueeze(row["texts"])), strict=True):
                ids[place], texts[place] = own, text
        out, at = Rows(_ENCODED), 0
        for doc, size in zip(docs, sizes, strict=True):
            own = places[at : at + size].tolist()
            at += size
            content = b"".join(map(ids.__getitem__, own))
            # a word without ids has no pieces, and no space of its own either
            decoded = b" ".join(filter(None, map(texts.__getitem__, own)))
            if out.add(len(content) + len(decoded), doc, len(content) // 4, content, decoded):
                yield out.batch()
        yield out.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current and current is not None:
                    yield from work(current, held)
                    held = []
                current = row["block"]
                if row["places"] is not None:
                    held.append(row)
        if current is not None:
            yield from work(current, held)

    return run


def id_pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """``id, piece``: the decoding table of a vocabulary."""
    loaded = tokenizer(vocabulary)
    size = loaded.get_vocab_size(with_added_tokens=True)
    if size > MOST_PIECES:
        raise ValueError(f"a vocabulary of {size} pieces is too large to broadcast")
    table = pa.table({"id": pa.array(range(size), pa.int64()), "piece": pa.array([loaded.id_to_token(i) or "" for i in range(size)], pa.string())})
    return spark.createDataFrame(table)


_POSITIONS = pa.schema([("row", pa.int64()), ("pos", pa.int64()), ("id", pa.int64())])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(content.as_py() or b"", "<u4").astype(np.int64)
            for start in range(0, len(ids), 1 << 16):
                own = ids[start : start + (1 << 16)]
                yield pa.record_batch([np.full(len(own), row), np.arange(start, start + len(own)), own], schema=_POSITIONS)


def decode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of its ``ids`` (little-endian unsigned 32-bit integers), wherever they come from.

    Every id is joined with its piece and put back by position, pieces joined by spaces.
    Ids that the vocabulary does not know give nothing; null or empty ids give an empty
    text; repeated rows are decoded each. If ``docs`` has a column ``decoded``, the new
    one ends in an underscore. ``encode_documents`` decodes the distinct words alone.
    """
    row, name = free_name(docs, "_row"), free_name(docs, "decoded")
    numbered = materialize(spark, docs.withColumn(row, F.monotonically_increasing_id()), "bpe-rows")
    tokens = numbered.select(row, ids).mapInArrow(released(_positions), "row long, pos long, id long")
    met = tokens.join(F.broadcast(id_pieces(spark, vocabulary or default_vocabulary())), "id").groupBy(F.col("row").alias(row))
    texts = met.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias(name))
    found = numbered.join(texts, row, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], name)


def encode_documents(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers without special tokens added;
    ``decoded`` is the vocabulary's decoding of them, pieces joined by spaces.

    Null texts count as empty and give no ids and an empty text; a very long text
    makes a block of its own; rows with equal or null keys are encoded each on their
    own; an empty table gives an empty result. Only ``key`` and ``text`` are read.

    A word goes back once to each block that lists it, so the commonest word has as
    many rows as there are blocks, not as many as it has places. Places stay in a file of
    their block in the shared folder, where the task that puts the block together reads it.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(key).cast("long").alias("k"), plain_text(text).alias("t"))
    folder = shared_dir(spark, "bpe-places")
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    blocks = materialize(spark, rows.mapInArrow(released(_blocks(folder, block_chars)), BLOCK), "bpe-blocks")
    listed = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = min(MOST_PARTS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed // PART_WORDS)))
    words = blocks.select("block", "words").mapInArrow(released(_deal(parts)), "part int, block long, places binary, words binary")
    dealt = words.repartition("part").sortWithinPartitions("part")
    # a row per id of each distinct word; a broadcast join keeps the rows of a task in order
    tokens = dealt.mapInArrow(released(_encode(vocabulary, known_words)), TOKENS)
    decoded = tokens.join(F.broadcast(id_pieces(spark, vocabulary)), "id", "left").select(*tokens.columns, "piece")
    back = decoded.mapInArrow(released(_decoded), WORDS)
    # a block whose texts have no words comes by itself
    none = [F.lit(None).cast("binary").alias(c) for c in ("places", "lengths", "ids", "sizes", "texts")]
    back = back.unionByName(blocks.where("n_words = 0").select("block", *none))
    return back.repartition("block").sortWithinPartitions("block").mapInArrow(released(_documents(folder)), ENCODED)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
