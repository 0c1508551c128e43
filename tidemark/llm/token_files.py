"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds whole documents. Layout, all integers little-endian:

    8 bytes   magic
    4 x u64   documents, ids, distinct ids, data bytes
    u32[]     the distinct ids by falling frequency (ties to the lower id)
    i64[]     document ids, u8[] 1 where the document id is null
    u64[]     ids per document
    u8[]      control bytes: two bits per id, its rank's byte length less one
    u8[]      ranks, each in as few bytes as it needs
    u32       crc32 of all before

Ranks below 256 take one byte; control bytes lie apart from the data, so a
256-row table turns each into four lengths and numpy gathers all ids at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Rows, filesystem, materialize, plain_text, qualified, released, shared_dir
from tidemark.llm.vocabulary import default_vocabulary, split_words, word_ids

MAGIC = b"TMTOKEN1"
#: A file is closed once it holds so many ids.
FILE_IDS = 4 << 20

#: Files are read by at most so many tasks.
READ_TASKS = 20_000

#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks."""
    ranks = ranks.astype("<u4", copy=False)
    extra = (ranks > 0xFF).astype(np.uint8)
    extra += ranks > 0xFFFF
    extra += ranks > 0xFFFFFF
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks again, by table lookup of the control bytes."""
    lengths = LENGTHS[control].ravel()[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for place in (1, 2, 3):
        at = np.flatnonzero(lengths > place)
        if not len(at):
            break
        ranks[at] |= data[starts[at] + place].astype(np.uint32) << np.uint32(8 * place)
    return ranks


def dump(documents: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    distinct = np.flatnonzero(counts)
    by_rank = distinct[np.argsort(-counts[distinct], kind="stable")].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    control, data = pack(rank[ids])
    body = b"".join(
        (
            MAGIC,
            np.array([len(documents), len(ids), len(by_rank), len(data)], "<u8").tobytes(),
            by_rank.tobytes(),
            np.array([d or 0 for d in documents], "<i8").tobytes(),
            np.array([d is None for d in documents], np.uint8).tobytes(),
            np.array(lengths, "<u8").tobytes(),
            control,
            data,
        )
    )
    return body + zlib.crc32(body).to_bytes(4, "little")


def load(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, all ids."""
    if content[:8] != MAGIC or zlib.crc32(content[:-4]) != int.from_bytes(content[-4:], "little"):
        raise ValueError("not a whole token file")
    n_docs, n_ids, n_distinct, n_data = (int(x) for x in np.frombuffer(content, "<u8", 4, 8))
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, count, at)
        at += found.nbytes
        return found

    by_rank, documents, nulls, lengths = take("<u4", n_distinct), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    ids = by_rank[unpack(control, data, n_ids)] if n_ids else np.zeros(0, "<u4")
    return [None if gone else int(d) for d, gone in zip(documents, nulls, strict=True)], lengths.astype(np.int64), ids


MANIFEST = "part int, file int, path string, n_docs long, n_ids long, n_bytes long"
_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def _write(vocabulary: str, end_id: int, folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files, root = filesystem(folder)
        cache, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        documents, lengths, pieces, held, number = [], [], [], 0, 0
        out = Rows(_MANIFEST)

        def close() -> None:
            nonlocal documents, lengths, pieces, held, number
            content = dump(documents, lengths, np.frombuffer(b"".join(pieces), "<u4"))
            path = f"{root}/part-{part:07d}-{number:05d}.ids"
            with files.open_output_stream(f"{path}.{attempt}.tmp") as f:
                f.write(content)
            files.move(f"{path}.{attempt}.tmp", path)  # a repeated task puts equal bytes in its place
            out.add(0, part, number, path, len(documents), sum(lengths), len(content))
            documents, lengths, pieces, held = [], [], [], 0
            number += 1

        for batch in batches:
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(cache.__getitem__, split_words(text.as_py()))) + end
                documents.append(document)
                lengths.append(len(ids) // 4)
                pieces.append(ids)
                held += len(ids) // 4
                if held >= file_ids:
                    close()
        if documents:
            close()
        yield out.batch()

    return run


def write_token_files(
    spark: SparkSession,
    docs: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode ``docs`` into files in ``folder`` in ascending ``key`` order; returns the manifest.

    The manifest has a row per file; files follow each other by (part, file).
    Null texts are empty and hold only the end id; null keys come first; rows with
    equal keys follow by text; an empty table gives no files. Only ``key`` and
    ``text`` are read, so clashing extra columns do no harm.
    """
    folder = qualified(spark, folder)
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("k"), plain_text(text).alias("t"))
    # equal keys can be dealt apart by their texts
    dealt = rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")
    written = dealt.mapInArrow(released(_write(vocabulary or default_vocabulary(), end_id, folder, file_ids)), MANIFEST)
    return materialize(spark, written, "token-manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all files before; sums go by blocks of parts."""
    block = F.floor(F.col("part") / 256)
    files = manifest.withColumn("block", block)
    inside = Window.partitionBy("block").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.groupBy("block").agg(F.sum("n_ids").alias("ids"))
    blocks = blocks.select("block", F.coalesce(F.sum("ids").over(above), F.lit(0)).alias("base"))
    files = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return files.join(blocks, "block").select(*manifest.columns, (F.col("base") + F.col("inside")).alias("start"))


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        out = Rows(_READ)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(row["path"]) as f:
                    documents, lengths, ids = load(f.read())
                start, at = row["start"], 0
                content = ids.astype("<u4", copy=False).tobytes()
                for document, length in zip(documents, lengths.tolist(), strict=True):
                    if out.add(4 * length, document, start + at, length, content[4 * at : 4 * (at + length)]):
                        yield out.batch()
                    at += length
        yield out.batch()

    return run


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files, ids as unsigned 32-bit bytes."""
    starts = file_starts(manifest).select("path", "start")
    tasks = max(1, min(manifest.count(), READ_TASKS))
    return starts.repartition(tasks).mapInArrow(released(_read(qualified(spark, folder))), "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    manifest = write_token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    read = read_token_files(spark, manifest, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
