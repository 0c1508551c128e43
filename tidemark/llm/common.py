"""Shared pieces: the cluster's shared folder, written tables, executor files, batching."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import filesystem, qualified  # noqa: F401
from tidemark.sources.folders import work_dir as shared_dir


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table cuts the lineage, so later readers neither repeat the work
    nor depend on a lost executor. ``discard`` deletes it once nothing reads it any more.
    """
    path = shared_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned; all that was made from them must be written by now."""
    for table in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop(table))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tables(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into ones of about ``limit`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Rows:
    """Collects output rows and hands out an Arrow batch whenever ``limit`` bytes are held."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20):
        self.schema, self.limit = schema, limit
        self._clear()

    def _clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.held = 0

    def add(self, size: int, *values) -> bool:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.held += size + 32
        return self.held >= self.limit

    def batch(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self._clear()
        return out


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task and is idle or does other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def released(run: Callable) -> Callable:
    """``run`` over Arrow batches, with ``release`` when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def plain_text(column: str = "text"):
    """The column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffled(table: DataFrame, rows: int, broadcast_rows: int) -> DataFrame:
    """``table`` as the side of a join that is not broadcast if more than ``broadcast_rows`` rows stand behind it.

    Spark judges a side by the size of the files it comes from. There equal values take next to nothing, and
    copies that ``explode`` makes are not counted, so the driver could have to build a table of any size.
    """
    return table.hint("merge") if rows > broadcast_rows else table


def hot_join(spark: SparkSession, rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], broadcast_rows: int, salts: int = 32) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique in ``keys``), where a key may hold a third of ``rows``.

    A table of at most ``broadcast_rows`` rows is broadcast. A larger one is repeated
    ``salts`` times, and the rows of a key are dealt to its copies by a hash of ``spread``.
    """
    if (count := table.count()) <= broadcast_rows:
        return rows.join(F.broadcast(table), keys, "left")
    salt = free_name(rows, "salt")
    salted = shuffled(table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), count, broadcast_rows)
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, salt], "left").drop(salt)
