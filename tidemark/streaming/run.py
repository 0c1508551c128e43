"""Running a streaming plan to its present end and reading what it wrote."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.upsert import keep_last
from tidemark.sources.folders import work_dir


def read_files(spark: SparkSession, folder: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A stored table, one file or a folder of part files, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        path = path[:-1] + "[t]"  # a stream takes a plain path for a folder, and what a pattern finds as it is
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def date_in_order(spark: SparkSession, folder: str) -> None:
    """Date a written table's files a second apart by their part numbers: a stream takes older files first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    last = int(time.time()) - 1
    for i, part in enumerate(parts):
        fs.setTimes(part, (last - len(parts) + i) * 1000, -1)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as state with timers and lists must."""
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), name: str = "stream", endless: bool = False, longest: float = 120.0, growing: bool = False) -> DataFrame:
    """Process all that is there, each batch written once under its number; returns the rows.

    In update mode a key's latest batch counts. ``endless`` is for plans on the clock,
    which go on with batches without input; they are stopped at the first of those,
    or after ``longest`` seconds. ``growing`` is for sources that give out a bounded part of
    what is there at a time; they are stopped when all of it is done.
    """
    spark = stream.sparkSession
    folder = work_dir(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put)
    if endless:
        query, began, fed = writer.trigger(processingTime="0 seconds").start(), time.monotonic(), False
        while query.isActive and time.monotonic() - began < longest:
            progress = query.lastProgress
            rows = progress["numInputRows"] if progress else None
            fed = fed or bool(rows)
            if fed and rows == 0:
                break
            time.sleep(0.2)
        query.stop()
        if query.exception():
            raise query.exception()
    elif growing:
        query = writer.trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    try:
        found = spark.read.option("recursiveFileLookup", "true").schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/out")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    return (keep_last(found, list(keys), ["_batch"]) if mode == "update" else found).drop("_batch")
