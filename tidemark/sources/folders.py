"""Folders that all machines share: their full names, new ones for a run, plain files in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without means Hadoop's default file system, as it does to Spark."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one. A session of one machine without one gets its own; a cluster must name it.

    All of an application's folders lie in one, which its driver deletes when it ends.
    """
    root = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SHARED} must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(SHARED, root)
    own = f"{qualified(spark, root).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    if own not in _marked:
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _marked.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_marked: set[str] = set()


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later readers depend on no lost executor and repeat no work."""
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """``(filesystem, path)`` for a ``qualified`` folder, in the driver or a worker."""
    from pyarrow import fs

    # Hadoop writes file:/folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
