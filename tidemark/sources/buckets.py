"""Keyed tables in hash buckets with versions: a change rewrites its buckets, a lookup opens one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.folders import qualified

#: Where a row lies, as a column of the stored files.
BUCKET = "_bucket"


class BucketedTable:
    """A table whose rows lie in buckets by a hash of their key, at a path that all machines share.

    A version is a small file that names, for each bucket, the folder that holds it; folders
    are written once and never changed. A change writes new folders for the buckets that it
    touches and then the next version's file, which either is there whole or does not count:
    a job that ends before that leaves the version before it, and readers of a version keep
    it until ``vacuum``. Two writers that start from one version cannot both succeed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path).rstrip("/")
        self._fs = self._where("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _where(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # --- versions

    def versions(self) -> list[int]:
        """The numbers of the version files that are there, sound or not."""
        folder = self._where("versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in self._fs.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> dict | None:
        stream = self._fs.open(self._where(f"versions/{version:08d}.json"))
        try:
            found = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(found)
        except ValueError:  # its writer ended before it was whole
            return None

    def version(self, number: int | None = None) -> tuple[int, dict]:
        """The version ``number``, or the last that is whole."""
        for n in [number] if number is not None else reversed(self.versions()):
            if (found := self._load(n)) is not None:
                return n, found
        raise FileNotFoundError(f"no version of {self.path}")

    def _commit(self, base: int, content: dict) -> int:
        number = max([base, *self.versions()]) + 1
        if number > base + 1 and any(self._load(n) is not None for n in range(base + 1, number)):
            raise RuntimeError(f"another writer changed {self.path} since version {base}")
        # the file must be new, so of two writers one fails here
        out = self._fs.create(self._where(f"versions/{number:08d}.json"), False)
        out.write(json.dumps(content).encode())
        out.close()
        return number

    # --- rows

    def bucket(self, count: int, key: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")

    def _write(self, rows: DataFrame, key: Sequence[str], count: int) -> dict[str, str]:
        """``rows`` in a new folder; ``{bucket: its folder}``."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, self.bucket(count, key)).repartition(BUCKET).sortWithinPartitions(BUCKET, *key)
        placed.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._where(folder)) if f.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def create(self, rows: DataFrame, key: Sequence[str], buckets: int = 64) -> int:
        """Store ``rows`` as the first version; nothing may be there."""
        if self.versions():
            raise FileExistsError(self.path)
        content = {"key": list(key), "buckets": buckets, "schema": rows.schema.jsonValue(), "files": self._write(rows, key, buckets)}
        return self._commit(0, content)

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, all or those of some buckets."""
        return self._rows(self.version(version)[1], buckets)

    def _rows(self, content: dict, buckets: Sequence[int] | None) -> DataFrame:
        schema = StructType.fromJson(content["schema"])
        wanted = content["files"].values() if buckets is None else [content["files"][str(b)] for b in buckets if str(b) in content["files"]]
        folders = [f"{self.path}/{f}" for f in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, *keys: tuple, version: int | None = None) -> DataFrame:
        """The rows of the given keys; none for a key that is not there. Opens one bucket per key."""
        content = self.version(version)[1]
        kinds = {f.name: f.dataType for f in StructType.fromJson(content["schema"])}
        values = [[F.lit(v).cast(kinds[k]) for v, k in zip(key, content["key"], strict=True)] for key in keys]
        asked = self.spark.range(1).select(*[F.pmod(F.xxhash64(*v), F.lit(content["buckets"])) for v in values]).first() if values else []
        hit = F.lit(False)
        for v in values:
            same = F.lit(True)
            for name, value in zip(content["key"], v, strict=True):
                same = same & F.col(name).eqNullSafe(value)
            hit = hit | same
        return self._rows(content, sorted(set(asked))).where(hit)

    def find(self, asked: DataFrame, version: int | None = None) -> DataFrame:
        """``asked``, which has the key's columns, with the other columns of its rows; null where a key is not there.

        Opens the buckets of the keys that are asked for; for a batch of a stream, say.
        """
        content = self.version(version)[1]
        buckets = [r[0] for r in asked.select(self.bucket(content["buckets"], content["key"]).alias(BUCKET)).distinct().collect()]
        return asked.join(self._rows(content, sorted(buckets)), content["key"], "left")

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of the keys of ``changes`` by ``apply(their rows, changes)``; the buckets touched.

        ``apply`` must return all rows of these buckets, new ones included, and none of
        others. Rows of other buckets are neither read nor written.
        """
        base, content = self.version()
        touched = sorted(r[0] for r in changes.select(self.bucket(content["buckets"], content["key"]).alias(BUCKET)).distinct().collect())
        if not touched:
            return []
        schema = StructType.fromJson(content["schema"])
        rows = apply(self._rows(content, touched), changes).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        written = self._write(rows, content["key"], content["buckets"])
        if astray := sorted(set(map(int, written)) - set(touched)):
            raise ValueError(f"rows of other buckets came out: {astray}")
        files = {b: f for b, f in content["files"].items() if int(b) not in set(touched)} | written
        self._commit(base, {**content, "files": files})
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` whole versions, and the folders that none of these names."""
        whole = [n for n in self.versions() if self._load(n) is not None][-keep:]
        used = {f for n in whole for f in self._load(n)["files"].values()}
        gone = []
        for n in self.versions():
            if n < whole[0]:
                self._fs.delete(self._where(f"versions/{n:08d}.json"), False)
        for folder in self._fs.listStatus(self._where("data")):
            name = f"data/{folder.getPath().getName()}"
            parts = [p.getPath().getName() for p in self._fs.listStatus(folder.getPath()) if p.isDirectory()]
            for part in parts:
                if f"{name}/{part}" not in used:
                    self._fs.delete(self._where(f"{name}/{part}"), True)
                    gone.append(f"{name}/{part}")
            if all(f"{name}/{p}" not in used for p in parts):
                self._fs.delete(folder.getPath(), True)
        return gone
