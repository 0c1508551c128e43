"""Keyed tables on files: keep first, keep last, merge, swap, logs, versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    latest = Window.partitionBy(*keys).orderBy(*[(o if isinstance(o, Column) else F.col(o)).desc() for o in order])
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``old`` and the new rows whose key it lacks; of new rows with one key the first by ``order``."""
    return old.unionByName(fresh_rows(old, new, keys, order))


def fresh_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that ``insert_ignore`` appends."""
    first = Window.partitionBy(*keys).orderBy(*order)
    once = new.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return once.join(old.select(*keys), list(keys), "left_anti").select(*old.columns)


def insert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``new`` over ``old``; of new rows with one key the last by ``order``."""
    once = keep_last(new, keys, order)
    return old.join(once.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(once.select(*old.columns))


def merge_incremental(old: DataFrame | None, new: DataFrame, key: str = "cs") -> DataFrame:
    """Bag union of both, missing columns null, one row per ``key`` with the new one kept; in no order."""
    if old is None:
        return keep_last(new.withColumn("_src", F.lit(1)), [key], ["_src"]).drop("_src")
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, [key], ["_src"]).drop("_src")


def update_by_id(ledger: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``ledger`` with the non-null columns of ``changes`` put in by ``key``."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    return ledger.join(renamed, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in ledger.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is stored; one whose replacement was cut off between its two renames is put back first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        for left in (f"{path}.new", f"{path}.old"):
            aside = spark._jvm.org.apache.hadoop.fs.Path(left)
            # the new table is whole once its writer has marked it
            if fs.exists(aside) and (left.endswith(".old") or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{left}/_SUCCESS"))):
                return fs.rename(aside, where)
        return False
    return True


def swap_write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite a parquet folder that ``df`` may be reading: write beside it, then rename.

    A job that ends between the renames leaves the new table beside; ``exists`` puts it
    in place, for readers that ask it first, as all of this package do.
    """
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    old, aside = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.new")
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"could not put {path} in place")
    fs.delete(aside, True)


def write_incremental(spark: SparkSession, new: DataFrame, path: str, key: str = "cs", incremental: bool = True) -> None:
    """Merge into the stored table by ``key``, or replace it; each file is in the order of ``key``."""
    old = spark.read.parquet(path) if incremental and exists(spark, path) else None
    swap_write(spark, merge_incremental(old, new, key).sortWithinPartitions(key), path)


def known_keys(spark: SparkSession, path: str, key: str = "cs", kind: str = "long") -> DataFrame:
    """The stored keys, read as that column alone; none if nothing is stored."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} {kind}")
    return spark.read.parquet(path).select(key)


def parse_guard(rows: DataFrame, required: dict[str, Column], reason: str = "error_msg") -> tuple[DataFrame, DataFrame]:
    """Rows whose required values all parse, with those values, and the others with the reason."""
    parsed = rows.withColumns(required)
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    parsed = parsed.withColumn("_bad", bad)
    good = parsed.where(F.size("_bad") == 0).drop("_bad")
    dead = parsed.where(F.size("_bad") > 0).withColumn(reason, F.concat(F.lit("no value: "), F.array_join("_bad", ","))).drop("_bad")
    return good, dead


def write_checked(rows: DataFrame, path: str, required: dict[str, Column], checks: dict[str, str], ts: str) -> dict[str, int | None]:
    """Write the rows whose ``required`` values parse to ``path`` and count, in the same pass, what is worth knowing.

    Returns rows_in, rows_good, rows_dead, the first and last ``ts`` of good rows, and for
    each of ``checks`` (an SQL condition) the good rows that fail it; null passes. The
    rejected rows lie below ``path``/dead=true, each with the reason in ``error_msg``. One
    job, by observed metrics.
    """
    good = F.lit(True)
    for name in required:
        good = good & F.col(name).isNotNull()
    seen = Observation()
    failed = [F.count_if(good & ~F.expr(check)).alias(f"failed_{name}") for name, check in checks.items()]
    time = F.when(good, F.col(ts).cast("long"))
    marked = rows.withColumns(required).observe(
        seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(good).alias("rows_good"), F.count_if(~good).alias("rows_dead"), F.min(time).alias("first_s"), F.max(time).alias("last_s"), *failed
    )
    bad = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])), ",")
    reason = F.when(~good, F.concat(F.lit("no value: "), bad)).alias("error_msg")
    marked.select("*", reason, (~good).alias("dead")).write.partitionBy("dead").parquet(path)
    return seen.get


class Migrations:
    """Versioned changes of stored tables, applied in ascending order and undone one at a time."""

    def __init__(self, spark: SparkSession, log: str):
        self.spark, self.log = spark, log
        self.steps: dict[int, tuple[Callable[[], None], Callable[[], None]]] = {}

    def add(self, version: int, up: Callable[[], None], down: Callable[[], None]) -> None:
        self.steps[version] = (up, down)

    def applied(self) -> list[int]:
        if not exists(self.spark, self.log):
            return []
        return sorted(r["version"] for r in self.spark.read.parquet(self.log).select("version").collect())

    def status(self) -> list[tuple[int, bool]]:
        done = set(self.applied())
        return [(v, v in done) for v in sorted(self.steps)]

    def up(self) -> list[int]:
        ran = []
        for version, done in self.status():
            if not done:
                self.steps[version][0]()
                row = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("applied_at"))
                row.write.mode("append").parquet(self.log)
                ran.append(version)
        return ran

    def down(self) -> int | None:
        done = self.applied()
        if not done:
            return None
        self.steps[done[-1]][1]()
        swap_write(self.spark, self.spark.read.parquet(self.log).where(F.col("version") != done[-1]), self.log)
        return done[-1]


def time_report(df: DataFrame, ts: str, millis: bool = False) -> DataFrame:
    """``n, first_s, last_s, first_utc, last_utc``: how many rows a table has and the times they span."""
    t = F.floor(F.col(ts) / 1000).cast("long") if millis else F.col(ts).cast("long")
    found = df.agg(F.count("*").alias("n"), F.min(t).alias("first_s"), F.max(t).alias("last_s"))
    # independent of the session's time zone
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    text = lambda c: F.date_format(F.timestamp_add("SECOND", F.col(c), start), "yyyy-MM-dd HH:mm")
    return found.withColumns({"first_utc": text("first_s"), "last_utc": text("last_s")})
