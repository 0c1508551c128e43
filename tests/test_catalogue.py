"""Every query of the engine against its SQL, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tidemark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(rows, columns):
    out = [tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in (r[c] for c in columns)) for r in rows]
    return sorted(out, key=lambda r: tuple(str(v) for v in r))


def _same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in found.collect()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    cursor = db.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    wanted = [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    assert sorted(found.columns) == columns
    assert len(rows) == len(wanted)
    for got, want in zip(_plain(rows, columns), _plain(wanted, columns), strict=True):
        assert all(map(_same, got, want)), (got, want)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
