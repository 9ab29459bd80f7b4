"""Every query with an SQL twin gives the twin's rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


CORE = entry.catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows(name, spark, db):
    got = entry.queries()[name](spark, str(DATA))
    twin = db.execute(CORE[name])
    assert _rows(got.columns, got.collect()) == _rows([x[0] for x in twin.description], twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.catalogue.queries()) - set(CORE)))
def test_runs(name, spark):
    assert entry.queries()[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns
