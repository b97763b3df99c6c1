"""Every query against its oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from segmenta.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _rows(rows, columns, names):
    order = [columns.index(c) for c in sorted(names)]
    value = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(str([value(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert _rows(rows, df.columns, df.columns) == _rows(cur.fetchall(), names, names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
