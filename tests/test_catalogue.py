"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import math
import os

import pytest

from gridloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = catalogue.queries()[name](spark, SF)
    names, rows = df.columns, df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(sql)
    other = [d[0] for d in found.description]
    assert sorted(names) == sorted(other)
    order = sorted(names)
    key = lambda cols, row: tuple(shown(row[cols.index(c)]) for c in order)
    assert sorted(key(names, r) for r in rows) == sorted(key(other, r) for r in found.fetchall())
