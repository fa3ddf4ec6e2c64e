"""Every query of the catalog against its SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from chronokv.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no testdata")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = rel.project(",".join(f'"{c}"' for c in cols)).fetchall()
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
