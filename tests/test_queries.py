"""Every query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from foldspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, str, type(None))) else v for v in r) for r in clean.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
