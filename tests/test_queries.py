"""Every registered query of the reference's operators against its SQL."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from sluice.plans import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    found = rows(got.columns, got.collect())
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for file in Path(DATA).glob("*.parquet"):
            con.sql(f"CREATE VIEW {file.stem} AS FROM '{file}'")
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(want.columns, want.fetchall()) == found
