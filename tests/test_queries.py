"""Every notebook query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from fieldbook.plans import block_queries, notebook_queries  # noqa: F401
from fieldbook.plans.catalog import QUERIES, SQL

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(TABLES))
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    want = [tuple(row[names.index(c)] for c in got.columns) for row in result.fetchall()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
