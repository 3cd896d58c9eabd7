"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import pytest

from corpusmill import plans

TABLES = Path("/root/testdata/sf0.001")
QUERIES = {k: (r.queries[k], sql) for r in plans.registries() for k, sql in r.sql.items()}

pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    found = duckdb.connect()
    found.execute("set timezone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        found.execute(f"create view {path.stem} as select * from '{path}'")
    return found


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str | datetime.datetime):
        return value
    if isinstance(value, int | float | decimal.Decimal):
        return "nan" if math.isnan(value) else round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, str(TABLES))
    answer = duck.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == Counter(tuple(map(plain, r)) for r in answer.fetchall())
