"""Every registered point-in-time query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import pytest

from lexepoch.plans import registry
from lexepoch.sources.tables import SCHEMAS

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return format(float(v), ".6g")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat().replace("T00:00:00", "")
    return str(v)


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for t in SCHEMAS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, tables, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = tables.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want
