"""Every registered query of the engine runs on the smallest tables and equals its SQL."""

import datetime
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from redlight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()[:10] if value == datetime.datetime(value.year, value.month, value.day) or type(value) is datetime.date else value.isoformat()
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6) + 0.0
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*order).collect())
    assert got
    if name in registry.SQL:
        rows = duck.execute(registry.SQL[name])
        names = [d[0] for d in rows.description]
        assert sorted(names) == order
        at = [names.index(c) for c in order]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in rows.fetchall())
