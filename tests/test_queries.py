"""Each registered query of the crawl library against its SQL."""

import math

import duckdb
import pytest

from crawlspark.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "benchmark customer orders lineitem events documents pages".split()


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    order = lambda rows: sorted((tuple(norm(x) for x in r) for r in rows), key=str)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert order(got.select(*[f"`{c}`" for c in cols]).collect()) == order(duck.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())
