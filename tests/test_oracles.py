"""Every registered query against its SQL in DuckDB, at the smallest size."""

import math
import os

import duckdb
import pytest

from tamarack import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return "null"
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLES:
        return
    wanted = duck.execute(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
