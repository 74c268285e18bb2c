"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from annalist.plans import catalogue, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_vector_search_takes_every_hundredth_row(spark, duck):
    want = {i for (i,) in duck.sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    got = QUERIES["vector_search"](spark, SF).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == dict.fromkeys(want, 10)


def test_asof_slice_keeps_facts_before_1970(spark):
    events = spark.sql("SELECT 1L event_id, TIMESTAMP_NTZ '1969-05-05 00:00:00' ts, 7L user_id, 'a' event_type, 2.5D value")
    assert [tuple(r) for r in catalogue.asof_slice(events).collect()] == [(7, "a", 1, 2.5)]
