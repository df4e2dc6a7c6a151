"""Every registered query against its SQL on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from lotwise.queries import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def text(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert not [n for n in catalog.QUERIES if re.search(r"pipeline|^op\d", n)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF_DIR)
    rows = frame.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    places = [names.index(c) for c in order]
    want = sorted(tuple(text(r[i]) for i in places) for r in cursor.fetchall())
    assert sorted(tuple(text(r[c]) for c in order) for r in rows) == want
