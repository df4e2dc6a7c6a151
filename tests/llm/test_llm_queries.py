"""The queries of this subpackage on the smallest tables, against their SQL where they have it."""

import duckdb
import pytest

from lotwise.llm import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    frame = catalog.QUERIES[name](spark, SF_DIR)
    rows = frame.collect()
    assert rows
    if name not in catalog.ORACLES:
        return
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = connection.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(map(str, r)) for r in found.fetchall()))
    assert sorted(tuple(str(r[c]) for c in names) for r in rows) == want


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
