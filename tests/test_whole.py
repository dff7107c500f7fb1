"""Queries over whole tables, against DuckDB on the star schema; none of their rows may be left out."""

from collections import Counter

import duckdb
import pytest

from symloom.plans import catalogue, whole, wide
from symloom.sources import star

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for name in star.SOURCES:
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
        yield c


@pytest.mark.parametrize("name", whole.WHOLE | wide.WIDE)
def test_whole_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute((whole.WHOLE | wide.WIDE)[name])
    assert got.columns == [c[0] for c in want.description]
    got, want = Counter(map(tuple, got.collect())), Counter(want.fetchall())
    assert got == want and want


def test_subsets_are_not_registered():
    assert not set(catalogue.SUBSETS) & set(catalogue.queries()) and set(catalogue.oracle_sql()) <= set(catalogue.queries())
