"""Every query against its oracle on the smallest test tables."""

import os

import pytest

from siftwell.plans import more_queries, registry, text_queries, tool_queries, trajectory_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name in registry.ORACLE_SQL:
        assert plain(rows) == plain(oracle.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
