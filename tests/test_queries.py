"""Every registered query of the core engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from docloom.plans import catalogue  # noqa: F401  (registers its queries)
from docloom.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"count_empty"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, SF)
    got = df.collect()
    found = duck.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, got) == rows(found.columns, found.fetchall())


def test_graph_lookup_starts_from_every_customer(spark, duck):
    got = {r.k for r in core.queries()["graph_lookup"](spark, SF).collect()}
    assert got == {k for (k,) in duck.sql("select c_custkey from customer where c_custkey >= 3").fetchall()}


def test_densify_hours_covers_every_event_and_has_gaps(spark, duck):
    got = {(r.event_type, r.d): r.total for r in core.queries()["densify_hours"](spark, SF).collect()}
    found = set(duck.sql("select distinct event_type, date_trunc('hour', ts) from events").fetchall())
    assert len(found) == sum(v != -1 for v in got.values()) < len(got)


def test_stream_watch(spark):
    out = core.queries()["stream_watch"](spark, SF)
    assert {r.updated for r in out.collect()} == {"o_orderstatus"}


def test_entry_needs_no_llm():
    import __spark_entry__

    assert set(core.queries()) <= set(__spark_entry__.queries())
    assert set(core.oracle_sql()) <= set(__spark_entry__.queries())
