"""Every query against its SQL on the smallest tables (where they exist)."""

import math
import os
from datetime import datetime

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("GRAUPEL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    rows = entry.queries()[name](spark, DATA)
    columns = sorted(rows.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in rows.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    """Their results are held against brute force in the tests of their operators."""
    rows = entry.queries()[name](spark, DATA).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_members_of_clusters_agree_with_components(spark):
    """Every cluster lies in one component of the graph at its threshold, named by its smallest member, with its representative."""
    for name in ("cluster_average_linkage", "cluster_greedy_medoid_v1", "cluster_greedy_medoid_v2"):
        rows = entry.queries()[name](spark, DATA).collect()
        members = {}
        for r in rows:
            members.setdefault(r.cluster, []).append(r["id"])
        assert len({r["id"] for r in rows}) == len(rows) and all(len(m) >= 2 and min(m) == c for c, m in members.items())
        assert all(r.representative in members[r.cluster] for r in rows)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
