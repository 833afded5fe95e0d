import random
from datetime import datetime, timedelta

from graupel.operators.skew import heavy_scopes, hot_keys, join_unique, latest_value_per_key, scope_run_totals

SCHEMA = "run_id string, scope_ref string, member_count int, observed_at timestamp, __packed string, run_count int"
T = datetime(2024, 1, 1)


def _rows(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scope = rng.choice([" a", "a ", "\ta", "b", "b\n", "", "  ", None, "c"]) if rng.random() > 0.33 else "hot"
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = None if rng.random() < 0.05 else T + timedelta(seconds=rng.randrange(5))
            rows.append((f"r{i}", scope, rng.choice([None, -5, 0, 7, 2**31 - 1, -(2**31)]), at, "x", 1))
    rows.append((None, "a", 1, T, "x", 1))
    return rows + rows[:50]


def _expected(rows):
    latest = {}
    for run, scope, members, at, *_ in rows:
        if run is None:
            continue
        scope = None if scope is None else scope.strip()
        key = (at is not None, at or T, members is not None, members or 0)
        if (run, scope) not in latest or key > latest[run, scope][0]:
            latest[run, scope] = (key, members)
    out = {}
    for (_, scope), (_, members) in latest.items():
        out.setdefault(scope, []).append(members)
    return {
        s: (len(m), sum(x for x in m if x is not None) if any(x is not None for x in m) else None, max((x for x in m if x is not None), default=None))
        for s, m in out.items()
    }


def test_totals_against_plain_python(spark):
    rows = _rows()
    found = scope_run_totals(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.scope_ref: (r["run_count"], r.member_sum, r.member_max) for r in found} == _expected(rows)


def test_heavy_scopes(spark):
    rows = [(f"r{i}", "a" if i < 2 else f"s{i}", 1, T, "x", 1) for i in range(100)]
    assert [r.scope_ref for r in heavy_scopes(spark.createDataFrame(rows, SCHEMA)).collect()] == ["a"]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scope_run_totals(empty).count() == 0 and heavy_scopes(empty).count() == 0


def test_latest_value_ties_and_nulls(spark):
    rows = [("a", T, 1), ("a", T, 2), ("b", None, 5), ("b", T, None), (None, T, 3), ("c", None, None)]
    found = latest_value_per_key(spark.createDataFrame(rows, "k string, at timestamp, v int"), ["k"], "v", "at").collect()
    assert {r.k: r.latest_value for r in found} == {"a": 2, "b": None, None: 3, "c": None}


def test_hash_aggregates_only(spark):
    plan = scope_run_totals(spark.createDataFrame(_rows(50), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_join_of_hot_keys_is_a_join(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 1000), ("lost", 1001)], "key string, i int")
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 300, 3)]], "key string, n int")
    assert [r.key for r in hot_keys(rows, "key", 5).collect()] == ["hot"] and hot_keys(rows, "key") is None
    for how in ("inner", "left"):
        plain = sorted(map(repr, rows.join(table, "key", how).collect()))
        assert sorted(map(repr, join_unique(rows, table, "key", how, least=5).collect())) == plain == sorted(map(repr, join_unique(rows, table, "key", how).collect()))
    assert join_unique(rows.limit(0), table, "key").count() == 0
