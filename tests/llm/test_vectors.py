import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from graupel.llm import shards, vptree
from graupel.llm.density import clusters
from graupel.llm.neighbours import nearest_neighbours, neighbour_pairs, shard_neighbours

T = datetime(2024, 1, 1)
VECTORS = "id bigint, namespace string, entity_ref string, model_key string, dimensions int, embedding array<float>, updated_at timestamp, h1 int, other string"
POINTS = "ref string, scope_ref string, vector array<double>, created_at timestamp, peak string, n int"


def _cloud(n, d, seed, spread=0.35, centres=None):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres or max(2, n // 5), d))
    return c[rng.integers(len(c), size=n)] + spread * rng.standard_normal((n, d))


def _rows(n=400, d=8, seed=1):
    x = _cloud(n, d, seed)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies of one vector
    rows = [(i, ["a", "b", None][i % 7 % 3], f"e{i}", "m", d, x[i].astype("f4").tolist(), T, 0, "x") for i in range(n)]
    rows += rows[:20]  # delivered again
    rows += [(n + i, rows[i][1], f"e{i}", "m", d, x[(i * 7) % n].astype("f4").tolist(), T - timedelta(days=1) if i % 2 else T + timedelta(days=1), 0, "x") for i in range(min(n, 30))]
    bad = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [1.0] * (d + 1), [None] + [1.0] * (d - 1)]
    return rows + [(5000 + i, "a", f"bad{i}", "m", d, v, T, 0, "x") for i, v in enumerate(bad)]


def _expected(rows, top=5, least=0.8):
    live = {}
    for r in {r[0]: r for r in rows}.values():
        v = r[5]
        if not v or len(v) != r[4] or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        k = (r[1], r[2], r[3])
        if k not in live or (r[6], -r[0]) > (live[k][6], -live[k][0]):
            live[k] = r
    out = {}
    for space in {r[1] for r in live.values()}:
        own = sorted((r for r in live.values() if r[1] == space), key=lambda r: r[0])
        ids = np.array([r[0] for r in own])
        u = vptree.unit(np.array([r[5] for r in own], dtype="f8"))
        s = np.round(u @ u.T, 6)
        for i, row in enumerate(s):
            best = [(ids[j], row[j]) for j in sorted((j for j in range(len(ids)) if j != i and row[j] >= least), key=lambda j: (-row[j], ids[j]))[:top]]
            out[int(ids[i])] = [int(b) for b, _ in best]
    return out


@pytest.mark.parametrize(("relax", "shard"), [(1.0, 10_000), (1.0, 60)])
def test_exact_search_with_relax_one(spark, relax, shard):
    rows = _rows()
    want = {(i, o) for i, others in _expected(rows).items() for o in others}
    found = nearest_neighbours(spark.createDataFrame(rows, VECTORS), relax=relax, shard_rows=shard).collect()
    assert {(r.id, r.other_id) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("relax", [1.0, 3.0])
def test_parts_and_chunks_meet_every_pair(spark, relax):
    """Shards over the bounds of a task are cut and still meet whole."""
    x = vptree.unit(_cloud(400, 8, 9, spread=0.2)).astype("f4")
    rows = [(7, i * 7919, i, v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "group bigint, salt bigint, id bigint, vector array<float>")
    reach = math.acos(0.8)
    plan = shards.routing(points, reach, relax, shard_rows=100 if relax == 1 else 12, part_rows=10 if relax > 1 else 40, visit_rows=60 if relax == 1 else 5)
    assert plan.parts and plan.chunks
    met = set()
    loads = {}
    for r in shards.sharded(points, plan).collect():
        loads.setdefault(r.shard, []).append(r)
    for load in loads.values():
        home, others = [r for r in load if r.home], [r for r in load if not r.home]
        assert len(home) < 80 and len(others) < 120
        for a in home:
            met |= {(min(a.id, b.id), max(a.id, b.id)) for b in others + (home if a.meet else []) if a.id != b.id}
    near = {(i, j) for i, j in itertools.combinations(range(400), 2) if x[i] @ x[j] >= 0.8}
    assert len(near & met) >= (1.0 if relax == 1 else 0.9) * len(near)


def test_relaxed_recall_over_many_shards(spark):
    x = _cloud(6000, 64, 5, spread=0.4)
    rows = [(i, "a", f"e{i}", "m", 64, x[i].astype("f4").tolist(), T, 0, "x") for i in range(len(x))]
    want = {(min(i, o), max(i, o)) for i, others in _expected(rows).items() for o in others}
    found = {tuple(r) for r in neighbour_pairs(spark.createDataFrame(rows, VECTORS), shard_rows=200).collect()}
    assert len(found & want) >= 0.9 * len(want) and len(want) > 3000


def test_empty_and_all_unusable(spark):
    table = spark.createDataFrame(_rows(10), VECTORS)
    assert nearest_neighbours(table.limit(0)).count() == 0 and nearest_neighbours(table.where("id >= 5000")).count() == 0


def test_join_meets_every_pair_once():
    u = vptree.unit(_cloud(500, 5, 3)).astype("f4")
    home = np.arange(500) % 4 != 0
    reach = math.acos(0.8)
    met = {}

    def visit(h, c, meet):
        for i in h:
            for j in np.concatenate([h, c]):
                if i != j:
                    met[frozenset((int(i), int(j)))] = met.get(frozenset((int(i), int(j))), 0) + (1 if j in set(c) else 0.5)

    vptree.self_join(u, home, reach + 1e-6, 20, visit)
    s = u @ u.T
    for i, j in itertools.combinations(range(500), 2):
        if s[i, j] >= 0.8 and (home[i] or home[j]):
            assert met.get(frozenset((i, j))) == 1


def test_ball_of_equal_rows_is_cut_in_blocks():
    u = np.ones((300, 4)) / 2
    left, right, _ = shard_neighbours(np.arange(300), u, np.ones(300, bool), 5, 0.8, 1.0, leaf_rows=32)
    assert len(left) == 1500 and set(right[left == 7]) == {0, 1, 2, 3, 4} and set(right[left == 2]) == {0, 1, 3, 4, 5}


def _groups(seed=6, d=80):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for scope, sizes in (("a", [120, 30, 5, 2, 1, 1]), ("b", [4, 2, 1]), (None, [3])):
        for size in sizes:
            c = rng.standard_normal(d)
            for _ in range(size):
                rows.append((f"r{at:04d}", scope, ((c + 0.2 * rng.standard_normal(d)) * rng.uniform(0.001, 50)).tolist(), T, "x", 1))
                at += 1
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    bad = [None, [], [0.0] * d, [float("nan")] * d, [1.0] * (d - 1)]
    return rows + rows[:15] + [(f"z{i}", "a", v, T, "x", 1) for i, v in enumerate(bad)] + [(None, "a", rows[0][2], T, "x", 1)]


def _cliques(rows):
    points = {r[0]: r for r in rows if r[0] and r[2] and len(r[2]) == 80 and all(map(math.isfinite, r[2])) and any(r[2])}
    refs = sorted(points)
    u = vptree.unit(np.array([points[r][2] for r in refs]))
    s = u @ u.T
    out = set()
    for i, r in enumerate(refs):
        near = [j for j in range(len(refs)) if points[refs[j]][1] == points[r][1] and s[i, j] >= 0.74]
        if len(near) > 1:
            means = {refs[j]: round(float(np.mean([s[j, k] for k in near if k != j])), 6) for j in near}
            out.add((refs[near[0]], r, min(means, key=lambda m: (-means[m], m))))
    return out


@pytest.mark.parametrize("limits", [{}, {"block_rows": 25}])
def test_clusters_against_brute_force(spark, limits):
    rows = _groups()
    found = clusters(spark.createDataFrame(rows, POINTS), **limits).collect()
    assert {(r.first_ref, r.member_ref, r.representative_ref) for r in found} == _cliques(rows)
    assert len(found) == len({r.member_ref for r in found})


def test_chain_has_one_peak_with_its_neighbours(spark):
    step = math.acos(0.75)
    rows = [(f"p{i}", "s", [math.cos(step * i), math.sin(step * i)] + [0.0] * 78, T, "x", 1) for i in range(5)]
    found = {r.member_ref: r.first_ref for r in clusters(spark.createDataFrame(rows, POINTS)).collect()}
    assert set(found) == {f"p{i}" for i in range(5)}


def test_no_points(spark):
    table = spark.createDataFrame(_groups(), POINTS)
    assert clusters(table.limit(0)).count() == 0 and clusters(table.where("ref = 'r0000'")).count() == 0
