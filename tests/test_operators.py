import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graupel.operators import clustering as C
from graupel.operators import concepts as K
from graupel.operators import edges as E
from graupel.operators import ranking as R
from graupel.operators.catalogue import catalogue_terms, unknown_acronyms
from graupel.operators.hybrid import _Grouping, group_texts
from graupel.operators.lexical import pair_evidence
from graupel.operators.search import search

POINTS = "`group` bigint, id bigint, vector array<double>"


def _points(n=120, d=6, seed=3, groups=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    return [(int(i % groups), i, (centres[rng.integers(8)] + 0.5 * rng.standard_normal(d)).tolist()) for i in range(n)]


def _cos(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("block", [7, 1000])
def test_edges_against_all_pairs(spark, block):
    rows = _points()
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and _cos(a[2], b[2]) >= 0.7}
    found = E.similarity_edges(spark.createDataFrame(rows, POINTS), 0.7, block).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 40)]
    found = {r.id: r.component for r in E.components(spark.createDataFrame(chain + hub, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(40))


def test_components_empty(spark):
    assert E.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("algorithm", C.ALGORITHMS)
def test_clusters_by_component_equal_clusters_of_the_whole(spark, algorithm):
    rows = _points(90, groups=1)
    u = C.unit(np.array([r[2] for r in rows]))
    s = u @ u.T
    whole = C.average_linkage(s.copy(), 0.74) if algorithm == "average_linkage" else C.greedy_medoids(s, 0.74, 0.77, algorithm.endswith("v1"))
    want = {tuple(c) for c in whole if len(c) > 1}
    found = C.cluster_points(spark.createDataFrame(rows, POINTS), algorithm).collect()
    by = {}
    for r in found:
        by.setdefault(r.cluster, []).append(r.id)
    assert {tuple(sorted(v)) for v in by.values()} == want


def test_search_ties_and_ids(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)] + [(9, None)], "id bigint, vector array<double>")
    found = search(rows.where("id = 3"), rows, 4, accept=0.5).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 1, 2, 3] and all(r.accepted for r in found)
    assert search(rows.where("id > 99"), rows, 4).count() == 0


CASES = [
    ("vải thun cotton xanh", "vải thun cotton đỏ", False, True), ("áo thun", "áo thun nam", True, False), ("đen vải thun", "nâu vải thun", True, False),
    ("a1 b1 c1", "b1 a1 c1 d1", True, False), ("a1 b1", "c1 d1", False, True), ("a1", "b1", False, False), ("", "a1", False, True),
]


@pytest.mark.parametrize(("a", "b", "compatible", "conflict"), CASES)
def test_pair_evidence(spark, a, b, compatible, conflict):
    row = pair_evidence(spark.createDataFrame([(a.split(), b.split())], "tokens_a array<string>, tokens_b array<string>")).first()
    assert (row.lexically_compatible, row.conflict) == (compatible, conflict)


def test_hybrid_grouping(spark):
    texts = {1: "máy lọc khí", 2: "máy lọc khí gia đình", 3: "lọc khí máy gia đình", 4: "xe đạp trẻ em", 5: "xe đạp trẻ em mini", 6: "ổ cắm"}
    near = {1: [1, 0, 0.1], 2: [1, 0.1, 0], 3: [1, 0, 0], 4: [0, 1, 0], 5: [0, 1, 0.1], 6: [0, 0, 1]}
    rows = [(0, i, [float(x) for x in near[i]], t.split()) for i, t in texts.items()]
    found = {r.id: r for r in group_texts(spark.createDataFrame(rows, POINTS + ", tokens array<string>")).collect()}
    assert found[1].cluster == found[2].cluster == found[3].cluster == 1 and found[4].cluster == found[5].cluster == 4
    assert found[6].cluster is None and found[6].reason == "below_semantic_floor"


def test_hybrid_lexical_veto(spark):
    rows = [(0, 1, [1.0, 0.0], ["áo", "thun", "xanh"]), (0, 2, [1.0, 0.01], ["áo", "thun", "đỏ"])]
    found = group_texts(spark.createDataFrame(rows, POINTS + ", tokens array<string>")).collect()
    assert {r.reason for r in found} == {"lexical_conflict"}


def test_concept_scores(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id bigint, vector array<double>")
    examples = spark.createDataFrame(
        [(7, 0, True, 70, [1.0, 0.0]), (7, 1, True, 71, [1.0, 0.0]), (7, 0, False, 72, [0.0, 1.0]), (8, 0, True, 80, [1.0, 1.0])],
        "concept bigint, ordinal int, positive boolean, example_id bigint, vector array<double>",
    )
    found = {(r.id, r.concept): r for r in K.concept_scores(points, examples).collect()}
    assert found[1, 7].positive_max == 1.0 and found[1, 7].best_positive == 70 and found[1, 7].margin == 1.0
    assert found[2, 8].negative_max is None and found[2, 8].margin is None and len(found) == 4


def test_balanced_rank_equals_greedy(spark):
    rng = random.Random(5)
    rows = [("s", rng.randrange(6), i, rng.choice([0, 1, 5, 9]), rng.choice([0.5, 0.52, 0.6])) for i in range(20)]
    found = R.balanced_rank(spark.createDataFrame(rows, "source_ref string, ref int, ordinal int, inbound bigint, relevance double"), limit=20).orderBy("rank").collect()
    inbound = sorted(r[3] for r in rows)
    median, scale = (inbound[9] + inbound[10]) / 2, max(1.0, inbound[-1])
    pool, taken, want = list(rows), set(), []
    while pool:
        score = lambda r: r[4] + max(-0.08, min(0.08, (0.03 if r[3] == 0 else 0) - 0.05 * max(0, r[3] - median) / scale - (0.04 if r[1] in taken else 0)))
        best = max(pool, key=lambda r: (round(score(r), 9), -r[2]))
        want.append((best[2], round(score(best), 6)))
        pool.remove(best)
        taken.add(best[1])
    assert [(r.ordinal, r.score) for r in found] == want


def test_spaced_sections(spark):
    rows = [("a", i, s, at, 400) for i, (s, at) in enumerate([(0.9, 0), (0.8, 100), (0.7, 300), (0.6, 600), (0.5, 2000)])]
    found = R.spaced(spark.createDataFrame(rows, "article string, section_id bigint, score double, start_word int, words int")).first()
    assert found.picked == [0, 2, 3, 4]


def test_page(spark):
    rows = spark.range(1, 8)
    first, cursor = R.page(rows, "id", 1, 3)
    assert [r.id for r in first.collect()] == [1, 2, 3] and cursor == 4
    last, end = R.page(rows, "id", 7, 3)
    assert [r.id for r in last.collect()] == [7] and end is None


def test_catalogue(spark):
    docs = spark.createDataFrame([(1, "Our ROI and the roi; XYZ9"), (2, None), (3, "polyesters only")], "doc_id bigint, text string")
    names = spark.createDataFrame([("w:roi", ["ROI"]), ("w:poly", ["polyester"]), ("w:p", ["product"])], "ref string, names array<string>")
    assert [(r.doc_id, r.ref, r.score) for r in catalogue_terms(docs, names).collect()] == [(1, "w:roi", 1.0)]
    assert [r.acronym for r in unknown_acronyms(docs, names).collect()] == ["XYZ9"]


def test_medoid_prefers_first_at_ties():
    assert C.medoid(np.array([0, 1]), np.array([[1.0, 0.8], [0.8, 1.0]])) == 0


def test_assigned_counts_low_confidence_before_dropping(spark):
    members = spark.createDataFrame([(0, 1, 1, 1, 1.0), (0, 2, 1, 1, 0.71), (0, 3, 1, 1, 0.2), (0, 4, 4, 4, 1.0)], "`group` bigint, id bigint, cluster bigint, representative bigint, score double")
    kept, groups = C.assigned(members)
    assert sorted(r.id for r in kept.collect()) == [1, 2]
    row = groups.collect()[0]
    assert (row["size"], row.low_confidence, row.min_score) == (2, 1, 0.71)


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_edges_against_all_pairs(spark, block):
    rows = _points() + [(0, 500, None), (0, None, [1.0] * 6)]
    found = E.nearest_edges(spark.createDataFrame(rows, POINTS), 0.7, 3, block).collect()
    want = set()
    for a in rows[:120]:
        near = sorted((-round(_cos(a[2], b[2]), 6), b[1]) for b in rows[:120] if a[0] == b[0] and a[1] != b[1] and _cos(a[2], b[2]) >= 0.7)
        want |= {(a[1], o, n + 1) for n, (_, o) in enumerate(near[:3])}
    assert {(r["id"], r.other, r["rank"]) for r in found} == want and len(found) == len(want)
    empty = E.nearest_edges(spark.createDataFrame([], POINTS), 0.7)
    assert empty.count() == 0 and E.reciprocal_pairs(empty).count() == 0 and F is not None


def _closest_first(similarity, threshold):
    """Average linkage by merging the two closest clusters each time."""
    clusters = [[i] for i in range(len(similarity))]
    while len(clusters) > 1:
        far = [(1 - float(similarity[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j]
        height, i, j = min(far)
        if height > 1 - threshold + 1e-12:
            break
        clusters[i] += clusters.pop(j)
    return {tuple(sorted(c)) for c in clusters}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("threshold", [0.9, 0.74, 0.3, -1.0])
def test_average_linkage_is_that_of_merging_the_closest(seed, threshold):
    u = C.unit(np.array([r[2] for r in _points(40, seed=seed)]))
    similarity = u @ u.T
    assert {tuple(c) for c in C.average_linkage(similarity.copy(), threshold)} == _closest_first(similarity, threshold)


def test_a_component_over_the_bound_is_an_error(spark):
    rows = spark.createDataFrame([(0, i, [1.0, i / 1000]) for i in range(12)], POINTS)
    with pytest.raises(Exception, match="a component of 12 rows"):
        C.cluster_points(rows, most=10).collect()
    assert C.cluster_points(rows, most=12).count() == 12



@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("threshold", [0.9, 0.74, 0.3, 0.1])
def test_linked_clusters_are_those_of_the_matrix(seed, threshold):
    rng = np.random.default_rng(seed)
    u, weight = C.unit(np.array([r[2] for r in _points(40, seed=seed)])), rng.integers(1, 4, 40)
    a, b = np.nonzero(np.triu(u @ u.T >= threshold - 1e-9, 1))
    label = C.linked_clusters(u, weight, a, b, threshold)
    many = np.repeat(np.arange(40), weight)
    want = {tuple(sorted(set(many[c].tolist()))) for c in C.average_linkage(u[many] @ u[many].T, threshold)}
    assert {tuple(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())} == want and all(label[x] == x for x in label)


def test_a_component_of_any_size_is_clustered(spark):
    """11 998 rows in one ring, in which each is linked to those beside it, with copies and zero vectors."""
    angle = np.arange(11_000) / 11_000 * 2 * np.pi
    rows = [(0, i, [float(np.cos(x)), float(np.sin(x)), 0.0]) for i, x in enumerate(angle)]
    rows += [(0, 11_000 + i, rows[7][2]) for i in range(998)] + [(0, 11_998, [0.0] * 3), (0, 11_999, [0.0] * 3)] + [(1, 12_000, [0.0, 0.0, 1.0]), (1, 12_001, [0.0, 0.0, 1.0])]
    found = {r["id"]: r for r in C.cluster_points(spark.createDataFrame(rows, POINTS), threshold=0.99999).collect()}
    assert sorted(found) == [*range(11_998), 12_000, 12_001]
    assert {found[11_000 + i].cluster for i in range(998)} == {found[7].cluster} and found[12_001].cluster == 12_000


def test_group_components_equal_components(spark):
    rng = random.Random(3)
    edges = [(g, 1000 * g + a, 1000 * g + b) for g in range(3) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(140))] + [(3, i, i + 1) for i in range(5000, 5400)]
    frame = spark.createDataFrame(edges, "`group` bigint, a bigint, b bigint").repartition(5)
    want = {(r["id"], r.component) for r in E.components(frame).collect()}
    assert {tuple(r) for r in E.group_components(frame).collect()} == want
    group, ids, label = E._forest(*np.array(edges).T)
    assert set(zip(ids.tolist(), label.tolist())) == want and group.tolist() == [min(i // 1000, 3) for i in ids.tolist()]


def test_grouping_needs_no_pairs_in_conflict():
    """Only their rows: the groups and reasons are those of all pairs."""
    for seed in range(20):
        rng = random.Random(seed)
        nodes = [(i, [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 5))]) for i in range(25)]
        edges = []
        for i in range(25):
            for j in range(i + 1, 25):
                if rng.random() < 0.3:
                    relation = rng.choice(["compatible", "incompatible", "incompatible", "unknown"])
                    edges.append((i, j, rng.choice([0.76, 0.8, 0.9, 1.0]), relation, relation == "compatible", relation == "incompatible", 0.7))
        want = sorted(_Grouping(nodes, edges, 0.8, 0.75, 0.67, 2).run(), key=str)
        vetoed = {i for e in edges if e[5] for i in e[:2]}
        assert sorted(_Grouping(nodes, [e for e in edges if not e[5]], 0.8, 0.75, 0.67, 2, vetoed).run(), key=str) == want
