"""Merges, caches, anchors and intents on small tables with nulls, ties and repeated rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graupel.operators import anchors as A
from graupel.operators import embedding as E
from graupel.operators import intents as I
from graupel.sources import store as S

T = datetime(2024, 1, 1)
STORED = "r int, i int, ref string, g string, extra string"


def test_put_batches(spark):
    stored = spark.createDataFrame([(1, 1, "a", "x", ""), (1, 1, "b", "x", ""), (1, 2, "c", "y", "")], STORED)
    sent = spark.createDataFrame(
        [(1, 1, "a", "x", ""), (1, 1, "b", "x", ""), (1, 2, "c", "z", ""), (1, 3, "a", "n", ""), (1, 4, "q", "n", ""), (1, 5, "d", "n", ""), (1, 5, "d", "n", ""), (1, 9, "e", "n", ""), (1, None, "e", "n", ""), (1, 6, "f", "n", ""), (1, 6, "g", "n", ""), (2, 1, "a", "n", "")],
        STORED,
    )
    expected = spark.createDataFrame([(1, 6, 4)], "r int, n int, items int")
    found = {(x.r, x.i): x.outcome for x in S.put_batches(stored, sent, expected, ["r"], "i", "ref", "g", "n", "items").collect()}
    assert found == {(1, 1): "idempotent", (1, 2): "conflict", (1, 3): "clash", (1, 4): "stored", (1, 5): "duplicate_ref", (1, 9): "outside", (1, None): "outside", (1, 6): "too_many", (2, 1): "outside"}
    assert S.put_batches(stored, sent.limit(0), expected, ["r"], "i", "ref", "g", "n", "items").count() == 0


def test_commit_revisions(spark):
    schema = "id int, scope_ref string, language string, revision int, status string, dataset_hash string, keyword_count int, expected_batch_count int, expected_keyword_count int"
    rows = [(1, "a", None, 1, "committed", "old", 2, 1, 2), (2, "a", None, 2, "staging", "h2", None, 1, 2), (3, "b", "vi", 5, "committed", "h", 1, 1, 1), (4, "b", "vi", 4, "staging", "h", None, 1, 1),
            (5, "b", "vi", 6, "staging", "h", None, 1, 1), (6, "b", "en", 1, "staging", "h", None, 2, 1), (7, "c", None, 1, "staging", "h", None, 1, 3), (8, "c", None, 2, "staging", None, None, 1, 1),
            (9, "d", "x", 1, "committed", "o", 1, 1, 1), (10, "d", "x", 2, "staging", "n", None, 1, 1), (11, "e", None, 1, "staging", "h", None, 1, 1), (12, "e", None, 1, "aborted", "h", None, 1, 1)]
    facts = [(2, 1, 2, "h2"), (4, 1, 1, "h"), (5, 1, 1, "h"), (6, 1, 1, "h"), (7, 1, 2, "h"), (8, 1, 1, "h"), (10, 1, 1, "n")]
    found = S.commit_revisions(spark.createDataFrame(rows, schema), spark.createDataFrame(facts, "id int, batches int, items int, digest string"), spark.createDataFrame([(1,), (1,)], "id int"))
    got = {r.id: (r.outcome, r.before_outcome) for r in found.collect()}
    assert got == {2: ("committed", "retained"), 4: ("stale", None), 5: ("unchanged", None), 6: ("missing_batches", None), 7: ("count_mismatch", None), 8: ("hash_mismatch", None), 10: ("committed", "deleted"), 11: ("missing_batches", None)}


def test_owned_rows(spark):
    schema = "k int, owner string, at timestamp, v int"
    store = spark.createDataFrame([(1, "a", T, 1), (2, "a", T, 1), (3, None, T, 1)], schema)
    batch = spark.createDataFrame([(1, "a", T, 2), (2, "b", T, 2), (3, None, T, 2), (4, "c", T, 2), (4, "d", T + timedelta(days=1), 3), (4, "c", T + timedelta(days=2), 4)], schema)
    after, acknowledged = S.upsert_owned(store, batch, "k", "owner", "at", "v")
    assert {(r.k, r.owner, r.v) for r in after.collect()} == {(1, "a", 2), (2, "a", 1), (3, None, 1), (4, "c", 4)}
    assert {r.k for r in acknowledged.collect()} == {1, 4}


def test_recovery(spark):
    rows = [("dead", "running", "p", 0, T), ("spent", "running", "p", 2, T), ("alive", "running", "p", 0, T + timedelta(seconds=100)), ("done", "completed", "p", 0, T), ("none", "running", "p", 0, None)]
    runs = spark.createDataFrame([(*r, None, None) for r in rows], "id string, status string, progress_phase string, attempt int, heartbeat_at timestamp, error string, finished_at timestamp")
    now = F.lit(T + timedelta(seconds=120))
    found = {r.id: (r.status, r.progress_phase, r.heartbeat_at is None, r.error) for r in S.recover_stale(runs, now, 90, F.col("attempt"), 2).collect()}
    assert found["dead"] == ("queued", "requeued", True, None) and found["spent"][0] == "failed" and found["spent"][3] == "worker heartbeat expired"
    assert [found[k][0] for k in ("alive", "done", "none")] == ["running", "completed", "running"]
    assert S.oldest(runs, "running", "heartbeat_at", "id").first().id == "none" and S.oldest(runs, "gone", "heartbeat_at", "id").count() == 0


def test_vectors_as_text(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 1e-9],), ([],), (None,)], "v array<double>")
    texts = [r.t for r in rows.select(S.vector_text(F.col("v")).alias("t")).collect()]
    assert texts == ["[0.50000000,-1.00000000,0.00000000]", "[]", None]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select(S.text_vector(F.col("t")).alias("v")).collect()
    assert [r.v for r in back] == [[0.5, -1.0, 0.0], [], None]


def test_vectors_that_do_not_fit_are_refused(spark):
    schema = "k string, dimensions int, embedding array<double>, at timestamp, id int"
    store, bad = spark.createDataFrame([], schema), spark.createDataFrame([("a", 2, [1.0], T, 1), ("b", 0, [], T, 2), ("c", None, None, T, 3)], schema)
    good = spark.createDataFrame([("a", 1, [1.0], T, 1)], schema)
    assert S.fitting(bad)[1].count() == 3 and S.upsert_vectors(store, good, ["k"], "at", "id").count() == 1
    with pytest.raises(ValueError):
        S.upsert_vectors(store, bad, ["k"], "at", "id")


def test_analyses_are_replaced_and_deleted(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "analysis_id string, n int")
    S.save_analysis(rows, path)
    S.save_analysis(rows.where("n = 1"), path)
    assert [r.n for r in S.read_analysis(spark, path, "a").collect()] == [1] and S.read_analysis(spark, path, "b").count() == 1
    assert S.delete_analysis(spark, path, "b") and not S.delete_analysis(spark, path, "b") and S.read_analysis(spark, path, "b").count() == 0


ITEMS = "entity_ref string, model_key string, content_hash string, text string"
STORE = "namespace string, entity_ref string, model_key string, content_hash string, dimensions int, embedding array<double>, updated_at timestamp, id bigint"


def test_cache_is_filled(spark):
    items = spark.createDataFrame([("a", "m", "1", "tea jar"), ("b", "m", "2", "desk"), ("c", "m", "2", "desk"), ("d", "m", "3", "  "), ("e", "m", "4", None)], ITEMS)
    store = spark.createDataFrame([("n", "a", "m", "1", 1, [7.0], T, 1), ("n", "b", "m", "other", 1, [7.0], T, 2), ("x", "c", "m", "2", 1, [7.0], T, 3)], STORE)
    filled, records = E.embedded(items, store, ["n"])
    assert {r.entity_ref: (r.hit, r.vector is None) for r in filled.collect()} == {"a": (True, False), "b": (False, False), "c": (False, False), "d": (False, True), "e": (False, True)}
    assert {(r.namespace, r.entity_ref, r.dimensions) for r in records.collect()} == {("n", "b", E.DIMENSIONS), ("n", "c", E.DIMENSIONS)}
    with pytest.raises(E.CacheMissError, match="4 of 5"):
        E.all_cached(items, store, ["n"])
    assert E.all_cached(items.where("entity_ref = 'a'"), store, ["n"]).count() == 1
    assert E.embedded(items.limit(0), store, ["n"])[0].count() == 0


def test_anchors(spark):
    rows = [(1, ["a", "b", "c"]), (1, ["x", "a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "b"]), (3, ["c", "d", "e"]), (4, ["a"]), (5, [])]
    found = {(r.cluster, r.ngram): r.support for r in A.group_anchors(spark.createDataFrame(rows, "cluster int, tokens array<string>")).collect()}
    assert found == {(1, "a b"): 2, (2, "a b"): 1, (2, "b c"): 1, (2, "a b c"): 1, (3, "a b"): 1, (3, "c d"): 1, (3, "c d e"): 1}


def test_typical_members_and_names(spark):
    rows = spark.createDataFrame([(7, 3, [1.0, 0.0]), (7, 1, [1.0, 1.0]), (7, 9, [0.0, 1.0]), (2, 5, [3.0, 4.0]), (4, 4, [1.0, 0.0]), (4, 2, [1.0, 1.0])], "cluster int, id bigint, vector array<double>")
    assert {r.cluster: (r.representative, r.mean_score) for r in A.typical_members(rows, 2).collect()} == {7: (1, 0.707107), 2: (5, 1.0), 4: (2, 0.707107)}
    assert {r.cluster: r.name for r in A.named_groups(rows).collect()} == {7: "g-0001", 4: "g-0002", 2: "g-0003"}
    assert A.named_groups(rows.limit(0)).count() == 0


CASES = [
    # mode, positives, negatives, text, hits, negative hits
    ("phrase", ("bảo hành",), (), "Dịch vụ bảo  hành", ["bảo hành"], []), ("phrase", ("bao hanh",), (), "Dịch vụ bảo hành", [], []), ("folded", ("bao hanh",), (), "Dịch vụ Bảo hành", ["bao hanh"], []),
    ("token", ("c++", "lamp"), ("desk",), "A C++ lamp, desk!", ["c++", "lamp"], ["desk"]), ("prefix", ("desk", "a"), (), "Desk lamp", ["desk"], []), ("exact", ("desk lamp",), (), " desk  LAMP ", ["desk lamp"], []),
    ("semantic", ("desk",), ("desk",), "desk", [], []), ("phrase", ("desk",), (), None, [], []), ("phrase", ("  ",), (), "desk", [], []),
]


@pytest.mark.parametrize("case", CASES)
def test_lexical_matches(spark, case):
    mode, good, bad, text, hits, nots = case
    found = I.lexical_matches(spark.createDataFrame([(1, text)], "id bigint, text string"), [I.Concept(3, good, bad, mode)]).first()
    assert (found.hits, found.negative_hits, found.lexical, found.best) == (hits, nots, bool(hits), hits[0] if hits else None)


def test_examples_and_selection():
    assert I.unique_examples([" a  b", "a b", None, "", "c"]) == ("a b", "c")
    every = [I.Concept(1, ("a",)), I.Concept(2, ()), I.Concept(3, ("a",), enabled=False), I.Concept(4, ("b",))]
    assert [c.id for c in I.selected(every)] == [1, 4] and [c.id for c in I.selected(every, [4, 9])] == [4]


def test_intents(spark):
    rows = {
        1: [(1, True, False, 0.5), (2, True, False, 0.9), (3, False, False, 0.1)],  # two hits
        2: [(1, True, False, 0.5), (2, False, False, 0.7), (3, False, False, 0.1)],  # a rival
        3: [(1, True, False, None), (2, False, False, 0.55), (3, False, False, 0.1)],  # no rival: below the floor
        4: [(1, True, True, 0.65), (2, False, False, 0.9), (3, False, False, 0.2)],  # negative: no hit
        5: [(1, False, False, 0.65), (2, False, False, 0.64), (3, False, False, None)],  # close
        6: [(1, False, False, 0.2), (2, False, False, 0.3), (3, False, False, None)],
    }
    table = spark.createDataFrame([(i, *r) for i, rs in rows.items() for r in rs], "id bigint, concept bigint, lexical boolean, negative boolean, positive_max double")
    found = {r.id: (r.status, r.first, r.second, r.score) for r in I.intents(table, 0.6, 0.08).collect()}
    assert found == {1: ("ambiguous", 1, 2, 1.0), 2: ("ambiguous", 1, 2, 1.0), 3: ("confident", 1, 2, 1.0), 4: ("confident", 2, 1, 0.9), 5: ("ambiguous", 1, 2, 0.65), 6: ("none", 2, 1, 0.3)}
