import json
from datetime import datetime

from pyspark.sql import functions as F

from graupel.operators.embedding import cached, embed_distinct
from graupel.sources import requests as Q
from graupel.sources import store as S
from graupel.streaming.merge import merge_stream, stream_table, window_counts

T = datetime(2024, 1, 1)


def test_requests_object_and_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"site_ref": "s", "language": "en", "keywords": [{"ref": "1", "text": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"ref": "2", "text": "y"}]))
    found = {(r.site_ref, r.language, r.ref, r.text) for r in Q.read_requests(spark, str(tmp_path)).collect()}
    assert found == {("s", "en", "1", "x"), ("local", "vi", "2", "y")}


def test_valid_keywords(spark):
    rows = spark.createDataFrame([("1", " a  b "), ("2", " "), ("3", "x" * 501), ("4", "q"), ("4", "r"), (None, "z"), ("5", None)], "ref string, text string")
    good, bad = Q.valid_keywords(rows)
    assert [(r.ref, r.text) for r in good.collect()] == [("1", "a b")]
    assert sorted(r.reason for r in bad.collect()) == ["blank", "blank", "duplicate_ref", "duplicate_ref", "long", "ref"]


def test_upsert_replaces_and_keeps(spark):
    store = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), (None, 1, 9)], "k string, v int, at int")
    batch = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 1), (None, 5, 1)], "k string, v int, at int")
    assert {r.k: r.v for r in S.upsert(store, batch, ["k"], "at", "v").collect()} == {"a": 3, "b": 1, "c": 4, None: 5}


def test_lookup_and_delete(spark):
    store = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    some = spark.createDataFrame([("b",), ("x",)], "k string")
    assert S.lookup(store, some, ["k"]).count() == 2 and [r.k for r in S.delete(store, some, ["k"]).collect()] == ["a"]


def test_missing_batches(spark):
    rows = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (2, 1), (2, None)], "r int, i int")
    expected = spark.createDataFrame([(1, 6), (2, 1), (3, 2), (4, None)], "r int, n int")
    assert {r.r: sorted(r.missing) for r in S.missing_batches(rows, expected, ["r"], "i", "n").collect()} == {1: [2, 3, 5, 6], 2: [], 3: [1, 2], 4: []}


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int"), path, "p")
    S.write_partitioned(spark.createDataFrame([("b", 3)], "p string, v int"), path, "p")
    assert {(r.p, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_stream_merge_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int").write.parquet(f"{source}/1")
    stream = lambda: stream_table(spark, f"{source}/*", spark.read.parquet(f"{source}/1").schema)
    merge_stream(stream(), target, ["k"], "at", "v")
    spark.createDataFrame([("a", 2, 2), ("b", 0, 0)], "k string, v int, at int").write.parquet(f"{source}/2")
    for _ in range(2):
        found = merge_stream(stream(), target, ["k"], "at", "v")
        assert {r.k: r.v for r in found.collect()} == {"a": 2, "b": 1}


def test_window_counts_is_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(T, "a")], "at timestamp, k string").write.parquet(source)
    counted = window_counts(spark.readStream.schema("at timestamp, k string").parquet(source), "at", "k", "1 hour", "1 hour")
    assert counted.isStreaming


def test_cache_prefers_first_namespace(spark):
    store = spark.createDataFrame(
        [("n2", "e", "m", "h", 2, [0.0, 2.0], T, 1), ("n1", "e", "m", "h", 2, [1.0, 0.0], T, 2), ("n1", "f", "m", "h", 3, [1.0], T, 3)],
        "namespace string, entity_ref string, model_key string, content_hash string, dimensions int, embedding array<double>, updated_at timestamp, id int",
    )
    items = store.select("entity_ref", "model_key", "content_hash").distinct()
    found = {r.entity_ref: r for r in cached(items, store, ["n1", "n2"]).collect()}
    assert found["e"].vector == [1.0, 0.0] and found["e"].found_in == "n1" and not found["f"].hit


def test_embed_distinct(spark):
    texts = spark.createDataFrame([(" a  b",), ("a b",), (None,), ("  ",)], "text string")
    found = embed_distinct(texts, lambda batch: [[float(len(t))] for t in batch]).collect()
    assert [(r.text, r.vector) for r in found] == [("a b", [3.0])] and F is not None
