"""Queries over stored tables: latest rows, upserts, lookups, caches, paging, batches, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.operators.embedding import cached, digest_vector
from graupel.session import ensure_checkpoint_dir, load
from graupel.sources import store as S
from graupel.streaming.merge import merge_stream, stream_table

RUN = ["run_id", "scope_ref", "status", "member_count", "observed_at"]


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "keyword_group_runs")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", "status", "member_count", F.unix_micros("observed_at").alias("observed_us"))


def runs_latest(spark: SparkSession, d: str) -> DataFrame:
    """The row that holds for each run."""
    return _flat(S.latest(_runs(spark, d).select(*RUN), ["run_id"], "observed_at", "status"))


def runs_latest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the table read as a stream of files and merged batch by batch."""
    path = f"{d}/keyword_group_runs.parquet"
    schema = spark.read.parquet(path).schema
    target = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    # a stream reads folders: the table may be one file
    stream = stream_table(spark, path if _is_folder(spark, path) else f"{d}/keyword_group_runs*.parquet", schema)
    return _flat(merge_stream(stream.select(*RUN), target, ["run_id"], "observed_at", "status"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def runs_stale(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose latest row is unfinished and has a heartbeat more than 90 seconds before it was observed."""
    rows = S.latest(_runs(spark, d).select("run_id", "status", "heartbeat_at", "finished_at", "observed_at"), ["run_id"], "observed_at", "status")
    late = F.unix_micros("observed_at") - F.unix_micros("heartbeat_at")
    return rows.where(F.col("finished_at").isNull() & (late > 90_000_000)).select("run_id", "status", late.alias("late_us"))


def runs_by_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Of each fingerprint the run that was created last."""
    rows = _runs(spark, d).where("fingerprint IS NOT NULL").select("fingerprint", "run_id", "created_at")
    return S.latest(rows, ["fingerprint"], "created_at", "run_id").select("fingerprint", "run_id")


def runs_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a hundred revisions by id, with the cursor of the next."""
    from graupel.operators.ranking import page

    rows, following = page(load(spark, d, "keyword_group_dataset_revisions").select("id", "scope_ref", "revision"), "id", 201, 100)
    return rows.withColumn("next_cursor", F.lit(following).cast("bigint"))


def revisions_next(spark: SparkSession, d: str) -> DataFrame:
    """The next revision number of each scope, over all languages and states."""
    rows = load(spark, d, "keyword_group_dataset_revisions")
    return rows.groupBy("scope_ref").agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"))


def revisions_committed(spark: SparkSession, d: str) -> DataFrame:
    """Of each scope and language (null is a language) the revision committed last."""
    rows = load(spark, d, "keyword_group_dataset_revisions").where("committed_at IS NOT NULL").select("scope_ref", "language", "id", "revision", "committed_at")
    return S.latest(rows, ["scope_ref", "language"], "committed_at", "id").select("scope_ref", "language", "id", "revision")


def revisions_against_items(spark: SparkSession, d: str) -> DataFrame:
    """Stored and stated numbers of items of each revision that has items."""
    items = load(spark, d, "dataset_keywords").groupBy("revision_id").agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("ref").alias("refs"))
    rows = load(spark, d, "keyword_group_dataset_revisions").select(F.col("id").alias("revision_id"), "keyword_count")
    return items.join(rows, "revision_id").select("revision_id", "stored", "refs", F.col("keyword_count").cast("bigint").alias("stated"))


def batches_missing(spark: SparkSession, d: str) -> DataFrame:
    """Of each revision the batches it expects and does not have."""
    rows = load(spark, d, "dataset_keywords").select("revision_id", "batch_index")
    expected = load(spark, d, "keyword_group_dataset_revisions").select(F.col("id").alias("revision_id"), "expected_batch_count")
    found = S.missing_batches(rows, expected, ["revision_id"], "batch_index", "expected_batch_count")
    return found.select("revision_id", "received", F.array_join(F.array_sort("missing").cast("array<string>"), ",").alias("missing"))


def batches_clashing(spark: SparkSession, d: str) -> DataFrame:
    """Refs that a revision has in more than one batch."""
    rows = load(spark, d, "dataset_keywords").groupBy("revision_id", "ref").agg(F.countDistinct("batch_index").alias("batches"))
    return rows.where("batches > 1")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "semantic_embeddings").select("id", "namespace", "entity_ref", "model_key", "content_hash", "dimensions", "embedding", "updated_at")


KEYS = ["namespace", "entity_ref", "model_key"]


def vectors_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Rows of even ids as the store, rows of odd ids as a batch."""
    rows = _vectors(spark, d)
    after = S.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), KEYS, "updated_at", "id")
    return after.select("namespace", "entity_ref", "model_key", "id")


def vectors_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors of the keywords of one table, by a join of whole tables."""
    wanted = load(spark, d, "cluster_points").select(F.col("ref").alias("entity_ref"))
    return S.lookup(_vectors(spark, d), wanted, ["entity_ref"]).groupBy("namespace").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_ref").alias("refs"))


def vectors_kept(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "cluster_points").select(F.col("ref").alias("entity_ref"))
    return S.delete(_vectors(spark, d), gone, ["entity_ref"]).groupBy("namespace").agg(F.count(F.lit(1)).alias("rows"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which contents have a valid vector in the published namespace or, failing that, in a second one."""
    rows = _vectors(spark, d)
    second = rows.where("namespace <> 'published_articles'").agg(F.min("namespace").alias("n")).first().n
    items = rows.select("entity_ref", "model_key", "content_hash").distinct()
    found = cached(items, rows, ["published_articles", second])
    return found.groupBy("model_key", "hit").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("found_in") == "published_articles").alias("in_first"))


def text_digest_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "dataset_keywords").select("item_id", digest_vector(F.col("text")).alias("v"))
    return rows.select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("v", 8), 6).alias("eighth"))


def event_latest_by_user(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return S.latest(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def run_durations(spark: SparkSession, d: str) -> DataFrame:
    """Finished runs by status and hour of the day: number and mean duration of their latest rows."""
    rows = S.latest(_runs(spark, d).select("run_id", "status", "started_at", "finished_at", "observed_at"), ["run_id"], "observed_at", "status")
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return rows.where("finished_at IS NOT NULL AND started_at IS NOT NULL").groupBy("status", F.hour("started_at").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(took), 3).alias("mean_s"))


def run_attempt_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How often runs were seen, and the longest time between two sightings, by status of the latest row."""
    seen = _runs(spark, d).select("run_id", "status", F.unix_micros("observed_at").alias("us")).distinct()
    order = W.partitionBy("run_id").orderBy("us", "status")
    gaps = seen.withColumn("gap", F.col("us") - F.lag("us").over(order)).withColumn("n", F.row_number().over(order))
    per_run = gaps.groupBy("run_id").agg(F.max("n").alias("seen"), F.max("gap").alias("gap"), F.max_by("status", F.struct("us", "status")).alias("status"))
    return per_run.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.max("seen").cast("bigint").alias("most_seen"), F.max("gap").alias("longest_gap_us"))


QUERIES = {f.__name__: f for f in (
    runs_latest, runs_latest_stream, runs_stale, runs_by_fingerprint, runs_page, revisions_next, revisions_committed, revisions_against_items,
    batches_missing, batches_clashing, vectors_upserted, vectors_found, vectors_kept, cache_hits, text_digest_vectors, event_latest_by_user,
    run_durations, run_attempt_gaps,
)}


def _latest(cols: str, keys: str, at: str, tie: str, table: str) -> str:
    return f"(SELECT {cols} FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {at} DESC NULLS LAST, {tie} DESC NULLS LAST) = 1)"


_RUNS = _latest("*", "run_id", "observed_at", "status", "keyword_group_runs")
_LATEST = f"SELECT run_id, status, member_count, epoch_us(observed_at) AS observed_us FROM {_RUNS}"
_GONE = "entity_ref IN (SELECT ref FROM cluster_points)"
_VALID = "(SELECT * FROM semantic_embeddings WHERE dimensions > 0 AND len(embedding) = dimensions)"
SQL = {
    "runs_latest": _LATEST,
    "runs_latest_stream": _LATEST,
    "runs_stale": f"SELECT run_id, status, epoch_us(observed_at) - epoch_us(heartbeat_at) AS late_us FROM {_RUNS} WHERE finished_at IS NULL AND epoch_us(observed_at) - epoch_us(heartbeat_at) > 90000000",
    "runs_by_fingerprint": "SELECT fingerprint, run_id FROM " + _latest("*", "fingerprint", "created_at", "run_id", "(SELECT * FROM keyword_group_runs WHERE fingerprint IS NOT NULL)"),
    "runs_page": "SELECT id, scope_ref, revision, (SELECT CAST(max(id) AS BIGINT) FROM (SELECT id FROM keyword_group_dataset_revisions WHERE id >= 201 ORDER BY id LIMIT 101)) AS next_cursor FROM keyword_group_dataset_revisions WHERE id >= 201 ORDER BY id LIMIT 100",
    "revisions_next": "SELECT scope_ref, coalesce(max(revision), 0) + 1 AS next_revision FROM keyword_group_dataset_revisions GROUP BY scope_ref",
    "revisions_committed": "SELECT scope_ref, language, id, revision FROM " + _latest("*", "scope_ref, language", "committed_at", "id", "(SELECT * FROM keyword_group_dataset_revisions WHERE committed_at IS NOT NULL)"),
    "revisions_against_items": "SELECT revision_id, count(*) AS stored, count(DISTINCT ref) AS refs, CAST(any_value(keyword_count) AS BIGINT) AS stated FROM dataset_keywords JOIN keyword_group_dataset_revisions r ON r.id = revision_id GROUP BY revision_id",
    "batches_missing": """WITH got AS (SELECT revision_id, list(DISTINCT batch_index) FILTER (WHERE batch_index IS NOT NULL) AS s FROM dataset_keywords GROUP BY revision_id)
SELECT id AS revision_id, coalesce(len(s), 0) AS received, coalesce(array_to_string(list_filter(range(1, coalesce(expected_batch_count, 0) + 1), lambda i: NOT list_contains(coalesce(s, []), i)), ','), '') AS missing
FROM keyword_group_dataset_revisions r LEFT JOIN got g ON g.revision_id = r.id""",
    "batches_clashing": "SELECT revision_id, ref, count(DISTINCT batch_index) AS batches FROM dataset_keywords GROUP BY ALL HAVING count(DISTINCT batch_index) > 1",
    "vectors_upserted": "SELECT namespace, entity_ref, model_key, id FROM semantic_embeddings QUALIFY row_number() OVER (PARTITION BY namespace, entity_ref, model_key ORDER BY id % 2 DESC, updated_at DESC NULLS LAST, id DESC) = 1",
    "vectors_found": f"SELECT namespace, count(*) AS rows, count(DISTINCT entity_ref) AS refs FROM semantic_embeddings WHERE {_GONE} GROUP BY namespace",
    "vectors_kept": f"SELECT namespace, count(*) AS rows FROM semantic_embeddings WHERE NOT {_GONE} GROUP BY namespace",
    "cache_hits": f"""WITH item AS (SELECT DISTINCT entity_ref, model_key, content_hash FROM semantic_embeddings),
hit AS (SELECT DISTINCT entity_ref, model_key, content_hash, namespace = 'published_articles' AS first FROM {_VALID}
 WHERE namespace IN ('published_articles', (SELECT min(namespace) FROM semantic_embeddings WHERE namespace <> 'published_articles'))),
found AS (SELECT model_key, EXISTS (SELECT 1 FROM hit h WHERE h.entity_ref = i.entity_ref AND h.model_key = i.model_key AND h.content_hash = i.content_hash) AS hit,
 EXISTS (SELECT 1 FROM hit h WHERE h.entity_ref = i.entity_ref AND h.model_key = i.model_key AND h.content_hash = i.content_hash AND h.first) AS first FROM item i)
SELECT model_key, hit, count(*) AS items, count(*) FILTER (WHERE first) AS in_first FROM found GROUP BY ALL""",
    "text_digest_vectors": """SELECT item_id, round(list_sum(v), 6) AS total, round(v[8], 6) AS eighth FROM (SELECT item_id,
 list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256(text), 2 * i + 1, 2)) AS INTEGER) / 255) AS v FROM dataset_keywords)""",
    "event_latest_by_user": "SELECT user_id, event_type, event_id FROM " + _latest("*", "user_id, event_type", "ts", "event_id", "events"),
    "run_durations": f"SELECT status, hour(started_at AT TIME ZONE 'UTC') AS hour, count(*) AS runs, round(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 3) AS mean_s FROM {_RUNS} WHERE finished_at IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL",
    "run_attempt_gaps": """WITH seen AS (SELECT DISTINCT run_id, status, epoch_us(observed_at) AS us FROM keyword_group_runs),
gap AS (SELECT *, us - lag(us) OVER w AS gap, row_number() OVER w AS n FROM seen WINDOW w AS (PARTITION BY run_id ORDER BY us, status)),
run AS (SELECT run_id, max(n) AS seen, max(gap) AS gap, arg_max(status, n) AS status FROM gap GROUP BY run_id)
SELECT status, count(*) AS runs, max(seen) AS most_seen, max(gap) AS longest_gap_us FROM run GROUP BY status""",
}
