"""Queries: uploads and commits as merges, recovered runs, caches that are filled, descriptions of groups, suggestions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.functions import hashing as H
from graupel.functions import text as T
from graupel.functions import vectors as V
from graupel.operators import anchors as A
from graupel.operators import catalogue as K
from graupel.operators import embedding as E
from graupel.plans.matching import CATALOGUE, SHOP
from graupel.plans.texts import _ITEMS, _items, sql_clean, sql_fold, sql_ngrams, sql_tokens
from graupel.session import cut, ensure_checkpoint_dir, load
from graupel.sources import requests as R
from graupel.sources import store as S
from graupel.streaming.merge import window_counts

KEYS = ["namespace", "entity_ref", "model_key"]


def vectors_checked(spark: SparkSession, d: str) -> DataFrame:
    """Rows of even ids as the store, those of odd ids that fit their dimensions as a batch."""
    rows = load(spark, d, "semantic_embeddings").select("id", *KEYS, "dimensions", "embedding", "updated_at")
    good, _ = S.fitting(rows.where("id % 2 = 1"))
    return S.upsert_vectors(rows.where("id % 2 = 0"), good, KEYS, "updated_at", "id").select(*KEYS, "id")


def vectors_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors as text and back: the text's digest, and the numbers that come back."""
    rows = load(spark, d, "semantic_embeddings").where(V.fits("embedding", F.col("dimensions"))).select("id", S.vector_text(F.col("embedding")).alias("t")).distinct()
    return rows.select("id", F.sha2("t", 256).alias("digest"), F.size(S.text_vector(F.col("t"))).cast("bigint").alias("numbers"))


def _sent(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    digests = H.batch_hash(rows, ["revision_id", "batch_index"]).select("revision_id", "batch_index", "digest")
    return rows.select("revision_id", "batch_index", "ref").join(digests, ["revision_id", "batch_index"])


def batches_put(spark: SparkSession, d: str) -> DataFrame:
    """All batches sent to a store that has the even ones, of some of which an item is missing."""
    items = cut(_items(spark, d).where("batch_index IS NOT NULL").select("item_id", "revision_id", "batch_index", "ref", "item"))
    stored = _sent(spark, d, items.where("batch_index % 2 = 0 AND item_id % 10 <> 0"))
    expected = load(spark, d, "keyword_group_dataset_revisions").select(F.col("id").alias("revision_id"), "expected_batch_count", "expected_keyword_count")
    return S.put_batches(stored, _sent(spark, d, items), expected, ["revision_id"], "batch_index", "ref", "digest", "expected_batch_count", "expected_keyword_count")


def revisions_commits(spark: SparkSession, d: str) -> DataFrame:
    """What a commit of every revision in staging gives."""
    items = cut(_items(spark, d).select("revision_id", "scope_ref", "language", "batch_index", "ref", "item"))
    revisions = load(spark, d, "keyword_group_dataset_revisions")
    counts = items.join(revisions.select(F.col("id").alias("revision_id"), "expected_batch_count"), "revision_id").groupBy("revision_id").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct(F.when(F.col("batch_index").between(1, F.col("expected_batch_count")), F.col("batch_index"))).alias("batches")
    )
    digests = H.dataset_hash(items, ["revision_id"]).select("revision_id", "digest")
    facts = counts.join(digests, "revision_id").withColumnRenamed("revision_id", "id")
    referenced = load(spark, d, "keyword_group_runs").where("revision_id IS NOT NULL").select(F.col("revision_id").alias("id"))
    return S.commit_revisions(revisions, facts, referenced)


def runs_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Latest rows after recovery at the time of the last sighting; finished units stand for attempts."""
    runs = load(spark, d, "keyword_group_runs")
    now = runs.agg(F.max("observed_at")).scalar()
    rows = S.latest(runs.select("run_id", "status", "progress_phase", "progress_completed", "error", "heartbeat_at", "finished_at", "observed_at"), ["run_id"], "observed_at", "status")
    after = S.recover_stale(rows, now, 90, F.coalesce("progress_completed", F.lit(0)) % 3, 2)
    return after.select("run_id", "status", "progress_phase", "error", *[F.unix_micros(c).alias(c.replace("_at", "_us")) for c in ("heartbeat_at", "finished_at")])


def runs_oldest(spark: SparkSession, d: str) -> DataFrame:
    """The queued run that waits longest."""
    rows = S.latest(load(spark, d, "keyword_group_runs").select("run_id", "status", "created_at", "observed_at"), ["run_id"], "observed_at", "status")
    return S.oldest(rows, "queued", "created_at", "run_id").select("run_id")


def events_owned(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback of users to one of 500 items: a later one replaces an earlier one of the same user only."""
    rows = load(spark, d, "events").select((F.col("event_id") % 500).alias("item"), "user_id", "event_id", "ts")
    after, _ = S.upsert_owned(rows.where("event_id % 4 = 0"), rows.where("event_id % 4 <> 0"), "item", "user_id", "ts", "event_id")
    return after.select("item", "user_id", "event_id")


def analyses_saved(spark: SparkSession, d: str) -> DataFrame:
    """Analyses by scope, saved, one replaced, one deleted, and read."""
    path = f"{ensure_checkpoint_dir(spark)}/analyses-{uuid.uuid4().hex}"
    rows = cut(load(spark, d, "cluster_groups").where("scope_ref IS NOT NULL").select(F.md5("scope_ref").alias("analysis_id"), "group_key", F.size("member_refs").alias("members")))
    ends = rows.agg(F.min("analysis_id").alias("a"), F.max("analysis_id").alias("b")).first()
    S.save_analysis(rows, path)
    S.save_analysis(rows.where(F.col("analysis_id") == ends.a).withColumn("members", F.lit(0)), path)
    if ends.a != ends.b:
        S.delete_analysis(spark, path, ends.b)
    return spark.read.parquet(path).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("members"))


MODEL = "token:digest:1"


def _cache_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "dataset_keywords").where("ref IS NOT NULL").select("item_id", F.col("ref").alias("entity_ref"), T.normalize("text").alias("text"), F.col("uploaded_at").alias("updated_at"))
    keyed = rows.select("*", F.lit(MODEL).alias("model_key"), F.sha2("text", 256).alias("content_hash")).where("text IS NOT NULL")
    store = keyed.where("item_id % 3 = 0").select(
        F.col("item_id").alias("id"), F.lit("published_articles").alias("namespace"), "entity_ref", "model_key", "content_hash", F.lit(E.DIMENSIONS).alias("dimensions"),
        F.array_repeat(F.lit(1.0), E.DIMENSIONS).alias("embedding"), "updated_at",
    )
    return keyed.select("entity_ref", "model_key", "content_hash", "text").distinct(), store


def vectors_filled(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with their vectors, of which the store has those of every third record; others are embedded, each content once."""
    filled, _ = E.embedded(*_cache_items(spark, d), ["published_articles"], at="2024-01-01 00:00:00")
    return filled.select("entity_ref", "content_hash", "hit", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def vectors_written_back(spark: SparkSession, d: str) -> DataFrame:
    """After writing back nothing is missing."""
    items, store = _cache_items(spark, d)
    items, store = cut(items), cut(store)
    _, records = E.embedded(items, store, ["published_articles"], at="2024-01-01 00:00:00")
    after = store.drop("id").unionByName(records).withColumn("id", F.monotonically_increasing_id())
    wanted = items.where("trim(text) <> ''")
    return E.all_cached(wanted, cut(after), ["published_articles"]).groupBy("model_key").agg(F.count(F.lit(1)).alias("items"))


def texts_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct text through a model, in batches: here the first bytes of its SHA-256."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]

    found = E.embed_distinct(load(spark, d, "keyword_inputs"), embed)
    return found.select("text", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def link_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Keywords as targets of the first of their revision; where a text is blank, what the caller says holds."""
    rows = load(spark, d, "dataset_keywords").select("item_id", "revision_id", T.normalize("text").alias("t"), (F.col("item_id") % 10 / 10).alias("relevance"))
    known = rows.withColumn("target_vector", F.when(F.coalesce("t", F.lit("")) != "", E.token_vector("t")))
    first = known.groupBy("revision_id").agg(F.min_by("target_vector", "item_id").alias("source_vector"))
    found = E.text_relevance(known.join(first, "revision_id"))
    distance = V.cosine_distance("source_vector", "target_vector")
    return found.select("item_id", F.round("relevance", 6).alias("relevance"), F.round(distance, 6).alias("distance"))


def group_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL").select(F.col("revision_id").alias("cluster"), T.content_tokens("text").alias("tokens"))
    return A.group_anchors(rows)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def typical_members(spark: SparkSession, d: str) -> DataFrame:
    return A.typical_members(_labelled(spark, d), 64)


def group_names(spark: SparkSession, d: str) -> DataFrame:
    return A.named_groups(_labelled(spark, d).select("cluster", "id"))


#: Pages that a lookup of acronyms would find.
PAGES = [("HTTP", "https://en.wikipedia.org/wiki/HTTP"), ("SKU", "https://en.wikipedia.org/wiki/Stock_keeping_unit"), ("LED", "https://example.org/led"), ("USB", "https://vi.wikipedia.org/wiki/USB"), ("PVC", "https://en.wikipedia.org/wiki/PVC")]
WIKIS = ("https://en.wikipedia.org/wiki/", "https://vi.wikipedia.org/wiki/")


def link_suggestions(spark: SparkSession, d: str) -> DataFrame:
    catalogue = spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(CATALOGUE + SHOP)], "ordinal int, ref string, names array<string>")
    pages = spark.createDataFrame(PAGES, "term string, url string")
    return K.suggestions(load(spark, d, "documents"), catalogue, pages, WIKIS)


def keywords_rejected(spark: SparkSession, d: str) -> DataFrame:
    """How many keywords of all requests, taken as one, are valid, and why the others are not."""
    good, bad = R.valid_keywords(load(spark, d, "keyword_inputs").select("ref", "text"), 60)
    return good.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    counts = window_counts(load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type", "1 hour", "2 hours")
    return counts.select(F.unix_micros("window.start").alias("start_us"), "event_type", "rows")


def links_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Sources and scopes of documents as link targets: which are links."""
    rows = load(spark, d, "documents").where("source IS NOT NULL").select("source", F.concat(F.element_at(F.array(*map(F.lit, ("https://", "http://", "/", "ftp://", " https://", ""))), (F.col("doc_id") % 6 + 1).cast("int")), "source").alias("url")).distinct()
    return rows.select("url", T.is_link("url").alias("link"))


QUERIES = {f.__name__: f for f in (
    vectors_checked, vectors_as_text, batches_put, revisions_commits, runs_recovered, runs_oldest, events_owned, analyses_saved, vectors_filled, vectors_written_back,
    texts_embedded, link_relevance, group_anchors, typical_members, group_names, link_suggestions, keywords_rejected, events_by_hour, links_eligible,
)}

_RUNS = "(SELECT * FROM keyword_group_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY observed_at DESC NULLS LAST, status DESC NULLS LAST) = 1)"
_VECTOR = lambda t: f"list_transform(range(0, {E.DIMENSIONS}), lambda i: coalesce(list_sum(list_transform({t}, lambda w: CAST(('0x' || substr(sha256(w), 2 * i + 1, 2)) AS INTEGER) / 255.0 - 0.5)), 0.0))"
_NFC = sql_clean("nfc_normalize(text)")
_CACHE = f"""WITH k AS (SELECT item_id, ref AS entity_ref, {_NFC} AS text, sha256({_NFC}) AS content_hash FROM dataset_keywords WHERE ref IS NOT NULL AND text IS NOT NULL),
item AS (SELECT DISTINCT entity_ref, content_hash, text FROM k), stored AS (SELECT DISTINCT entity_ref, content_hash FROM k WHERE item_id % 3 = 0)"""
_SIM = "list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"
_NAMES = ", ".join(f"('{r}', {i}, {j}, '{n}')" for i, (r, names) in enumerate(CATALOGUE + SHOP) for j, n in enumerate(names))
_PAGES = ", ".join(f"('{t}', '{u}')" for t, u in PAGES)
SQL = {
    "vectors_checked": """SELECT namespace, entity_ref, model_key, id FROM semantic_embeddings WHERE id % 2 = 0 OR coalesce(dimensions > 0 AND len(embedding) = dimensions, false)
QUALIFY row_number() OVER (PARTITION BY namespace, entity_ref, model_key ORDER BY id % 2 DESC, updated_at DESC NULLS LAST, id DESC) = 1""",
    "vectors_as_text": """SELECT DISTINCT id, sha256('[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', CAST(x AS DOUBLE))), ',') || ']') AS digest, len(embedding) AS numbers FROM semantic_embeddings
WHERE coalesce(dimensions > 0 AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false)""",
    "batches_put": _ITEMS + """, sent AS (SELECT * FROM item WHERE batch_index IS NOT NULL), held AS (SELECT * FROM sent WHERE batch_index % 2 = 0 AND item_id % 10 <> 0),
digest AS (SELECT revision_id, batch_index, sha256(string_agg(item, ',' ORDER BY ref, item)) AS g FROM (SELECT DISTINCT revision_id, batch_index, ref, item FROM sent) GROUP BY ALL),
was AS (SELECT revision_id, batch_index, sha256(string_agg(item, ',' ORDER BY ref, item)) AS g FROM (SELECT DISTINCT revision_id, batch_index, ref, item FROM held) GROUP BY ALL),
tally AS (SELECT revision_id, batch_index, count(*) AS n, count(DISTINCT ref) AS refs FROM sent GROUP BY ALL), size AS (SELECT revision_id, count(*) AS have FROM held GROUP BY ALL)
SELECT f.revision_id, f.batch_index, CASE WHEN NOT coalesce(f.batch_index BETWEEN 1 AND expected_batch_count, false) THEN 'outside' WHEN refs < n THEN 'duplicate_ref' WHEN w.g IS NOT NULL THEN CASE WHEN w.g = d.g THEN 'idempotent' ELSE 'conflict' END
 WHEN coalesce(have, 0) + n > expected_keyword_count THEN 'too_many'
 WHEN EXISTS (SELECT 1 FROM sent s JOIN held h ON h.revision_id = s.revision_id AND h.ref = s.ref AND h.batch_index <> s.batch_index WHERE s.revision_id = f.revision_id AND s.batch_index = f.batch_index) THEN 'clash' ELSE 'stored' END AS outcome
FROM tally f JOIN digest d USING (revision_id, batch_index) LEFT JOIN was w USING (revision_id, batch_index) LEFT JOIN size z ON z.revision_id = f.revision_id JOIN keyword_group_dataset_revisions r ON r.id = f.revision_id""",
    "revisions_commits": _ITEMS + """, tally AS (SELECT i.revision_id, count(*) AS items, count(DISTINCT batch_index) FILTER (WHERE batch_index BETWEEN 1 AND expected_batch_count) AS batches FROM item i JOIN keyword_group_dataset_revisions r ON r.id = i.revision_id GROUP BY ALL),
digest AS (SELECT revision_id, sha256('{"items":[' || string_agg(item, ',' ORDER BY ref, item) || '],"language":' || coalesce(CAST(to_json(any_value(language)) AS VARCHAR), 'null') || ',"scope_ref":' || CAST(to_json(any_value(scope_ref)) AS VARCHAR) || '}') AS g FROM whole GROUP BY revision_id),
live AS (SELECT * FROM keyword_group_dataset_revisions WHERE status = 'committed' QUALIFY row_number() OVER (PARTITION BY scope_ref, language ORDER BY revision DESC NULLS LAST, id DESC) = 1),
judged AS (SELECT s.id, c.id AS before, CASE WHEN coalesce(batches, 0) < s.expected_batch_count THEN 'missing_batches' WHEN coalesce(items, 0) <> s.expected_keyword_count THEN 'count_mismatch' WHEN g IS DISTINCT FROM s.dataset_hash THEN 'hash_mismatch'
 WHEN c.revision > s.revision THEN 'stale' WHEN c.dataset_hash = g AND c.keyword_count = coalesce(items, 0) THEN 'unchanged' ELSE 'committed' END AS outcome
 FROM keyword_group_dataset_revisions s LEFT JOIN live c ON c.scope_ref = s.scope_ref AND c.language IS NOT DISTINCT FROM s.language LEFT JOIN tally f ON f.revision_id = s.id LEFT JOIN digest d ON d.revision_id = s.id WHERE s.status = 'staging')
SELECT id, outcome, before, CASE WHEN outcome = 'committed' AND before IS NOT NULL THEN CASE WHEN before IN (SELECT revision_id FROM keyword_group_runs) THEN 'retained' ELSE 'deleted' END END AS before_outcome FROM judged""",
    "runs_recovered": f"""WITH r AS (SELECT *, status = 'running' AND coalesce(epoch_us(heartbeat_at) < (SELECT max(epoch_us(observed_at)) FROM keyword_group_runs) - 90000000, false) AS dead, coalesce(progress_completed, 0) % 3 < 2 AS again FROM {_RUNS})
SELECT run_id, CASE WHEN dead AND again THEN 'queued' WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead AND again THEN 'requeued' WHEN dead THEN 'failed' ELSE progress_phase END AS progress_phase, CASE WHEN dead AND NOT again THEN 'worker heartbeat expired' ELSE error END AS error,
CASE WHEN dead AND again THEN NULL ELSE epoch_us(heartbeat_at) END AS heartbeat_us, CASE WHEN dead AND NOT again THEN (SELECT max(epoch_us(observed_at)) FROM keyword_group_runs) ELSE epoch_us(finished_at) END AS finished_us FROM r""",
    "runs_oldest": f"SELECT run_id FROM {_RUNS} WHERE status = 'queued' ORDER BY created_at NULLS FIRST, run_id LIMIT 1",
    "events_owned": """WITH e AS (SELECT event_id % 500 AS item, user_id, event_id, ts, event_id % 4 = 0 AS old FROM events),
held AS (SELECT item, arg_max(user_id, (ts, event_id)) AS owner FROM e WHERE old GROUP BY item), first AS (SELECT item, arg_min(user_id, (ts, event_id)) AS owner FROM e WHERE NOT old GROUP BY item),
ok AS (SELECT e.* FROM e LEFT JOIN held h USING (item) LEFT JOIN first f USING (item) WHERE old OR CASE WHEN h.item IS NOT NULL THEN e.user_id = h.owner ELSE e.user_id = f.owner END)
SELECT item, user_id, event_id FROM ok QUALIFY row_number() OVER (PARTITION BY item ORDER BY old, ts DESC NULLS LAST, event_id DESC) = 1""",
    "analyses_saved": """WITH a AS (SELECT md5(scope_ref) AS analysis_id, len(member_refs) AS m FROM cluster_groups WHERE scope_ref IS NOT NULL), e AS (SELECT min(analysis_id) AS lo, max(analysis_id) AS hi FROM a)
SELECT analysis_id, count(*) AS groups, CAST(sum(CASE WHEN analysis_id = lo THEN 0 ELSE m END) AS BIGINT) AS members FROM a, e WHERE lo = hi OR analysis_id <> hi GROUP BY analysis_id""",
    "vectors_filled": _CACHE + f""" SELECT entity_ref, content_hash, s.content_hash IS NOT NULL AS hit, CASE WHEN s.content_hash IS NOT NULL THEN {E.DIMENSIONS}.0 WHEN text <> '' THEN round(list_sum({_VECTOR(sql_tokens("text"))}), 6) END AS total
FROM item LEFT JOIN stored s USING (entity_ref, content_hash)""",
    "vectors_written_back": _CACHE + f" SELECT '{MODEL}' AS model_key, count(*) AS items FROM item WHERE text <> ''",
    "texts_embedded": f"""SELECT t AS text, round(list_sum(list_transform(range(0, 8), lambda i: CAST(('0x' || substr(sha256(t), 2 * i + 1, 2)) AS INTEGER) / 255)), 6) AS total FROM (SELECT DISTINCT {_NFC} AS t FROM keyword_inputs) WHERE t <> ''""",
    "link_relevance": f"""WITH k AS (SELECT item_id, revision_id, item_id % 10 / 10 AS r, CASE WHEN {_NFC} <> '' THEN {_VECTOR(sql_tokens(_NFC))} END AS v FROM dataset_keywords),
f AS (SELECT revision_id, arg_min(v, item_id) AS s FROM k WHERE v IS NOT NULL GROUP BY revision_id), c AS (SELECT item_id, r, CASE WHEN v IS NULL OR s IS NULL THEN NULL WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 OR list_sum(list_transform(s, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity(v, s) END AS c FROM k JOIN f USING (revision_id))
SELECT item_id, round(coalesce(greatest(0, least(1, c)), r), 6) AS relevance, round(1 - c, 6) AS distance FROM c""",
    "group_anchors": f"""WITH t AS (SELECT revision_id AS cluster, {sql_tokens("text")} AS t FROM dataset_keywords WHERE text IS NOT NULL), g AS (SELECT cluster, unnest({sql_ngrams("t")}) AS ngram FROM t),
n AS (SELECT cluster, count(*) AS n FROM t GROUP BY cluster), c AS (SELECT cluster, ngram, count(*) AS support, any_value(n) >= 0 AND count(*) >= least(2, any_value(n)) AS enough FROM g JOIN n USING (cluster) GROUP BY ALL),
p AS (SELECT *, bool_or(enough) OVER (PARTITION BY cluster) AS any_enough, row_number() OVER (PARTITION BY cluster ORDER BY support DESC, ngram) AS place FROM c)
SELECT cluster, ngram, support FROM p WHERE enough OR (NOT any_enough AND place <= 3)""",
    "typical_members": f"""WITH m AS (SELECT x.label AS cluster, x.vec_id AS id, round(avg({_SIM}), 6) AS s FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY ALL
 UNION ALL SELECT any_value(label), any_value(vec_id), 1.0 FROM embeddings GROUP BY label HAVING count(*) = 1)
SELECT cluster, id AS representative, s AS mean_score FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, id) = 1""",
    "group_names": "SELECT label AS cluster, printf('g-%04d', row_number() OVER (ORDER BY min(vec_id), label)) AS name FROM embeddings GROUP BY label",
    "link_suggestions": rf"""WITH name(ref, ordinal, n, term) AS (VALUES {_NAMES}), page(term, url) AS (VALUES {_PAGES}), body AS MATERIALIZED (SELECT doc_id, text, regexp_replace({sql_fold('text')}, '[\s\pZ]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
hit AS (SELECT doc_id, ref, ordinal, n, term FROM body, name WHERE regexp_matches(t, '(^|[^\pL\pN_])' || regexp_escape({sql_fold('term')}) || '($|[^\pL\pN_])') QUALIFY row_number() OVER (PARTITION BY doc_id, ref ORDER BY n) = 1),
a AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_]+')) AS w FROM body) WHERE regexp_matches(w, '^[A-Z][A-Z0-9]{{1,7}}$') AND lower(w) NOT IN (SELECT {sql_fold('term')} FROM name)),
every AS (SELECT doc_id, ref, term, CASE WHEN upper(term) = term AND lower(term) <> term THEN 1.0 ELSE 0.9 END AS score, ordinal FROM hit
 UNION ALL SELECT doc_id, 'wiki:' || lower(w), w, 0.8, 1000000 FROM a JOIN page ON page.term = w WHERE starts_with(url, '{WIKIS[0]}') OR starts_with(url, '{WIKIS[1]}'))
SELECT doc_id, ref, term, score::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal, term) AS rank FROM every QUALIFY rank <= 2""",
    "keywords_rejected": f"""WITH k AS (SELECT trim(ref) AS ref, {_NFC} AS t FROM keyword_inputs), j AS (SELECT k.*, CASE WHEN coalesce(ref, '') = '' THEN 'ref' WHEN coalesce(t, '') = '' THEN 'blank' WHEN length(t) > 60 THEN 'long'
 WHEN count(*) OVER (PARTITION BY ref) > 1 THEN 'duplicate_ref' ELSE 'valid' END AS reason FROM k) SELECT reason, count(*) AS rows FROM j GROUP BY reason""",
    "events_by_hour": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS rows FROM events GROUP BY ALL",
    "links_eligible": """WITH u AS (SELECT DISTINCT (['https://', 'http://', '/', 'ftp://', ' https://', ''])[doc_id % 6 + 1] || source AS url FROM documents WHERE source IS NOT NULL)
SELECT url, starts_with(trim(url), 'https://') OR starts_with(trim(url), 'http://') OR starts_with(trim(url), '/') AS link FROM u""",
}
