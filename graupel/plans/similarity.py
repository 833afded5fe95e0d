"""Queries over vectors: neighbours, edges, components, clusters, given groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.functions import vectors as V
from graupel.operators import clustering as C
from graupel.operators import edges as E
from graupel.operators.search import search
from graupel.operators.skew import join_unique
from graupel.session import load

TAU = 0.35


def _points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.lit(0).cast("bigint").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all rows for every row whose id is divisible by 50."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows.where("id % 50 = 0"), rows, 10)


def search_accept(spark: SparkSession, d: str) -> DataFrame:
    """As a keyword search answers: the best five with a flag for a rounded score of at least 0.4."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows.where("id % 50 = 0"), rows, 5, accept=0.4)


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "semantic_embeddings")
    fit = V.fits("embedding", F.col("dimensions"))
    return rows.select("id", fit.alias("usable"), F.when(fit, F.round(V.norm("embedding"), 6)).alias("norm")).distinct()


def cosine_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.similarity_edges(_points(spark, d), 0.3)).select("a", "b", "score")


def neighbours_top3(spark: SparkSession, d: str) -> DataFrame:
    top = E.nearest_edges(_points(spark, d), 0.3)
    return top.select("id", "other", "score", F.col("rank").cast("bigint").alias("rank"))


def reciprocal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.reciprocal_pairs(E.nearest_edges(_points(spark, d), 0.3)).select("a", "b", "score")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return E.components(E.similarity_edges(_points(spark, d), TAU))


def medoid_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The member of each given group with the highest mean cosine to all its members, from the sum of unit vectors."""
    rows = _by_label(spark, d).select("group", "id", V.normalized("vector").alias("u"))
    sums = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(64)])
    sums = sums.select("group", "n", F.array(*[F.col(f"s{i}") for i in range(64)]).alias("total"))
    means = join_unique(rows, sums, "group").select("group", "id", F.round(V.dot("u", "total") / F.col("n"), 6).alias("mean_score"))
    best = means.groupBy("group").agg(F.min(F.struct((-F.col("mean_score")).alias("s"), "id")).alias("b"))
    return best.select(F.col("group").cast("int").alias("label"), F.col("b.id").alias("representative"), (-F.col("b.s")).alias("mean_score"))


def _given_groups(spark: SparkSession, d: str) -> DataFrame:
    """label's rows scored against the medoid."""
    rows = _by_label(spark, d)
    reps = medoid_by_label(spark, d).select(F.col("label").cast("bigint").alias("group"), F.col("representative").alias("id"))
    vectors = reps.join(rows, ["group", "id"]).select("group", F.col("id").alias("representative"), F.col("vector").alias("rep_vector"))
    return join_unique(rows, vectors, "group").select("group", "id", F.col("group").alias("cluster"), "representative", V.cosine("vector", "rep_vector").alias("score"))


def group_stats(spark: SparkSession, d: str) -> DataFrame:
    _, groups = C.assigned(_given_groups(spark, d), floor=0.05)
    return groups.select(F.col("cluster").alias("label"), "representative", "size", "mean_score", "min_score", "cohesion", "low_confidence")


def group_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    _, groups = C.assigned(_given_groups(spark, d), floor=0.05)
    return C.size_histogram(groups)


def score_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _given_groups(spark, d)
    return rows.select("id", F.round(V.confidence("score", 0.05), 6).alias("confidence"))


def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles of the scores of each given group."""
    rows = _given_groups(spark, d)
    return rows.groupBy(F.col("group").alias("label")).agg(
        F.round(F.percentile("score", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("score", F.lit(0.9)), 6).alias("p90"),
        F.round(V.nearest_rank(F.collect_list("score"), 0.9), 6).alias("p90_rank"),
    )


def _clusters(algorithm: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = C.cluster_points(_points(spark, d), algorithm, TAU, 0.4)
        return _rounded(found).select("id", "cluster", "representative", "score")

    return query


QUERIES = {f.__name__: f for f in (
    knn_topk, search_accept, vector_norms, cosine_edges, neighbours_top3, reciprocal_pairs, connected_components, medoid_by_label,
    group_stats, group_size_histogram, score_confidence, score_percentiles,
)} | {f"cluster_{a}": _clusters(a) for a in C.ALGORITHMS}

_V = "WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SIM = "list_cosine_similarity(x.e, y.e)"
_EDGES = f"{_V}, edge AS (SELECT x.id AS a, y.id AS b, round({_SIM}, 6) AS score FROM v x JOIN v y ON x.id < y.id WHERE {_SIM} >= 0.3)"
_TOP = f"""{_EDGES}, bidi AS (SELECT a AS id, b AS other, score FROM edge UNION ALL SELECT b, a, score FROM edge),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM bidi QUALIFY rank <= 3)"""
_KNN = f"""{_V}, hit AS (SELECT x.id AS query_id, y.id, round({_SIM}, 6) AS score FROM v x JOIN v y ON x.id % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit)"""
_REP = f"""{_V}, mean AS (SELECT x.label, x.id, round(avg({_SIM}), 6) AS mean_score FROM v x JOIN v y ON x.label = y.label GROUP BY ALL),
rep AS (SELECT * FROM mean QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean_score DESC, id) = 1)"""
_GIVEN = f"""{_REP}, given AS (SELECT x.label, x.id, rep.id AS representative, {_SIM} AS score FROM v x JOIN rep ON x.label = rep.label JOIN v y ON y.id = rep.id),
adjusted AS (SELECT label, id, representative, id = representative AS is_rep, CASE WHEN id = representative THEN 1.0 ELSE score END AS score FROM given),
grouped AS (SELECT label, representative, count(*) AS size, avg(score) AS m, min(score) AS s,
  count(*) FILTER (WHERE NOT is_rep AND greatest(0, least(1, (score - 0.05) / 0.95)) < 0.35) AS low_confidence
  FROM adjusted WHERE is_rep OR score >= 0.05 GROUP BY ALL HAVING count(*) >= 2)"""
SQL = {
    "knn_topk": _KNN + " SELECT query_id, id, score, rank FROM best WHERE rank <= 10",
    "search_accept": _KNN + " SELECT query_id, id, score, rank, score >= 0.4 AS accepted FROM best WHERE rank <= 5",
    "vector_norms": """WITH u AS (SELECT DISTINCT id, embedding, coalesce(dimensions > 0 AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS usable FROM semantic_embeddings)
SELECT DISTINCT id, usable, CASE WHEN usable THEN round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) END AS norm FROM u""",
    "cosine_edges": _EDGES + " SELECT a, b, score FROM edge",
    "neighbours_top3": _TOP + " SELECT id, other, score, rank FROM top",
    "reciprocal_pairs": _TOP + " SELECT id AS a, other AS b, score FROM top t WHERE id < other AND EXISTS (SELECT 1 FROM top o WHERE o.id = t.other AND o.other = t.id)",
    "connected_components": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
edge AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE {_SIM} >= {TAU}),
reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.other = edge.a)
SELECT id, min(other) AS component FROM reach GROUP BY id""",
    "medoid_by_label": _REP + " SELECT label, id AS representative, mean_score FROM rep",
    "group_stats": _GIVEN + " SELECT CAST(label AS BIGINT) AS label, representative, size, round(m, 6) AS mean_score, round(s, 6) AS min_score, round(greatest(0, least(1, 0.65 * m + 0.35 * s)), 6) AS cohesion, low_confidence FROM grouped",
    "group_size_histogram": _GIVEN + " SELECT size, count(*) AS groups FROM grouped GROUP BY size",
    "score_confidence": _GIVEN + " SELECT id, CASE WHEN score <= 0.05 THEN 0.0 ELSE round(greatest(0, least(1, (score - 0.05) / 0.95)), 6) END AS confidence FROM given",
    "score_percentiles": _GIVEN + """, ranked AS (SELECT label, list_sort(list(score)) AS l FROM given GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, (SELECT round(l[CAST(round_even(0.9 * (len(l) - 1), 0) AS BIGINT) + 1], 6) FROM ranked r WHERE r.label = given.label) AS p90_rank FROM given GROUP BY label""",
}
