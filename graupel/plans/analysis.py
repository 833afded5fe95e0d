"""Whole analyses: prepared keywords to groups with labels, and the rest with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.functions.text import normalize
from graupel.operators.clustering import assigned, cluster_points
from graupel.operators.embedding import token_vector
from graupel.session import cut, load

THRESHOLD, FLOOR = 0.74, 0.70


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with normal text, the reason why one can't be analysed ("blank" or "long", as in valid_keywords), and, where
    there is none, its vector."""
    rows = load(spark, d, "dataset_keywords").select("item_id", "scope_ref", normalize("text").alias("text"))
    reason = F.when(F.coalesce("text", F.lit("")) == "", "blank").when(F.length("text") > 500, "long")
    judged = rows.withColumn("reason", reason)
    return judged.select(
        F.xxhash64("scope_ref").alias("group"), F.col("item_id").alias("id"), "scope_ref", "text", F.when(F.col("reason").isNull(), token_vector("text")).alias("vector"), "reason"
    )


def topic_analysis(spark: SparkSession, d: str) -> DataFrame:
    """(id, cluster, label, score, reason): every keyword with its group, the group's label (the text of its representative) and
    its similarity to that, or the reason why it is in none."""
    prepared = cut(_prepared(spark, d))
    rows = prepared.where("reason IS NULL").drop("reason")
    rejected = prepared.where("reason IS NOT NULL").select("id", "reason")
    members = cut(cluster_points(rows.select("group", "id", "vector"), "average_linkage", THRESHOLD))
    kept, _ = assigned(members, FLOOR)
    labels = rows.select(F.col("id").alias("representative"), F.col("text").alias("label"))
    grouped = kept.join(labels, "representative").select("id", "cluster", "label", F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("reason"))
    low = members.where((F.col("id") != F.col("representative")) & (F.col("score") < FLOOR)).select("id", F.lit("below_assignment_min_score").alias("reason"))
    small = members.join(low, "id", "left_anti").join(kept.select("id"), "id", "left_anti").select("id", F.lit("below_min_group_size_after_assignment").alias("reason"))
    alone = rows.select("id").join(members.select("id"), "id", "left_anti").select("id", F.lit("below_threshold_or_small_component").alias("reason"))
    rest = low.unionByName(small).unionByName(alone).unionByName(rejected)
    return grouped.unionByName(rest.select("id", F.lit(None).cast("bigint").alias("cluster"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"), "reason"))


def topic_summary(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of the analysis: keywords by outcome, and groups."""
    rows = topic_analysis(spark, d)
    return rows.groupBy(F.coalesce("reason", F.lit("grouped")).alias("outcome")).agg(F.count(F.lit(1)).alias("keywords"), F.countDistinct("cluster").alias("groups"))


QUERIES = {f.__name__: f for f in (topic_analysis, topic_summary)}
SQL: dict[str, str] = {}
