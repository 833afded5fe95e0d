"""What describes a group of texts: its anchors (runs of tokens that several members share) and its most typical member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.functions.text import ngrams
from graupel.functions.vectors import dot, normalized
from graupel.operators.skew import join_unique
from graupel.session import cut

FALLBACK = 3


def group_anchors(members: DataFrame) -> DataFrame:
    """(cluster, ngram, support): runs of two or more tokens that at least two members of a cluster have (one, if it has one
    member); where there are none, its three most frequent runs, ties to the smaller run.

    members: cluster, tokens ARRAY<STRING>. Counts combine per task, and at most three rows a cluster and task are ranked."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    counts = members.select("cluster", F.explode(ngrams("tokens")).alias("ngram")).groupBy("cluster", "ngram").agg(F.count(F.lit(1)).alias("support"))
    rated = counts.join(sizes, "cluster").withColumn("enough", F.col("support") >= F.least(F.lit(2), F.col("n")))
    has = rated.where("enough").select("cluster").distinct()
    order = W.partitionBy("cluster").orderBy(F.desc("support"), "ngram")
    few = rated.where("NOT enough").join(has, "cluster", "left_anti").withColumn("place", F.row_number().over(order)).where(F.col("place") <= FALLBACK)
    return rated.where("enough").select("cluster", "ngram", "support").unionByName(few.select("cluster", "ngram", "support"))


def typical_members(members: DataFrame, dimensions: int) -> DataFrame:
    """(cluster, representative, mean_score): the member with the highest mean cosine to the others, ties to the smaller id; alone
    a member has 1. The mean follows from the sum of the cluster's unit vectors, so no pairs are built.

    members: cluster, id, vector of `dimensions` numbers."""
    rows = members.select("cluster", "id", normalized("vector").alias("u"))
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dimensions)])
    sums = sums.select("cluster", "n", F.array(*[F.col(f"s{i}") for i in range(dimensions)]).alias("total"))
    means = join_unique(rows, sums, "cluster").select(
        "cluster", "id", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.round((dot("u", "total") - dot("u", "u")) / (F.col("n") - 1), 6)).alias("mean")
    )
    best = means.groupBy("cluster").agg(F.min(F.struct((-F.col("mean")).alias("m"), "id")).alias("b"))
    return best.select("cluster", F.col("b.id").alias("representative"), (-F.col("b.m")).alias("mean_score"))


def named_groups(members: DataFrame, form: str = "g-%04d") -> DataFrame:
    """(cluster, name): groups numbered by their smallest member, from 1. A rank over all groups needs them in one order: they are
    sorted by range, and each range counts on from those before it, so that no task holds all of them."""
    firsts = members.groupBy("cluster").agg(F.min("id").alias("first"))
    ordered = firsts.repartitionByRange("first").sortWithinPartitions("first", "cluster").withColumn("part", F.spark_partition_id())
    ordered = cut(ordered)
    counts = {r.part: r.n for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    offsets, before = [], 0
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    table = F.broadcast(members.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, before bigint"))
    place = F.row_number().over(W.partitionBy("part").orderBy("first", "cluster"))
    return ordered.join(table, "part").select("cluster", F.format_string(form, F.col("before") + place).alias("name"))
