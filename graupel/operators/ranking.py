"""Blending, spacing, distribution and paging of ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.functions.vectors import clip
from graupel.operators.skew import join_unique


def blend(similarities: Column) -> Column:
    """One score from the similarities of a text's segments, in their order: the best, the better half, and the lead."""
    floor = F.transform(similarities, lambda s: F.greatest(s, F.lit(0.0)))
    n = F.size(similarities)
    best = F.sort_array(floor, asc=False)
    half = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    mean = F.aggregate(F.slice(best, F.lit(1), half), F.lit(0.0), lambda a, x: a + x) / half
    mixed = 0.45 * best[0] + 0.35 * mean + 0.20 * F.array_max(F.slice(floor, 1, 2))
    return F.when(n == 0, F.lit(0.0)).when(n == 1, clip(floor[0])).otherwise(clip(mixed))


def boosted(semantic: Column, exact: Column, label: Column, example: Column) -> Column:
    """A text that is the label scores at least 0.95; mentions add a little, in proportion to the semantic score."""
    return (
        F.when(exact, F.greatest(F.lit(0.95), semantic))
        .when(label, F.least(F.lit(1.0), semantic + 0.08 * clip((semantic - 0.40) / 0.40)))
        .when(example, F.least(F.lit(1.0), semantic + 0.04 * clip((semantic - 0.45) / 0.40)))
        .otherwise(semantic)
    )


def inbound_metrics(candidates: DataFrame, key: str = "source_ref") -> DataFrame:
    """Per key: rows without inbound links, median, 90th percentile (nearest rank), maximum, repeated refs, and the share of all
    links that goes to the top fifth. candidates: key, ref, inbound BIGINT."""
    # counts of equal numbers combine per task; what is ranked is the few different numbers of a key
    values = candidates.groupBy(key, "inbound").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(key).orderBy(F.desc("inbound"))
    ranked = values.withColumn("before", F.sum("c").over(order) - F.col("c")).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    place = F.col("n") - F.rint((F.col("n") - 1) * F.lit(0.9))
    top = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), top - F.col("before")))
    stats = ranked.groupBy(key).agg(
        F.sum(F.when(F.col("inbound") == 0, F.col("c")).otherwise(0)).alias("zero_inbound"), F.percentile("inbound", F.lit(0.5), F.col("c")).alias("median_inbound"),
        F.max(F.when((place > F.col("before")) & (place <= F.col("before") + F.col("c")), F.col("inbound"))).cast("double").alias("p90_inbound"), F.max("inbound").alias("max_inbound"),
        F.try_divide(F.sum(taken * F.col("inbound")), F.sum(F.col("c") * F.col("inbound"))).alias("c"),
    )
    twice = candidates.groupBy(key, "ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(key).agg(F.count(F.lit(1)).alias("repeated_refs"))
    return stats.join(twice, key, "left").select(
        key, "zero_inbound", "median_inbound", "p90_inbound", "max_inbound", F.coalesce("repeated_refs", F.lit(0)).alias("repeated_refs"),
        F.round(F.coalesce("c", F.lit(0.0)), 6).alias("top_share"),
    )


def balanced_rank(candidates: DataFrame, key: str = "source_ref", overuse: float = 0.05, underlinked: float = 0.03, repetition: float = 0.04, limit: int = 10) -> DataFrame:
    """(key, ref, ordinal, score, rank): relevance, nudged by at most 0.08 towards rows with few inbound links; further rows of
    a ref that was taken lose `repetition`. Greedy selection in closed form: of a ref the best row is taken first, all others carry
    the penalty. candidates: key, ref, ordinal, inbound, relevance."""
    per_key = W.partitionBy(key)
    values = candidates.groupBy(key, "inbound").agg(F.count(F.lit(1)).alias("c"))
    stats = values.groupBy(key).agg(F.greatest(F.lit(1.0), F.max("inbound")).alias("scale"), F.percentile("inbound", F.lit(0.5), F.col("c")).alias("median"))
    base = join_unique(candidates, stats, key)
    over = overuse * F.greatest(F.lit(0.0), F.col("inbound") - F.col("median")) / F.col("scale")
    bonus = F.when(F.col("inbound") == 0, F.lit(underlinked)).otherwise(F.lit(0.0))
    nudge = lambda r: clip(bonus - over - r, -0.08, 0.08)
    first = W.partitionBy(key, "ref").orderBy(F.desc("once"), "ordinal")
    scored = base.withColumn("once", F.col("relevance") + nudge(F.lit(0.0))).withColumn("again", F.col("relevance") + nudge(F.lit(repetition)))
    final = scored.withColumn("score", F.when(F.row_number().over(first) == 1, F.col("once")).otherwise(F.col("again")))
    order = per_key.orderBy(F.desc("score"), "ordinal")
    return final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, "ref", "ordinal", F.round("score", 6).alias("score"), "rank")


def spaced(sections: DataFrame, key: str = "article", gap: int = 180, words_each: int = 350, cap: int = 5) -> DataFrame:
    """(key, picked ARRAY<BIGINT>): section ids picked from each article, best score first, at most one for `words_each` words and
    `cap` in all, and at least `gap` words apart. A fold over the sorted array of one article's sections.
    sections: key, section_id, score, start_word, words."""
    entry = F.struct((-F.col("score")).alias("s"), F.col("start_word").alias("at"), "section_id")
    listed = sections.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("all"), F.sum("words").alias("words"))
    ceiling = F.when(F.col("words") > 0, F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(F.col("words") / words_each)))).otherwise(F.lit(cap))
    start = F.array().cast("array<struct<at:bigint,id:bigint>>")
    picked = F.aggregate(
        "all", start,
        lambda got, x: F.when(
            (F.size(got) < ceiling) & ~F.exists(got, lambda g: F.abs(g["at"] - x["at"]) < gap),
            F.concat(got, F.array(F.struct(x["at"].cast("bigint").alias("at"), x["section_id"].cast("bigint").alias("id")))),
        ).otherwise(got),
    )
    return listed.select(key, F.transform(F.array_sort(picked), lambda g: g["id"]).alias("picked"))


def page(rows: DataFrame, ordinal: str, cursor: int, limit: int) -> tuple[DataFrame, int | None]:
    """The rows from `cursor` on and the cursor of the next page, found by reading one row more."""
    some = rows.where(F.col(ordinal) >= cursor).orderBy(ordinal).limit(limit + 1)
    more = some.agg(F.count(F.lit(1)).alias("n"), F.max(ordinal).alias("last")).first()
    following = more["last"] if more["n"] > limit else None
    return (some if following is None else some.where(F.col(ordinal) < following)), following
