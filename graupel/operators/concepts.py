"""Scoring of rows against concepts given by examples, decisions, and ranking of weighted targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.operators.blocks import matrix, unit

TOP_POSITIVES = 3
#: Most example vectors a catalogue may have: it travels to every task.
MAX_EXAMPLES = 100_000


def concept_scores(points: DataFrame, examples: DataFrame) -> DataFrame:
    """(id, concept, positive_max, best_positive, top_mean, negative_max, best_negative, margin).

    points: id BIGINT, vector. examples: concept, ordinal, positive BOOLEAN, example_id, vector: a catalogue, at most
    MAX_EXAMPLES vectors (more is an error). Each task multiplies its points with all examples at once; the numbers of a concept come
    from its columns. Concepts need a positive example; without negatives their fields and the margin are null. The first
    example wins ties.
    """
    rows = examples.orderBy("concept", F.desc("positive"), "ordinal").limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} examples")
    schema = "id bigint, concept bigint, positive_max double, best_positive bigint, top_mean double, negative_max double, best_negative bigint"
    if not rows:
        return points.sparkSession.createDataFrame([], schema + ", margin double")
    vectors = unit(np.array([r.vector for r in rows]))
    names = np.array([r.example_id for r in rows])
    spans: dict[int, tuple[list[int], list[int]]] = {}
    for i, r in enumerate(rows):
        spans.setdefault(r.concept, ([], []))[0 if r.positive else 1].append(i)
    spans = {c: s for c, s in spans.items() if s[0]}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            sims = unit(matrix(batch.column("vector"))) @ vectors.T
            for concept, (good, bad) in spans.items():
                p = sims[:, good]
                best = p.argmax(axis=1)
                top = -np.sort(-p, axis=1)[:, : min(TOP_POSITIVES, len(good))]
                n = len(batch)
                fields = [ids, pa.array(np.full(n, concept, np.int64)), pa.array(p.max(axis=1)), pa.array(names[good][best]), pa.array(top.mean(axis=1))]
                if bad:
                    q = sims[:, bad]
                    fields += [pa.array(q.max(axis=1)), pa.array(names[bad][q.argmax(axis=1)])]
                else:
                    fields += [pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(fields, names=[f.split()[0] for f in schema.split(", ")])

    known = points.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    return known.mapInArrow(score, schema).withColumn("margin", F.col("positive_max") - F.col("negative_max"))


def accepts(least: float | None, margin: float) -> Column:
    """The semantic gate: enough similarity and, where there are negatives, enough distance to them."""
    if least is None:
        return F.lit(False)
    return F.coalesce((F.col("positive_max") >= least) & (F.col("margin").isNull() | (F.col("margin") >= margin)), F.lit(False))


def decide(strategy: str, lexical: Column, negative: Column, least: float | None, margin: float, fallback: bool) -> Column:
    """lexical, semantic or hybrid decision. `lexical` and `negative` say whether positive and negative examples occur."""
    clean = lexical & ~negative
    if strategy == "lexical":
        return clean
    if strategy == "semantic":
        return accepts(least, margin)
    return clean | accepts(least, margin) if fallback else clean


def verdicts(scores: DataFrame, least: float, margin: float, key: str = "id", name: str = "concept", score: str = "positive_max") -> DataFrame:
    """(key, status, chosen, score, runner_up_margin): confident, ambiguous (the next is closer than `margin`), or none."""
    order = W.partitionBy(key).orderBy(F.desc(score), name)
    ranked = scores.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead(score).over(order)).where("n = 1")
    gap = F.col(score) - F.col("next")
    status = F.when(F.col(score) < least, "none").when((F.col("next") >= least) & (gap < margin), "ambiguous").otherwise("confident")
    return ranked.select(key, status.alias("status"), F.when(status == "confident", F.col(name)).alias("chosen"), F.round(score, 6).alias("score"), F.round(gap, 6).alias("runner_up_margin"))


def weighted_targets(relevance: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, ref, group_id, relevance, weight, score, rank): for every row its targets by relevance x weight / greatest weight; of
    several groups with one target the best holds, the first at ties.

    relevance: id, group_id, relevance. targets: group_id, ordinal, ref, weight (a catalogue; Catalyst broadcasts it only under its
    size threshold)."""
    most = targets.agg(F.max("weight").alias("w"))
    shares = targets.withColumn("share", F.try_divide(F.col("weight"), most.scalar())).where(F.col("share").isNotNull())
    scored = relevance.join(shares, "group_id").withColumn("score", F.col("relevance") * F.col("share"))
    best = scored.groupBy("id", "ref").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "group_id", "relevance", "weight")).alias("b")).select("id", "ref", "b.*")
    order = W.partitionBy("id").orderBy(F.desc("score"), F.desc("o"), "ref")
    return best.withColumn("rank", F.row_number().over(order)).drop("o")


def lexical_bonus(texts: DataFrame, hints: DataFrame, ceiling: float) -> DataFrame:
    """(id, module, bonus, matched): the weights of hints of which a phrase occurs in the text, added up to a ceiling.

    texts: id, padded (words between single blanks, a blank at both ends). hints: hint_id, module, weight, phrases; a catalogue.
    Phrases of one to several words are found by their first word, so that no row meets every hint."""
    phrases = hints.select("hint_id", "module", "weight", F.explode("phrases").alias("p")).select("hint_id", "module", "weight", F.concat(F.lit(" "), F.trim("p"), F.lit(" ")).alias("phrase"), F.split(F.trim("p"), " ")[0].alias("word"))
    tokens = texts.select("id", "padded", F.explode(F.array_distinct(F.split(F.trim("padded"), " "))).alias("word"))
    hits = tokens.join(phrases, "word").where(F.contains("padded", "phrase")).select("id", "module", "hint_id", "weight").distinct()
    return hits.groupBy("id", "module").agg(F.least(F.lit(ceiling), F.sum("weight")).alias("bonus"), F.array_sort(F.collect_list("hint_id")).alias("matched"))
