"""Texts against a catalogue of concepts: lexical and semantic evidence, decisions, intents, and routes of two levels.

The catalogue is a stated set that travels to every task; what grows with the data is never broadcast or paired with itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.functions.text import collapse_blanks, folds_case, matches_form
from graupel.operators.concepts import accepts, concept_scores, decide, weighted_targets
from graupel.operators.embedding import token_vector


@dataclass(frozen=True)
class Concept:
    id: int
    positives: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    mode: str = "phrase"
    strategy: str = "hybrid"
    enabled: bool = True

    @property
    def semantic(self) -> bool:
        return self.strategy != "lexical"


def unique_examples(examples: Sequence[str | None]) -> tuple[str, ...]:
    """Examples with single blanks, blank ones dropped, the first of equal ones kept."""
    return tuple(dict.fromkeys(t for t in (" ".join((e or "").split()) for e in examples) if t))


def selected(concepts: Sequence[Concept], allowed: Sequence[int] | None = None) -> list[Concept]:
    """Enabled concepts with a positive example, of the allowed ones."""
    return [c for c in concepts if c.enabled and c.positives and (allowed is None or c.id in allowed)]


def lexical_matches(texts: DataFrame, concepts: Sequence[Concept]) -> DataFrame:
    """(id, concept, lexical, hits, best, negative, negative_hits): for every text and concept which examples occur in it, in their
    order, by the concept's mode; `best` is the first. Modes that are not deterministic (semantic) match nothing. Null texts match
    nothing. texts: id, text (composed). Each text is folded once for all examples."""
    none = F.array().cast("array<string>")

    def hits(examples: tuple[str, ...], mode: str) -> Column:
        if mode == "semantic" or not examples:
            return none
        form = F.col("folded" if folds_case(mode) else "bare")
        found = [F.when(F.coalesce(matches_form(form, e, mode), F.lit(False)), F.lit(e)) for e in examples]
        return F.filter(F.array(*found), lambda e: e.isNotNull())

    forms = texts.select("id", collapse_blanks(folds_case("phrase", F.col("text"))).alias("folded"), collapse_blanks(folds_case("folded", F.col("text"))).alias("bare"))
    rows = [F.struct(F.lit(c.id).cast("bigint").alias("concept"), hits(c.positives, c.mode).alias("hits"), hits(c.negatives, c.mode).alias("negative_hits")) for c in concepts]
    if not rows:
        rows = [F.struct(F.lit(None).cast("bigint").alias("concept"), none.alias("hits"), none.alias("negative_hits"))]
        forms = forms.limit(0)
    listed = forms.select("id", F.explode(F.array(*rows)).alias("m")).select("id", "m.*")
    return listed.select(
        "id", "concept", (F.size("hits") > 0).alias("lexical"), "hits", F.get("hits", F.lit(0)).alias("best"), (F.size("negative_hits") > 0).alias("negative"), "negative_hits"
    )


def example_vectors(spark: SparkSession, concepts: Sequence[Concept]) -> DataFrame:
    """(concept, ordinal, positive, example_id, vector) of the concepts that need vectors; every different text is embedded once."""
    listed = [(c.id, i, good, e) for c in concepts if c.semantic for good, examples in ((True, c.positives), (False, c.negatives)) for i, e in enumerate(examples)]
    rows = spark.createDataFrame(listed, "concept bigint, ordinal int, positive boolean, example string")
    vectors = rows.select("example").distinct().select("example", token_vector("example").alias("vector"))
    return rows.join(F.broadcast(vectors), "example").select("concept", "ordinal", "positive", F.col("ordinal").cast("bigint").alias("example_id"), "vector")


def concept_matches(texts: DataFrame, concepts: Sequence[Concept], least: float | None, margin: float = 0.0, fallback: bool = True) -> DataFrame:
    """(id, concept, lexical, best, negative, positive_max, top_mean, negative_max, margin, suggested) of every text and concept:
    lexical evidence, semantic evidence (null for lexical concepts, which are not embedded), and the decision by the concept's
    strategy (null where `least` is None: no policy). texts: id, text, vector."""
    words = lexical_matches(texts.select("id", "text"), concepts)
    scores = concept_scores(texts.select("id", "vector"), example_vectors(texts.sparkSession, concepts))
    both = words.join(scores, ["id", "concept"], "left")
    suggested = F.lit(None).cast("boolean")
    if least is not None:
        for c in concepts:
            suggested = F.when(F.col("concept") == c.id, decide(c.strategy, F.col("lexical"), F.col("negative"), least, margin, fallback)).otherwise(suggested)
    return both.select("id", "concept", "lexical", "best", "negative", "positive_max", "top_mean", "negative_max", "margin", suggested.alias("suggested"))


def intents(matches: DataFrame, least: float, margin: float) -> DataFrame:
    """(id, status, first, second, score, runner_up_margin): the intent of each text. matches: id, concept, lexical, negative,
    positive_max.

    Lexical hits (positive and not negative) come first: several are ambiguous; one is confident, unless another concept is
    semantically better by `margin` and at least `least`. Without, the best semantic score decides. A row a text is gathered from its
    rows of the catalogue, which bounds it."""
    entry = F.struct(
        (-F.coalesce("positive_max", F.lit(-1.0))).alias("order"), F.col("concept"), (F.col("lexical") & ~F.col("negative")).alias("hit"), F.col("positive_max").alias("score")
    )
    listed = matches.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    hits = F.array_sort(F.transform(F.filter("all", lambda e: e["hit"]), lambda e: F.struct(e["concept"].alias("concept"), e["score"].alias("score"))))
    chosen = listed.select("id", "all", F.size(hits).alias("n"), F.get(hits, F.lit(0)).alias("h1"), F.get(hits, F.lit(1)).alias("h2"), F.get("all", F.lit(0)).alias("t1"), F.get("all", F.lit(1)).alias("t2"))
    gap = lambda a, b: F.when(a.isNull(), F.lit(0.0)).otherwise(a - F.coalesce(b, F.lit(0.0)))
    t1, t2, h1 = F.col("t1.score"), F.col("t2.score"), F.col("h1.score")
    rival = (F.col("t1.concept") != F.col("h1.concept")) & F.coalesce(t1 >= least, F.lit(False)) & (gap(t1, h1) >= margin)
    close = F.coalesce(t2 >= least, F.lit(False)) & (gap(t1, t2) < margin)
    status = (
        F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, F.when(rival, "ambiguous").otherwise("confident"))
        .when(~F.coalesce(t1 >= least, F.lit(False)), "none").when(close, "ambiguous").otherwise("confident")
    )
    lexical = F.col("n") >= 1
    pair = lambda c, s: F.struct(c.alias("concept"), s.alias("score"))
    rest = F.get(F.filter("all", lambda e: e["concept"] != F.col("h1.concept")), F.lit(0))
    first = F.when(lexical, F.col("h1")).otherwise(pair(F.col("t1.concept"), t1))
    second = F.when(F.col("n") > 1, F.col("h2")).when(lexical, pair(rest["concept"], rest["score"])).otherwise(pair(F.col("t2.concept"), t2))
    found = chosen.select("id", status.alias("status"), lexical.alias("lexical"), first.alias("f"), second.alias("s"))
    return found.select(
        "id", "status", F.col("f.concept").alias("first"), F.col("s.concept").alias("second"),
        F.round(F.when(F.col("lexical"), F.lit(1.0)).otherwise(F.coalesce("f.score", F.lit(0.0))), 6).alias("score"),
        F.when(F.col("s.concept").isNotNull(), F.round(gap(F.col("f.score"), F.col("s.score")), 6)).alias("runner_up_margin"),
    )


@dataclass(frozen=True)
class RoutePolicy:
    least_candidate: float = 0.45
    least_operation: float = 0.62
    final_margin: float = 0.08
    outer: float = 0.35
    inner: float = 0.65
    modules: int = 3


def routes(relevance: DataFrame, outer: DataFrame, inner: DataFrame, bonus: DataFrame, policy: RoutePolicy = RoutePolicy()) -> DataFrame:
    """(id, status, module, operation, score): routing on two levels. The four best modules of each text (of weighted groups)
    that are relevant enough take their lexical bonus, and the best `modules` of them stay; their operations score by both levels; the
    best one holds if it leads by the margin. Ties go to the earlier.

    relevance: id, group_id, relevance. outer: group_id, ordinal, ref (a module), weight. inner: module, group_id, ordinal, ref (an
    operation), weight. bonus: id, module, bonus. outer and inner are catalogues."""
    ranked = weighted_targets(relevance, outer).where((F.col("rank") <= 4) & (F.col("relevance") >= policy.least_candidate))
    raised = ranked.select("id", F.col("ref").alias("module"), "score", "rank").join(bonus, ["id", "module"], "left")
    combined = F.least(F.lit(1.0), F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    place = W.partitionBy("id").orderBy(F.desc("combined"), "rank")
    modules = raised.withColumn("combined", combined).withColumn("place", F.row_number().over(place)).where(F.col("place") <= policy.modules).select("id", "module", "combined", "place")

    shares = inner.withColumn("share", F.try_divide(F.col("weight"), F.max("weight").over(W.partitionBy("module")))).where("share IS NOT NULL")
    scored = modules.join(shares, "module").join(relevance, ["id", "group_id"]).withColumn("inner", F.col("relevance") * F.col("share"))
    best = scored.groupBy("id", "module", "combined", "place", "ref").agg(F.max(F.struct("inner", (-F.col("ordinal")).alias("o"), "relevance")).alias("b"))
    order = W.partitionBy("id", "module").orderBy(F.desc("b.inner"), F.desc("b.o"))
    kept = best.withColumn("n", F.row_number().over(order)).where((F.col("n") <= 4) & (F.col("b.relevance") >= policy.least_operation))
    final = kept.withColumn("final", policy.outer * F.col("combined") + policy.inner * F.col("b.inner"))
    last = W.partitionBy("id").orderBy(F.desc("final"), "place", "n")
    ends = final.withColumn("next", F.lead("final").over(last)).withColumn("at", F.row_number().over(last)).where("at = 1")
    close = F.coalesce(F.col("final") - F.col("next") < policy.final_margin, F.lit(False))
    winners = ends.select("id", F.when(close, "ambiguous").otherwise("confident").alias("status"), F.when(~close, F.col("module")).alias("module"), F.when(~close, F.col("ref")).alias("operation"), F.round("final", 6).alias("score"))
    seen = modules.groupBy("id").agg(F.lit(True).alias("any"))
    every = relevance.select("id").distinct().join(seen, "id", "left").join(winners, "id", "left")
    return every.select("id", F.coalesce("status", F.when(F.col("any"), "unsupported").otherwise("none")).alias("status"), "module", "operation", "score")
