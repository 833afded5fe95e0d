"""Lexical evidence about pairs of texts, as column expressions over their content tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graupel.functions.text import is_span, ngrams

CONTAINMENT = 0.67
COMPATIBLE, INCOMPATIBLE, UNKNOWN = "compatible", "incompatible", "unknown"


def _shared_start(a: Column, b: Column) -> Column:
    """How many leading tokens agree."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, shorter)


def pair_evidence(pairs: DataFrame, a: str = "tokens_a", b: str = "tokens_b", least: float = CONTAINMENT) -> DataFrame:
    """pairs with containment DOUBLE, lexically_compatible and conflict BOOLEAN.

    Without tokens on one side a pair is in conflict. Else, in this order: a shared start with different short ends is a
    conflict; one text within the other, a changed first token, or nearly the same tokens are compatible; runs of tokens on
    both sides and none in common are a conflict; anything else is neither.
    """
    A, B = F.col(a), F.col(b)
    sa, sb = F.array_distinct(A), F.array_distinct(B)
    na, nb = F.size(A), F.size(B)
    facts = pairs.select(
        "*",
        F.try_divide(F.size(F.array_intersect(sa, sb)), F.least(F.size(sa), F.size(sb))).alias("__c"),
        ngrams(A).alias("__ga"), ngrams(B).alias("__gb"),
        _shared_start(A, B).alias("__p"), _shared_start(F.reverse(A), F.reverse(B)).alias("__s"),
        F.when(na <= nb, is_span(B, A)).otherwise(is_span(A, B)).alias("__embedded"),
    )
    tail = lambda x, n: F.array_distinct(F.slice(x, F.col("__p") + 1, F.greatest(n - F.col("__p"), F.lit(0))))
    ta, tb = tail(A, na), tail(B, nb)
    substitution = (F.col("__p") >= 2) & F.size(ta).between(1, 3) & F.size(tb).between(1, 3) & ~F.arrays_overlap(ta, tb)
    swap = (F.col("__s") >= 2) & (na - F.col("__s") == 1) & (nb - F.col("__s") == 1)
    near = (F.abs(na - nb) <= 2) & (F.col("__c") >= least)
    apart = (F.size(F.array_except("__ga", "__gb")) > 0) & (F.size(F.array_except("__gb", "__ga")) > 0) & ~F.arrays_overlap("__ga", "__gb")
    empty = (na == 0) | (nb == 0)
    verdict = (
        F.when(empty, F.lit("x")).when(substitution, F.lit("x")).when(F.col("__embedded") | swap | near, F.lit("c")).when(apart, F.lit("x")).otherwise(F.lit("-"))
    )
    return facts.select(
        *pairs.columns, F.when(empty, F.lit(0.0)).otherwise(F.col("__c")).alias("containment"),
        (verdict == "c").alias("lexically_compatible"), (verdict == "x").alias("conflict"),
    )


def pair_relation(floor: float, score: str = "score", shared_evidence: Column | None = None) -> Column:
    """The relation of a pair with evidence: a conflict comes first, then the semantic floor."""
    support = F.col("lexically_compatible") if shared_evidence is None else F.col("lexically_compatible") | F.coalesce(shared_evidence, F.lit(False))
    return (
        F.when(F.col("conflict"), F.lit(INCOMPATIBLE)).when(F.col(score) < floor, F.lit(UNKNOWN)).when(support, F.lit(COMPATIBLE)).otherwise(F.lit(UNKNOWN))
    )
