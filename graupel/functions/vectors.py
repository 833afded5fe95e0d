"""Vector and score functions as column expressions, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graupel.functions.text import bind


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for a vector of norm zero; null for null, unequal or no dimensions."""
    length = norm(a) * norm(b)
    value = F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)
    return F.when((F.size(_c(a)) == F.size(_c(b))) & (F.size(_c(a)) > 0), value)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def normalized(a: Column | str) -> Column:
    """A zero vector stays zero."""
    length = norm(a)
    return bind(F.when(length == 0, F.lit(1.0)).otherwise(length), lambda n: F.transform(_c(a), lambda x: x.cast("double") / n))


def is_finite(a: Column | str) -> Column:
    bad = F.exists(_c(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def fits(a: Column | str, dimensions: Column | int) -> Column:
    d = F.lit(dimensions) if isinstance(dimensions, int) else dimensions
    return F.coalesce((F.size(_c(a)) == d) & (d > 0), F.lit(False)) & is_finite(a)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(score: Column | str, floor: float) -> Column:
    s = _c(score)
    return F.when(s <= floor, F.lit(0.0)).otherwise(clip((s - floor) / max(1e-9, 1.0 - floor)))


def cohesion(mean: Column | str, least: Column | str) -> Column:
    return clip(0.65 * _c(mean) + 0.35 * _c(least))


def nearest_rank(values: Column, share: float) -> Column:
    """Of a collected array the element at round-half-even((n - 1) * share)."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.rint((F.size(ordered) - 1) * F.lit(share)) + 1).cast("int"))
