"""Deterministic embeddings as column expressions, batch embedding of distinct texts, and the cache of stored vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from graupel.functions.text import bind, content_tokens, normalize
from graupel.functions.vectors import clip, cosine
from graupel.session import cut

DIMENSIONS = 32


def digest_vector(text: Column, dimensions: int = 8) -> Column:
    """The first bytes of the text's SHA-256, each divided by 255 (at most 32)."""
    digits = F.lit("0123456789abcdef")
    nibble = lambda digest, i: F.position(F.substring(digest, i + 1, 1), digits) - 1
    byte = lambda digest, i: (nibble(digest, 2 * i) * 16 + nibble(digest, 2 * i + 1)) / F.lit(255.0)
    return bind(F.sha2(text, 256), lambda digest: F.array(*[byte(digest, i) for i in range(dimensions)]))


@lru_cache(maxsize=200_000)
def _token(token: str, dimensions: int) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(token.encode()).digest()[:dimensions], np.uint8) / 255.0 - 0.5


def token_vector(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """The sum over the content tokens of their digest vectors around zero: texts that share tokens are close. Null for null.
    In Arrow batches: a worker computes each token once, where an expression would for every dimension of every row."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def add(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: sum((_token(t, dimensions) for t in ts), np.zeros(dimensions)), na_action="ignore")

    return add(content_tokens(text))


def embed_distinct(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "text") -> DataFrame:
    """(text, vector): every distinct text once through `embed`, in Arrow batches; null and blank texts are left out.
    `embed` is made in each worker (a model is loaded there once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "vector": embed(batch["text"].tolist())})

    clean = texts.select(normalize(column).alias("text")).where(F.col("text") != "").distinct()
    return clean.mapInPandas(run, "text string, vector array<double>")


def cached(items: DataFrame, store: DataFrame, namespaces: list[str]) -> DataFrame:
    """items (entity_ref, model_key, content_hash) with vector and hit: the stored vector of the first namespace that has one
    for the same content. Joins on all keys, never a lookup per row; later rows of the store hold over earlier ones."""
    rank = F.array_position(F.array(*[F.lit(n) for n in namespaces]), F.col("namespace"))
    valid = store.where(F.col("namespace").isin(namespaces) & (F.col("dimensions") > 0) & (F.size("embedding") == F.col("dimensions")))
    best = valid.groupBy("entity_ref", "model_key", "content_hash").agg(
        F.min_by(F.struct("namespace", "embedding"), F.struct(rank.alias("r"), (-F.unix_micros("updated_at")).alias("t"), "id")).alias("b")
    )
    joined = items.join(best, ["entity_ref", "model_key", "content_hash"], "left")
    return joined.select(*items.columns, F.col("b.namespace").alias("found_in"), F.col("b.embedding").alias("vector"), F.col("b").isNotNull().alias("hit"))


def split_cache(items: DataFrame, store: DataFrame, namespaces: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of cached(), each with the columns of items; hits also with vector and found_in."""
    both = cut(cached(items, store, namespaces))
    return both.where("hit").drop("hit"), both.where("NOT hit").select(*items.columns)


def embedded(
    items: DataFrame, store: DataFrame, namespaces: list[str], embed: Callable[[Column], Column] = token_vector, at: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items with vector and hit, records to write back). Stored vectors of the same content are taken; the others' texts are
    embedded, every different content once. Records are rows for the first namespace, to be upserted.

    items: entity_ref, model_key, content_hash, text. Blank and null texts have no vector and are no record."""
    hits, misses = split_cache(items, store, namespaces)
    distinct = misses.where(F.coalesce(F.trim("text"), F.lit("")) != "").groupBy("model_key", "content_hash").agg(F.min("text").alias("text"))
    fresh = cut(distinct.select("model_key", "content_hash", embed("text").alias("vector")))
    filled = misses.join(fresh, ["model_key", "content_hash"], "left").select(*items.columns, "vector", F.lit(False).alias("hit"))
    known = hits.select(*items.columns, F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("hit"))
    stamp = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    records = filled.where("vector IS NOT NULL").select(
        F.lit(namespaces[0]).alias("namespace"), "entity_ref", "model_key", "content_hash", F.size("vector").alias("dimensions"), F.col("vector").alias("embedding"), stamp.alias("updated_at")
    ).distinct()
    return known.unionByName(filled), records


class CacheMissError(ValueError):
    """Some items have no stored vector."""


def all_cached(items: DataFrame, store: DataFrame, namespaces: list[str]) -> DataFrame:
    """The hits, if there is no miss; else an error with the numbers."""
    hits, misses = split_cache(items, store, namespaces)
    missing = misses.count()
    if missing:
        raise CacheMissError(f"{missing} of {missing + hits.count()} items have no stored vector")
    return hits


def text_relevance(pairs: DataFrame) -> DataFrame:
    """pairs with relevance: the cosine of source and target vectors, from 0 to 1, or, where a text is blank and so has no
    vector, the relevance that is there. pairs: source_vector, target_vector, relevance."""
    return pairs.withColumn("relevance", F.coalesce(clip(cosine("source_vector", "target_vector")), "relevance"))
