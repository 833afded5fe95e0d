"""Similarity edges, their ranking, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.operators.blocks import BLOCK_ROWS, block_pairs, each_key, matrix, unit
from graupel.session import cut

_ROWS = 512


def similarity_edges(points: DataFrame, cutoff: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, a, b, score): pairs of one group with cosine >= cutoff, a < b. points: group BIGINT, id BIGINT, vector ARRAY.

    Zero vectors have cosine 0 to all. Null ids and vectors are left out; ids are unique within a group.
    """
    known = points.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    pairs = block_pairs(known.select("group", "id", F.col("vector").cast("array<double>").alias("vector")), block_rows)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rows = table["id"].to_numpy(), unit(matrix(table["vector"].combine_chunks()))
        group = table["group"][0].as_py()
        if table["same"][0].as_py():
            left = right = np.arange(len(ids))
        else:
            side = table["side"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for start in range(0, len(left), _ROWS):
            some = left[start : start + _ROWS]
            scores = np.clip(rows[some] @ rows[right].T, -1.0, 1.0)
            i, j = np.nonzero(scores >= cutoff)
            a, b, s = ids[some[i]], ids[right[j]], scores[i, j]
            keep = a < b if left is right else a != b
            a, b, s = a[keep], b[keep], s[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), group, np.int64)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)],
                names=["group", "a", "b", "score"],
            )

    return each_key(pairs, "pair", work, "`group` bigint, a bigint, b bigint, score double")


def nearest_edges(points: DataFrame, cutoff: float, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, id, other, score, rank): of each row the k most similar of its group with cosine >= cutoff, scores rounded to 6
    places, ties to the smaller id. A block keeps k a row, so pairs are never listed. points as in similarity_edges."""
    known = points.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    pairs = block_pairs(known.select("group", "id", F.col("vector").cast("array<double>").alias("vector")), block_rows)

    def best(ids: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
        right = right[np.argsort(ids[right], kind="stable")]
        for start in range(0, len(left), _ROWS):
            some = left[start : start + _ROWS]
            exact = np.clip(rows[some] @ rows[right].T, -1.0, 1.0)
            scores = np.where((exact >= cutoff) & (ids[some][:, None] != ids[right][None, :]), np.round(exact, 6), -2.0)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(scores, top, 1)
            i, j = np.nonzero(value > -2.0)
            if len(i):
                columns = (np.full(len(i), group), ids[some[i]], ids[right[top[i, j]]], value[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "id", "other", "score"])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rows, group = table["id"].to_numpy(), unit(matrix(table["vector"].combine_chunks())), table["group"][0].as_py()
        if table["same"][0].as_py():
            yield from best(ids, rows, np.arange(len(ids)), np.arange(len(ids)), group)
        else:
            side = table["side"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            yield from best(ids, rows, left, right, group)
            yield from best(ids, rows, right, left, group)

    found = each_key(pairs, "pair", work, "`group` bigint, id bigint, other bigint, score double")
    order = W.partitionBy("group", "id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_pairs(nearest: DataFrame) -> DataFrame:
    """(group, a, b, score): pairs of which each is among the k best of the other (see nearest_edges). An aggregate instead of a
    self-join."""
    top = nearest.select("group", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "score")
    return top.groupBy("group", "a", "b").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): connected components of edges (a, b) over BIGINT ids, named by their smallest id.

    Rounds of taking the smallest label among the neighbours and of following labels, each kept in the shared folder; the
    number of rounds grows with the logarithm of the diameter. Aggregates combine per task, so a hub is no hot spot.
    """
    links = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = links.join(labels.select(F.col("id").alias("b"), F.col("component").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        nearer = labels.join(around, "id", "left").select("id", F.least("component", F.coalesce("seen", "component")).alias("component"), F.col("component").alias("before"))
        target = nearer.select(F.col("id").alias("component"), F.col("component").alias("further"))
        stepped = cut(nearer.join(target, "component").select("id", F.col("further").alias("component"), (F.col("further") != F.col("before")).alias("moved")))
        labels = stepped.select("id", "component")
        if stepped.where("moved").isEmpty():
            return labels


#: Links that a task holds before it replaces them by their forest.
_HELD = 1 << 21


def _forest(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, id and smallest connected id of every id among a and b."""
    ids, first, at = np.unique(np.concatenate((a, b)), return_index=True, return_inverse=True)
    label, (x, y) = np.arange(len(ids)), at.reshape(2, -1)
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return np.concatenate((group, group))[first], ids, ids[label]


def group_components(edges: DataFrame) -> DataFrame:
    """components() of edges (group BIGINT, a, b) that stay within a group, in one shuffle and without rounds: a task replaces
    its links by their forest, and a group's forests, at most one link an id and task, meet in one task. An id linked to itself
    only is a component."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("group", "a", "b")))
            if sum(len(h[0]) for h in held) > _HELD:
                held = [_forest(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > _HELD // 2:  # the forest itself is large: it goes on, and the next begins
                    yield from pa.Table.from_arrays([pa.array(c) for c in held.pop()], names=["group", "a", "b"]).to_batches(100_000)
        if held:
            yield from pa.Table.from_arrays([pa.array(c) for c in _forest(*map(np.concatenate, zip(*held)))], names=["group", "a", "b"]).to_batches(100_000)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, ids, label = _forest(*(table[c].to_numpy() for c in ("group", "a", "b")))
        yield from pa.Table.from_arrays([pa.array(ids), pa.array(label)], names=["id", "component"]).to_batches(100_000)

    forests = edges.select("group", "a", "b").mapInArrow(thin, "`group` bigint, a bigint, b bigint")
    return each_key(forests, "group", work, "id bigint, component bigint")
