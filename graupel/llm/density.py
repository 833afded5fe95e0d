"""Grouping records into similarity clusters by density peaks.

Density is the number of neighbours within the cutoff; every record points to its nearest denser
neighbour; records without one within the cutoff are peaks, whatever their distance to denser records beyond it. Neighbour
joins run in bounded blocks (shards of vantage-point trees with exact reach), count and compare inside the block and never
emit pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graupel.llm import vptree
from graupel.llm.shards import Routing, each_shard, routing, sharded, usable
from graupel.operators.blocks import matrix
from graupel.operators.skew import join_unique
from graupel.session import cut

DIMENSIONS = 80
CUTOFF = 0.74
_LEAF = 2_048
_CHUNK = 1_024

def clean_points(points: DataFrame, dimensions: int) -> DataFrame:
    """(group, salt, ref, vector): usable points, each ref once (of its deliveries the earliest)."""
    kept = points.where(F.col("ref").isNotNull() & usable(F.col("vector"), F.lit(dimensions)))
    once = kept.groupBy("ref").agg(F.min(F.struct("created_at", "scope_ref", "vector")).alias("p"))
    return once.select(
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), "p.scope_ref"), F.lit("n"))).alias("group"), F.xxhash64("ref").alias("salt"),
        "ref", F.col("p.vector").alias("vector"),
    )


def _similar_blocks(table: pa.Table, unit: np.ndarray, cutoff: float, reach: float, visit) -> None:
    """visit(rows, columns, similar, scores) for blocks that hold each pair of the shard within the cutoff once: rows are at
    home or copies, columns at home. Among rows at home only pairs with the column behind the row are true."""
    single, home_flag = unit.astype(np.float32), table["home"].to_numpy()

    def leaf(home: np.ndarray, copies: np.ndarray, meet: bool) -> None:
        everyone = np.concatenate([home, copies]) if meet else copies
        for start in range(0, len(everyone), _CHUNK):
            rows = everyone[start : start + _CHUNK]
            scores = single[rows] @ single[home].T
            close = np.nonzero(np.abs(scores - cutoff) < 2e-5)  # single precision can't tell: in doubles
            similar = scores >= cutoff
            if len(close[0]):
                similar[close] = np.einsum("ij,ij->i", unit[rows[close[0]]], unit[home[close[1]]]) >= cutoff
            if meet and start < len(home):
                inside = np.arange(start, start + len(rows))[:, None] >= np.arange(len(home))[None, :]
                inside[len(home) - start :] = False  # copies meet all
                similar &= ~inside
            if similar.any():
                visit(rows, home, similar, scores)

    vptree.self_join(single, home_flag, reach, _LEAF, leaf, bool(table["meet"].to_numpy()[home_flag].any()))


def densities(points: DataFrame, cutoff: float, plan: Routing) -> DataFrame:
    """(ref, density): the number of other points of the group within the cutoff, where there is one."""
    reach = math.acos(cutoff) + 1e-6

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = vptree.unit(matrix(table["vector"].combine_chunks()))
        count = np.zeros(len(unit), np.int64)

        def visit(rows, columns, similar, scores) -> None:
            count[rows] += similar.sum(axis=1)
            count[columns] += similar.sum(axis=0)

        _similar_blocks(table, unit, cutoff, reach, visit)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([table["ref"].combine_chunks().take(pa.array(some)), pa.array(count[some])], names=["ref", "density"])

    parts = each_shard(sharded(points, plan), work, "ref string, density bigint")
    return parts.groupBy("ref").agg(F.sum("density").alias("density"))


def denser_neighbours(points: DataFrame, cutoff: float, plan: Routing) -> DataFrame:
    """points with density -> (ref, denser): the nearest point within the cutoff that is denser (at equal density: of
    smaller ref). Peaks have none and are in no row."""
    reach = math.acos(cutoff) + 1e-6

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = vptree.unit(matrix(table["vector"].combine_chunks()))
        refs = np.array([r.encode() for r in table["ref"].to_pylist()], dtype=object)
        density = table["density"].to_numpy()
        rank = np.empty(len(unit), np.int64)  # 0: the densest, at equal density the smallest ref
        rank[np.lexsort((refs, -density))] = np.arange(len(unit))
        best = np.full(len(unit), -2.0)
        denser = np.full(len(unit), -1, np.int64)

        def take(low: np.ndarray, high: np.ndarray, similar: np.ndarray, scores: np.ndarray) -> None:
            """For each of `low` (rows of the matrix) the most similar of `high` that is denser."""
            s = np.where(similar & (rank[high][None, :] < rank[low][:, None]), scores, -2.0)
            top = s.argmax(axis=1)
            value = s[np.arange(len(low)), top]
            better = value > best[low]
            best[low[better]], denser[low[better]] = value[better], high[top[better]]

        def visit(rows, columns, similar, scores) -> None:
            take(rows, columns, similar, scores)
            take(columns, rows, similar.T, scores.T)

        _similar_blocks(table, unit, cutoff, reach, visit)
        some = np.flatnonzero(denser >= 0)
        names = table["ref"].combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(some)), names.take(pa.array(denser[some])), pa.array(best[some].astype(np.float64))],
            names=["ref", "denser", "similarity"],
        )

    parts = each_shard(sharded(points, plan), work, "ref string, denser string, similarity double")
    nearest = F.max(F.struct("similarity", F.col("denser"))).alias("n")
    return parts.groupBy("ref").agg(nearest).select("ref", "n.denser")


def follow(pointers: DataFrame) -> DataFrame:
    """(ref, peak) from (ref, parent), peaks being their own parents: pointer doubling, one join for each doubling of the
    longest chain. Each round is kept in the shared folder. The peak of a large cluster is a hot key, and is looked up by broadcast."""
    current = cut(pointers.select("ref", F.col("parent").alias("peak")))
    while True:
        up = current.select(F.col("ref").alias("peak"), F.col("peak").alias("next"))
        step = cut(join_unique(current, up, "peak").select("ref", F.col("next").alias("peak"), (F.col("next") != F.col("peak")).alias("moved")))
        current = step.select("ref", "peak")
        if step.where("moved").isEmpty():
            return current


def clusters(points: DataFrame, dimensions: int = DIMENSIONS, cutoff: float = CUTOFF, block_rows: int | None = None) -> DataFrame:
    """(first_ref, member_ref, representative_ref, members, score): one row per member of every cluster of at least two.

    `first_ref` is the smallest ref, `representative_ref` the member with the highest mean cosine to the other members
    (rounded to 6 places, ties to the smaller ref), `members` the size, `score` the member's own mean cosine. Points that
    are not usable (null, another length, not finite, all zero) and null refs are left out; repeated refs count once;
    a null scope is a scope. Points without neighbour are in no cluster. `block_rows` None: by the number of rows.
    """
    clean = cut(clean_points(points, dimensions))
    plan = routing(clean, math.acos(cutoff) + 1e-6, shard_rows=block_rows)
    dense = cut(densities(clean, cutoff, plan))
    grouped = cut(clean.join(dense, "ref"))
    parents = denser_neighbours(grouped, cutoff, plan)
    pointers = dense.select("ref").join(parents, "ref", "left").select("ref", F.coalesce("denser", "ref").alias("parent"))
    labels = follow(pointers)

    members = grouped.join(labels, "ref").select("ref", "peak", "vector")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # the norm is bound once per row; named in the inner lambda directly it would be summed again for every element
    unit = members.select("ref", "peak", F.transform(F.array(norm), lambda n: F.transform("vector", lambda x: x / n))[0].alias("u"))
    unit = cut(unit)
    # The mean cosine to all others follows from the sum of the group's unit vectors: no pairs.
    sums = unit.groupBy("peak").agg(
        F.count(F.lit(1)).alias("n"), F.min("ref").alias("first_ref"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dimensions)]
    ).select("peak", "n", "first_ref", F.array(*[F.col(f"s{i}") for i in range(dimensions)]).alias("total"))
    scored = join_unique(unit, cut(sums), "peak").select(
        "ref", "peak", "first_ref", F.col("n").alias("members"),
        F.round((F.aggregate(F.zip_with("u", "total", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
                 - F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)) / (F.col("n") - 1), 6).alias("score"),
    )
    scored = cut(scored)
    typical = scored.groupBy("peak").agg(F.min(F.struct((-F.col("score")).alias("s"), "ref")).alias("r")).select("peak", F.col("r.ref").alias("representative_ref"))
    named = join_unique(scored, typical, "peak")
    return named.select("first_ref", F.col("ref").alias("member_ref"), "representative_ref", "members", "score")
