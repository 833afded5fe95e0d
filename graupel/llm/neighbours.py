"""Most similar vectors for every vector: vantage-point trees per shard, pruned by the triangle inequality with
a relaxed reach."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.llm import vptree
from graupel.llm.shards import each_shard, routing, sharded, usable
from graupel.operators.blocks import matrix
from graupel.session import cut

TOP = 5
MIN_SIMILARITY = 0.80
#: Divides the reach of a query, and the trees of a forest of shards; 1 restores exact search. See the README for recall by factor.
RELAX = 3.0
LEAF_ROWS = 768
_CHUNK = 512


def _group() -> Column:
    """Namespace, model and length of the vector: vectors of different length do not compare."""
    named = [F.coalesce(F.concat(F.lit(s), F.col(c)), F.lit("")) for s, c in (("n", "namespace"), ("m", "model_key"))]
    return F.xxhash64(named[0], F.lit("|"), named[1], F.size("embedding"))


def live_rows(vectors: DataFrame) -> DataFrame:
    """(group, id, vector): of each (namespace, entity_ref, model_key) the usable row with the latest updated_at, null
    times first; the smaller id at equal times. The table is read once."""
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), F.col("dimensions")))
    newest = F.max_by(F.struct(_group().alias("group"), "id", F.col("embedding").alias("vector")), F.struct("updated_at", (-F.col("id")).alias("i"))).alias("r")
    return rows.groupBy("namespace", "entity_ref", "model_key").agg(newest).select("r.*")


def _best(left: np.ndarray, right: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> tuple:
    """The `top` best of each left row: higher score first, then smaller id."""
    order = np.lexsort((ids[right], -score, left))
    left, right, score = left[order], right[order], score[order]
    first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.empty(0, np.int64)
    rank = np.arange(len(left)) - np.repeat(first, np.diff(np.r_[first, len(left)]))
    keep = rank < top
    return left[keep], right[keep], score[keep]


def shard_neighbours(ids: np.ndarray, unit: np.ndarray, at_home: np.ndarray, top: int, least: float, reach: float, leaf_rows: int = LEAF_ROWS, meet: bool = True):
    """(left, right, score) of the best partners within the shard, by index. Scores are doubles rounded to 6 places."""
    single = unit.astype(np.float32)
    found: list[tuple] = []

    def exact(i: np.ndarray, j: np.ndarray, block: tuple | None) -> np.ndarray:
        if block is not None:
            dense = unit[block[0]] @ unit[block[1]].T
            s = dense[block[2], block[3]]
        else:
            s = np.einsum("ij,ij->i", unit[i], unit[j])
        return np.round(s, 6)

    def visit(home: np.ndarray, copies: np.ndarray, meet: bool) -> None:
        columns = single[home].T
        everyone = np.concatenate([home, copies]) if meet else copies
        others = len(home) if meet else 0
        for start in range(0, len(everyone), _CHUNK):
            rows = everyone[start : start + _CHUNK]
            r, c = np.nonzero(single[rows] @ columns >= least - 1e-5)
            i, j = rows[r], home[c]
            other = i != j
            r, c, i, j = r[other], c[other], i[other], j[other]
            if not len(i):
                continue
            score = exact(i, j, (rows, home, r, c) if len(i) > 40_000 else None)
            ok = score >= least
            i, j, score, r = i[ok], j[ok], score[ok], r[ok]
            found.append(_best(i, j, score, ids, top))
            back = start + r >= others  # a copy: its partner at home learns of it too
            if back.any():
                found.append(_best(j[back], i[back], score[back], ids, top))

    vptree.self_join(single, at_home, reach, leaf_rows, visit, meet)
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0)
    return _best(*(np.concatenate(x) for x in zip(*found)), ids, top)


def class_neighbours(points: DataFrame, top: int, least: float, relax: float, shard_rows: int | None) -> DataFrame:
    """points (group, id, vector), ids unique: (id, other, similarity), each with its `top` best."""
    reach = math.acos(min(1.0, least)) + 1e-6
    salted = points.select("group", F.xxhash64("id").alias("salt"), "id", "vector")
    plan = routing(salted, reach, relax, shard_rows)
    shards = sharded(salted, plan)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, home = table["id"].to_numpy(), table["home"].to_numpy()
        meet = bool(table["meet"].to_numpy()[home].any())
        unit = vptree.unit(matrix(table["vector"].combine_chunks()))
        left, right, score = shard_neighbours(ids, unit, home, top, least, reach / relax, meet=meet)
        yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right]), pa.array(score)], names=["id", "other", "similarity"])

    pairs = each_shard(shards, work, "id bigint, other bigint, similarity double")
    if not plan.trees:
        return pairs
    # one pair may be found in several shards
    per_id = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return pairs.distinct().withColumn("rank", F.row_number().over(per_id)).where(F.col("rank") <= top).drop("rank")


def nearest_neighbours(
    vectors: DataFrame, top: int = TOP, least: float = MIN_SIMILARITY, relax: float = RELAX, shard_rows: int | None = None
) -> DataFrame:
    """(id, other_id, similarity): for every live row its `top` most similar live rows of the same namespace and
    model, cosine rounded to 6 places and at least `least`, ties to the smaller id.

    Unusable rows (null, wrong length, not finite, all zero) are ignored before the live row is chosen. Null namespace,
    model or entity count as values. Equal vectors form a class of which one is searched; its members share
    the result, so any number of copies costs one search and no pairs among them are built. A row without partners is in
    no output row. `shard_rows` None: by the number of rows, see shards.shard_size.
    """
    live = cut(live_rows(vectors).withColumn("h1", F.xxhash64(F.lit(1), "vector")).withColumn("h2", F.xxhash64(F.lit(2), F.reverse("vector"))))
    keys = ["group", "h1", "h2"]
    in_class = W.partitionBy(*keys).orderBy("id")
    # at most top + 1 members a class matter to others: limited before the shuffle (WindowGroupLimit)
    firsts = live.select(*keys, "id").withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= top + 1)
    classes = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    classes = cut(classes)
    several = cut(classes.where(F.size("ids") > 1))
    # Vectors stay where they are: the rows of a class but its first leave by the class's narrow key, which few rows have.
    later = several.select(*keys, F.col("id").alias("first"))
    points = live.join(later, keys, "left").where(F.col("first").isNull() | (F.col("first") == F.col("id")))
    found = class_neighbours(points.select("group", "id", "vector"), top, least, relax, shard_rows)

    members = several.select(F.col("id").alias("other"), "ids")
    reached = found.join(members, "other", "left").select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other_id"), "similarity")
    own = several.select("id", F.explode("ids").alias("other_id"), F.lit(1.0).alias("similarity"))
    per_class = W.partitionBy("id").orderBy(F.desc("similarity"), "other_id")
    best = (
        reached.unionByName(own)
        .withColumn("n", F.row_number().over(per_class))
        .where(F.col("n") <= top + 1)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "other_id", "similarity"))).alias("best"))
    )
    by_class = classes.join(best, "id").select(*keys, "best")
    rows = live.select(*keys, "id").join(by_class, keys).select("id", F.slice(F.filter("best", lambda b: b["other_id"] != F.col("id")), 1, top).alias("best"))
    return rows.select("id", F.explode("best").alias("b")).select("id", "b.other_id", "b.similarity")


def neighbour_pairs(vectors: DataFrame, **parameters) -> DataFrame:
    """(id_a, id_b): pairs where one is among the most similar of the other, id_a < id_b."""
    found = nearest_neighbours(vectors, **parameters)
    return found.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()
