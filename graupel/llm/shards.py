"""Shards of vectors. Groups are cut by vantage-point routing trees, and what one task holds is bounded: a shard's rows
at home by PART_ROWS, the rows that visit it at a time by VISIT_ROWS, whatever the data.

Two ways of cutting a group: exactly, by one tree, where a row also visits every shard that may hold a partner within
reach; or by a forest of trees, where a row goes to one shard of each tree, so that its copies are the number of trees. A
relaxed search takes the forest where that makes fewer copies than visiting half of all shards, which is the most the tree can need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.llm import vptree
from graupel.operators.blocks import each_key, matrix
from graupel.session import cut

#: A shard's share of all rows is that of a quarter of a core's, within these bounds.
LEAST_SHARD, MOST_SHARD = 32, 16_384
#: A shard with more rows at home is cut into parts by the hash of the row, and every row of the shard visits all of them.
PART_ROWS = 24_576
#: Visitors of a part that meet it in one task; more come in further chunks, each with the part.
VISIT_ROWS = 65_536
#: Rows sampled for each leaf of a routing tree, and for all trees together.
SAMPLE_A_LEAF = 24
SAMPLE_ROWS = 400_000
_SLICE = 16_384


def usable(vector: Column, dimensions: Column) -> Column:
    """Exactly `dimensions` numbers, all finite and not all zero; false for null."""
    x = vector
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return F.coalesce((F.size(x) == dimensions) & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def shard_size(rows: int, spark: SparkSession) -> int:
    return max(LEAST_SHARD, min(MOST_SHARD, math.ceil(rows / (4 * spark.sparkContext.defaultParallelism))))


def forest_size(leaves: int, relax: float) -> int:
    """Trees of a forest: more for more leaves, in proportion to their logarithm, and fewer the more the search is relaxed."""
    return max(2, round((4 + math.log2(max(2, leaves))) * 3 / relax))


@dataclass
class Routing:
    """Trees by group, and the parts and chunks of the shards that need more than one. A single tree is exact within `reach`,
    several are a forest."""

    trees: dict[int, list[vptree.Node]]
    reach: float
    parts: dict[int, int] = field(default_factory=dict)
    chunks: dict[int, int] = field(default_factory=dict)

    def shards(self, group: int, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows at home, visitors) for rows of one group."""
        trees = self.trees[group]
        for number, tree in enumerate(trees):
            for leaf, home, copies in vptree.route(tree, unit, self.reach if len(trees) == 1 else None):
                yield _mixed(group, number, leaf), home, copies

    def tasks(self, group: int, unit: np.ndarray, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool, bool]]:
        """(task, rows, at home, whether rows at home meet each other there)."""
        for shard, home, copies in self.shards(group, unit):
            parts, chunks = self.parts.get(shard, 1), self.chunks.get(shard, 1)
            part = salt[home] % parts
            for j in range(parts):
                own = home[part == j]
                visitors = np.concatenate([copies, home[part > j]]) if parts > 1 else copies
                chunk = salt[visitors] // parts % chunks
                for k in range(chunks):
                    task = _mixed(shard, j, k)
                    if len(own):
                        yield task, own, True, k == 0
                    if len(seen := visitors[chunk == k]):
                        yield task, seen, False, False


def _mixed(*parts: int) -> int:
    """64 bits from a few integers."""
    x = 0
    for p in parts:
        x = (x ^ (p + 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, places in the batch, unit vectors)."""
    groups = batch.column("group").to_numpy()
    order = np.argsort(groups, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        if len(places):
            yield int(groups[places[0]]), places, vptree.unit(matrix(batch.column("vector").take(pa.array(places)))).astype(np.float32)


def _large(rows: DataFrame, groups: list[int]) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in groups], "group bigint"))


def routing(rows: DataFrame, reach: float, relax: float = 1.0, shard_rows: int | None = None, part_rows: int = PART_ROWS, visit_rows: int = VISIT_ROWS) -> Routing:
    """How rows (group BIGINT, salt BIGINT, vector) are cut. Groups above `shard_rows` (there are at most rows / shard_rows)
    get trees, fitted on a sample of at most SAMPLE_ROWS rows in all that depends on the salts only; every row is routed.
    relax 1: one tree with exact reach; else that or a forest, whichever makes fewer copies. Where the sample is too small for so many leaves, shards are larger
    and cut into parts."""
    spark = rows.sparkSession
    counts = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    size = shard_rows or shard_size(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], spark)
    sizes = counts.where(F.col("n") > size).collect()
    out = Routing({}, reach)
    if not sizes:
        return out
    leaves = {r.group: math.ceil(r.n / size) for r in sizes}
    fit = min(1.0, SAMPLE_ROWS / (sum(leaves.values()) * SAMPLE_A_LEAF))
    shares = [(r.group, max(1, min(1_000_000, math.ceil(1e6 * fit * leaves[r.group] * SAMPLE_A_LEAF / r.n)))) for r in sizes]
    wanted = F.broadcast(spark.createDataFrame(shares, "group bigint, ppm int"))
    sample = rows.join(wanted, "group").where(F.pmod("salt", F.lit(1_000_000)) < F.col("ppm")).select("group", "salt", F.col("vector").cast("array<float>").alias("vector")).toArrow()
    salts = sample["salt"].to_numpy()
    for batch in sample.combine_chunks().to_batches():
        for group, places, unit in _by_group(batch):
            unit = unit[np.argsort(salts[places], kind="stable")]
            trees = forest_size(leaves[group], relax)
            if relax == 1 or trees >= (leaves[group] + 1) / 2:
                trees = 1
            out.trees[group] = [vptree.build(unit, leaves[group], t) for t in range(trees)]
    if not out.trees:
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, len(h), len(c)) for g, _, unit in _by_group(batch) for s, h, c in out.shards(g, unit)]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "home", "visits"), f)) for f in found], pa.schema([(c, pa.int64()) for c in ("shard", "home", "visits")]))

    large = rows.join(_large(rows, list(out.trees)), "group", "left_semi").select("group", "vector")
    loads = large.mapInArrow(count, "shard bigint, home bigint, visits bigint").groupBy("shard").agg(F.sum("home").alias("home"), F.sum("visits").alias("visits"))
    for r in loads.where((F.col("home") > part_rows) | (F.col("visits") > visit_rows)).collect():
        parts = math.ceil(r.home / part_rows)
        chunks = math.ceil((r.visits + (r.home if parts > 1 else 0)) / visit_rows)
        if parts > 1:
            out.parts[r.shard] = parts
        if chunks > 1:
            out.chunks[r.shard] = chunks
    return out


def sharded(rows: DataFrame, plan: Routing) -> DataFrame:
    """rows (group, salt, ..., vector) with shard BIGINT, home and meet BOOLEAN in place of group and salt: each row at home
    in one shard of each tree, and visiting others. Rows at home meet each other where `meet` is true. Groups without a tree
    are one shard and stay in the JVM."""
    names = [c for c in rows.columns if c not in ("group", "salt")]
    flags = [F.lit(True).alias("home"), F.lit(True).alias("meet")]
    if not plan.trees:
        return rows.select(F.col("group").alias("shard"), *flags, *names)
    known = _large(rows, list(plan.trees))
    small = rows.join(known, "group", "left_anti").select(F.col("group").alias("shard"), *flags, *names)
    large = rows.join(known, "group", "left_semi")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = batch.column("salt").to_numpy().view(np.uint64) >> np.uint64(1)
            moves = [
                (np.full(len(at), task), places[at], np.full(len(at), home), np.full(len(at), meet))
                for group, places, unit in _by_group(batch)
                for task, at, home, meet in plan.tasks(group, unit, salt[places].astype(np.int64))
            ]
            if not moves:
                continue
            shard, at, home, meet = (np.concatenate(m) for m in zip(*moves))
            for start in range(0, len(at), _SLICE):
                cols = [x[start : start + _SLICE] for x in (shard, home, meet)]
                picked = batch.select(names).take(pa.array(at[start : start + _SLICE]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *picked.columns], names=["shard", "home", "meet", *names])

    schema = "shard bigint, home boolean, meet boolean, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return small.unionByName(large.mapInArrow(send, schema))


def each_shard(shards: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Gathers every shard in one task and applies `work`; a task holds one shard at a time."""
    return each_key(shards, "shard", work, schema)
