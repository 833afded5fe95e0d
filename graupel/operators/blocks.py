"""Blocks of vectors in Arrow batches: one task at a time holds one block or pair of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in a block of a group.
BLOCK_ROWS = 8_192


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in doubles; a zero row stays zero."""
    v = np.asarray(vectors, dtype=np.float64)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length == 0, 1.0, length)


def each_key(rows: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Gathers the rows of every `key` (BIGINT) in one task, which applies `work` to one key's rows at a time."""
    gathered = rows.repartition(key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and keys[a] != current:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                current = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return gathered.mapInArrow(run, schema)


def block_pairs(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """points (group BIGINT, id, vector) with pair BIGINT, side INT: each group is cut by the hash of the id into blocks of
    about block_rows rows, and a row goes to each pair its block belongs to. A group of b blocks gives b(b+1)/2 tasks, so a
    group with a third of all rows is spread like any other. Groups larger than one block, of which there are at most rows /
    block_rows, are looked up by broadcast."""
    sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    blocks = sizes.select("group", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = points.join(F.broadcast(blocks), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return other.select(
        F.xxhash64("group", low, high).alias("pair"), (F.col("block") > F.col("other")).cast("int").alias("side"),
        (F.col("block") == F.col("other")).alias("same"), "group", "id", "vector",
    )
