"""Exact top-k search of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.operators.blocks import matrix, unit

#: Bytes of query vectors sent to the tasks at a time; more queries are searched in further blocks.
QUERY_BYTES = 64 << 20


def _query_blocks(queries: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and unit vectors, streamed and cut into blocks of bounded size."""
    ids: list[int] = []
    rows: list = []
    size = 0
    for q in queries.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).orderBy("id").toLocalIterator():
        ids.append(q.id)
        rows.append(q.vector)
        size += 8 * len(q.vector)
        if size >= limit:
            yield np.array(ids), unit(np.array(rows))
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), unit(np.array(rows))


def search(queries: DataFrame, rows: DataFrame, k: int, accept: float | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank[, accepted]): the k best rows of each query: cosine rounded to 6 places, then smaller id.

    Each task multiplies its rows with the queries and keeps k a query and batch, so at most k rows a query and batch are
    shuffled. queries and rows: id BIGINT, vector ARRAY of one length. Null ids and vectors are left out.
    """
    known = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    schema = "query_id bigint, id bigint, score double"
    found = rows.sparkSession.createDataFrame([], schema)
    for names, targets in _query_blocks(queries, query_bytes):

        def work(batches: Iterator[pa.RecordBatch], names=names, targets=targets) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                scores = np.round(targets @ unit(matrix(batch.column("vector")))[order].T, 6) + 0.0
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, best.shape[1])), pa.array(ids[order][best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())],
                    names=["query_id", "id", "score"],
                )

        found = found.unionByName(known.mapInArrow(work, schema))
    per_query = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(per_query).cast("bigint")).where(F.col("rank") <= k)
    return top if accept is None else top.withColumn("accepted", F.col("score") >= accept)
