"""Deterministic clustering: average linkage and greedy medoids, exact per connected component of the similarity graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graupel.functions.vectors import cohesion, confidence
from graupel.operators.blocks import each_key, matrix, unit
from graupel.operators.edges import components, group_components, similarity_edges
from graupel.session import cut

ALGORITHMS = ("average_linkage", "greedy_medoid_v1", "greedy_medoid_v2")
_SCHEMA = "`group` bigint, id bigint, cluster bigint, representative bigint, score double"


def medoid(members: np.ndarray, similarity: np.ndarray) -> int:
    """The member with the highest mean similarity to all members, itself among them; the first at ties."""
    means = similarity[np.ix_(members, members)].mean(axis=1)
    return int(members[int(np.argmax(np.round(means, 12)))])


def average_linkage(similarity: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The clusters of mean pairwise distance (average linkage) cut at 1 - threshold. A chain of nearest neighbours finds the merges
    in time of the square of the rows; average linkage is reducible, so they are those of merging the two closest each time."""
    n = len(similarity)
    distance = 1.0 - similarity
    np.fill_diagonal(distance, np.inf)
    size = np.ones(n)
    merges: list[tuple[float, int, int]] = []
    alive = np.ones(n, bool)
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            row = distance[chain[-1]]
            nearest = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[nearest]:
                nearest = chain[-2]  # at equal distance back, so that the chain ends
            if len(chain) > 1 and nearest == chain[-2]:
                break
            chain.append(nearest)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((distance[i, j], i, j))
        joined = (size[i] * distance[i] + size[j] * distance[j]) / (size[i] + size[j])
        distance[i], distance[:, i] = joined, joined
        distance[i, i] = np.inf
        distance[j], distance[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    # each merge is of the clusters that then hold rows i and j; heights grow from the leaves up
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for height, i, j in merges:
        if height <= 1.0 - threshold + 1e-12:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    members: dict[int, list[int]] = {}
    for x in range(n):
        members.setdefault(top(x), []).append(x)
    return [np.array(m) for m in members.values()]


#: Links whose similarity is computed at a time.
_LINKS = 1 << 18


def _similar(sums: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean cosine between clusters a and b: that of their sums of unit vectors, by their sizes."""
    out = np.empty(len(a))
    for k in range(0, len(a), _LINKS):
        i, j = a[k : k + _LINKS], b[k : k + _LINKS]
        out[k : k + _LINKS] = np.einsum("ij,ij->i", sums[i], sums[j]) / (size[i] * size[j])
    return out


def linked_clusters(u: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """average_linkage() of unit vectors without their matrix: of every row the first row of its cluster. A row counts `weight`
    times; a < b are all pairs of rows at or above the threshold.

    A mean reaches the threshold only if a pair does, so only linked clusters can merge, and the link of a union comes from a
    link of its parts. Clusters nearest to each other merge, all such pairs in one round: average linkage is reducible. At equal
    similarity the smaller rows come first. Memory grows with the links."""
    n, low = len(u), threshold - 1e-12
    sums, size, label = u * weight[:, None], weight.astype(np.float64), np.arange(n)
    score = _similar(sums, size, a, b)
    fits = score >= low
    a, b, score = a[fits], b[fits], score[fits]
    while len(a):
        most = np.full(n, -np.inf)
        np.maximum.at(most, a, score)
        np.maximum.at(most, b, score)
        both = np.flatnonzero((score == most[a]) & (score == most[b]))
        both = both[np.lexsort((b[both], a[both]))]
        place, first = np.arange(len(both)), np.full(n, len(both))
        np.minimum.at(first, a[both], place)
        np.minimum.at(first, b[both], place)
        both = both[(first[a[both]] == place) & (first[b[both]] == place)]
        i, j, to = a[both], b[both], np.arange(n)
        sums[i] += sums[j]
        size[i] += size[j]
        to[j] = i
        label = to[label]
        changed = np.zeros(n, bool)
        changed[i] = changed[j] = True
        again = changed[a] | changed[b]
        x, y = to[a[again]], to[b[again]]
        key = np.unique(np.minimum(x, y)[x != y] * n + np.maximum(x, y)[x != y])
        x, y = key // n, key % n
        renewed = _similar(sums, size, x, y)
        fits = renewed >= low
        a, b, score = (np.concatenate((old[~again], new[fits])) for old, new in ((a, x), (b, y), (score, renewed)))
    return label


def greedy_medoids(similarity: np.ndarray, density: float, member: float, pool_only: bool) -> list[np.ndarray]:
    """Takes the row with most free neighbours at `density` (first at ties) as seed, and with it the free rows at `member`
    from it; with pool_only these must also reach `density`."""
    free = np.ones(len(similarity), bool)
    near = similarity >= density
    np.fill_diagonal(near, False)
    bar = max(density, member) if pool_only else member
    out = []
    while free.any():
        counts = np.where(free, (near & free[None, :]).sum(axis=1), -1)
        seed = int(np.argmax(counts))
        taken = free & (similarity[seed] >= bar)
        taken[seed] = True
        out.append(np.flatnonzero(taken))
        free &= ~taken
    return out


#: Rows of a component that one task clusters by greedy medoids: its matrix of similarities takes 8 bytes a pair, 800 MB.
MOST_ROWS = 10_000


def _too_many(rows: int, algorithm: str, most: int) -> ValueError:
    return ValueError(f"a component of {rows} rows; {algorithm} takes at most {most}: raise the threshold, or use density peaks")


def _linkage_kernel(threshold: float, least: int, most: int | None) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        links = table.filter(pc.is_valid(table["a"]))
        table = table.filter(pc.is_valid(table["id"]))
        table = table.take(pa.array(np.argsort(table["id"].to_numpy(), kind="stable")))
        ids, weight = table["id"].to_numpy(), table["copies"].to_numpy()
        if most is not None and weight.sum() > most:
            raise _too_many(int(weight.sum()), "average_linkage", most)
        u = unit(matrix(table["vector"].combine_chunks()))
        a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in "ab")
        label = linked_clusters(u, weight, a[a < b], b[a < b], threshold)
        size = np.bincount(label, weight, len(ids))
        sums = np.zeros_like(u)
        np.add.at(sums, label, u * weight[:, None])
        mean = np.round(np.einsum("ij,ij->i", u, sums[label]) / size[label], 12)
        medoid = np.zeros(len(ids), np.int64)
        order = np.lexsort((-np.arange(len(ids)), mean))
        medoid[label[order]] = order  # the last holds: the highest mean, and the first row at ties
        kept = np.flatnonzero(size[label] >= least)
        top = medoid[label[kept]]
        columns = (np.full(len(kept), table["group"][0].as_py()), ids[kept], ids[label[kept]], ids[top], np.einsum("ij,ij->i", u[kept], u[top]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "id", "cluster", "representative", "score"])

    return run


def _average_linkage(rows: DataFrame, threshold: float, least: int, most: int | None) -> DataFrame:
    """Equal vectors merge before all others, so they are one row with a number of copies; a link of that row with itself keeps
    it where it has no other. Zero vectors are not similar to their copies."""
    zero = F.when(~F.exists("vector", lambda x: x != 0), F.col("id"))
    alike = rows.groupBy("group", "vector", zero.alias("zero")).agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"))
    alike = cut(alike.select("group", "id", "vector", F.size("ids").cast("bigint").alias("copies"), "ids"))
    own = alike.where("copies > 1").select("group", F.col("id").alias("a"), F.col("id").alias("b"))
    links = cut(similarity_edges(alike, threshold - 1e-9).select("group", "a", "b").unionByName(own))
    labels = cut(group_components(links))
    nodes = alike.join(labels, "id").select("component", "group", "id", "vector", "copies", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))
    none = {"group": "bigint", "id": "bigint", "vector": "array<double>", "copies": "bigint"}
    pairs = links.where("a != b").join(labels.select(F.col("id").alias("a"), "component"), "a").select("component", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "a", "b")
    found = each_key(nodes.unionByName(pairs), "component", _linkage_kernel(threshold, least, most), _SCHEMA)
    return found.join(alike.select("id", "ids"), "id").select("group", F.explode("ids").alias("id"), "cluster", "representative", "score")


def _kernel(algorithm: str, threshold: float, member: float, least: int, most: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows > most:
            raise _too_many(table.num_rows, algorithm, most)
        table = table.take(pa.array(np.argsort(table["id"].to_numpy(), kind="stable")))
        ids = table["id"].to_numpy()
        u = unit(matrix(table["vector"].combine_chunks()))
        similarity = u @ u.T
        for cluster in greedy_medoids(similarity, threshold, member, algorithm == "greedy_medoid_v1"):
            if len(cluster) >= least:
                m, n = medoid(cluster, similarity), len(cluster)
                columns = (np.full(n, table["group"][0].as_py()), ids[cluster], np.full(n, ids[cluster].min()), np.full(n, ids[m]), similarity[cluster, m])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "id", "cluster", "representative", "score"])

    return run


def cluster_points(points: DataFrame, algorithm: str = "average_linkage", threshold: float = 0.74, member: float = 0.77, least: int = 2, most: int | None = None) -> DataFrame:
    """(group, id, cluster, representative, score): members of every cluster of at least `least`; `cluster` is the smallest id,
    `score` the cosine to the representative.

    Two rows below the threshold of the graph are never joined directly, so each component is clustered alone and the result
    is that of the whole. The rule inside a component is sequential by nature. For average linkage its memory grows with the
    component's links; for greedy medoids with the square of its rows, of which there are at most MOST_ROWS. A component of more
    than `most` rows is an error that says so. points: group BIGINT, id BIGINT (unique), vector ARRAY. Null vectors are left out.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    rows = points.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("group", "id", F.col("vector").cast("array<double>").alias("vector"))
    if algorithm == "average_linkage":
        return _average_linkage(rows, threshold, least, most)
    labels = components(similarity_edges(rows, min(threshold, member) - 1e-9))
    kernel = _kernel(algorithm, threshold, member, least, MOST_ROWS if most is None else most)
    return each_key(rows.join(labels, "id").select("component", "group", "id", "vector"), "component", kernel, _SCHEMA)


def assigned(members: DataFrame, floor: float = 0.70, least: int = 2, low: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(members kept, groups): members below `floor` of their representative leave, groups below `least` after that too.

    Groups: cluster, representative, size, mean and least score, cohesion, and the number of members of low confidence, which
    also counts members of groups that were dropped for size."""
    is_rep = F.col("id") == F.col("representative")
    scored = members.withColumn("score", F.when(is_rep, F.lit(1.0)).otherwise(F.col("score"))).withColumn("is_rep", is_rep)
    kept = scored.where(F.col("is_rep") | (F.col("score") >= floor))
    groups = kept.groupBy("group", "cluster", "representative").agg(
        F.count(F.lit(1)).alias("size"), F.avg("score").alias("m"), F.min("score").alias("s"),
        F.count_if(~F.col("is_rep") & (confidence("score", floor) < low)).alias("low_confidence"),
    )
    groups = groups.where(F.col("size") >= least).select(
        "group", "cluster", "representative", "size", F.round("m", 6).alias("mean_score"), F.round("s", 6).alias("min_score"),
        F.round(cohesion("m", "s"), 6).alias("cohesion"), "low_confidence",
    )
    return kept.join(groups.select("group", "cluster"), ["group", "cluster"], "left_semi"), groups


def size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
