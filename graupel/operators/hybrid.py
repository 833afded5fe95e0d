"""Hybrid grouping: reciprocal semantic neighbours with a lexical veto, one connected component at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graupel.operators.blocks import each_key
from graupel.operators.edges import group_components, similarity_edges
from graupel.operators.lexical import COMPATIBLE, CONTAINMENT, INCOMPATIBLE, UNKNOWN, pair_evidence, pair_relation
from graupel.session import cut

FLOOR, RESCUE, NEIGHBOURS, LEAST = 0.55, 0.50, 3, 2
_SCHEMA = "`group` bigint, id bigint, cluster bigint, representative bigint, reason string"


def _within(short: tuple, long: tuple) -> bool:
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


class _Grouping:
    """One component: rows ordered by id, what is known of each pair of them, and the rows that are in conflict with another."""

    def __init__(self, nodes: list[tuple], edges: Iterable[tuple], floor: float, rescue: float, containment: float, least: int, vetoed: Iterable[int] = ()) -> None:
        """nodes: (id, tokens); edges: (a, b, score, relation, compatible, conflict, containment), where pairs in conflict may be
        left out if their rows are in vetoed."""
        self.tokens = {i: tuple(t) for i, t in nodes}
        self.ids = sorted(self.tokens)
        self.floor, self.rescue, self.containment, self.least = floor, rescue, containment, least
        self.around: dict[int, dict[int, tuple]] = {i: {} for i in self.ids}
        for a, b, *fact in edges:
            self.around[a][b] = self.around[b][a] = tuple(fact)
        self.groups: dict[int, list[int]] = {}  # members by representative
        self.free = set(self.ids)
        self.ambiguous: set[int] = set()
        self.vetoed = set(vetoed)

    def neighbours(self, floor: float) -> dict[int, list[int]]:
        out = {}
        for i in self.ids:
            fit = [(-f[0], j) for j, f in self.around[i].items() if f[0] >= floor and f[1] != INCOMPATIBLE]
            out[i] = [j for _, j in sorted(fit)[:NEIGHBOURS]]
        return out

    def coherent(self, i: int, representative: int, members: list[int], floor: float, near: dict[int, list[int]]) -> bool:
        fact = self.around[i].get(representative)
        if fact is None or fact[0] < floor or fact[1] == INCOMPATIBLE or fact[3]:
            return False
        if fact[2]:
            return True
        mine = self.tokens[i]
        for m in members:
            short, long = sorted((mine, self.tokens[m]), key=len)
            if len(short) >= 3 and _within(short, long):
                return True
        mutual = representative in near[i] and i in near[representative]
        return fact[1] == COMPATIBLE and mutual and fact[4] >= self.containment

    def pass_over(self, floor: float) -> None:
        near = self.neighbours(floor)
        pairs = [
            (-self.around[i][j][0], i, j) for i in self.ids for j in near[i] if i < j and i in near[j] and self.around[i][j][1] == COMPATIBLE
        ]
        for _, i, j in sorted(pairs):
            if i in self.free and j in self.free:
                self.groups[i] = [i, j]  # both have the same mean to the other: the smaller id represents
                self.free -= {i, j}
        for i in sorted(self.free - self.ambiguous):
            # only groups whose representative is a neighbour can take the row
            fits = [self.groups[r] for r in self.around[i] if r in self.groups and self.coherent(i, r, self.groups[r], floor, near)]
            if len(fits) == 1:
                fits[0].append(i)
                self.free.discard(i)
            elif fits:
                self.ambiguous.add(i)

    def reason(self, i: int) -> str:
        if i in self.ambiguous:
            return "ambiguous_multiple_groups"
        facts = [f for f in self.around[i].values() if f[0] >= self.rescue]
        if not facts:
            return "lexical_conflict" if i in self.vetoed else "below_semantic_floor"
        return "lexical_conflict" if all(f[1] == INCOMPATIBLE for f in facts) else "no_compatible_group"

    def run(self) -> list[tuple]:
        self.pass_over(self.floor)
        self.pass_over(self.rescue)
        out = []
        for representative, members in self.groups.items():
            if len(members) >= self.least:
                out += [(m, min(members), representative, None) for m in members]
            else:
                self.free |= set(members)
        return out + [(i, None, None, self.reason(i)) for i in self.free]


def group_texts(points: DataFrame, floor: float = FLOOR, rescue: float = RESCUE, containment: float = CONTAINMENT, least: int = LEAST) -> DataFrame:
    """(group, id, cluster, representative, reason): every point either in a cluster, named by its smallest id, or with the reason
    why it is in none. points: group BIGINT, id BIGINT (unique), vector ARRAY, tokens ARRAY<STRING>, and optionally keys
    ARRAY<STRING> of evidence memberships.

    Neighbours and groups only use pairs at or above the lower floor that are not in conflict, so components of that graph are
    grouped independently; of the pairs in conflict only the rows are kept, for the reason. The fold in a component is
    sequential; its size is bounded by the largest component.
    """
    cutoff = min(floor, rescue)
    rows = points if "keys" in points.columns else points.withColumn("keys", F.array().cast("array<string>"))
    rows = cut(rows.select("group", "id", "vector", "tokens", "keys"))  # read five times below
    edges = similarity_edges(rows, cutoff)
    a, b = (rows.select(F.col("id").alias(s), F.col("tokens").alias(f"tokens_{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab")
    judged = pair_evidence(edges.join(a, "a").join(b, "b"), least=containment)
    judged = judged.withColumn("relation", pair_relation(floor, shared_evidence=F.arrays_overlap("keys_a", "keys_b")))
    facts = cut(judged.select("group", "a", "b", "score", (F.col("relation") == COMPATIBLE).alias("related"), "lexically_compatible", "conflict", "containment"))
    fit = facts.where("NOT conflict")
    labels = cut(group_components(fit))
    vetoed = facts.where(F.col("conflict") & (F.col("score") >= rescue)).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    judged_rows = rows.select("group", "id", "tokens").join(vetoed.withColumn("vetoed", F.lit(True)), "id", "left").join(labels, "id", "left")
    judged_rows = cut(judged_rows.withColumn("vetoed", F.coalesce("vetoed", F.lit(False))))
    fields = {"a": "bigint", "b": "bigint", "score": "double", "related": "boolean", "lexically_compatible": "boolean", "containment": "double"}
    nodes = judged_rows.where("component IS NOT NULL").select("component", "group", "id", "tokens", "vetoed", *[F.lit(None).cast(t).alias(f) for f, t in fields.items()])
    none = {"id": "bigint", "tokens": "array<string>", "vetoed": "boolean"}
    links = fit.join(labels.select(F.col("id").alias("a"), "component"), "a").select("component", "group", *[F.lit(None).cast(t).alias(f) for f, t in none.items()], *fields)

    def pairs(table: pa.Table) -> Iterator[tuple]:
        for batch in table.to_batches():
            for x, y, score, related, fits, part in zip(*(batch.column(f).to_pylist() for f in fields)):
                yield x, y, score, COMPATIBLE if related else UNKNOWN, fits, False, part

    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = table.filter(pc.is_valid(table["id"]))
        ids = own["id"].to_pylist()
        against = [i for i, v in zip(ids, own["vetoed"].to_pylist()) if v]
        found = _Grouping(list(zip(ids, own["tokens"].to_pylist())), pairs(table.filter(pc.is_valid(table["a"]))), floor, rescue, containment, least, against).run()
        group = pa.array([table["group"][0].as_py()] * len(found), pa.int64())
        rest = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([group, *rest], names=["group", "id", "cluster", "representative", "reason"])

    grouped = each_key(nodes.unionByName(links), "component", kernel, _SCHEMA)
    alone = judged_rows.where("component IS NULL").select(
        "group", "id", F.lit(None).cast("bigint").alias("cluster"), F.lit(None).cast("bigint").alias("representative"),
        F.when(F.col("vetoed"), "lexical_conflict").otherwise("below_semantic_floor").alias("reason"),
    )
    return grouped.unionByName(alone)
