"""Per-key results when a few keys own most rows.

Every aggregate here is algebraic and has a fixed-width state, so Spark plans HashAggregate on both
sides of each shuffle: a task folds its rows into a bounded hash table (which spills), and only one
compact state per key and task is shuffled. A key that owns a third of the rows costs its reducer one
row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graupel.session import cut

#: Characters removed around a scope: spaces, tabs, line breaks and no-break spaces.
BLANKS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000, 0xFEFF)
)

_RADIX = 1 << 33
_SHIFT = (1 << 31) + 1
_NEVER = -(1 << 62)


def strip_blanks(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.btrim(column, F.lit(BLANKS))


def _pack(at: Column, value: Column) -> Column:
    """(time, int) as one decimal that orders by time and then by value, nulls first: a state of fixed
    width, which keeps the aggregate on the hash path (a struct or a string would force a sort)."""
    micros = F.coalesce(F.unix_micros(at), F.lit(_NEVER)).cast("decimal(20,0)")
    code = F.coalesce(value.cast("bigint") + F.lit(_SHIFT), F.lit(0)).cast("decimal(11,0)")
    return micros * F.lit(_RADIX).cast("decimal(10,0)") + code


def _unpack(packed: Column) -> Column:
    code = F.pmod(packed, F.lit(_RADIX).cast("decimal(10,0)")).cast("bigint")
    return F.when(code > 0, code - F.lit(_SHIFT))


def latest_value_per_key(
    df: DataFrame, keys: list[str], value: str, at: str, out: str = "latest_value"
) -> DataFrame:
    """`value` (an int) of the row with the latest `at`, per key.

    A null `at` counts as earliest. At the same `at` the greater value holds, and any value before
    null. Keys may be null and then form a key of their own. An empty input gives no rows.
    """
    picked = df.select(*keys, F.col(at).alias("__at"), F.col(value).cast("int").alias("__value"))
    packed = picked.select(*keys, _pack(F.col("__at"), F.col("__value")).alias("__packed"))
    return packed.groupBy(*keys).agg(F.max("__packed").alias("__packed")).select(
        *keys, _unpack(F.col("__packed")).cast("int").alias(out)
    )


def scope_run_totals(runs: DataFrame) -> DataFrame:
    """(scope_ref, run_count, member_sum, member_max): for every scope, blanks around it removed, its
    distinct runs and the sum and maximum of `member_count` over their latest rows.

    Rows without run_id are no runs and are left out. A null scope is a scope of its own; a blank one
    is the empty string. Null counts add nothing; a scope with none but nulls has null sums. A run
    seen under two scopes counts in both. Other columns are not read.
    """
    rows = runs.where(F.col("run_id").isNotNull()).select(
        "run_id", strip_blanks("scope_ref").alias("scope_ref"), "observed_at", "member_count"
    )
    latest = latest_value_per_key(rows, ["run_id", "scope_ref"], "member_count", "observed_at", "members")
    return latest.groupBy("scope_ref").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.sum(F.col("members").cast("bigint")).alias("member_sum"),
        F.max("members").alias("member_max"),
    )


def heavy_scopes(runs: DataFrame, share: float = 0.02) -> DataFrame:
    """(scope_ref) of every scope that owns at least `share` of all distinct runs (null scope: none).

    The totals, one row a scope, are kept in the shared folder: the runs are read once, though the totals serve both as
    rows and, in a scalar subquery, as the sum they are compared with. `share` counts in parts per million, so 0.02 is exact.
    """
    totals = cut(scope_run_totals(runs))
    ppm = round(share * 1_000_000)
    every = totals.agg(F.sum("run_count").alias("n"))
    return totals.where(
        F.col("scope_ref").isNotNull() & (F.col("run_count") * 1_000_000 >= every.scalar() * F.lit(ppm))
    ).select("scope_ref")


def hot_keys(rows: DataFrame, key: str, least: int = 1000) -> DataFrame | None:
    """(key) of the keys with more than a quarter of a core's share of the rows, and more than `least`: at most four a core, so
    the table may be broadcast. None if there are none. Counts combine per task, so a hot key costs one row a task."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bar = F.greatest(F.lit(least), counts.agg(F.sum("n")).scalar() / (4 * rows.sparkSession.sparkContext.defaultParallelism))
    found = [(r[0],) for r in counts.where(F.col(key).isNotNull() & (F.col("n") > bar)).select(key).collect()]
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema) if found else None


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """rows joined (inner or left) with a table of which `key` is unique. Rows of hot keys stay where they are and take the
    table's row by broadcast; the rest take one shuffle. Both sides should be cheap to read again (see session.cut)."""
    hot = hot_keys(rows, key, least)
    if hot is None:
        return rows.join(table, key, how)
    hot = F.broadcast(hot)
    own = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(own, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))
