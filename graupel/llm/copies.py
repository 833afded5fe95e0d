"""Duplicates hidden by formatting differences.

Records are brought to one canonical key; keys with very many copies are found exactly by partial
counts and aggregated on two salted levels, all others take one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graupel.functions.text import casefold
from graupel.session import cut, shuffle_partitions

#: Blanks, and marks (punctuation, symbols) that do not stand between two digits.
_IGNORED = r"[\s\p{Z}\u0085\x1c-\x1f]+|(?<!\p{Nd})[\p{P}\p{S}]|[\p{P}\p{S}](?!\p{Nd})"
#: A key is hot if it has more than this share of the rows (or a shuffle partition's share, if that is less), and more than HOT_LEAST.
HOT_SHARE = 0.0005
HOT_LEAST = 8


def bare_text(text: Column) -> Column:
    """Letter case (full folding), blanks and marks removed; accents stay."""
    return casefold(F.regexp_replace(text, _IGNORED, ""))


def canonical_json(text: Column) -> Column:
    """JSON with sorted fields and no blanks. Text that is no JSON stays as it is."""
    parsed = F.to_json(F.try_parse_json(text))
    return F.coalesce(F.concat(F.lit("j"), parsed), F.concat(F.lit("t"), text))


def canonical_record(scope: str = "scope_ref", ref: str = "ref", text: str = "text", language: str = "language",
                     evidence: str = "industry_evidence", metadata: str = "metadata") -> Column:
    """One string per record; equal strings mean equal records. Null differs from empty."""
    return F.to_json(
        F.struct(
            F.col(scope).alias("s"),
            bare_text(F.col(ref)).alias("r"),
            bare_text(F.col(text)).alias("t"),
            casefold(F.col(language)).alias("l"),
            F.array_sort(F.col(evidence)).alias("e"),
            canonical_json(F.col(metadata)).alias("m"),
        ),
        {"ignoreNullFields": "false"},
    )


def _keyed(records: DataFrame) -> DataFrame:
    """(k1, k2, item_id): 128 bits of the canonical record, of fixed width for hash aggregation."""
    canon = canonical_record()
    return records.select("item_id", canon.alias("c")).select(
        F.xxhash64(F.lit(17), "c").alias("k1"), F.xxhash64(F.lit(71), F.reverse("c")).alias("k2"), "item_id"
    )


def _hot_keys(keyed: DataFrame, share: float, least: int) -> DataFrame:
    """Keys with more than max(share x rows, least) copies: at most 1 / share rows, exactly counted. The
    count combines on the map side, so a hot key costs one row per task."""
    counts = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    big = counts.where(F.col("n") > least)
    total = keyed.agg(F.count(F.lit(1)).alias("n"))
    return big.where(F.col("n") > total.scalar() * F.lit(share)).select("k1", "k2")


def with_first_copy(records: DataFrame, share: float = HOT_SHARE, least: int = HOT_LEAST, salts: int = 64) -> DataFrame:
    """(item_id, first_id, copies) for every record: the smallest item_id among its equals and their number.

    The records are read and brought to keys once; the keys (24 bytes a record) are kept in the shared folder.

    Hot keys (at most 1 / share of them, 2000 or one a shuffle partition, so the set may be broadcast) go through (key, salt) and then
    key aggregation; their rows take the result by a broadcast join and are never gathered. All other
    keys have at most max(share x rows, least) rows and take one shuffle.
    Rows without item_id are left out; an empty table gives no rows.
    """
    share = min(share, 1 / shuffle_partitions(records.sparkSession))
    keyed = cut(_keyed(records.where(F.col("item_id").isNotNull())))
    hot = F.broadcast(_hot_keys(keyed, share, least))

    one_level = keyed.join(hot, ["k1", "k2"], "left_anti")
    per_key = W.partitionBy("k1", "k2")
    cold = one_level.select(
        "item_id", F.min("item_id").over(per_key).alias("first_id"), F.count(F.lit(1)).over(per_key).alias("copies")
    )

    rows = keyed.join(hot, ["k1", "k2"], "left_semi")
    salted = rows.groupBy("k1", "k2", F.pmod("item_id", F.lit(salts)).alias("salt")).agg(
        F.min("item_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    merged = salted.groupBy("k1", "k2").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    warm = rows.join(F.broadcast(merged), ["k1", "k2"]).select("item_id", "first_id", "copies")
    return cold.unionByName(warm)


def copy_pairs(records: DataFrame, **sizes) -> DataFrame:
    """(item_id, copy_id): the smallest id of each group with each other one."""
    return with_first_copy(records, **sizes).where(F.col("item_id") != F.col("first_id")).select(
        F.col("first_id").alias("item_id"), F.col("item_id").alias("copy_id")
    )


def copy_groups(records: DataFrame, **sizes) -> DataFrame:
    """(item_id, copies): one representative per group, the smallest id, and the group's size."""
    return with_first_copy(records, **sizes).where(F.col("item_id") == F.col("first_id")).select("item_id", "copies").distinct()
