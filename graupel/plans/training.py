"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graupel.operators.skew import heavy_scopes, scope_run_totals
from graupel.session import load

_BLANKS = (
    "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)"
    "||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"
)
_TOTALS = f"""
WITH latest AS (
  SELECT run_id, trim(scope_ref, {_BLANKS}) AS scope_ref, member_count,
         row_number() OVER (PARTITION BY run_id, trim(scope_ref, {_BLANKS})
                            ORDER BY observed_at DESC NULLS LAST, member_count DESC NULLS LAST) AS pos
  FROM keyword_group_runs WHERE run_id IS NOT NULL
), totals AS (
  SELECT scope_ref, count(*) AS run_count, CAST(sum(member_count) AS BIGINT) AS member_sum,
         max(member_count) AS member_max
  FROM latest WHERE pos = 1 GROUP BY scope_ref
)
"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_scopes(load(spark, sf_dir, "keyword_group_runs"))


def p1_scope_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_run_totals(load(spark, sf_dir, "keyword_group_runs"))


QUERIES = {"p1_found": p1_found, "p1_scope_totals": p1_scope_totals}
SQL = {
    "p1_found": _TOTALS
    + "SELECT scope_ref FROM totals WHERE scope_ref IS NOT NULL AND run_count * 50 >= (SELECT sum(run_count) FROM totals)",
    "p1_scope_totals": _TOTALS + "SELECT scope_ref, run_count, member_sum, member_max FROM totals",
}
