"""All queries of the core and their SQL."""

from __future__ import annotations

from graupel.plans import analysis, intents, matching, records, similarity, state, texts, training

FLAGSHIP = "knn_topk"
_PARTS = (training, texts, similarity, matching, intents, state, records, analysis)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
