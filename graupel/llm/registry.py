from graupel.llm import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.sql())
