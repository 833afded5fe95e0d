"""Queries: texts against concepts by words and by vectors, intents, routes of two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.functions.text import routing_form
from graupel.operators import intents as I
from graupel.operators.concepts import lexical_bonus
from graupel.operators.embedding import DIMENSIONS, token_vector
from graupel.plans.texts import sql_bare, sql_clean, sql_fold, sql_tokens
from graupel.session import load

CONCEPTS = [
    I.Concept(1, I.unique_examples(("máy lọc khí", "máy  lọc khí", "air purifier", "máy lọc nước")), ("phụ kiện", "model 39"), "phrase"),
    I.Concept(2, ("robot hut bui", "may hut bui"), ("bán buôn",), "folded", "lexical"),
    I.Concept(3, ("bàn", "desk", "ghế xoay lưới"), ("bàn phím", "đèn bàn"), "token"),
    I.Concept(4, ("cân điện tử", "digital scale"), (), "prefix"),
    I.Concept(5, ("tea maker", "tea jar", "hộp trà"), ("in bulk",), "semantic", "semantic"),
    I.Concept(6, ("loa kéo", "mesh chair", "patio cover", "mái che"), ("chính hãng",), "accent_sensitive"),
    I.Concept(7, ("mái che mạ kẽm",), (), "exact", "lexical", enabled=False),
]
LEAST, MARGIN = 0.6, 0.08


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL")
    return rows.select(F.col("item_id").alias("id"), "text", token_vector("text").alias("vector"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    found = I.concept_matches(_texts(spark, d), I.selected(CONCEPTS), LEAST, MARGIN)
    return found.withColumn("positive_max", F.round("positive_max", 6))


def concept_words(spark: SparkSession, d: str) -> DataFrame:
    """Examples of each concept that occur in each text, where any do."""
    found = I.lexical_matches(_texts(spark, d), I.selected(CONCEPTS)).where("lexical OR negative")
    return found.select("id", "concept", F.array_join("hits", "|").alias("hits"), "best", F.array_join("negative_hits", "|").alias("negative_hits"))


def concept_matches(spark: SparkSession, d: str) -> DataFrame:
    found = _matches(spark, d)
    return found.select("id", "concept", "lexical", "best", "negative", "positive_max", *[F.round(c, 6).alias(c) for c in ("top_mean", "negative_max", "margin")], "suggested")


def text_intents(spark: SparkSession, d: str) -> DataFrame:
    return I.intents(_matches(spark, d), LEAST, MARGIN)


#: (group, ordinal, module, weight), (module, group, ordinal, operation, weight)
OUTER = [(1, 0, "air", 3.0), (3, 1, "home", 4.0), (4, 2, "kitchen", 2.0), (5, 3, "kitchen", 4.0), (6, 4, "home", 1.0), (6, 5, "outdoor", 4.0), (1, 6, "care", 2.0), (5, 7, "tea", 3.5)]
INNER = [("air", 1, 0, "filter", 2.0), ("air", 6, 1, "fan", 1.0), ("home", 3, 0, "desk", 2.0), ("home", 6, 1, "chair", 2.0), ("kitchen", 4, 0, "weigh", 1.0), ("kitchen", 5, 1, "brew", 1.0), ("outdoor", 6, 0, "cover", 1.0), ("tea", 5, 0, "jar", 1.0), ("tea", 5, 1, "jar", 0.5)]
HINTS = [(1, "air", 0.05, ["lọc", "máy"]), (2, "tea", 0.08, ["trà", "tea"]), (3, "home", 0.1, ["phòng", "ghế xoay"]), (4, "home", 0.02, ["gỗ"])]
POLICY = I.RoutePolicy(least_candidate=0.3, least_operation=0.4)


def text_routes(spark: SparkSession, d: str) -> DataFrame:
    found = _matches(spark, d).where("positive_max IS NOT NULL").select("id", F.col("concept").alias("group_id"), F.col("positive_max").alias("relevance"))
    outer = spark.createDataFrame(OUTER, "group_id bigint, ordinal int, ref string, weight double")
    inner = spark.createDataFrame(INNER, "module string, group_id bigint, ordinal int, ref string, weight double")
    padded = _texts(spark, d).select("id", F.concat(F.lit(" "), routing_form("text"), F.lit(" ")).alias("padded"))
    hints = spark.createDataFrame(HINTS, "hint_id int, module string, weight double, phrases array<string>")
    return I.routes(found, outer, inner, lexical_bonus(padded, hints, 0.10).select("id", "module", "bonus"), POLICY)


QUERIES = {f.__name__: f for f in (concept_words, concept_matches, text_intents, text_routes)}

_USED = I.selected(CONCEPTS)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
_TABLE = ", ".join(f"({c.id}, {_LIST(c.positives)}, {_LIST(c.negatives)}, '{c.mode}', '{c.strategy}')" for c in _USED)


def _hit(e: str) -> str:
    f, b = sql_clean(sql_fold(e)), sql_clean(sql_bare(e))
    return (
        f"CASE mode WHEN 'exact' THEN f = {f} WHEN 'prefix' THEN starts_with(f, {f}) WHEN 'semantic' THEN false WHEN 'phrase' THEN contains(' ' || f || ' ', ' ' || {f} || ' ')"
        rf" WHEN 'folded' THEN contains(' ' || b || ' ', ' ' || {b} || ' ') ELSE regexp_matches(f, '(^|[^\pL\pN_])' || regexp_escape({f}) || '($|[^\pL\pN_])') END"
    )


_VECTOR = lambda t: f"list_transform(range(0, {DIMENSIONS}), lambda i: coalesce(list_sum(list_transform({t}, lambda w: CAST(('0x' || substr(sha256(w), 2 * i + 1, 2)) AS INTEGER) / 255.0 - 0.5)), 0.0))"
_WORDS = f"""WITH concept(concept, good, bad, mode, strategy) AS (VALUES {_TABLE}),
body AS MATERIALIZED (SELECT item_id AS id, {sql_clean(sql_fold("text"))} AS f, {sql_clean(sql_bare("text"))} AS b, {_VECTOR(sql_tokens("text"))} AS v FROM dataset_keywords WHERE text IS NOT NULL),
word AS MATERIALIZED (SELECT id, concept, strategy, list_filter(good, lambda e: {_hit("e")}) AS hits, list_filter(bad, lambda e: {_hit("e")}) AS nots FROM body, concept)"""
_MATCH = _WORDS + f""",
example AS MATERIALIZED (SELECT concept, true AS good, unnest(good) AS e FROM concept WHERE strategy <> 'lexical' UNION ALL SELECT concept, false, unnest(bad) FROM concept WHERE strategy <> 'lexical'),
target AS MATERIALIZED (SELECT concept, good, {_VECTOR(sql_tokens("e"))} AS v FROM example),
sim AS (SELECT id, concept, good, CASE WHEN list_sum(list_transform(a.v, lambda x: x * x)) = 0 OR list_sum(list_transform(t.v, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(a.v, t.v) END AS s FROM body a, target t),
near AS (SELECT id, concept, max(s) FILTER (WHERE good) AS p, list_avg(list_sort(list(s) FILTER (WHERE good), 'DESC')[1:3]) AS top_mean, max(s) FILTER (WHERE NOT good) AS n FROM sim GROUP BY ALL),
fact AS (SELECT w.id, w.concept, strategy, len(hits) > 0 AS lexical, hits[1] AS best, len(nots) > 0 AS negative, p, top_mean, n, p - n AS margin, p >= {LEAST} AND (n IS NULL OR p - n >= {MARGIN}) AS gate FROM word w LEFT JOIN near USING (id, concept)),
m AS MATERIALIZED (SELECT *, round(p, 6) AS positive_max, CASE strategy WHEN 'lexical' THEN lexical AND NOT negative WHEN 'semantic' THEN coalesce(gate, false) ELSE (lexical AND NOT negative) OR coalesce(gate, false) END AS suggested FROM fact)"""
_INTENTS = _MATCH + f""",
r AS (SELECT *, lexical AND NOT negative AS hit, row_number() OVER (PARTITION BY id ORDER BY coalesce(positive_max, -1) DESC, concept) AS place FROM m),
h AS (SELECT id, count(*) AS n, min(concept) AS c, (list(concept ORDER BY concept))[2] AS c2 FROM r WHERE hit GROUP BY id),
q AS (SELECT a.id, coalesce(h.n, 0) AS n, h.c, h.c2, a.concept AS t1, a.positive_max AS s1, b.concept AS t2, b.positive_max AS s2, x.positive_max AS hs, y.positive_max AS hs2,
  (SELECT arg_min(concept, place) FROM r o WHERE o.id = a.id AND o.concept <> h.c) AS o1 FROM r a JOIN r b ON b.id = a.id AND b.place = 2 LEFT JOIN h ON h.id = a.id LEFT JOIN r x ON x.id = a.id AND x.concept = h.c LEFT JOIN r y ON y.id = a.id AND y.concept = h.c2 WHERE a.place = 1),
z AS (SELECT *, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN CASE WHEN t1 <> c AND coalesce(s1 >= {LEAST}, false) AND s1 - coalesce(hs, 0) >= {MARGIN} THEN 'ambiguous' ELSE 'confident' END
  WHEN NOT coalesce(s1 >= {LEAST}, false) THEN 'none' WHEN coalesce(s2 >= {LEAST}, false) AND s1 - s2 < {MARGIN} THEN 'ambiguous' ELSE 'confident' END AS status,
  CASE WHEN n >= 1 THEN c ELSE t1 END AS first, CASE WHEN n > 1 THEN c2 WHEN n = 1 THEN o1 ELSE t2 END AS second FROM q)
SELECT z.id, status, first, second, CASE WHEN z.n >= 1 THEN 1.0 ELSE round(coalesce(s1, 0), 6) END::DOUBLE AS score,
  round(CASE WHEN f.positive_max IS NULL THEN 0.0 ELSE f.positive_max - coalesce(s.positive_max, 0) END, 6) AS runner_up_margin
FROM z JOIN m f ON f.id = z.id AND f.concept = first JOIN m s ON s.id = z.id AND s.concept = second"""
_ROWS = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
_ROUTES = _MATCH + f""",
outside(group_id, ordinal, module, weight) AS (VALUES {_ROWS(OUTER)}), inside(module, group_id, ordinal, op, weight) AS (VALUES {_ROWS(INNER)}),
hint(hint_id, module, weight, phrases) AS (VALUES {", ".join(f"({i}, '{m}', {w}::DOUBLE, {p})" for i, m, w, p in HINTS)}),
form AS (SELECT item_id AS id, ' ' || trim(regexp_replace({sql_fold("text")}, '[^\\pL\\pN_]+', ' ', 'g')) || ' ' AS t FROM dataset_keywords WHERE text IS NOT NULL),
bonus AS (SELECT id, module, least(0.1, sum(weight)) AS bonus FROM form, hint WHERE len(list_filter(phrases, lambda p: contains(t, ' ' || p || ' '))) > 0 GROUP BY ALL),
rel AS (SELECT id, concept AS group_id, positive_max AS r FROM m WHERE positive_max IS NOT NULL),
o1 AS (SELECT id, module, r, r * (weight / (SELECT max(weight) FROM outside)) AS s, ordinal FROM rel JOIN outside USING (group_id) QUALIFY row_number() OVER (PARTITION BY id, module ORDER BY s DESC, ordinal) = 1),
o2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, ordinal) AS rank FROM o1),
o3 AS (SELECT o2.id, o2.module, least(1.0, s + coalesce(bonus, 0)) AS combined, rank FROM o2 LEFT JOIN bonus b ON b.id = o2.id AND b.module = o2.module WHERE rank <= 4 AND r >= {POLICY.least_candidate}),
o4 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY combined DESC, rank) AS place FROM o3 QUALIFY place <= 3),
share AS (SELECT *, weight / max(weight) OVER (PARTITION BY module) AS share FROM inside),
i1 AS (SELECT o4.id, o4.module, combined, place, op, r, r * share AS s, ordinal FROM o4 JOIN share USING (module) JOIN rel ON rel.id = o4.id AND rel.group_id = share.group_id QUALIFY row_number() OVER (PARTITION BY o4.id, o4.module, op ORDER BY s DESC, ordinal) = 1),
i2 AS (SELECT *, row_number() OVER (PARTITION BY id, module ORDER BY s DESC, ordinal) AS n FROM i1),
i3 AS (SELECT *, {POLICY.outer} * combined + {POLICY.inner} * s AS final FROM i2 WHERE n <= 4 AND r >= {POLICY.least_operation}),
i4 AS (SELECT *, lead(final) OVER w AS nxt, row_number() OVER w AS pos FROM i3 WINDOW w AS (PARTITION BY id ORDER BY final DESC, place, n)),
won AS (SELECT id, coalesce(final - nxt < {POLICY.final_margin}, false) AS close, module, op, final FROM i4 WHERE pos = 1)
SELECT q.id, CASE WHEN won.id IS NOT NULL THEN CASE WHEN close THEN 'ambiguous' ELSE 'confident' END WHEN q.id IN (SELECT id FROM o4) THEN 'unsupported' ELSE 'none' END AS status,
  CASE WHEN NOT close THEN module END AS module, CASE WHEN NOT close THEN op END AS operation, round(final, 6) AS score FROM (SELECT DISTINCT id FROM rel) q LEFT JOIN won ON won.id = q.id"""
SQL = {
    "concept_words": _WORDS + " SELECT id, concept, array_to_string(hits, '|') AS hits, hits[1] AS best, array_to_string(nots, '|') AS negative_hits FROM word WHERE len(hits) > 0 OR len(nots) > 0",
    "concept_matches": _MATCH + " SELECT id, concept, lexical, best, negative, positive_max, round(top_mean, 6) AS top_mean, round(n, 6) AS negative_max, round(margin, 6) AS margin, suggested FROM m",
    "text_intents": _INTENTS,
    "text_routes": _ROUTES,
}
