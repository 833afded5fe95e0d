"""Queries: lexical relations, grouping, concepts, targets, ranking, catalogue terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.functions import vectors as V
from graupel.functions.text import content_tokens
from graupel.operators import catalogue as K
from graupel.operators import concepts as C
from graupel.operators import ranking as R
from graupel.operators.edges import nearest_edges, similarity_edges
from graupel.operators.embedding import DIMENSIONS, token_vector
from graupel.operators.hybrid import group_texts
from graupel.operators.lexical import pair_evidence, pair_relation
from graupel.plans.texts import sql_fold, sql_ngrams, sql_tokens
from graupel.session import cut, load

FLOOR = 0.75


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL")
    return rows.select(
        F.xxhash64("scope_ref").alias("group"), F.col("item_id").alias("id"), token_vector("text").alias("vector"), content_tokens("text").alias("tokens"),
        F.coalesce(F.col("industry_evidence.key"), F.array().cast("array<string>")).alias("keys"),
    )


def _near(rows: DataFrame) -> DataFrame:
    return nearest_edges(rows, FLOOR).select("id", "other", "score", F.col("rank").cast("bigint").alias("rank"))


def keyword_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _near(_keywords(spark, d))


def lexical_relations(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and relation of every keyword and its three nearest of the same scope, as its SQL has it. Copies can fill the
    three places: lexical_class_relations has all pairs."""
    rows = cut(_keywords(spark, d))
    a, b = (rows.select(F.col("id").alias(i), F.col("tokens").alias(f"tokens_{s}"), F.col("keys").alias(f"keys_{s}")) for i, s in (("id", "a"), ("other", "b")))
    pairs = pair_evidence(_near(rows).join(a, "id").join(b, "other"))
    shared = F.arrays_overlap("keys_a", "keys_b")
    return pairs.select(
        "id", "other", F.round("containment", 6).alias("containment"), "lexically_compatible", "conflict", pair_relation(0.9, shared_evidence=shared).alias("relation")
    )


def _classes(rows: DataFrame) -> DataFrame:
    """rows with class: the smallest id of those of the group with equal tokens and evidence keys, which relate alike to all others."""
    alike = rows.withColumn("keys", F.array_sort(F.array_distinct("keys")))
    first = alike.groupBy("group", "tokens", "keys").agg(F.min("id").alias("class"), F.first("vector").alias("vector"), F.collect_list("id").alias("ids"))
    return first.select("group", F.col("class"), "tokens", "keys", "vector", "ids")


def lexical_classes(spark: SparkSession, d: str) -> DataFrame:
    """(id, class): every keyword with its class."""
    return _classes(_keywords(spark, d)).select(F.explode("ids").alias("id"), "class")


def lexical_class_relations(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and relation of all pairs of classes (class < other) of a scope at or above the floor. The members of a class of
    two or more are a pair of it with itself."""
    classes = cut(_classes(_keywords(spark, d)))
    apart = similarity_edges(classes.select("group", F.col("class").alias("id"), "vector"), FLOOR).select(F.col("a").alias("class"), F.col("b").alias("other"), "score")
    within = classes.where((F.size("ids") > 1) & F.exists("vector", lambda x: x != 0)).select("class", F.col("class").alias("other"), F.lit(1.0).alias("score"))
    a, b = (classes.select(F.col("class").alias(i), F.col("tokens").alias(f"tokens_{s}"), F.col("keys").alias(f"keys_{s}")) for i, s in (("class", "a"), ("other", "b")))
    edges = apart.unionByName(within).withColumn("score", F.round("score", 6))
    pairs = pair_evidence(edges.join(a, "class").join(b, "other"))
    return pairs.select(
        "class", "other", "score", F.round("containment", 6).alias("containment"), "lexically_compatible", "conflict",
        pair_relation(0.9, shared_evidence=F.arrays_overlap("keys_a", "keys_b")).alias("relation"),
    )


def keyword_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_texts(_keywords(spark, d), floor=0.8, rescue=FLOOR).select("id", "cluster", "representative", "reason")


def _concepts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each label is a concept: its five smallest ids are positive, the three smallest of the next label negative examples."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vector"))
    by_label = rows.groupBy("label").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("ids"))
    first = by_label.select("label", F.posexplode("ids").alias("ordinal", "id")).join(rows, ["label", "id"])
    good = first.select(F.col("label").alias("concept"), "ordinal", F.lit(True).alias("positive"), F.col("id").alias("example_id"), "vector")
    bad = first.where("ordinal < 3 AND label > 0").select((F.col("label") - 1).alias("concept"), "ordinal", F.lit(False).alias("positive"), F.col("id").alias("example_id"), "vector")
    return rows, good.unionByName(bad)


def concept_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = C.concept_scores(*_concepts(spark, d))
    return scores.select("id", "concept", *[F.round(c, 6).alias(c) for c in ("positive_max", "top_mean", "negative_max", "margin")])


def concept_decisions(spark: SparkSession, d: str) -> DataFrame:
    scores = C.concept_scores(*_concepts(spark, d))
    return scores.groupBy("concept").agg(F.count_if(C.accepts(0.25, 0.05)).alias("accepted"), F.count_if(C.decide("hybrid", F.col("id") % 7 == 0, F.col("id") % 14 == 0, 0.25, 0.05, True)).alias("suggested"))


def concept_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return C.verdicts(C.concept_scores(*_concepts(spark, d)), 0.25, 0.05)


TARGETS = [(g, o, f"t{(g * 3 + o * 5) % 7}", float(1 + (g + 2 * o) % 4)) for g in range(10) for o in range(3)]


def weighted_routing(spark: SparkSession, d: str) -> DataFrame:
    scores = C.concept_scores(*_concepts(spark, d))
    relevance = scores.select("id", F.col("concept").alias("group_id"), F.round("positive_max", 6).alias("relevance"))
    targets = spark.createDataFrame([(g, g * 100 + o, t, w) for g, o, t, w in TARGETS], "group_id bigint, ordinal int, ref string, weight double")
    ranked = C.weighted_targets(relevance, targets).where("rank <= 4")
    return ranked.select("id", "ref", F.round("score", 8).alias("score"), F.col("rank").cast("bigint").alias("rank"))


HINTS = [(1, "care", 0.05, ["bảo hành", "đổi trả"]), (2, "care", 0.08, ["repair", "trả góp"]), (3, "size", 0.1, ["loại", "in 1", "cho"]), (4, "model", 0.02, ["mã", "model"])]


def routing_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL")
    from graupel.functions.text import casefold

    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(casefold("text"), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
    hints = spark.createDataFrame(HINTS, "hint_id int, module string, weight double, phrases array<string>")
    found = C.lexical_bonus(rows.select(F.col("item_id").alias("id"), padded.alias("padded")), hints, 0.12)
    return found.select("id", "module", F.round("bonus", 6).alias("bonus"), F.array_join("matched", ",").alias("matched"))


def retrieval_blend(spark: SparkSession, d: str) -> DataFrame:
    """Articles of five segments each against the labels: a segment's score is its highest to the label's two examples of smallest
    id, as the SQL has it (other vectors of the label are no targets), and every label from 0.3 on comes out."""
    rows, examples = _concepts(spark, d)
    scores = C.concept_scores(rows.select("id", "vector"), examples.where("positive AND ordinal < 2"))
    articles = scores.groupBy((F.floor(F.col("id") / 5)).alias("article"), "concept").agg(F.array_sort(F.collect_list(F.struct("id", "positive_max"))).alias("s"))
    semantic = R.blend(F.col("s.positive_max"))
    final = R.boosted(semantic, F.col("article") % 11 == F.col("concept"), F.col("article") % 5 == F.col("concept") % 5, F.col("article") % 3 == 0)
    return articles.select("article", "concept", F.round(final, 4).alias("score")).where("score >= 0.3")


def _links(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("inbound"))
    rows = load(spark, d, "customer").join(orders, "c_custkey", "left")
    return rows.select(
        F.col("c_nationkey").alias("source_ref"), F.pmod("c_custkey", F.lit(500)).alias("ref"), F.col("c_custkey").alias("ordinal"),
        F.coalesce("inbound", F.lit(0)).alias("inbound"), F.round((F.col("c_acctbal") + 1000) / 11000, 4).alias("relevance"),
    )


def link_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.inbound_metrics(_links(spark, d))


def link_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.balanced_rank(_links(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


def spaced_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(
        F.col("user_id").alias("article"), F.col("event_id").alias("section_id"), F.col("value").alias("score"), (F.col("event_id") % 5000).alias("start_word"), F.lit(40).alias("words")
    )
    return R.spaced(rows).select("article", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"))


# Concepts with checked pages.
CATALOGUE = [
    ("wiki:roi", ["ROI", "Return on investment"]), ("wiki:rfid", ["RFID", "Radio-frequency identification"]),
    ("wiki:polyester", ["Polyester", "polyester"]), ("wiki:oem", ["OEM", "Original equipment manufacturer"]),
    ("wiki:moq", ["MOQ", "minimum order quantity"]),
]
SHOP = [("shop:lamp", ["folding lamp", "đèn bàn gập"]), ("shop:scale", ["digital scale", "cân điện tử"]), ("shop:js", ["JavaScript", "HTTP"]), ("shop:robot", ["robot hút bụi", "floor robot"])]


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE + SHOP, "ref string, names array<string>")


def catalogue_terms(spark: SparkSession, d: str) -> DataFrame:
    return K.catalogue_terms(load(spark, d, "documents"), _catalogue(spark))


def unknown_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return K.unknown_acronyms(load(spark, d, "documents"), _catalogue(spark))


QUERIES = {f.__name__: f for f in (
    keyword_neighbours, lexical_relations, lexical_classes, lexical_class_relations, keyword_groups, concept_scores, concept_decisions, concept_verdicts, weighted_routing, routing_hints,
    retrieval_blend, link_metrics, link_rank, spaced_sections, catalogue_terms, unknown_acronyms,
)}

_BYTE = "CAST(('0x' || substr(sha256(w), 2 * i + 1, 2)) AS INTEGER)"
_KEYWORDS = f"""WITH k AS MATERIALIZED (SELECT scope_ref, item_id AS id, coalesce(list_transform(industry_evidence, lambda e: e.key), []) AS keys, {sql_tokens("text")} AS t FROM dataset_keywords WHERE text IS NOT NULL),
vec AS MATERIALIZED (SELECT *, list_transform(range(0, {DIMENSIONS}), lambda i: coalesce(list_sum(list_transform(t, lambda w: {_BYTE} / 255.0 - 0.5)), 0.0)) AS v FROM k),
link AS (SELECT x.id, y.id AS other, round(list_cosine_similarity(x.v, y.v), 6) AS score, x.t AS a, y.t AS b, x.keys AS ka, y.keys AS kb FROM vec x JOIN vec y ON x.scope_ref = y.scope_ref AND x.id <> y.id
  WHERE list_cosine_similarity(x.v, y.v) >= {FLOOR}),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM link QUALIFY rank <= 3)"""


def _prefix(a: str, b: str) -> str:
    return f"coalesce(list_min(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] <> {b}[i])) - 1, least(len({a}), len({b})))"


_FLAT = "chr(1) || array_to_string({0}, chr(1)) || chr(1)"
_LEXICAL = _KEYWORDS + f""",
fact AS (SELECT *, len(list_intersect(a, b)) / least(len(list_distinct(a)), len(list_distinct(b))) AS c, {sql_ngrams("a")} AS ga, {sql_ngrams("b")} AS gb,
  {_prefix("a", "b")} AS p, {_prefix("list_reverse(a)", "list_reverse(b)")} AS s,
  CASE WHEN len(a) <= len(b) THEN contains({_FLAT.format("b")}, {_FLAT.format("a")}) ELSE contains({_FLAT.format("a")}, {_FLAT.format("b")}) END AS embedded FROM near),
tail AS (SELECT *, list_distinct(a[p + 1 :]) AS ta, list_distinct(b[p + 1 :]) AS tb FROM fact),
verdict AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 'x' WHEN p >= 2 AND len(ta) BETWEEN 1 AND 3 AND len(tb) BETWEEN 1 AND 3 AND NOT list_has_any(ta, tb) THEN 'x'
  WHEN embedded OR (s >= 2 AND len(a) - s = 1 AND len(b) - s = 1) OR (abs(len(a) - len(b)) <= 2 AND c >= 0.67) THEN 'c'
  WHEN len(list_filter(ga, lambda g: NOT list_contains(gb, g))) > 0 AND len(list_filter(gb, lambda g: NOT list_contains(ga, g))) > 0 AND NOT list_has_any(ga, gb) THEN 'x' ELSE '-' END AS z FROM tail)
SELECT id, other, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE c END, 6) AS containment, z = 'c' AS lexically_compatible, z = 'x' AS conflict,
  CASE WHEN z = 'x' THEN 'incompatible' WHEN score < 0.9 THEN 'unknown' WHEN z = 'c' OR list_has_any(ka, kb) THEN 'compatible' ELSE 'unknown' END AS relation FROM verdict"""
_SCORES = """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS o FROM embeddings),
example AS (SELECT CAST(label AS BIGINT) AS concept, o, true AS positive, id AS example_id, e FROM v WHERE o < 5 UNION ALL SELECT label - 1, o, false, id, e FROM v WHERE o < 3 AND label > 0),
sim AS (SELECT v.id, x.concept, x.positive, list_cosine_similarity(v.e, x.e) AS s FROM v JOIN example x ON true WHERE x.concept IN (SELECT label FROM v)),
score AS (SELECT id, concept, max(s) FILTER (WHERE positive) AS positive_max, list_avg(list_sort(list(s) FILTER (WHERE positive), 'DESC')[1:3]) AS top_mean,
  max(s) FILTER (WHERE NOT positive) AS negative_max FROM sim GROUP BY ALL), scored AS (SELECT *, positive_max - negative_max AS margin FROM score)"""
_ACCEPT = "(positive_max >= 0.25 AND (margin IS NULL OR margin >= 0.05))"
_TARGETS = ", ".join(f"({g}, {g * 100 + o}, '{t}', {w}::DOUBLE)" for g, o, t, w in TARGETS)
_LINKS = """WITH link AS (SELECT c_nationkey AS source_ref, c_custkey % 500 AS ref, c_custkey AS ordinal, coalesce(n, 0) AS inbound, round((c_acctbal + 1000) / 11000, 4) AS relevance
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
_NAMES = ", ".join(f"('{r}', {i}, '{n}')" for r, names in CATALOGUE + SHOP for i, n in enumerate(names))
SQL = {
    "keyword_neighbours": _KEYWORDS + " SELECT id, other, score, rank FROM near",
    "lexical_relations": _LEXICAL,
    "concept_scores": _SCORES + " SELECT id, concept, round(positive_max, 6) AS positive_max, round(top_mean, 6) AS top_mean, round(negative_max, 6) AS negative_max, round(margin, 6) AS margin FROM scored",
    "concept_decisions": _SCORES + f" SELECT concept, count(*) FILTER (WHERE {_ACCEPT}) AS accepted, count(*) FILTER (WHERE (id % 7 = 0 AND NOT id % 14 = 0) OR {_ACCEPT}) AS suggested FROM scored GROUP BY concept",
    "concept_verdicts": _SCORES + """, ranked AS (SELECT *, lead(positive_max) OVER w AS nxt, row_number() OVER w AS n FROM scored WINDOW w AS (PARTITION BY id ORDER BY positive_max DESC, concept)),
v1 AS (SELECT *, CASE WHEN positive_max < 0.25 THEN 'none' WHEN nxt >= 0.25 AND positive_max - nxt < 0.05 THEN 'ambiguous' ELSE 'confident' END AS status FROM ranked WHERE n = 1)
SELECT id, status, CASE WHEN status = 'confident' THEN concept END AS chosen, round(positive_max, 6) AS score, round(positive_max - nxt, 6) AS runner_up_margin FROM v1""",
    "weighted_routing": _SCORES + f""", target(group_id, ordinal, ref, weight) AS (VALUES {_TARGETS}),
hit AS (SELECT id, ref, ordinal, round(positive_max, 6) * (weight / (SELECT max(weight) FROM target)) AS s FROM scored JOIN target ON group_id = concept),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id, ref ORDER BY s DESC, ordinal) = 1)
SELECT id, ref, round(s, 8) AS score, row_number() OVER (PARTITION BY id ORDER BY s DESC, ordinal, ref) AS rank FROM best QUALIFY rank <= 4""",
    "routing_hints": "WITH hint(hint_id, module, weight, phrases) AS (VALUES " + ", ".join(f"({i}, '{m}', {w}::DOUBLE, {p})" for i, m, w, p in HINTS) + rf"""),
body AS (SELECT item_id AS id, ' ' || trim(regexp_replace({sql_fold('text')}, '[^\pL\pN_]+', ' ', 'g')) || ' ' AS t FROM dataset_keywords WHERE text IS NOT NULL),
hit AS (SELECT id, module, hint_id, weight FROM body, hint WHERE len(list_filter(phrases, lambda p: contains(t, ' ' || p || ' '))) > 0)
SELECT id, module, round(least(0.12, sum(weight)), 6) AS bonus, string_agg(CAST(hint_id AS VARCHAR), ',' ORDER BY hint_id) AS matched FROM hit GROUP BY id, module""",
    "retrieval_blend": _SCORES.replace("o < 5 UNION ALL", "o < 2 UNION ALL") + """, art AS (SELECT id // 5 AS article, concept, list(greatest(positive_max, 0) ORDER BY id) AS s FROM scored GROUP BY ALL),
sem AS (SELECT article, concept, CASE WHEN len(s) = 1 THEN least(1, s[1]) ELSE greatest(0, least(1, 0.45 * list_max(s) + 0.35 * list_avg(list_sort(s, 'DESC')[1 : greatest(1, len(s) // 2)]) + 0.2 * list_max(s[1:2]))) END AS m FROM art),
fin AS (SELECT article, concept, CASE WHEN article % 11 = concept THEN greatest(0.95, m) WHEN article % 5 = concept % 5 THEN least(1, m + 0.08 * greatest(0, least(1, (m - 0.4) / 0.4)))
 WHEN article % 3 = 0 THEN least(1, m + 0.04 * greatest(0, least(1, (m - 0.45) / 0.4))) ELSE m END AS f FROM sem)
SELECT article, concept, round(f, 4) AS score FROM fin WHERE round(f, 4) >= 0.3""",
    "link_metrics": _LINKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY inbound DESC) AS place, count(*) OVER (PARTITION BY source_ref) AS n FROM link)
SELECT source_ref, count(*) FILTER (WHERE inbound = 0) AS zero_inbound, median(inbound) AS median_inbound, CAST(max(inbound) FILTER (WHERE place = n - round_even((n - 1) * 0.9, 0)) AS DOUBLE) AS p90_inbound,
max(inbound) AS max_inbound, (SELECT count(*) FROM (SELECT ref FROM link l WHERE l.source_ref = r.source_ref GROUP BY ref HAVING count(*) > 1)) AS repeated_refs,
round(coalesce(sum(inbound) FILTER (WHERE place <= greatest(1, n // 5)) / nullif(sum(inbound), 0), 0), 6) AS top_share FROM r GROUP BY source_ref""",
    "link_rank": _LINKS + """, base AS (SELECT *, greatest(1, max(inbound) OVER w) AS scale, median(inbound) OVER w AS med FROM link WINDOW w AS (PARTITION BY source_ref)),
raw AS (SELECT *, CASE WHEN inbound = 0 THEN 0.03 ELSE 0.0 END - 0.05 * greatest(0, inbound - med) / scale AS x FROM base),
two AS (SELECT *, relevance + greatest(-0.08, least(0.08, x)) AS once, relevance + greatest(-0.08, least(0.08, x - 0.04)) AS again FROM raw),
fin AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_ref, ref ORDER BY once DESC, ordinal) = 1 THEN once ELSE again END AS f FROM two)
SELECT source_ref, ref, ordinal, round(f, 6) AS score, row_number() OVER (PARTITION BY source_ref ORDER BY f DESC, ordinal) AS rank FROM fin QUALIFY rank <= 10""",
    "spaced_sections": """WITH s AS (SELECT user_id AS article, event_id AS id, value AS score, event_id % 5000 AS pos FROM events),
a AS (SELECT article, list([{'pos': pos, 'id': id}] ORDER BY -score NULLS FIRST, pos, id) AS l, sum(40) AS words FROM s GROUP BY article),
p AS (SELECT article, list_reduce(l, lambda got, x: CASE WHEN len(got) < least(5, greatest(1, words // 350)) AND len(list_filter(got, lambda g: abs(g.pos - x[1].pos) < 180)) = 0 THEN got || x ELSE got END) AS got FROM a)
SELECT article, array_to_string(list_transform(list_sort(got), lambda g: g.id), ',') AS picked FROM p""",
    "catalogue_terms": rf"""WITH name(ref, ordinal, term) AS (VALUES {_NAMES}), body AS (SELECT doc_id, {sql_fold('text')} AS t FROM documents WHERE text IS NOT NULL),
hit AS (SELECT doc_id, ref, ordinal, term FROM body, name WHERE regexp_matches(regexp_replace(t, '[\s\pZ]+', ' ', 'g'), '(^|[^\pL\pN_])' || regexp_escape({sql_fold('term')}) || '($|[^\pL\pN_])'))
SELECT doc_id, ref, term, CASE WHEN upper(term) = term AND lower(term) <> term THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, ref ORDER BY ordinal) = 1""",
    "unknown_acronyms": rf"""WITH name(ref, ordinal, term) AS (VALUES {_NAMES}), a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_]+')) AS acronym FROM documents)
SELECT doc_id, acronym FROM a WHERE regexp_matches(acronym, '^[A-Z][A-Z0-9]{{1,7}}$') AND lower(acronym) NOT IN (SELECT {sql_fold('term')} FROM name) AND lower(acronym) NOT IN ('product', 'customer', 'company', 'website')""",
}
