"""Queries over the text and hash functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.functions import hashing as H
from graupel.functions import text as T
from graupel.session import load


def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text IS NOT NULL")
    clean = T.normalize("text")
    return docs.select("doc_id", F.length(clean).cast("bigint").alias("n_clean"), F.sha2(clean, 256).alias("clean_hash"))


def text_casefolded(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(T.casefold("text"), 256).alias("folded_hash"))


def text_unaccented(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dataset_keywords").select("item_id", T.fold_accents(T.collapse_blanks("text")).alias("folded"))


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = load(spark, d, "dataset_keywords").select("item_id", T.content_tokens("text").alias("t"))
    return tokens.select("item_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n"))


def text_ngram_frequency(spark: SparkSession, d: str) -> DataFrame:
    """In how many texts each run of two or more tokens occurs."""
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL").select(F.explode(T.ngrams(T.content_tokens("text"))).alias("ngram"))
    return rows.groupBy("ngram").agg(F.count(F.lit(1)).alias("texts"))


def text_frequent_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Of each scope with at least 40 texts the runs in at least max(8, a tenth of them, rounded up)."""
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL").select("scope_ref", T.ngrams(T.content_tokens("text")).alias("g"))
    texts = rows.groupBy("scope_ref").agg(F.count(F.lit(1)).alias("n")).where("n >= 40")
    counts = rows.select("scope_ref", F.explode("g").alias("ngram")).groupBy("scope_ref", "ngram").agg(F.count(F.lit(1)).alias("texts")).where("texts >= 8")
    return counts.join(texts, "scope_ref").where(F.col("texts") >= F.ceil(F.col("n") / 10)).select("scope_ref", "ngram", "texts")


MODES = ("exact", "prefix", "token", "phrase", "folded", "semantic")
NEEDLES = ("máy", "robot hút bụi", "tea maker", "k8", "cho", "may", "(x)", " ")


def text_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many keywords match each of a few values in each mode."""
    rows = load(spark, d, "dataset_keywords").where("text IS NOT NULL").select("text")
    counts = [
        F.count_if(T.matches_value("text", F.lit(n), m)).alias(f"c{i}_{j}") for i, n in enumerate(NEEDLES) for j, m in enumerate(MODES)
    ]
    one = rows.agg(*counts)
    cells = [F.struct(F.lit(n).alias("needle"), F.lit(m).alias("mode"), F.col(f"c{i}_{j}").alias("hits")) for i, n in enumerate(NEEDLES) for j, m in enumerate(MODES)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def text_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.segments("text")).alias("pos", "segment"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "segment")


def text_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(T.is_heading(F.col("line"))).alias("headings"), F.count_if(T.is_contact_line(F.col("line"))).alias("contacts")
    )


def text_acronyms(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(T.acronyms("text")).alias("acronym"))
    return rows.where(~T.is_generic("acronym")).groupBy("acronym").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("doc_id").alias("documents"))


def text_generic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the general terms their folded text holds."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.fold_accents("text").alias("folded"))
    terms = F.array(*[F.lit(t) for t in sorted({T._fold_literal(t) for t in T.GENERIC_TERMS})])
    return docs.select("doc_id", F.explode(F.filter(terms, lambda t: F.contains("folded", t))).alias("term"))


def hash_contents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dataset_keywords").select("item_id", H.content_hash("text").alias("hash"), (H.content_hash("text") == F.col("content_hash")).alias("agrees"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded records as canonical JSON, with scope and language of their revision."""
    item = H.canonical_item("ref", H.content_hash("text"), "language", "industry_evidence", "metadata")
    rows = load(spark, d, "dataset_keywords").where("ref IS NOT NULL").select("item_id", "revision_id", "batch_index", "ref", "text", "industry_evidence", item.alias("item"))
    revisions = load(spark, d, "keyword_group_dataset_revisions").select(F.col("id").alias("revision_id"), "scope_ref", "language")
    return rows.join(revisions, "revision_id")


def hash_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", "item")


def hash_batches(spark: SparkSession, d: str) -> DataFrame:
    return H.batch_hash(_items(spark, d), ["revision_id", "batch_index"])


def hash_datasets(spark: SparkSession, d: str) -> DataFrame:
    return H.dataset_hash(_items(spark, d), ["revision_id"])


def hash_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The input hash of a grouping of each revision: evidence of the keywords that have any, then their texts."""
    rows = _items(spark, d).where("text IS NOT NULL")
    tail = F.concat(F.lit('],"language":'), H.quoted("language"), F.lit(',"scope_ref":'), H.quoted("scope_ref"), F.lit("}"))
    evidence = H.json_object({"memberships": F.to_json(H.canonical_evidence("industry_evidence")), "ref": H.quoted("ref")})
    keyword = H.json_object({"ref": H.quoted("ref"), "text": H.quoted(T.normalize("text"))})
    parts = F.array(F.when(F.size("industry_evidence") > 0, F.struct(F.lit(0).alias("section"), evidence.alias("item"))), F.struct(F.lit(1).alias("section"), keyword.alias("item")))
    listed = rows.select("revision_id", "ref", tail.alias("tail"), F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"))
    return H.listed_digest(listed.select("revision_id", "ref", "tail", "p.section", "p.item"), ["revision_id"], ('{"industry_evidence":[', '],"keywords":['))


def hash_topic_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The input hash of a topic analysis of each request's keywords, by scope and language."""
    rows = load(spark, d, "keyword_inputs").where("request_id IS NOT NULL AND scope_ref IS NOT NULL AND ref IS NOT NULL AND text IS NOT NULL")
    tail = F.concat(F.lit('],"language":'), H.quoted("language"), F.lit(',"site_ref":'), H.quoted("scope_ref"), F.lit("}"))
    keyword = H.json_object({"ref": H.quoted("ref"), "text": H.quoted(T.normalize("text"))})
    listed = rows.select("request_id", "scope_ref", "language", F.lit(0).alias("section"), "ref", keyword.alias("item"), tail.alias("tail"))
    return H.listed_digest(listed, ["request_id", "scope_ref", "language"], ('{"keywords":[',))


#: Settings of a run, as its fingerprint has them.
RUN_CONFIG = {
    "algorithm": "hybrid_semantic_lexical_v3", "ambiguity_margin": 0.05, "containment_min": 0.67, "min_group_size": 2, "model_key": "onnx:mini-sem-multi:2",
    "reciprocal_neighbor_k": 3, "rescue_semantic_floor": 0.5, "semantic_floor": 0.55,
}


def hash_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "keyword_group_dataset_revisions").where("dataset_hash IS NOT NULL")
    return rows.select("id", H.fingerprint(RUN_CONFIG, "dataset_hash", "scope_ref", "language").alias("fingerprint"))


def hash_targets(spark: SparkSession, d: str) -> DataFrame:
    """Digests of link targets: of the normal text of each document that has any."""
    return load(spark, d, "documents").select("doc_id", T.normalize("text").alias("t")).where("t <> ''").select("doc_id", F.sha2("t", 256).alias("digest"))


def text_namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Where a scope's vectors are stored, for groupings and for topics, and under which model."""
    rows = load(spark, d, "keyword_group_dataset_revisions").select("scope_ref", "language").distinct()
    return rows.select("scope_ref", "language", T.grouping_namespace("scope_ref", "language").alias("namespace"), T.topic_namespace("scope_ref").alias("topic_namespace"), T.model_key("onnx", "mini-sem-multi", "2").alias("model_key"))


def text_error_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "keyword_group_runs").where("error IS NOT NULL").select(T.summary("error").alias("error"))
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


def text_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Texts as routing hints compare them: compatible forms, case folded, other signs blank."""
    return load(spark, d, "keyword_inputs").where("text IS NOT NULL").select("text").distinct().select("text", T.routing_form("text").alias("form"))


QUERIES = {f.__name__: f for f in (
    text_normalized, text_casefolded, text_unaccented, text_tokens, text_ngram_frequency, text_frequent_ngrams, text_matches, text_segments,
    text_line_kinds, text_acronyms, text_generic_terms, hash_contents, hash_items, hash_batches, hash_datasets, hash_inputs, hash_topic_inputs, hash_fingerprints, hash_targets,
    text_namespaces, text_error_summaries, text_compatible,
)}

_STOP = "[" + ",".join(f"'{w}'" for w in T.FUNCTION_WORDS) + "]"
_GAP = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_GAP}+', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"translate(replace(lower({x}), 'ß', 'ss'), 'ſς', 'sσ')"


def sql_bare(x: str) -> str:
    return sql_fold(f"strip_accents(translate({x}, 'đĐ', 'dd'))")


def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all({sql_fold(sql_clean(x))}, '[\pL\pN]+'), lambda t: NOT list_contains({_STOP}, t))"


def sql_ngrams(t: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(range(2, len({t}) + 1), lambda k: list_transform(range(1, len({t}) - k + 2), "
        f"lambda i: array_to_string({t}[i : i + k - 1], ' ')))))"
    )


def _sql_match(n: str, m: str) -> str:
    q = n.replace("'", "''")
    fold = sql_bare if m == "folded" else sql_fold
    h, x = sql_clean(fold("text")), sql_clean(fold(f"'{q}'"))
    hit = {
        "exact": f"{h} = {x}",
        "prefix": f"starts_with({h}, {x})",
        "token": rf"regexp_matches({h}, '(^|[^\pL\pN_])' || regexp_escape({x}) || '($|[^\pL\pN_])')",
        "semantic": "false",
    }.get(m, f"contains(' ' || {h} || ' ', ' ' || {x} || ' ')")
    return f"SELECT '{q}' AS needle, '{m}' AS mode, count(*) FILTER (WHERE {x} <> '' AND {hit}) AS hits FROM dataset_keywords WHERE text IS NOT NULL"


_EDGE = rf"^{_GAP}+|{_GAP}+$"
_HEAD = r"(length({0}) BETWEEN 15 AND 120 AND NOT regexp_matches({0}, '[.:!?;,]$'))"
_CONTACT = r"(length({0}) <= 160 AND regexp_matches(lower({0}), '(hotline|email|gọi ngay|đặt lịch|liên hệ|inbox|nhận mẫu.*miễn phí|(^|[^\pL\pN_])0\p{{Nd}}{{8,10}}($|[^\pL\pN_]))'))"
_NGRAMS = f"""WITH token AS (SELECT {sql_tokens("text")} AS t FROM dataset_keywords WHERE text IS NOT NULL),
gram AS (SELECT unnest({sql_ngrams("t")}) AS ngram FROM token),
counted AS (SELECT ngram, count(*) AS texts FROM gram GROUP BY ngram) """
_J = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
_EVIDENCE = """'[' || coalesce(array_to_string(list_transform(list_sort(list_transform(industry_evidence, lambda e: [e.key, e.group_type])),
 lambda e: '{"group_type":' || CAST(to_json(e[2]) AS VARCHAR) || ',"key":' || CAST(to_json(e[1]) AS VARCHAR) || '}'), ','), '') || ']'"""
_NORMAL = sql_clean("nfc_normalize(k.text)")
_ITEM = f"""'{{"content_hash":' || {_J(f"sha256({_NORMAL})")} || ',"industry_evidence":' || {_EVIDENCE} || ',"language":' || {_J("k.language")}
 || ',"metadata":' || coalesce('{{' || array_to_string(list_transform(list_sort(json_keys(metadata)), lambda f: '"' || f || '":' || CAST(json_extract(metadata, '$."' || f || '"') AS VARCHAR)), ',') || '}}', '{{}}')
 || ',"ref":' || {_J("k.ref")} || '}}'"""
_ITEMS = f"""WITH item AS MATERIALIZED (SELECT item_id, revision_id, batch_index, k.ref, r.scope_ref, r.language, {_ITEM} AS item, k.text,
 CASE WHEN len(industry_evidence) > 0 THEN '{{"memberships":' || {_EVIDENCE} || ',"ref":' || {_J("k.ref")} || '}}' END AS evidence,
 '{{"ref":' || {_J("k.ref")} || ',"text":' || {_J(_NORMAL)} || '}}' AS keyword
 FROM dataset_keywords k JOIN keyword_group_dataset_revisions r ON r.id = revision_id WHERE k.ref IS NOT NULL),
once AS (SELECT DISTINCT revision_id, batch_index, ref, item FROM item), whole AS (SELECT DISTINCT revision_id, scope_ref, language, ref, item FROM item),
word AS (SELECT DISTINCT revision_id, scope_ref, language, ref, keyword FROM item WHERE text IS NOT NULL), fact AS (SELECT DISTINCT revision_id, ref, evidence FROM item WHERE evidence IS NOT NULL AND text IS NOT NULL)
"""
_CONFIG = json.dumps(RUN_CONFIG | {"dataset_hash": "@d", "language": "@l", "scope_ref": "@s"}, sort_keys=True, separators=(",", ":"))
SQL = {
    "text_normalized": f"SELECT doc_id, length(c) AS n_clean, sha256(c) AS clean_hash FROM (SELECT doc_id, {sql_clean('nfc_normalize(text)')} AS c FROM documents WHERE text IS NOT NULL)",
    "text_casefolded": f"SELECT doc_id, sha256({sql_fold('text')}) AS folded_hash FROM documents WHERE text IS NOT NULL",
    "text_unaccented": f"SELECT item_id, {sql_bare(sql_clean('text'))} AS folded FROM dataset_keywords",
    "text_tokens": f"SELECT item_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM (SELECT item_id, {sql_tokens('text')} AS t FROM dataset_keywords)",
    "text_ngram_frequency": _NGRAMS + "SELECT ngram, texts FROM counted",
    "text_frequent_ngrams": f"""WITH token AS (SELECT scope_ref, {sql_tokens("text")} AS t FROM dataset_keywords WHERE text IS NOT NULL),
gram AS (SELECT scope_ref, unnest({sql_ngrams("t")}) AS ngram FROM token), n AS (SELECT scope_ref, count(*) AS n FROM token GROUP BY scope_ref)
SELECT scope_ref, ngram, count(*) AS texts FROM gram JOIN n USING (scope_ref) WHERE n >= 40 GROUP BY scope_ref, ngram, n HAVING count(*) >= greatest(8, (n + 9) // 10)""",
    "text_matches": " UNION ALL ".join(_sql_match(n, m) for n in NEEDLES for m in MODES),
    "text_segments": f"""
WITH doc AS (SELECT doc_id, regexp_replace(text, '{_EDGE}', '', 'g') AS c FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, c, list_filter(list_transform(string_split(c, chr(10)), lambda x: regexp_replace(x, '{_EDGE}', '', 'g')), lambda x: x <> '') AS l FROM doc WHERE c <> ''),
content AS (SELECT *, list_filter(l, lambda x: NOT {_CONTACT.format('x')}) AS k FROM line),
kept AS (SELECT doc_id, c, CASE WHEN len(k) > 0 THEN k ELSE l END AS k FROM content),
split AS (SELECT *, list_filter(k[3:], lambda x: {_HEAD.format('x')})[1:10] AS h, list_filter(k[3:], lambda x: NOT {_HEAD.format('x')}) AS b FROM kept),
chosen AS (SELECT doc_id, CASE WHEN length(c) <= 300 AND len(string_split(c, chr(10))) <= 2 THEN [c] WHEN len(k) <= 12 THEN k
  ELSE k[1:2] || h || CASE WHEN len(h) >= 10 THEN [] WHEN len(b) <= 10 - len(h) THEN b
    ELSE list_transform(range(0, 10 - len(h)), lambda i: b[CAST(floor(i * (len(b) / (10 - len(h)))) AS BIGINT) + 1]) END END AS s FROM split)
SELECT doc_id, i - 1 AS pos, s[i] AS segment FROM chosen, unnest(range(1, len(s) + 1)) AS t(i)""",
    "text_line_kinds": f"""SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {_HEAD.format('trim(x)')}) AS headings, count(*) FILTER (WHERE {_CONTACT.format('trim(x)')}) AS contacts
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) GROUP BY doc_id""",
    "text_acronyms": rf"""SELECT a AS acronym, count(*) AS uses, count(DISTINCT doc_id) AS documents
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_]+')) AS a FROM documents)
WHERE regexp_matches(a, '^[A-Z][A-Z0-9]{{1,7}}$') AND lower(a) NOT IN ('product', 'customer', 'company', 'website') GROUP BY a""",
    "text_generic_terms": f"""SELECT doc_id, term FROM (SELECT doc_id, {sql_bare('text')} AS f FROM documents WHERE text IS NOT NULL),
(SELECT unnest(['san pham', 'khach hang', 'cong ty', 'product', 'customer', 'company', 'website', 'dich vu']) AS term) WHERE contains(f, term)""",
    "hash_contents": f"SELECT item_id, sha256({sql_clean('nfc_normalize(text)')}) AS hash, sha256({sql_clean('nfc_normalize(text)')}) = content_hash AS agrees FROM dataset_keywords",
    "hash_items": _ITEMS + "SELECT item_id, item FROM item",
    "hash_batches": _ITEMS + """SELECT revision_id, batch_index, count(*) AS items, sha256('{"items":[' || string_agg(item, ',' ORDER BY ref, item) || ']}') AS digest FROM once GROUP BY ALL""",
    "hash_datasets": _ITEMS + f"""SELECT revision_id, count(*) AS items, sha256('{{"items":[' || string_agg(item, ',' ORDER BY ref, item) || '],"language":' || {_J("any_value(language)")} || ',"scope_ref":' || {_J("any_value(scope_ref)")} || '}}') AS digest
FROM whole GROUP BY revision_id""",
    "hash_inputs": _ITEMS + f""", words AS (SELECT revision_id, count(*) AS n, string_agg(keyword, ',' ORDER BY ref, keyword) AS w, {_J("any_value(language)")} AS l, {_J("any_value(scope_ref)")} AS s FROM word GROUP BY revision_id),
facts AS (SELECT revision_id, count(*) AS n, string_agg(evidence, ',' ORDER BY ref, evidence) AS e FROM fact GROUP BY revision_id)
SELECT w.revision_id, w.n + coalesce(f.n, 0) AS items, sha256('{{"industry_evidence":[' || coalesce(e, '') || '],"keywords":[' || w || '],"language":' || l || ',"scope_ref":' || s || '}}') AS digest FROM words w LEFT JOIN facts f USING (revision_id)""",
    "hash_topic_inputs": f"""WITH w AS (SELECT DISTINCT request_id, scope_ref, language, ref, '{{"ref":' || {_J("ref")} || ',"text":' || {_J(sql_clean("nfc_normalize(text)"))} || '}}' AS k FROM keyword_inputs
 WHERE request_id IS NOT NULL AND scope_ref IS NOT NULL AND ref IS NOT NULL AND text IS NOT NULL)
SELECT request_id, scope_ref, language, count(*) AS items, sha256('{{"keywords":[' || string_agg(k, ',' ORDER BY ref, k) || '],"language":' || {_J("any_value(language)")} || ',"site_ref":' || {_J("any_value(scope_ref)")} || '}}') AS digest FROM w GROUP BY request_id, scope_ref, language""",
    "hash_fingerprints": f"""SELECT id, sha256(replace(replace(replace('{_CONFIG}', '"@d"', {_J("dataset_hash")}), '"@l"', {_J("language")}), '"@s"', {_J("scope_ref")})) AS fingerprint FROM keyword_group_dataset_revisions WHERE dataset_hash IS NOT NULL""",
    "hash_targets": f"SELECT doc_id, sha256(t) AS digest FROM (SELECT doc_id, {sql_clean('nfc_normalize(text)')} AS t FROM documents) WHERE t <> ''",
    "text_namespaces": """SELECT DISTINCT scope_ref, language, 'keyword-group:' || scope_ref || CASE WHEN coalesce(trim(language), '') = '' THEN '' ELSE ':' || trim(language) END AS namespace,
'topic:' || scope_ref AS topic_namespace, 'onnx:mini-sem-multi:2' AS model_key FROM keyword_group_dataset_revisions""",
    "text_error_summaries": f"SELECT substr({sql_clean('error')}, 1, 500) AS error, count(*) AS rows FROM keyword_group_runs WHERE error IS NOT NULL GROUP BY 1",
}
