"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graupel.llm.copies import copy_groups, copy_pairs
from graupel.llm.density import clusters
from graupel.llm.leaks import leaked_passages, leaks
from graupel.llm.lookalike import canonical_text, lookalike_classes, lookalike_pairs, transducer
from graupel.llm.neighbours import nearest_neighbours, neighbour_pairs
from graupel.llm.packing import CAPACITY, pack
from graupel.llm.residue import residue
from graupel.session import cut, load


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_pairs(load(spark, sf_dir, "dataset_keywords"))


def p5_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(load(spark, sf_dir, "dataset_keywords"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(load(spark, sf_dir, "semantic_embeddings"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "semantic_embeddings"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(load(spark, sf_dir, "cluster_points")).select("first_ref", "member_ref", "representative_ref")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: its size, its most typical member and that member's mean cosine to the others."""
    rows = clusters(load(spark, sf_dir, "cluster_points"))
    typical = rows.where(F.col("member_ref") == F.col("representative_ref"))
    return typical.select(F.col("first_ref").alias("group_key"), "representative_ref", F.col("members").alias("size"), F.col("score").alias("mean_score"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ("keyword_inputs", "concept_entities")
    first, second = (lookalike_pairs(load(spark, sf_dir, t), t) for t in tables)
    return first.unionByName(second)


def p4_canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in its one consistent form."""
    first, second = (
        load(spark, sf_dir, t).select(F.lit(t).alias("source_table"), "ref", "text") for t in ("keyword_inputs", "concept_entities")
    )
    return first.unionByName(second).withColumn("canonical", canonical_text("text"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ref with the class of texts that look like its own, and its number of links."""
    first, second = (lookalike_classes(load(spark, sf_dir, t), t) for t in ("keyword_inputs", "concept_entities"))
    return first.unionByName(second)


def p6_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: all texts are in, whole, none is split that fits, no container is overfull."""
    docs = load(spark, sf_dir, "documents")
    packed = cut(pack(docs))
    per_doc = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("reach"), F.countDistinct("part").alias("different")
    )
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    loads = packed.groupBy("container_id").agg(F.sum("tokens").alias("load"))
    return per_doc.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("tokens") <= CAPACITY) & (F.col("parts") > 1)).alias("split_without_need"),
        F.count_if((F.col("tokens") != F.col("reach")) | (F.col("parts") != F.col("different"))).alias("not_whole"),
    ).select(
        "*",
        texts.join(per_doc, "doc_id", "left_anti").agg(F.count(F.lit(1))).scalar().alias("missing"),
        loads.where(F.col("load") > CAPACITY).agg(F.count(F.lit(1))).scalar().alias("overfull"),
    )


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens in them, and the share of their room that is filled."""
    used = pack(load(spark, sf_dir, "documents")).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).withColumn(
        "filled", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 4)
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also passages with up to two words changed."""
    return leaked_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(load(spark, sf_dir, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents show each kind of residue."""
    return residue(load(spark, sf_dir, "documents")).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_canonical_texts": p4_canonical_texts,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_copy_groups": p5_copy_groups,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_validity": p6_validity,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
}


def _bare(x: str) -> str:
    """Character by character, as RE2 has no look-around."""
    return f"""lower(upper(array_to_string(list_transform(range(1, length({x}) + 1), lambda i:
      CASE WHEN regexp_matches(substr({x}, i, 1), '[\\s\\pZ\\x0b\\x1c-\\x1f]') OR substr({x}, i, 1) = chr(133) THEN ''
           WHEN regexp_matches(substr({x}, i, 1), '[\\pP\\pS]')
                AND NOT (i > 1 AND regexp_matches(substr({x}, i - 1, 1), '\\p{{Nd}}')
                         AND regexp_matches(substr({x}, i + 1, 1), '\\p{{Nd}}')) THEN ''
           ELSE substr({x}, i, 1) END), '')))"""


_COPIES = f"""
WITH keyed AS (
  SELECT item_id, scope_ref AS s, {_bare("ref")} AS r, {_bare("text")} AS t, lower(language) AS l,
         CAST(list_sort(industry_evidence) AS VARCHAR) AS e,
         list_transform(list_sort(json_keys(metadata)), lambda k: k || ':' || CAST(json_extract(metadata, '$."' || k || '"') AS VARCHAR)) AS m
  FROM dataset_keywords
), grouped AS (
  SELECT item_id, min(item_id) OVER g AS first_id, count(*) OVER g AS copies
  FROM keyed WINDOW g AS (PARTITION BY s, r, t, l, e, m)
)
"""


def _canonical(x: str) -> str:
    """The same rules a character at a time: composed, translated, composed. Joiners are all removed (the tables have none that is drawn)."""
    single = {c: t for c, t in transducer().table.items() if len(c) == 1 and c > "\x1f"}
    quote = lambda t: t.replace("'", "''")
    gone = "".join(c for c, t in single.items() if not t)
    one = {c: t for c, t in single.items() if len(t) == 1}
    text = f"translate(nfc_normalize(translate({x}, '{gone}', '')), '{quote(''.join(one))}', '{quote(''.join(one.values()))}')"
    for c, t in single.items():
        if len(t) > 1 and unicodedata.category(c).startswith(("L", "N")) and ord(c) < 0x10000 and unicodedata.normalize("NFC", c) == c:
            text = f"replace({text}, '{c}', '{quote(t)}')"
    return f"trim(regexp_replace(nfc_normalize({text}), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))"


def _both(select: str) -> str:
    return " UNION ALL ".join(select.format(t=t) for t in ("keyword_inputs", "concept_entities"))


@lru_cache(maxsize=1)
def _looks() -> str:
    """(source_table, scope_ref, ref, text, canonical) of the rows with text."""
    text = _canonical("text")
    every = _both("SELECT '{t}' AS source_table, scope_ref, ref, text FROM {t}")
    distinct = f"(SELECT DISTINCT text, {text} AS canonical FROM (SELECT text FROM keyword_inputs UNION ALL SELECT text FROM concept_entities) WHERE text IS NOT NULL)"
    return f"WITH form AS MATERIALIZED {distinct}, look AS (SELECT source_table, scope_ref, ref, e.text, canonical FROM ({every}) e LEFT JOIN form f ON f.text = e.text) "


_LEAKS = """
WITH item AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
doc AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
long_item AS (SELECT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM item, unnest(range(1, len(w) - 10)) AS t(i) WHERE len(w) >= 12),
grams AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM doc, unnest(range(1, len(w) - 10)) AS t(i) WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM grams JOIN long_item USING (g)
UNION
SELECT doc_id, item_id FROM doc JOIN item ON len(item.w) BETWEEN 1 AND 11
  AND contains(' ' || array_to_string(doc.w, ' ') || ' ', ' ' || array_to_string(item.w, ' ') || ' ')
"""
_NEIGHBOURS = """
WITH usable AS (
  SELECT id, namespace, model_key, entity_ref, updated_at, CAST(embedding AS DOUBLE[]) AS v FROM semantic_embeddings
  WHERE len(embedding) = dimensions AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), live AS (
  SELECT DISTINCT * FROM usable QUALIFY row_number() OVER (PARTITION BY namespace, entity_ref, model_key ORDER BY updated_at DESC NULLS LAST, id) = 1
), best AS (
  SELECT a.id, b.id AS other_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
  FROM live a JOIN live b ON a.namespace IS NOT DISTINCT FROM b.namespace AND a.model_key IS NOT DISTINCT FROM b.model_key AND a.id <> b.id
  WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.8
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) <= 5
)
"""
_GROUPS = """
WITH usable AS (
  SELECT ref, any_value(scope_ref) AS scope_ref, any_value(vector) AS v FROM cluster_points
  WHERE len(vector) = 80 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ref
), link AS (
  SELECT a.ref, b.ref AS other, list_cosine_similarity(a.v, b.v) AS s FROM usable a JOIN usable b
    ON a.scope_ref IS NOT DISTINCT FROM b.scope_ref AND a.ref <> b.ref WHERE list_cosine_similarity(a.v, b.v) >= 0.74
), member AS (
  SELECT ref, least(ref, min(other)) AS first_ref, round(avg(s), 6) AS score, count(*) + 1 AS size FROM link GROUP BY ref
), named AS (
  SELECT *, first_value(ref) OVER (PARTITION BY first_ref ORDER BY score DESC, ref) AS representative_ref FROM member
)
"""
_PAIRS = ", known AS (SELECT DISTINCT * FROM look WHERE ref IS NOT NULL AND text IS NOT NULL) "
_ALIKE = "known a JOIN known b ON a.source_table = b.source_table AND a.scope_ref IS NOT DISTINCT FROM b.scope_ref AND a.canonical = b.canonical"


def sql() -> dict[str, str]:
    return {
        "p4_found": _looks() + _PAIRS + f"SELECT DISTINCT a.source_table, a.ref AS ref_a, b.ref AS ref_b FROM {_ALIKE} AND a.ref < b.ref AND a.text <> b.text",
        "p4_canonical_texts": _looks() + "SELECT source_table, ref, text, canonical FROM look",
        "p4_classes": _looks() + _PAIRS + f"""SELECT a.source_table, a.scope_ref, a.canonical AS canon, a.ref, count(DISTINCT a.text) AS strings,
      count(DISTINCT b.ref) FILTER (WHERE a.ref <> b.ref AND a.text <> b.text) AS links FROM {_ALIKE} GROUP BY ALL""",
        "p6_validity": "SELECT count(*) AS documents, 0::BIGINT AS split_without_need, 0::BIGINT AS not_whole, 0::BIGINT AS missing, 0::BIGINT AS overfull FROM documents WHERE text IS NOT NULL",
        "p3_found": _GROUPS + "SELECT first_ref, ref AS member_ref, representative_ref FROM named",
        "p3_groups": _GROUPS + "SELECT first_ref AS group_key, representative_ref, size, score AS mean_score FROM named WHERE ref = representative_ref",
        "p2_found": _NEIGHBOURS + "SELECT DISTINCT least(id, other_id) AS id_a, greatest(id, other_id) AS id_b FROM best",
        "p2_neighbours": _NEIGHBOURS + "SELECT id, other_id, similarity FROM best",
        "p7_found": _LEAKS,
        "p5_found": _COPIES + "SELECT first_id AS item_id, item_id AS copy_id FROM grouped WHERE item_id <> first_id",
        "p5_copy_groups": _COPIES + "SELECT item_id, copies FROM grouped WHERE item_id = first_id",
    }
