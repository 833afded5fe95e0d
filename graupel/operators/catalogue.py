"""Terms of a catalogue in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graupel.functions.text import acronyms, casefold, collapse_blanks, has_token, is_generic, words


def catalogue_terms(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, ref, term, score): of each concept the first of its names that a document holds as whole words; 1.0 for names
    in capitals, else 0.9. General names do not count.

    docs: doc_id, text. catalogue: ref, names ARRAY<STRING>. Names meet documents by their first word, so no document meets the
    whole catalogue."""
    names = catalogue.select("ref", F.posexplode("names").alias("ordinal", "term")).where(~is_generic("term"))
    names = names.withColumn("folded", collapse_blanks(casefold("term"))).withColumn("word", F.get(words("folded"), F.lit(0))).where("word IS NOT NULL")
    texts = docs.where("text IS NOT NULL").select("doc_id", collapse_blanks(casefold("text")).alias("body"))
    first_words = texts.select("doc_id", "body", F.explode(F.array_distinct(words("body"))).alias("word"))
    hits = first_words.join(names, "word").where(has_token(F.col("body"), F.col("folded")))
    best = hits.groupBy("doc_id", "ref").agg(F.min_by("term", "ordinal").alias("term"))
    return best.select("doc_id", "ref", "term", F.when((F.upper("term") == F.col("term")) & (F.lower("term") != F.col("term")), 1.0).otherwise(0.9).alias("score"))


def unknown_acronyms(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, acronym): acronyms that no concept has as a name."""
    known = catalogue.select(F.explode("names").alias("n")).select(casefold("n").alias("folded")).distinct()
    found = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(acronyms("text"))).alias("acronym"))
    return found.where(~is_generic("acronym")).withColumn("folded", casefold("acronym")).join(known, "folded", "left_anti").select("doc_id", "acronym")


def suggestions(docs: DataFrame, catalogue: DataFrame, pages: DataFrame, prefixes: tuple[str, ...], most: int = 2) -> DataFrame:
    """(doc_id, ref, term, score, rank): of each document its best terms: those of the catalogue, and acronyms it does not know
    for which a lookup found a page of one of the prefixes (0.8). Ties go to the earlier concept, then the smaller term.

    catalogue: ordinal, ref, names. pages: term, url (the answers of a lookup; one a term)."""
    known = catalogue_terms(docs, catalogue).join(catalogue.select("ref", "ordinal"), "ref")
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | F.startswith("url", F.lit(prefix))
    found = unknown_acronyms(docs, catalogue).withColumnRenamed("acronym", "term").join(pages.where(allowed), "term")
    looked_up = found.select("doc_id", F.concat(F.lit("wiki:"), casefold("term")).alias("ref"), "term", F.lit(0.8).alias("score"), F.lit(1_000_000).alias("ordinal"))
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal", "term")
    every = known.select("doc_id", "ref", "term", "score", "ordinal").unionByName(looked_up)
    return every.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most).drop("ordinal")
