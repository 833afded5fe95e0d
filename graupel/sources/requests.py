"""JSON requests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = "array<struct<ref:string,text:string>>"
REQUEST = f"site_ref string, language string, keywords {KEYWORDS}"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(site_ref, language, ref, text): each file is an object with keywords, or a bare list of them (then of the local
    Vietnamese site)."""
    files = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
    bare = F.startswith("j", F.lit("["))
    parsed = files.select(F.when(bare, F.from_json("j", KEYWORDS)).alias("bare"), F.when(~bare, F.from_json("j", REQUEST)).alias("r"))
    keywords = F.explode(F.coalesce("bare", "r.keywords")).alias("k")
    rows = parsed.select(F.coalesce("r.site_ref", F.lit("local")).alias("site_ref"), F.coalesce("r.language", F.lit("vi")).alias("language"), keywords)
    return rows.select("site_ref", "language", "k.ref", "k.text")


def valid_keywords(rows: DataFrame, longest: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows with normal text, rejected rows with a reason): blank or missing refs and texts, texts that are too long, and refs
    that occur twice are rejected."""
    from graupel.functions.text import normalize

    clean = rows.withColumn("text", normalize("text")).withColumn("ref", F.trim("ref"))
    twice = clean.groupBy("ref").agg(F.count(F.lit(1)).alias("__n"))
    judged = clean.join(twice, "ref", "left").withColumn(
        "reason",
        F.when(F.coalesce("ref", F.lit("")) == "", "ref").when(F.coalesce("text", F.lit("")) == "", "blank")
        .when(F.length("text") > longest, "long").when(F.col("__n") > 1, "duplicate_ref"),
    ).drop("__n")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
