"""Keyed tables: latest rows, upsert, lookup, delete; batches and commits as merges; vectors as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Of each key the row with the greatest `at` (nulls first), then the greatest `tie`. Keys may be null. An aggregate, so
    copies of a hot key combine in each task before the shuffle."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(F.col(at), F.col(tie))).alias("r")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest).select("r.*")


def upsert(store: DataFrame, batch: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The store after the batch: rows of the batch replace those of equal key; within each side the latest row holds."""
    both = store.withColumn("__side", F.lit(0)).unionByName(batch.withColumn("__side", F.lit(1)))
    order = F.struct(F.col("__side"), F.col(at), F.col(tie))
    newest = F.max_by(F.struct(*store.columns), order).alias("r")
    return both.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest).select("r.*")


def fitting(batch: DataFrame, dimensions: str = "dimensions", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with as many numbers as they state, at least one; the others)."""
    fit = F.coalesce((F.col(dimensions) > 0) & (F.size(vector) == F.col(dimensions)), F.lit(False))
    return batch.where(fit), batch.where(~fit)


def upsert_vectors(store: DataFrame, batch: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """upsert of a batch of vectors; rows that do not fit their dimensions are refused with an error."""
    good, bad = fitting(batch)
    if not bad.isEmpty():
        raise ValueError("vectors that do not have as many numbers as they state")
    return upsert(store, good, keys, at, tie)


def upsert_owned(store: DataFrame, batch: DataFrame, key: str, owner: str, at: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(store after the batch, acknowledged keys): a row of the batch replaces one of equal key only if it has the same owner;
    of several new rows of one key the earliest owner keeps it. A null owner owns nothing that is there."""
    first = batch.groupBy(key).agg(F.min_by(owner, F.struct(at, tie)).alias("__first"))
    held = store.groupBy(key).agg(F.max_by(owner, F.struct(at, tie)).alias("__held"), F.lit(True).alias("__there"))
    judged = batch.join(first, key).join(held, key, "left")
    mine = judged.where(F.when(F.col("__there"), F.col(owner) == F.col("__held")).otherwise(F.col(owner).eqNullSafe(F.col("__first"))))
    accepted = mine.select(*batch.columns)
    return upsert(store, accepted, [key], at, tie), accepted.select(key).distinct()


def put_batches(stored: DataFrame, sent: DataFrame, expected: DataFrame, keys: list[str], index: str, ref: str, digest: str, count: str, items: str) -> DataFrame:
    """(keys, index, outcome) of every batch sent: stored, idempotent (there with the same digest), or why it is refused: conflict
    (there with another), outside (not from 1 to the expected count), duplicate_ref (a ref twice in the batch), clash (a ref
    that another batch has), too_many (more items than expected with what is stored).

    stored, sent: keys, index, ref, digest (of the whole batch). expected: keys, count of batches, items. Batches sent together
    are judged each against what is stored."""
    batch = [*keys, index]
    facts = sent.groupBy(*batch).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct(ref).alias("__refs"), F.min(digest).alias("__digest"))
    there = stored.groupBy(*batch).agg(F.min(digest).alias("__was"))
    sizes = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
    others = stored.select(*keys, F.col(ref), F.col(index).alias("__other"))
    clash = sent.join(others, [*keys, ref]).where(F.col(index) != F.col("__other")).select(*batch).distinct().withColumn("__clash", F.lit(True))
    judged = facts.join(expected, keys, "left").join(there, batch, "left").join(sizes, keys, "left").join(clash, batch, "left")
    outcome = (
        F.when(~F.coalesce(F.col(index).between(1, F.col(count)), F.lit(False)), "outside").when(F.col("__refs") < F.col("__n"), "duplicate_ref")
        .when(F.col("__was").isNotNull(), F.when(F.col("__was") == F.col("__digest"), "idempotent").otherwise("conflict"))
        .when(F.coalesce("__have", F.lit(0)) + F.col("__n") > F.col(items), "too_many").when(F.col("__clash"), "clash").otherwise("stored")
    )
    return judged.select(*batch, outcome.alias("outcome"))


def commit_revisions(revisions: DataFrame, facts: DataFrame, referenced: DataFrame) -> DataFrame:
    """(id, outcome, before, before_outcome): what a commit of every staging revision gives: missing_batches, count_mismatch,
    hash_mismatch, stale (a newer one is committed), unchanged (the committed one has the same digest and count), or committed; and
    what becomes of the one committed before: retained if runs refer to it, else deleted.

    revisions: id, scope_ref, language, revision, status, dataset_hash, keyword_count, expected_batch_count, expected_keyword_count.
    facts: id, batches (different ones from 1 to the expected count), items, digest. referenced: id. A null language is a language."""
    staging = revisions.where("status = 'staging'").select("id", "scope_ref", "language", "revision", "dataset_hash", "expected_batch_count", "expected_keyword_count")
    live = latest(revisions.where("status = 'committed'").select("scope_ref", "language", "id", "revision", "dataset_hash", "keyword_count"), ["scope_ref", "language"], "revision", "id")
    live = live.select("scope_ref", F.col("language").alias("l"), F.col("id").alias("before"), F.col("revision").alias("r"), F.col("dataset_hash").alias("h"), F.col("keyword_count").alias("k"))
    refs = referenced.select(F.col("id").alias("before")).distinct().withColumn("used", F.lit(True))
    s, c = staging.alias("s"), live.alias("c")
    joined = s.join(c, (F.col("s.scope_ref") == F.col("c.scope_ref")) & F.col("s.language").eqNullSafe(F.col("c.l")), "left").join(facts, "id", "left").join(refs, "before", "left")
    items = F.coalesce("items", F.lit(0))
    outcome = (
        F.when(F.coalesce("batches", F.lit(0)) < F.col("expected_batch_count"), "missing_batches").when(items != F.col("expected_keyword_count"), "count_mismatch")
        .when(~F.col("digest").eqNullSafe(F.col("s.dataset_hash")), "hash_mismatch").when(F.col("r") > F.col("revision"), "stale")
        .when((F.col("h") == F.col("digest")) & (F.col("k") == items), "unchanged").otherwise("committed")
    )
    fate = F.when((outcome == "committed") & F.col("before").isNotNull(), F.when(F.col("used"), "retained").otherwise("deleted"))
    return joined.select("id", outcome.alias("outcome"), "before", fate.alias("before_outcome"))


def recover_stale(runs: DataFrame, now: Column, stale_seconds: int, attempt: Column, most_attempts: int) -> DataFrame:
    """runs after recovery: those running whose heartbeat is too old are queued again, or failed if they had their attempts."""
    dead = F.coalesce((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.make_dt_interval(secs=F.lit(stale_seconds))), F.lit(False))
    again, gone = dead & (attempt < most_attempts), dead & (attempt >= most_attempts)
    return runs.withColumns({
        "progress_phase": F.when(again, "requeued").when(gone, "failed").otherwise(F.col("progress_phase")),
        "error": F.when(gone, "worker heartbeat expired").otherwise(F.col("error")),
        "finished_at": F.when(gone, now).otherwise(F.col("finished_at")),
        "heartbeat_at": F.when(~again, F.col("heartbeat_at")),
        "status": F.when(again, "queued").when(gone, "failed").otherwise(F.col("status")),
    })


def oldest(rows: DataFrame, status: str, at: str, tie: str) -> DataFrame:
    """The row of a status that waits longest."""
    return rows.where(F.col("status") == status).orderBy(F.asc_nulls_first(at), tie).limit(1)


def vector_text(vector: Column) -> Column:
    """A vector as text of eight decimals in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def text_vector(text: Column) -> Column:
    """The numbers of such a text; null for null, empty for brackets without numbers."""
    inner = F.btrim(text, F.lit("[] "))
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double")))


def lookup(store: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(wanted.select(*keys).distinct(), keys, "left_semi")


def delete(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def missing_batches(rows: DataFrame, expected: DataFrame, keys: list[str], index: str, count: str) -> DataFrame:
    """(keys, received, missing): the batch numbers from 1 to the expected count that have no row. expected: keys, count.
    A key without rows misses all."""
    seen = rows.where(F.col(index).isNotNull()).groupBy(*keys).agg(F.collect_set(index).alias("s"))
    every = F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count).cast("int"))).otherwise(F.array().cast("array<int>"))
    got = F.coalesce("s", F.array().cast("array<int>"))
    return expected.join(seen, keys, "left").select(*keys, F.size(got).cast("bigint").alias("received"), F.array_except(every, got).alias("missing"))


def save_analysis(rows: DataFrame, path: str, key: str = "analysis_id") -> None:
    """Saves analyses as partitions of a table; one that is there is replaced whole, others stay."""
    write_partitioned(rows, path, key)


def read_analysis(spark: SparkSession, path: str, value: str, key: str = "analysis_id") -> DataFrame:
    """The rows of one analysis: only its partition is read."""
    return spark.read.parquet(path).where(F.col(key) == value)


def delete_analysis(spark: SparkSession, path: str, value: str, key: str = "analysis_id") -> bool:
    """Drops one analysis; whether it was there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that `rows` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
