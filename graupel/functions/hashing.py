"""Canonical JSON (sorted fields, no blanks) and its SHA-256, as column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graupel.functions.text import normalize

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str, composed: bool = False) -> Column:
    return F.sha2(normalize(text, composed), 256)


def canonical_evidence(evidence: Column | str) -> Column:
    """Evidence in the order of (key, group_type); null is empty."""
    rows = F.transform(F.col(evidence) if isinstance(evidence, str) else evidence, lambda e: F.struct(e["key"].alias("group_type_key"), e["group_type"].alias("t")))
    ordered = F.transform(F.array_sort(rows), lambda e: F.struct(e["t"].alias("group_type"), e["group_type_key"].alias("key")))
    return F.coalesce(ordered, F.array().cast("array<struct<group_type:string,key:string>>"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, 2, F.length(listed) - 2)


def canonical_json(text: Column | str) -> Column:
    """A flat JSON object with sorted fields and no blanks; numbers keep their spelling (3.0 stays 3.0), nested values
    theirs. Null, and text that is no object, is {}."""
    source = F.col(text) if isinstance(text, str) else text
    raw = F.from_json(source, "map<string,string>")
    typed = F.from_json(source, "map<string,variant>")
    fields = F.transform(
        F.array_sort(F.map_keys(raw)),
        lambda k: F.concat(
            _quoted(k), F.lit(":"),
            F.coalesce(F.when(F.schema_of_variant(typed[k]) == "STRING", _quoted(raw[k])).otherwise(raw[k]), F.lit("null")),
        ),
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(fields, ","), F.lit("")), F.lit("}"))


def canonical_item(ref: Column | str, digest: Column | str, language: Column | str, evidence: str, metadata: str) -> Column:
    """One record as canonical JSON; `digest` is its content hash. `metadata` is JSON text, see canonical_json."""
    parts = {
        "content_hash": _quoted(_c(digest)), "industry_evidence": F.to_json(canonical_evidence(evidence), _KEEP_NULLS),
        "language": _quoted(_c(language)), "metadata": canonical_json(metadata), "ref": _quoted(_c(ref)),
    }
    return json_object(parts)


def json_object(parts: dict[str, Column]) -> Column:
    """An object from fields that are JSON already, in the order given."""
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def quoted(text: Column | str) -> Column:
    """A string as JSON; null is null."""
    return _quoted(_c(text))


def listed_digest(rows: DataFrame, keys: list[str], heads: tuple[str, ...] = ('{"items":[',)) -> DataFrame:
    """(keys, items, digest): SHA-256 over lists of a key's JSON items in the order of their refs.

    rows: keys, section INT, ref, item, tail. Section i begins with heads[i], items are joined by commas, and `tail` ends the
    text. Rows that are equal count once. A digest is sequential by nature: a key's items are streamed through one task, which holds
    one batch of them and the state of the hash, however many there are.
    """
    names = [f"k{i}" for i in range(len(keys))]
    types = [rows.schema[k].dataType.simpleString() for k in keys]
    flat = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "section", "ref", "item", "tail").distinct()
    ordered = flat.repartition(*names).sortWithinPartitions(*names, "section", "ref", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # key, digest so far, items, next section, tail
        done: list[tuple] = []

        def finish() -> None:
            key, digest, items, section, tail = state
            for head in heads[section:]:
                digest.update(head.encode())
            digest.update(tail.encode())
            done.append((*key, items, digest.hexdigest()))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, section, item, tail in zip(zip(*columns[: len(names)]), columns[-4], columns[-2], columns[-1]):
                if state is None or state[0] != key:
                    if state is not None:
                        finish()
                    state = [key, hashlib.sha256(), 0, 0, tail]
                between = "," if section < state[3] else "".join(heads[state[3] : section + 1])
                state[1].update((between + item).encode())
                state[2] += 1
                state[3] = section + 1
            if done:
                yield _records(done, batch.schema, names)
                done.clear()
        if state is not None:
            finish()
            yield _records(done, batch.schema, names)

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types)) + ", items bigint, digest string"
    found = ordered.mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "items", "digest")


def _records(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    fields = [schema.field(n) for n in names] + [pa.field("items", pa.int64()), pa.field("digest", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))


def batch_hash(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items, digest) of batches. items: keys, ref, item."""
    return listed_digest(items.withColumn("section", F.lit(0)).withColumn("tail", F.lit("]}")), keys)


def dataset_hash(items: DataFrame, keys: list[str], scope: str = "scope_ref", language: str = "language") -> DataFrame:
    """(keys, items, digest) of datasets. items: keys, scope and language of the dataset, ref, item."""
    tail = F.concat(F.lit("],"), F.substring(json_object({"language": quoted(language), "scope_ref": quoted(scope)}), 2, 1_000_000_000))
    return listed_digest(items.withColumn("section", F.lit(0)).withColumn("tail", tail), keys)


def fingerprint(config: dict[str, object], dataset_hash: Column | str, scope: Column | str, language: Column | str) -> Column:
    """SHA-256 of what a run depends on: the settings, and its dataset, scope and language, with sorted fields."""
    parts = {k: F.lit(json.dumps(v, ensure_ascii=False)) for k, v in config.items()}
    parts |= {"dataset_hash": quoted(dataset_hash), "language": quoted(language), "scope_ref": quoted(scope)}
    return F.sha2(json_object(dict(sorted(parts.items()))), 256)
