"""Visually identical text in one consistent form.

A transducer is compiled once from rules: for every grapheme cluster (a base character with its combining marks) that
Unicode composes, and for every look-alike letter with each of their marks, it holds the canonical cluster, checked for
conflicts; a text is rewritten in one pass, the longest match first. Other clusters (rare accents on rare letters) are
resolved by the same rules when first met. Look-alike letters are those of Latin, Cyrillic, Greek and Armenian; other scripts
keep theirs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graupel.operators.skew import join_unique
from graupel.session import cut

# Letters of other scripts with the shape of a Latin letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ә": "ə", "Ә": "Ə", "ӕ": "æ", "Ӕ": "Æ", "Ӡ": "Ʒ", "ӡ": "ʒ", "к": "ĸ",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "ν": "v", "κ": "ĸ", "ɛ": "ε",
}
ARMENIAN = {"Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "հ": "h", "ո": "n", "Տ": "S", "Լ": "L", "ց": "g", "զ": "q"}
#: Latin letters of one shape: eth and African D look as D with stroke.
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g"}
#: Hyphens of one shape; the second may not break.
HYPHENS = {"\u2010": "-", "\u2011": "-"}
LETTERS = CYRILLIC | GREEK | ARMENIAN | LATIN | HYPHENS
#: Format characters that are drawn.
DRAWN_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD])
#: Characters without shape that are no format characters.
SHAPELESS = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
#: Joiners are drawn between pictures, and after a sign that binds the next letter (combining class 9).
JOINERS = "\u200c\u200d"
PICTURES = "\u2190-\u21ff\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
BLANK_CONTROLS = "\t\n\x0b\x0c\r\x85\u2028\u2029"


def _shape(char: str) -> str:
    """The canonical base of one character without accents: "" if invisible, " " if blank."""
    code, category = ord(char), unicodedata.category(char)
    if code in SHAPELESS or category == "Cf" and code not in DRAWN_FORMATS:
        return ""
    if category == "Zs" or char in BLANK_CONTROLS:
        return " "
    kind, _, points = unicodedata.decomposition(char).partition(" ")
    if kind in ("<wide>", "<narrow>"):
        return "".join(_shape(chr(int(p, 16))) for p in points.split())
    if kind == "<compat>" and (category.startswith("L") or category == "Nl"):  # ligatures, Roman numerals, the micro sign
        parts = [chr(int(p, 16)) for p in points.split()]
        if all(unicodedata.category(p).startswith("L") for p in parts) and (len(parts) > 1 or category == "Nl" or code == 0xB5):
            return "".join(map(_shape, parts))
    return LETTERS.get(char) or char


def _resolve(cluster: str) -> str:
    """The rule behind the table: decompose, map every character, compose."""
    if len(cluster) > 1 and "\u200d" in cluster and re.match(f"[{PICTURES}]", cluster):
        return cluster.replace("\ufe0f", "")
    parts = unicodedata.normalize("NFD", cluster)
    shapes = [c if c in JOINERS and unicodedata.combining(parts[i - 1 : i] or " ") == 9 else _shape(c) for i, c in enumerate(parts)]
    return unicodedata.normalize("NFC", "".join(shapes))


class ConflictError(ValueError):
    """Two rules disagree, or a canonical form would be mapped again."""


class Transducer:
    def __init__(self) -> None:
        table: dict[str, str] = {}
        marks = []
        for code in range(0x80, sys.maxunicode + 1):
            if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0xE0000 or code >= 0xF0000:
                continue  # surrogates, composed Hangul, ideographs, private use: none is mapped
            char = chr(code)
            if unicodedata.category(char)[0] == "M" or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2:
                marks.append(code)  # also the Korean letters that compose with one before them
            target = _resolve(char)
            if target != char:
                table[char] = target
        for char in BLANK_CONTROLS[:5]:
            table[char] = " "
        composed = [unicodedata.normalize("NFD", chr(c)) for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))]
        accents = {m for form in composed for m in form[1:] if unicodedata.combining(m)}
        clusters = {form for form in composed if len(form) > 1} | {base + m for base in LETTERS for m in accents}
        self.table = table | {c: _resolve(c) for c in sorted(clusters)}
        self.check()
        mark = _char_class(marks)
        invisible = _char_class([ord(c) for c, t in table.items() if t == ""])
        single = _char_class([ord(c) for c in table] + marks)
        pictures = f"[{PICTURES}](?:[\ufe0f\U0001f3fb-\U0001f3ff]*\u200d[{PICTURES}])+\ufe0f?"
        # Longest match first: joined pictures, a base with marks (invisible characters may stand between), one mapped character.
        self._pattern = re.compile(f"{pictures}|[\\s\\S][{invisible}]*[{mark}][{mark}{invisible}]*|[{single}]")
        self._plain = re.compile(f"[{single}]")
        self._seen = dict(self.table)

    def check(self) -> None:
        """Every canonical form must be its own canonical form, and composed and decomposed spellings of one
        cluster must lead to the same form."""
        for source, target in self.table.items():
            if _resolve(target) != target:
                raise ConflictError(f"{source!r} -> {target!r} -> {_resolve(target)!r}")
            for form in ("NFC", "NFD"):
                if _resolve(unicodedata.normalize(form, source)) != target:
                    raise ConflictError(f"{form} of {source!r}")

    def _step(self, match: re.Match) -> str:
        cluster = match.group()
        found = self._seen.get(cluster)
        if found is None:
            found = _resolve(cluster)
            if len(self._seen) < 200_000:
                self._seen[cluster] = found
        return found

    def __call__(self, text: str | None) -> str | None:
        """Null stays null. The result has single blanks, and none around it."""
        if text is None:
            return None
        if not text.isascii() and self._plain.search(text):
            text = self._pattern.sub(self._step, text)
        return " ".join(text.split())


def _char_class(codes: list[int]) -> str:
    """Ranges for a regular expression's class."""
    out, codes = [], sorted(set(codes))
    start = last = None
    for c in [*codes, None]:
        if last is not None and c == last + 1:
            last = c
            continue
        if start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
        start = last = c
    return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(StringType())
def canonical_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts that look alike become equal, all others stay different. Null stays null."""
    step = transducer()
    for texts in batches:
        yield texts.map(step, na_action="ignore").astype(object).where(texts.notna(), None)


def _seen(rows: DataFrame) -> DataFrame:
    """(k1, k2, scope_ref, ref, raw, canon): each different (scope, ref, text) once; (k1, k2) is the scope and canonical text."""
    clean = rows.where(F.col("ref").isNotNull() & F.col("text").isNotNull()).select("scope_ref", "ref", "text").distinct()
    scope = F.coalesce(F.concat(F.lit("s"), "scope_ref"), F.lit("n"))
    return clean.select("scope_ref", "ref", F.xxhash64("text").alias("raw"), canonical_text("text").alias("canon")).select(
        F.xxhash64(scope, "canon").alias("k1"), F.xxhash64(F.lit(7), "canon", scope).alias("k2"), "scope_ref", "ref", "raw", "canon"
    )


def lookalike_classes(rows: DataFrame, source_table: str) -> DataFrame:
    """(source_table, scope_ref, canon, ref, strings, links): every ref with the canonical text of its class, how many different
    strings the class has for it, and its links: the other refs of the scope whose text looks the same but is another
    string. A ref with several texts is in the class of each.

    Nothing is paired: links are counts of the class less those of the ref's own string, both combined per task, so a class of
    a third of all rows costs a row a task. Null refs and texts are left out; a null scope is a scope; repeated rows count once.
    """
    per_ref = cut(_seen(rows).groupBy("k1", "k2", "scope_ref", "canon", "ref").agg(F.count(F.lit(1)).alias("strings"), F.min("raw").alias("raw")))
    # refs of one string only are no link of others with the same
    alone = per_ref.where("strings = 1").groupBy("k1", "k2", "raw").agg(F.count(F.lit(1)).alias("same"))
    refs = per_ref.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"))
    sizes = alone.join(refs, ["k1", "k2"]).select(F.xxhash64("k1", "k2", "raw").alias("key"), (F.col("refs") - F.col("same")).alias("others"))
    all_refs = refs.select(F.xxhash64("k1", "k2", F.lit(None).cast("bigint")).alias("key"), (F.col("refs") - 1).alias("others"))
    own = per_ref.withColumn("key", F.xxhash64("k1", "k2", F.when(F.col("strings") == 1, F.col("raw"))))
    linked = join_unique(own, sizes.unionByName(all_refs), "key")
    return linked.select(F.lit(source_table).alias("source_table"), "scope_ref", "canon", "ref", "strings", F.col("others").alias("links"))


#: Rows of a group on one side of a task of the pair query; larger groups are cut by a salt.
PAIR_ROWS = 2_000


def lookalike_pairs(rows: DataFrame, source_table: str, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(source_table, ref_a, ref_b): different refs of one scope whose texts look the same but are different
    strings, ref_a < ref_b.

    Repeated rows count once. Null refs and null texts are in no pair; a null scope is a scope. Groups in
    which every string is the same are dropped before the join, so delivered copies, however many, cost
    nothing there; a ref with several strings is paired through each of them, once per other ref. The left side of a group
    of more than `pair_rows` rows is spread over tasks by a salt, the right side goes to each of them.
    """
    seen = cut(_seen(rows).select("k1", "k2", "ref", "raw"))
    # The mixed groups: found by combining per task, so a group of a third of all rows is one row per task.
    groups = seen.groupBy("k1", "k2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    mixed = groups.select("k1", "k2", F.ceil(F.col("n") / pair_rows).cast("int").alias("salts"))
    rest = cut(seen.join(mixed, ["k1", "k2"]))
    a = rest.select("k1", "k2", F.col("ref").alias("ref_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("ref"), F.col("salts")).cast("int").alias("salt"))
    b = rest.select("k1", "k2", F.col("ref").alias("ref_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, ["k1", "k2", "salt"]).where("ref_a < ref_b AND raw_a <> raw_b")
    return pairs.select(F.lit(source_table).alias("source_table"), "ref_a", "ref_b").distinct()
