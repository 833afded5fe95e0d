"""Text functions as column expressions. Only composition (NFC) needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words without content, Vietnamese and English.
FUNCTION_WORDS = tuple(
    "cho cua của va và voi với tai tại o ở cac các mot một nhung những la là thi thì ma mà neu nếu de để tu từ tren trên "
    "trong ngoai ngoài vao vào ra len lên xuong xuống bi bị duoc được nhu như hay hoac hoặc này nay kia do đó ay ấy the a "
    "an of and or for with at in on to from".split()
)
# Terms too general for a link.
GENERIC_TERMS = (
    "sản phẩm", "san pham", "khách hàng", "khach hang", "công ty", "cong ty", "product", "customer", "company", "website",
    "dịch vụ", "dich vu",
)
# Fixed value: lines that call for contact.
CONTACT_LINE = r"(hotline|email|gọi ngay|đặt lịch|liên hệ|inbox|nhận mẫu.*miễn phí|(?<![\p{L}\p{N}_])0\p{Nd}{8,10}(?![\p{L}\p{N}_]))"
CONTACT_LENGTH = 160
WORD = r"[\p{L}\p{N}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: an expression named several times, or inside a lambda, would be computed
    every time."""
    return F.transform(F.array(value), use)[0]


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore").astype(object).where(texts.notna(), None)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore").astype(object).where(texts.notna(), None)


@F.pandas_udf(StringType())
def full_casefold(texts: pd.Series) -> pd.Series:
    """Unicode's full case folding in Arrow batches; casefold() is its form in the JVM, without ligatures and rarer scripts."""
    return texts.map(str.casefold, na_action="ignore").astype(object).where(texts.notna(), None)


def collapse_blanks(text: Column | str) -> Column:
    """Runs of Unicode blanks become one space; none around the text."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize(text: Column | str, composed: bool = False) -> Column:
    """Composed text with single blanks. `composed`: the input is known to be NFC, so all stays in the JVM."""
    return collapse_blanks(_c(text) if composed else nfc(_c(text)))


def casefold(text: Column | str) -> Column:
    """Full case folding: as lower(), but ß, long s and final sigma fold too."""
    return F.translate(F.replace(F.lower(_c(text)), F.lit("ß"), F.lit("ss")), "ſς", "sσ")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Composed letters and their bases, by rule: every character whose decomposition is a base and marks U+0300–036F."""
    source, target = ["đ", "Đ"], ["d", "d"]
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(m) <= 0x36F for m in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold_accents(text: Column | str) -> Column:
    source, target = _accent_table()
    bare = F.regexp_replace(F.translate(_c(text), source, target), "[̀-ͯ]", "")
    return casefold(bare)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(WORD), 0)


def content_tokens(text: Column | str, composed: bool = True) -> Column:
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return F.filter(words(casefold(normalize(text, composed))), lambda t: ~F.array_contains(stop, t))


def ngrams(tokens: Column | str, least: int = 2) -> Column:
    """All different runs of at least `least` tokens, joined by blanks."""
    return bind(_c(tokens), lambda t: _ngrams(t, least))


def _ngrams(t: Column, least: int) -> Column:
    n = F.size(t)
    every = F.flatten(
        F.transform(
            F.sequence(F.lit(least), n),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " ")),
        )
    )
    return F.when(n >= least, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def is_span(haystack: Column | str, needle: Column | str) -> Column:
    """The needle's tokens occur in a row among the haystack's; an empty needle does not."""
    h, n = _c(haystack), _c(needle)
    edge = "\u0001"
    flat = lambda x: F.concat(F.lit(edge), F.array_join(x, edge), F.lit(edge))
    return (F.size(n) > 0) & (F.size(n) <= F.size(h)) & F.contains(flat(h), flat(n))


def has_token(haystack: Column, needle: Column) -> Column:
    """The needle occurs with no letter, number or underscore next to it."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.trim(needle), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return (F.trim(needle) != "") & F.regexp_like(haystack, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))


def folds_case(mode: str, text: Column | None = None):
    """Whether a mode keeps accents; with a text, the text folded as the mode has it."""
    keeps = mode in {"exact", "prefix", "token", "phrase", "accent_sensitive"}
    return keeps if text is None else (casefold if keeps else fold_accents)(text)


def matches_form(form: Column, needle: Column | str, mode: str) -> Column:
    """As matches_value, of a text that is folded as the mode has it, with single blanks."""
    n = collapse_blanks(folds_case(mode, F.lit(needle) if isinstance(needle, str) else needle))
    if mode == "exact":
        hit = form == n
    elif mode == "prefix":
        hit = F.startswith(form, n)
    elif mode in {"token", "accent_sensitive"}:
        hit = has_token(form, n)
    else:
        pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
        hit = F.contains(pad(form), pad(n))
    return (n != "") & hit


def matches_value(haystack: Column | str, needle: Column | str, mode: str, composed: bool = True) -> Column:
    """exact, prefix, token (accent_sensitive), phrase; semantic never matches; any other mode is a phrase without accents."""
    if mode == "semantic":
        return F.lit(False)
    return matches_form(collapse_blanks(folds_case(mode, normalize(haystack, composed))), normalize(needle, composed), mode)


def is_contact_line(line: Column) -> Column:
    low = F.lower(F.trim(line))
    return (F.length(low) <= CONTACT_LENGTH) & low.rlike(CONTACT_LINE)


def is_heading(line: Column) -> Column:
    t = F.trim(line)
    return F.length(t).between(15, 120) & ~t.rlike(r"[.:!?;,]\z")


def segments(text: Column | str, limit: int = 12) -> Column:
    """Up to `limit` segments of a text: a short text is one; else its lines without contact lines (all lines, if none
    is left): two leading lines, then headings, then lines picked evenly from the rest."""
    return bind(collapse_edges(_c(text)), lambda clean: _segments(clean, limit))


def _segments(clean: Column, limit: int) -> Column:
    lines = F.filter(F.transform(F.split(clean, "\n"), collapse_edges), lambda x: x != "")
    chosen = bind(bind(lines, _kept), lambda ls: F.when(F.size(ls) <= limit, ls).otherwise(_chosen(ls, limit)))
    short = (F.length(clean) <= 300) & (F.size(F.split(clean, "\n")) <= 2)
    return F.when(clean == "", F.array().cast("array<string>")).when(short, F.array(clean)).otherwise(chosen)


def collapse_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _kept(lines: Column) -> Column:
    content = F.filter(lines, lambda x: ~is_contact_line(x))
    return F.when(F.size(content) > 0, content).otherwise(lines)


def _chosen(lines: Column, limit: int) -> Column:
    rest = F.slice(lines, 3, 100_000_000)
    heads = F.slice(F.filter(rest, is_heading), 1, limit - 2)
    return bind(F.struct(heads.alias("heads"), F.filter(rest, lambda x: ~is_heading(x)).alias("bodies")), lambda p: _picked(lines, p["heads"], p["bodies"], limit))


def _picked(lines: Column, heads: Column, bodies: Column, limit: int) -> Column:
    room = F.lit(limit - 2) - F.size(heads)
    strided = F.transform(
        F.sequence(F.lit(0), room - 1),
        lambda i: F.element_at(bodies, (F.floor(i * (F.size(bodies) / room)) + 1).cast("int")),
    )
    picked = F.when(room <= 0, F.array().cast("array<string>")).when(F.size(bodies) <= room, bodies).otherwise(strided)
    return F.concat(F.slice(lines, 1, 2), heads, picked)


def acronyms(text: Column | str) -> Column:
    """All words of 2 to 8 capitals and digits that begin with a capital, in order."""
    return F.filter(F.regexp_extract_all(_c(text), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike(r"^[A-Z][A-Z0-9]{1,7}\z"))


def is_generic(term: Column | str) -> Column:
    return fold_accents(term).isin(*{fold for fold in map(_fold_literal, GENERIC_TERMS)})


def _fold_literal(term: str) -> str:
    bare = unicodedata.normalize("NFD", term.replace("đ", "d").replace("Đ", "d"))
    return "".join(c for c in bare if not 0x300 <= ord(c) <= 0x36F).casefold()


def is_link(url: Column | str) -> Column:
    u = F.trim(_c(url))
    return F.coalesce(F.startswith(u, F.lit("https://")) | F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("/")), F.lit(False))


def summary(error: Column | str, length: int = 500) -> Column:
    return F.substring(collapse_blanks(error), 1, length)


def grouping_namespace(scope: Column | str, language: Column | str) -> Column:
    trimmed = F.coalesce(F.trim(_c(language)), F.lit(""))
    return F.concat(F.lit("keyword-group:"), _c(scope), F.when(trimmed == "", F.lit("")).otherwise(F.concat(F.lit(":"), trimmed)))


def topic_namespace(scope: Column | str) -> Column:
    return F.concat(F.lit("topic:"), _c(scope))


def model_key(provider: str, model: str, version: str) -> Column:
    return F.lit(f"{provider}:{model}:{version}")


def routing_form(text: Column | str) -> Column:
    """Compatible forms (NFKC), case folded, every run of other signs than letters, numbers and underscores one blank."""
    return F.trim(F.regexp_replace(full_casefold(nfkc(_c(text))), r"[^\p{L}\p{N}_]+", " "))
