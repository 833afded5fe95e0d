"""Evaluation texts leaking into training text.

Pigeonhole matching: a window of `window` words that occurs with at most `budget` word edits, cut into
budget + 1 pieces, has at least one piece that occurs without any. The pieces of all items are kept as sorted
hashes of word numbers; a batch of documents is looked up in them at once, and each hit is verified with Myers'
bit-parallel edit distance, of many windows at a time. The corpus is neither shuffled nor copied: only the
items, a stated query set, travel to the tasks.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
BUDGET = 2
#: Items travel to the tasks in blocks of at most so many characters; each block is one pass over the corpus.
BLOCK_CHARS = 16_000_000
#: Words of documents looked up at a time, and windows compared at a time.
_WORDS_AT_ONCE, _AT_ONCE = 400_000, 100_000

_WORD = re.compile(r"[^\W_]+")
_SCHEMA = "doc_id bigint, item_id bigint, edits int, run_words int"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, case folded, of the composed text."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.casefold())


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row the least edit distance between the pattern and any stretch of the text, over word numbers (Myers 1999).
    Patterns have at most 64 words; -1 in a text stands for no word there, -2 for a word that no pattern has."""
    n, m = patterns.shape
    bits = np.uint64(1) << np.arange(m, dtype=np.uint64)
    one, top = np.uint64(1), np.uint64(1) << np.uint64(m - 1)
    pv, mv = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    full = pv[:1].copy()
    score = np.full(n, m, np.int64)
    best = score.copy()
    for column in texts.T:
        eq = ((patterns == column[:, None]) * bits).sum(axis=1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        there = column != -1
        score += there & ((ph & top) != 0)
        score -= there & ((mh & top) != 0)
        ph, mh = ph << one, mh << one
        new_pv, new_mv = (mh | ~(xv | ph)) & full, ph & xv & full
        pv, mv = np.where(there, new_pv, pv), np.where(there, new_mv, mv)
        np.minimum(best, score, out=best)
    return best


def pieces_of(length: int, budget: int) -> list[tuple[int, int]]:
    """A window of `length` words in budget + 1 pieces (fewer if it has fewer words), as (start, length)."""
    n = min(budget + 1, length)
    cuts = [length * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _grams(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` word numbers from each place on."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - length + 1, np.uint64)
    for i in range(length):
        h = (h ^ words[i : len(words) - length + 1 + i].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class PieceIndex:
    """The pieces of every window of every item in flat arrays: of each different piece (its length, and its start in the
    window) the sorted hashes and the places of their windows."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, budget: int = BUDGET) -> None:
        if window > 64:
            raise ValueError("a window has at most 64 words")
        self.window, self.budget, self.number, self.ids = window, budget, {}, []
        parts, sizes = [], []
        for item_id, text in items:
            if words := words_of(text):
                self.ids.append(item_id)
                parts.append(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32))
                sizes.append(len(words))
        self.words = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.words)) - self.starts[owner] if len(sizes) else np.empty(0, np.int64)
        width = np.minimum(window, self.sizes)
        #: [(width, piece start, piece length, sorted hashes, window starts in their order)]
        self.tables: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        for w in np.unique(width):
            begins = np.flatnonzero((width[owner] == w) & (place <= (self.sizes - w)[owner]))
            for at, length in pieces_of(int(w), budget):
                hashes = _grams(self.words, length)[begins + at]
                order = np.argsort(hashes, kind="stable")
                self.tables.append((int(w), at, length, hashes[order], begins[order].astype(np.int32)))

    def item_of(self, windows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, windows, side="right") - 1

    def _windows(self, words: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Different (window, where it would begin in the documents) of one width with a piece hit, some at a time."""
        seen = []
        for w, at, length, hashes, begins in self.tables:
            if w != width or not len(hashes):
                continue
            grams = _grams(words, length)
            low = np.searchsorted(hashes, grams)
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == grams)
            low, high = low[hit], np.searchsorted(hashes, grams[hit], side="right")
            seen.append((hit - at, low, high, begins))
        for origins, low, high, begins in seen:
            ends = np.cumsum(high - low)
            for start in range(0, int(ends[-1]) if len(ends) else 0, _AT_ONCE):
                k = np.arange(start, min(start + _AT_ONCE, int(ends[-1])))
                row = np.searchsorted(ends, k, side="right")
                yield begins[low[row] + k - (ends[row] - (high - low)[row])].astype(np.int64), origins[row]

    def search(self, texts: list[str], most: int | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, least edits, longest run of exact words) of every text and item with a window within `most` (at
        most the budget) edits."""
        most = self.budget if most is None else min(most, self.budget)
        batch: list[list[int]] = []
        first = size = 0
        for n, text in enumerate(texts):
            batch.append([self.number.get(w, -2) for w in words_of(text)])
            size += len(batch[-1])
            if size >= _WORDS_AT_ONCE or n == len(texts) - 1:
                yield from self._search(batch, first, most)
                batch, first, size = [], n + 1, 0

    def _search(self, batch: list[list[int]], first: int, most: int) -> Iterator[tuple[int, int, int, int]]:
        gap = 2 * 64  # no window reaches over it
        words = np.full(sum(map(len, batch)) + gap * (len(batch) + 1), -1, np.int32)
        begins = np.empty(len(batch), np.int64)
        at = gap
        for i, b in enumerate(batch):
            words[at : at + len(b)] = b
            begins[i], at = at, at + len(b) + gap
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for width in sorted({t[0] for t in self.tables}):
            limit = min(most, self.budget * width // self.window)  # a shorter item has its share of the budget
            for windows, origins in self._windows(words, width):
                patterns = self.words[windows[:, None] + np.arange(width)]
                reach = np.arange(-limit, width + limit)
                near = words[np.maximum(origins, limit)[:, None] + reach]
                # each word of the window that is not near costs an edit: most hits go here, the rest is verified
                lacking = sum(~(near == patterns[:, i : i + 1]).any(axis=1) for i in range(width))
                ok = np.flatnonzero(lacking <= limit)
                edits = myers(patterns[ok], near[ok])
                good = edits <= limit
                ok, edits = ok[good], edits[good]
                owners, docs = self.item_of(windows[ok]), np.searchsorted(begins, origins[ok] + limit, side="right") - 1
                for doc, item, e, window, origin in zip(docs.tolist(), owners.tolist(), edits.tolist(), windows[ok].tolist(), origins[ok].tolist()):
                    known, run = found.get((doc, item), (e, 0))
                    if e == 0 and (words[origin : origin + width] == self.words[window : window + width]).all():
                        run = max(run, self._run(words, item, window, origin))
                    found[doc, item] = min(known, e), run
        for (doc, item), (edits, run) in sorted(found.items()):
            yield first + doc, self.ids[item], edits, run

    def _run(self, words: np.ndarray, item: int, window: int, origin: int) -> int:
        """Length of the run of equal words on the diagonal of (window, origin)."""
        before, total = window - self.starts[item], self.sizes[item]
        base = origin - before
        low, high = max(0, -base), min(total, len(words) - base)
        same = np.zeros(total, bool)
        same[low:high] = words[base + low : base + high] == self.words[self.starts[item] + low : self.starts[item] + high]
        a = before - int(np.argmin(np.r_[same[:before][::-1], False]))
        return int(np.argmin(np.r_[same[a:], False]))


_indexes: dict[tuple, PieceIndex] = {}


def _index(key: tuple, block, window: int, budget: int) -> PieceIndex:
    """The block's index, built once a worker process and kept until another is asked for."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = PieceIndex(block.value, window, budget)
    return _indexes[key]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed to the driver and cut into blocks of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        if block and size + len(row.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def leaked_passages(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, block_chars: int = BLOCK_CHARS, most: int | None = None
) -> DataFrame:
    """(doc_id, item_id, edits, run_words): documents and items where a window of the item (`window` consecutive
    words, or all if it has fewer) occurs with at most `most` (None: `budget`) words inserted, removed or changed, for shorter
    items in proportion to their words. `edits` is the least number over all windows; `run_words` the longest run of equal words (0 unless edits is 0).

    Null texts, texts without words and null ids of either side are in no row. Repeated rows of a document come out
    as often; other columns are not read. Whole texts are searched.
    """
    corpus = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    sc = docs.sparkSession.sparkContext
    out = None
    for block in _blocks(items, block_chars):
        sent = sc.broadcast(block)
        key = (uuid.uuid4().hex, window, budget)

        def search(batches: Iterator[pd.DataFrame], sent=sent, key=key) -> Iterator[pd.DataFrame]:
            index = _index(key, sent, window, budget)
            for batch in batches:
                ids = batch["doc_id"].tolist()
                rows = [(ids[n], *found) for n, *found in index.search(batch["text"].tolist(), most)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "run_words"])

        part = corpus.mapInPandas(search, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def leaks(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """(doc_id, item_id) of the passages that occur word for word. Nothing with edits is verified."""
    return leaked_passages(docs, items, most=0, **parameters).select("doc_id", "item_id").distinct()
