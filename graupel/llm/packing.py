"""Filling fixed-capacity containers: documents in space-filling-curve order, packed with their neighbours.

Every text is tokenised once and reduced to a narrow row: its number of tokens and the Hilbert key of its
hashed token vector, projected to few dimensions. The rows are range-sorted by key; each range is packed as a
stream, best fit decreasing over a window of neighbours, with a bounded number of containers left open.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import erf

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graupel.session import cut, shuffle_partitions

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the word pattern of byte-level BPE.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HASHED = 1024
AXES = 4
BITS = 10
WINDOW = 4096
OPEN = 256
#: Containers a range should have at least: what stays unused at its end is at most one container in so many. And at most, however
#: many partitions there are: ranges grow with the data.
RANGE_CONTAINERS, MOST_CONTAINERS = 1000, 50_000
_TEXTS = 512


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((HASHED, AXES))


def curve_positions(texts: list[list[int]]) -> np.ndarray:
    """AXES coordinates of BITS bits of each document: token ids hashed to counts, their roots projected and spread
    evenly by the normal distribution. A text without tokens is at the origin."""
    out = np.zeros((len(texts), AXES), np.int64)
    for start in range(0, len(texts), _TEXTS):
        some = texts[start : start + _TEXTS]
        sizes = np.array([len(t) for t in some])
        tokens = np.fromiter(chain.from_iterable(some), np.uint64, int(sizes.sum()))
        hashed = (tokens * np.uint64(2654435761)) % np.uint64(HASHED)
        cells = np.repeat(np.arange(len(some)), sizes) * HASHED + hashed.astype(np.int64)
        weights = np.sqrt(np.bincount(cells, minlength=len(some) * HASHED).reshape(len(some), HASHED))
        x = weights @ _projection() / np.sqrt(np.maximum(sizes, 1))[:, None]
        share = 0.5 * (1 + np.array([erf(v / 1.4142135623730951) for v in x.ravel()]).reshape(x.shape))
        out[start : start + _TEXTS] = np.where(sizes[:, None] > 0, np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), 0)
    return out


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of each row of coordinates (transposed form, after Skilling 2004)."""
    x = np.array(points, dtype=np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b) & 1
    return key


def measured(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, place): narrow rows, a text that is null left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            ids = [encode(t) for t in batch["text"]]
            keys = hilbert_keys(curve_positions(ids))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(i) for i in ids], "place": keys})

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return rows.mapInPandas(run, "doc_id bigint, tokens bigint, place bigint")


class Packer:
    """Best fit over open containers, the largest of a window first. `open` holds (free, container), sorted."""

    def __init__(self, capacity: int, first: int, open_limit: int = OPEN) -> None:
        self.capacity, self.next, self.limit = capacity, first, open_limit
        self.open: list[tuple[int, int]] = []

    def place(self, sizes: list[int]) -> list[int]:
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            size = sizes[i]
            at = bisect_left(self.open, (size, -1))
            if at < len(self.open):
                free, container = self.open.pop(at)
            else:
                free, container = self.capacity, self.next
                self.next += 1
            out[i] = container
            if free > size:
                insort(self.open, (free - size, container))
        if len(self.open) > self.limit:  # the emptiest stay open for the next neighbours
            self.open = self.open[-self.limit :]
        return out


def pack(
    docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, window: int = WINDOW, range_containers: int = RANGE_CONTAINERS
) -> DataFrame:
    """(doc_id, part, first_token, tokens, container_id) for every text.

    A text within the capacity is one part. A larger one is split into full containers and a rest, which is packed as an
    item. Texts without tokens take no room in some container. Null texts and null ids are left out; a repeated id
    is packed as often as it comes. Equal keys are ordered by id, so a third of all rows with one text is spread over ranges.
    """
    sizes = cut(measured(docs, path))
    full, rest = F.floor(F.col("tokens") / capacity), F.col("tokens") % capacity
    last = F.when((rest > 0) | (full == 0), full).otherwise(full - 1)
    parts = sizes.select("doc_id", "place", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")).select(
        "doc_id", "place", "part", F.least(F.col("tokens") - F.col("part") * capacity, F.lit(capacity)).alias("size")
    )
    every = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    ranges = max(1, min(every // (capacity * range_containers), max(4 * shuffle_partitions(docs.sparkSession), every // (capacity * MOST_CONTAINERS))))
    spread = F.xxhash64("doc_id", "part")
    ordered = parts.repartitionByRange(ranges, "place", spread).sortWithinPartitions("place", spread, "doc_id", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        held = None
        for batch in chain(batches, [None]):  # windows do not depend on how rows come in batches
            if batch is not None:
                held = batch if held is None else pd.concat([held, batch])
            while held is not None and len(held) and (batch is None or len(held) >= window):
                rows, held = held.iloc[:window], held.iloc[window:]
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"], "part": rows["part"], "first_token": rows["part"] * capacity,
                        "tokens": rows["size"], "container_id": packer.place(rows["size"].tolist()),
                    }
                )

    return ordered.mapInPandas(run, "doc_id bigint, part bigint, first_token bigint, tokens bigint, container_id bigint")
