import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graupel.llm.packing import CAPACITY, TOKENIZER, Packer, hilbert_keys, pack

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
SCHEMA = "doc_id bigint, text string, tokens string, part string, place int, container_id int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=300))
def test_packer_never_overfills_and_has_at_most_one_half_empty(sizes):
    packer = Packer(100, 0, open_limit=10_000)
    got = packer.place(sizes)
    load = {}
    for c, s in zip(got, sizes):
        load[c] = load.get(c, 0) + s
    assert all(v <= 100 for v in load.values())
    assert sum(1 for v in load.values() if v <= 50) <= 1


def test_hilbert_keys_are_a_curve():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = hilbert_keys(points, bits=3)
    assert sorted(keys) == list(range(side**3))
    ordered = points[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_pack_whole_table(spark):
    rng = random.Random(3)
    words = ["tea", "máy", "lọc", "khí", "Größe", "prix", "1.5", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 40, 300, 900]))), "", "", 0, 0) for i in range(400)]
    rows += [(1000 + i, "the same text", "", "", 0, 0) for i in range(200)] + [(2000, "word " * 9000, "", "", 0, 0), (2001, None, "", "", 0, 0), (2002, "   ", "", "", 0, 0)]
    found = pack(spark.createDataFrame(rows, SCHEMA)).collect()
    load, parts = {}, {}
    for r in found:
        load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append((r.part, r.first_token, r.tokens))
    assert set(parts) == {r[0] for r in rows if r[1] is not None}
    assert max(load.values()) <= CAPACITY
    for doc, pieces in parts.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(f == p * CAPACITY for p, f, _ in pieces)
        assert all(n == CAPACITY for _, _, n in pieces[:-1])
    assert len(parts[2000]) > 1 and sum(1 for v in load.values() if v <= CAPACITY / 2) <= 1


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
