import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graupel.llm.lookalike import ConflictError, Transducer, canonical_text, lookalike_classes, lookalike_pairs, transducer
from pyspark.sql import functions as F

SAME = [
    ("ﬁt", "fit"), ("ｋｅｙ１", "key1"), ("Маrkеt", "Market"), ("téa", "téa"), ("Ðá", "Đá"), ("a​b­", "ab"), ("a  b", "a b"), ("﻿x ", "x"),
    ("Bӑ̀ng", "Bằng"), ("gόp", "góp"), ("ё", "ë"), ("e​́", "é"), ("̀", "̀"), ("a b　", "a b"), ("ẩ", "ẩ"),
]
OTHER = [("5 m²", "5 m2"), ("H₂O", "H2O"), ("O", "0"), ("l", "1"), ("a", "A"), ("à", "a"), ("đ", "d"), ("и", "n"), ("ß", "ss"), ("З", "3"), ("½", "1/2"), ("ab", "a b"), ("к", "k"), ("\U0001f468\u200d\U0001f469", "\U0001f468\U0001f469"), ("\u0915\u094d\u200d\u0937", "\u0915\u094d\u0937")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    t = transducer()
    assert t(a) == t(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    t = transducer()
    assert t(a) != t(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aаеｋ́̂​ ﬁЁӑ")), max_size=30))
def test_idempotent_and_blind_to_composition(text):
    t = transducer()
    once = t(text)
    assert t(once) == once
    assert t(unicodedata.normalize("NFD", text)) == t(unicodedata.normalize("NFC", text))


def test_conflicts_are_found():
    t = Transducer.__new__(Transducer)
    t.table = {"а": "ӑ", "ё": "е"}
    with pytest.raises(ConflictError):
        t.check()


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    forms = [["tea", "tеa", "ｔea"], ["tée", "tée"], ["x"], [""], [None], ["z" * 30000, "z" * 30000 + "​"]]
    rows = [(rng.choice(["s", "t", None]), rng.choice([f"r{i}", f"r{i % 40}", None] if i % 9 == 0 else [f"r{i}"]), rng.choice(rng.choice(forms)), "k") for i in range(150)]
    rows += rows[:30] + [("s", f"hot{i}", "tea", "k") for i in range(60)]
    t = transducer()
    want = set()
    for a, b in itertools.product(set(rows), repeat=2):
        if a[0] == b[0] and None not in (a[1], b[1], a[2], b[2]) and a[1] < b[1] and a[2] != b[2] and t(a[2]) == t(b[2]):
            want.add(("q", a[1], b[1]))
    table = spark.createDataFrame(rows, "scope_ref string, ref string, text string, canon string")
    found = lookalike_pairs(table, "q").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert lookalike_pairs(table.limit(0), "q").count() == 0 and lookalike_classes(table.limit(0), "q").count() == 0
    assert {tuple(r) for r in lookalike_pairs(table, "q", pair_rows=7).collect()} == want
    links = {}
    for a, b in itertools.product({r[:3] for r in rows}, repeat=2):
        if a[0] == b[0] and None not in (a[1], b[1], a[2], b[2]) and a[1] != b[1] and a[2] != b[2] and t(a[2]) == t(b[2]):
            links.setdefault((a[0], t(a[2]), a[1]), set()).add(b[1])
    classes = lookalike_classes(table, "q").collect()
    known = {(a[0], t(a[2]), a[1]) for a in rows if None not in (a[1], a[2])}
    assert {(r.scope_ref, r.canon, r.ref): r.links for r in classes} == {k: len(links.get(k, ())) for k in known} and len(classes) == len(known)


def test_udf_keeps_nulls_and_long_texts(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "ﬁ" * 50000)], "i int, t string").select("i", canonical_text(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == [None, "", "fi" * 50000]
