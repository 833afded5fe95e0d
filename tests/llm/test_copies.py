import json
import random
import unicodedata

import pytest

from graupel.llm.copies import HOT_LEAST, HOT_SHARE, _hot_keys, bare_text, copy_groups, copy_pairs
from pyspark.sql import functions as F

SCHEMA = (
    "item_id bigint, scope_ref string, ref string, text string, language string, "
    "industry_evidence array<struct<key:string,group_type:string>>, metadata string, k1 bigint, first_id int, copies int"
)


def _bare(t):
    if t is None:
        return None
    out = []
    for i, c in enumerate(t):
        kind = unicodedata.category(c)
        if c.isspace() or kind[0] == "Z":
            continue
        if kind[0] in "PS" and not (0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit()):
            continue
        out.append(c)
    return "".join(out).casefold()


def _key(r):
    _, scope, ref, text, language, evidence, metadata = r[:7]
    data = metadata if metadata is None else json.dumps(json.loads(metadata), sort_keys=True)
    return (scope, _bare(ref), _bare(text), language and language.lower(), None if evidence is None else tuple(sorted(evidence)), data)


def _rows(n=600, seed=2):
    rng = random.Random(seed)
    base = [("tea maker 1.5 l", "q-1"), ("tea maker 15 l", "q-1"), ("ấm trà", "q-2"), ("am tra", "q-2"), ("", ""), (None, None), ("straße", "x"), ("x" * 20000, "long")]
    out = []
    for i in range(n):
        text, ref = rng.choice(base) if rng.random() > 0.33 else base[0]
        if text and rng.random() < 0.5:
            text = rng.choice([text.upper(), text.replace(" ", "  "), f" {text}!", text.replace(" ", " - "), f"“{text}”"])
        evidence = rng.choice([None, [], [("a", "b"), ("c", "d")], [("c", "d"), ("a", "b")]])
        metadata = rng.choice([None, "{}", '{"a":1,"b":"x"}', '{ "b" : "x", "a" : 1 }', '{"a":2}'])
        out.append((i, rng.choice(["s", None]), ref, text, rng.choice(["vi", "VI", None]), evidence, metadata, 1, 2, 3))
    return out


@pytest.mark.parametrize("limits", [{}, {"share": 0.01, "least": 3}])
def test_pairs_against_brute_force(spark, limits):
    rows = _rows()
    groups = {}
    for r in rows:
        groups.setdefault(_key(r), []).append(r[0])
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    table = spark.createDataFrame(rows, SCHEMA)
    assert {(r.item_id, r.copy_id) for r in copy_pairs(table, **limits).collect()} == want
    assert {(r.item_id, r.copies) for r in copy_groups(table, **limits).collect()} == {(min(g), len(g)) for g in groups.values()}


def test_hot_keys_take_two_salted_levels(spark):
    """With production parameters a key with a third of the rows goes through (key, salt), and no window sees it."""
    found = copy_pairs(spark.createDataFrame(_rows(), SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "pmod(item_id" in plan and "LeftAnti" in plan
    keyed = spark.createDataFrame([(1, 1, i) for i in range(50)] + [(i, 2, 100 + i) for i in range(50)], "k1 bigint, k2 bigint, item_id bigint")
    assert [tuple(r) for r in _hot_keys(keyed, HOT_SHARE, HOT_LEAST).collect()] == [(1, 1)]


def test_empty(spark):
    assert copy_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["a.b", "1.5", "1..5", "v 1 . 5", "ＡＢＣ", "١.٢", "é-É", "a 　b\r\n", "…", "Straße ΣΑΣ ς"])
def test_bare_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(bare_text(F.col("t")).alias("b")).first().b
    assert got == _bare(text)
