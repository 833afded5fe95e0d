import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from graupel.functions import hashing as H
from graupel.functions import text as T
from graupel.functions import vectors as V

TEXTS = ["  Máy lọc 　 khí ", "STRASSE straße", "été", "", "   ", None, "Ποιός", "đường ĐI", "a_b-c 1.5", "x" * 5000]


def _column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_and_casefold(spark):
    want = [None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for t in TEXTS]
    assert _column(spark, TEXTS, T.normalize) == want
    assert _column(spark, TEXTS, T.casefold) == [None if t is None else t.casefold() for t in TEXTS]


def test_fold_accents(spark):
    def plain(t):
        bare = unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "d"))
        return "".join(c for c in bare if not 0x300 <= ord(c) <= 0x36F).casefold()

    assert _column(spark, TEXTS, T.fold_accents) == [None if t is None else plain(t) for t in TEXTS]


def test_tokens_and_ngrams(spark):
    assert _column(spark, ["Máy lọc của KHÍ the best", "the", None], T.content_tokens) == [["máy", "lọc", "khí", "best"], [], None]
    grams = _column(spark, [["a", "b", "c"], ["a"], []], T.ngrams, "array<string>")
    assert [sorted(g) for g in grams] == [["a b", "a b c", "b c"], [], []]


@pytest.mark.parametrize(
    ("hay", "needle", "mode", "hit"),
    [
        ("Robot Hút Bụi", "robot hút bụi", "exact", True), ("robot x", "robot", "prefix", True), ("xrobot", "robot", "token", False),
        ("a (x) b", "(x)", "token", True), ("a.b+c", "b+c", "token", True), ("a b c", "b c", "phrase", True), ("ab c", "b c", "phrase", False),
        ("máy lọc", "may loc", "folded", True), ("máy", "may", "token", False), ("máy", "máy", "semantic", False), ("máy", " ", "phrase", False),
        ("a \\E b", "\\E", "token", True),
    ],
)
def test_match_modes(spark, hay, needle, mode, hit):
    row = spark.createDataFrame([(hay, needle)], "h string, n string").select(T.matches_value("h", "n", mode, composed=False).alias("m")).first()
    assert row.m is hit


def test_segments(spark):
    bodies = [f"This is body line number {i}." for i in range(40)]
    text = "\n".join(["Lead one.", "Lead two.", "Call our hotline now", *bodies[:20], "A heading without a stop", *bodies[20:]])
    (segments,) = _column(spark, [text], T.segments)
    assert segments[:3] == ["Lead one.", "Lead two.", "A heading without a stop"] and len(segments) == 12
    assert segments[3:] == [bodies[int(i * 40 / 9)] for i in range(9)]
    assert _column(spark, ["short", "", None], T.segments) == [["short"], [], None]


def test_canonical_json_keeps_spelling(spark):
    texts = ['{"b": 3.0, "a":"3", "c": null}', None, "no json", "{}"]
    assert _column(spark, texts, H.canonical_json) == ['{"a":"3","b":3.0,"c":null}', "{}", "{}", "{}"]


def test_item_is_compact_sorted_json(spark):
    rows = spark.createDataFrame(
        [("r1", " Tê n ", None, [("b", "y"), ("a", "z")], '{"k":1}')], "ref string, text string, language string, ev array<struct<key:string,group_type:string>>, meta string"
    )
    item = rows.select(H.canonical_item("ref", H.content_hash("text"), "language", "ev", "meta").alias("x")).first().x
    digest = hashlib.sha256("Tê n".encode()).hexdigest()
    want = {"content_hash": digest, "industry_evidence": [{"group_type": "z", "key": "a"}, {"group_type": "y", "key": "b"}], "language": None, "metadata": {"k": 1}, "ref": "r1"}
    assert item == json.dumps(want, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


# Digests of small datasets that other systems compute alike. (scope, language, records (ref, text, evidence, metadata), digest)
GOLDEN = [
    ("6", "vi", [("2", "on ap", [], "{}"), ("1", "may phat", [], "{}")], "9854bc334a230b16aa2242bb3ee4d2f83f9332ee533b7f73b3678611ecc070e3"),
    ("6", "vi", [("1", "  May   phat  ", [], "{}")], "4cd523bd04b0cc1703a44590b44a0c27307fb1caf4d1cceffe9aec8e2d2cbb94"),
    ("6", "vi", [("1", "may phat", [("b", "product"), ("a", "brand")], "{}")], "6db99d06b8300f951ad2aa355bf6246a61f1b10a305cdfbd41d5d9a7104ac634"),
    ("6", None, [("1", "may phat", [], "{}")], "ee7d6712eb3449e64154c17ddf216949268c87080dc5e5afa5072c14097a001e"),
    ("6", "vi", [("1", "may phat", [], '{"source": "inventory"}')], "c12d7f4af42df464079bb10d203f6de80c6fd7fb4293785cb475d63467a7cdca"),
    ("6", "vi", [("1", "  Máy   phát  ", None, None)], "06662233cdf3b37922886e43984fddf3dacfc8cfdacc8d70ee1f2922dcce573d"),
]


def test_dataset_digests(spark):
    rows = [(n, scope, language, *record) for n, (scope, language, records, _) in enumerate(GOLDEN) for record in records]
    table = spark.createDataFrame(rows, "n int, scope_ref string, language string, ref string, text string, ev array<struct<key:string,group_type:string>>, meta string")
    items = table.withColumn("item", H.canonical_item("ref", H.content_hash("text"), "language", "ev", "meta"))
    found = {r.n: (r["items"], r.digest) for r in H.dataset_hash(items.unionByName(items), ["n"]).collect()}
    assert found == {n: (len(records), digest) for n, (_, _, records, digest) in enumerate(GOLDEN)}
    assert H.dataset_hash(items.limit(0), ["n"]).count() == 0
    assert [r.digest for r in H.batch_hash(items.where("n = 3"), ["n"]).collect()] == [hashlib.sha256(b'{"items":[' + items.where("n = 3").first()["item"].encode() + b"]}").hexdigest()]


def test_fingerprint_is_that_of_sorted_json(spark):
    config = {"b": 0.5, "z": "x", "a": 3}
    got = spark.range(1).select(H.fingerprint(config, F.lit("d"), F.lit('s"'), F.lit(None)).alias("f")).first().f
    want = json.dumps(config | {"dataset_hash": "d", "scope_ref": 's"', "language": None}, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize(("text", "form"), [(" Ｂảo-hành! ", "bảo hành"), ("ﬁx_it ①", "fix_it 1"), ("", ""), (None, None), ("Straße", "strasse")])
def test_routing_form(spark, text, form):
    assert _column(spark, [text], T.routing_form) == [form]


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.c for r in rows.select(V.cosine("a", "b").alias("c")).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[2] is None and got[3] is None


def test_nearest_rank_is_half_even(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in range(6)], "k int, x double")
    assert rows.groupBy("k").agg(V.nearest_rank(F.collect_list("x"), 0.9).alias("p")).first().p == 4.0
