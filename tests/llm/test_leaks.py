import random

import numpy as np
import pytest

from graupel.llm.leaks import PieceIndex, leaked_passages, leaks, myers, pieces_of, words_of

DOCS = "doc_id bigint, text string, edits int, item_id string"
ITEMS = "item_id bigint, text string, run_words int"


def _least(pattern, text):
    """Plain semi-global edit distance."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        p = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        t = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        pattern, text = np.array([[ord(c) for c in p]]), np.array([[*map(ord, t), -1, -1]]).reshape(1, -1)
        assert myers(pattern, text)[0] == _least(p, t)


def test_pieces_cover_the_window():
    for length in range(1, 20):
        for budget in range(5):
            parts = pieces_of(length, budget)
            assert len(parts) == min(budget + 1, length) and sum(n for _, n in parts) == length and all(n > 0 for _, n in parts)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_no_passage_within_the_budget_is_missed(budget):
    rng = random.Random(budget)
    for _ in range(150):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7 and doc:
            at = rng.randrange(len(doc))
            doc[at:at] = item
            for _ in range(rng.randint(0, 3)):
                doc[rng.randrange(len(doc))] = "z"
        width = min(8, len(item))
        least = min(_least(item[s : s + width], doc) for s in range(len(item) - width + 1))
        found = {i: e for n, i, e, _ in PieceIndex([(5, " ".join(item))], 8, budget).search(["x y", " ".join(doc), ""]) if n == 1}
        if least <= budget * width // 8:
            assert found.get(5) is not None and found[5] >= least
            if least == 0:
                assert found[5] == 0
        else:
            assert 5 not in found


def _exact(doc, item):
    d, i = words_of(doc), words_of(item)
    n = min(12, len(i))
    return n > 0 and any(d[a : a + n] == i[b : b + n] for b in range(len(i) - n + 1) for a in range(len(d) - n + 1))


def test_found_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 30]))), 1) for i in range(20)] + [(90, None, 1), (91, " ?! ", 1), (None, "a b c", 1)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([0, 5, 60]))]
        if rng.random() < 0.7:
            words[len(words) // 2 : len(words) // 2] = rng.choice(items[:20])[1].upper().split()[: rng.choice([5, 12, 40])]
        docs.append((i, rng.choice([" ", ", ", "_ \n"]).join(words), 1, "x"))
    docs += [(100, None, 1, "x"), (101, "", 1, "x"), (102, "ab " * 30000, 1, "x"), docs[0]]
    want = {(d[0], i[0]) for d in docs for i in items if d[1] and i[1] and i[0] is not None and _exact(d[1], i[1])}
    tables = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = leaks(*tables).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert {tuple(r) for r in leaks(*tables, block_chars=60).collect()} == want


def test_passages_with_edits_against_dynamic_programming(spark):
    """Planted windows with no, one, two and three words changed, lost or added."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(20)), 1) for i in range(12)]
    docs = []
    for i in range(48):
        own = items[i % 12][1].split()[4:16]
        for _ in range(i // 12):
            at = rng.randrange(1, len(own) - 1)
            own[at : at + rng.choice([0, 1])] = rng.choice([[], ["zzz"]])
        docs.append((i, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)]), 1, "x"))
    want = {}
    for d in docs:
        for i in items:
            words = i[1].split()
            least = min(_least(words[a : a + 12], d[1].split()) for a in range(9))
            if least <= 2:
                want[d[0], i[0]] = least
    found = {(r.doc_id, r.item_id): r.edits for r in leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert found == want and set(want.values()) == {0, 1, 2}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c", 0, "")], DOCS), spark.createDataFrame([(1, "a b c", 0)], ITEMS)
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0
    assert [r.run_words for r in leaked_passages(docs, items).collect()] == [3]
