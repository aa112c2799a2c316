import hashlib
import random
import re

import pytest
from hard import frame

from rewardloom.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(lowered)]


def windows(text):
    found = [w for w, _, _ in cut(text)]
    return [tuple(found[i : i + 10]) for i in range(max(1, len(found) - 9))] if found else []


def expected(row, items):
    found = cut(row[1])
    hit, named = set(), set()
    for item_id, text in items:
        for w in windows(text):
            for i in range(len(found) - len(w) + 1):
                if tuple(x for x, _, _ in found[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    named |= {str(item_id)} if item_id is not None else set()
    return row[0], len(found), hit, sorted(named), found


ITEMS = [
    (1, "What is the capital of the land of w1 and w2, then? It is W3."),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"),
    (3, "É漢 ß"),
    (4, "w7"),
    (5, None),
    (6, ""),
    (7, " -- !"),
    (None, "no name here at all"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (8, "one one one one one one one one one one one"),
    (11, "w1 w2 w3"),
    (12, "w2 w3"),
]


def rows():
    rng = random.Random(4)
    out = []
    parts = [t for _, t in ITEMS if t] + ["alpha beta gamma", "one one one one one one one one one one one one", "Delta-Epsilon;", "ABC_def"]
    for k in range(80):
        text = " ".join(rng.choice(parts) if rng.random() < 0.4 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 14)))
        out.append((k, text.replace(" ", rng.choice([" ", "  ", "\n", ", "])), "en", "s", 0))
    out += [(100, "ALPHA, beta gamma-delta \x00epsilon zeta_eta theta;iota kappa 😀 lambda mu nu", "en", "s", 0), (101, "é漢 ß É漢 ß", None, None, None)]
    return [*out, (102, None, None, None, None), (103, "", "en", "s", 0), (104, "!?", "en", "s", 0), (None, "w7", "en", "s", 0), (None, "w7", "en", "s", 0)]


@pytest.mark.parametrize("most_words", [contamination.MOST_WORDS, 40])
def test_hits_items_and_places(spark, most_words):
    docs = rows()
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS row", "1 AS words")
    got = contamination.contamination(frame(spark, docs), benchmark, most_words=most_words).collect()
    want = [expected(r, ITEMS) for r in docs]
    seen = sorted(((r.doc_id, r.n_words, {w for s in r.spans for w in range(s.first, s.last + 1)}, r["items"]) for r in got), key=repr)
    assert seen == sorted((w[:4] for w in want), key=repr)
    texts, words = {r[0]: r[1] for r in docs}, {w[0]: w[4] for w in want}
    for r in got:
        assert all(a.last + 1 < b.first for a, b in zip(r.spans, r.spans[1:]))
        for s in r.spans:  # the place in the original text is that of the words
            assert (s.start, s.end) == (words[r.doc_id][s.first][1], words[r.doc_id][s.last][2])
            assert [w for w, _, _ in cut(texts[r.doc_id][s.start : s.end])] == [w for w, _, _ in words[r.doc_id][s.first : s.last + 1]]


def test_report(spark, hard, nothing):
    docs, df = hard
    benchmark = spark.createDataFrame([(9, docs[0][1]), (10, docs[5][1][5:300]), (11, docs[20][1])], "item_id long, text string")
    items = [tuple(r) for r in benchmark.collect()]
    got = sorted((tuple(r) for r in contamination.contamination_report(df, benchmark).collect()), key=repr)
    want = []
    for doc_id, n, hit, named, _ in (expected(r, items) for r in docs):
        want.append((doc_id, n, len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=repr)
    assert contamination.contamination_report(nothing, benchmark).collect() == []
    assert not any(r.contaminated for r in contamination.contamination_report(df, benchmark.limit(0)).collect())


def test_long_items_are_cut_with_overlap(spark):
    rng = random.Random(9)
    long = [f"x{rng.randrange(10_000)}" for _ in range(3000)]
    benchmark = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    docs = [(k, " ".join(long[k : k + 10]), "en", "s", 0) for k in range(0, 2991, 7)]
    got = contamination.contamination(frame(spark, docs), benchmark, most_words=500).collect()
    assert {(r.doc_id, len(r.spans), r.spans[0].first, r.spans[0].last) for r in got} == {(d[0], 1, 0, 9) for d in docs}
