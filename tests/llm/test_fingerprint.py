import hashlib
import random

import numpy as np
from hard import smallest

from rewardloom.llm import fingerprint as fp


def test_extensions_agree_with_letters_one_by_one():
    rng, powers = random.Random(0), fp._Powers()
    for _ in range(60):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(1, 40))) for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        right = left = 0
        while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
            right += 1
        while left < i and left < j and a[i - left - 1] == b[j - left - 1]:
            left += 1
        both = np.array([i, i]), np.array([j, j])
        found = fp.common_extensions(fp.PrefixHashes(a, powers), both[0], fp.PrefixHashes(b, powers), both[1], np.array([0, 1]))
        assert found.tolist() == [right, left]


def test_span_hashes_are_equal_where_spans_are():
    rng, powers = random.Random(1), fp._Powers()
    text = "".join(rng.choices("abc\0漢", k=300))
    hashes = fp.PrefixHashes(text, powers)
    for length in (1, 3, 7):
        starts = np.arange(len(text) - length + 1)
        values = [tuple(v) for v in hashes.spans(starts, length).T.tolist()]
        spans = [text[s : s + length] for s in starts]
        assert len(set(values)) == len(set(spans)) == len(set(zip(values, spans)))


def test_likeness():
    powers = fp._Powers()
    near = lambda a, b: fp.likeness(fp.PrefixHashes(a, powers), fp.PrefixHashes(b, powers))
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdefghij ", k=4000)) for _ in range(2))
    assert near(a, a) == 1 and near("", "") == 1 and near(a, "") == near("", a) == 0
    assert near(a, b) < 0.05
    assert near(a, a[:1000] + "#" + a[1000:3000] + "##" + a[3000:]) > 0.95
    assert near(a, a[2000:] + a[:2000]) > 0.95
    assert near(a, a[:2000] + b[:2000]) > 0.49
    assert near("abcdefgh", "abcdefxy") == 0.75
    assert near("aaaa", "aa") <= 1


def test_report(hard, nothing):
    rows, df = hard
    got = fp.fingerprint_report(df).collect()
    assert len(got) == len(rows)
    powers, order = fp._Powers(), sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: smallest(r[0]))
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add((r.n_chars, r.fingerprint))
    for doc_id, text in order:
        assert (len(text), fp.PrefixHashes(text, powers).fingerprint) in by_text[doc_id]
    alone = [k for k in range(len(order)) if sum(r[0] == order[k][0] for r in rows) == 1]
    report = {r.doc_id: r for r in got}
    for k in alone:
        doc_id, text = order[k]
        if (k + 1) % len(order) in alone:
            edited = fp.edited_text(text, order[(k + 1) % len(order)][1])
            assert report[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert report[doc_id].edited_fingerprint == fp.PrefixHashes(edited, powers).fingerprint
            assert report[doc_id].near_edited >= 0.7
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.fingerprint_report(nothing).collect() == []


def test_one_row_is_its_own_neighbour(spark):
    row = fp.fingerprint_report(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert (row.doc_id, row.near_next) == (5, 1.0)
