import hashlib
import random
import re

import pytest
from hard import frame, smallest

from rewardloom.llm import substring


def plain(rows, size=50):
    """n_words, n_removed and digest per row, by listing every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            first[window] = min(first.get(window, r[0]), r[0], key=smallest)
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if smallest(first[tuple(w[i : i + size])]) < smallest(r[0]):
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_automaton_matches_windows():
    rng = random.Random(0)
    for _ in range(200):
        held = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for words in held:
            automaton.add(words)
        text = [bytes([97 + rng.randrange(3)]) for _ in range(40)]
        wanted = [e for e in range(5, 41) if any(text[e - 5 : e] == h[i : i + 5] for h in held for i in range(len(h) - 4))]
        assert automaton.window_ends(text, 5) == wanted


def test_awkward_documents(hard, nothing):
    rows, df = hard
    assert sorted((tuple(r)[:4] for r in substring.remove_repeats(df).collect()), key=repr) == plain(rows)
    assert substring.remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("chunk, share", [(4096, 4096), (64, 5)])
def test_small_vocabulary(spark, monkeypatch, chunk, share):
    """Passages in changing surroundings, with edits and periodic texts; small shards and copies of shards."""
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "SHARE", share)
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    passages = [some(rng.randrange(48, 120)) for _ in range(8)]
    rows = []
    for d in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.6 else some(rng.randrange(1, 80)) for _ in range(rng.randrange(5))]
        text = " ".join(parts)
        if text and rng.random() < 0.3:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((rng.choice([d, d, 3 * d]), text, None, None, None))
    rows = list({r[0]: r for r in rows}.values())
    rows += [(900, "a " * 300, None, None, None), (901, "a " * 120, None, None, None), (902, "a b " * 90, None, None, None), (903, "b a " * 60, None, None, None)]
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain(rows)
    assert all(0 <= r.n_by_hash <= r.n_removed for r in got)
