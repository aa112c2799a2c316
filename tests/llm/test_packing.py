import random
import zlib

import numpy as np
import pyarrow as pa
from hard import smallest

from rewardloom.llm import encoder, packing


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[k]}):
            at = rooms.index(room)
            place(k + 1, rooms[:at] + [room - items[k]] + rooms[at + 1 :])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def sequences_of(counts, capacity):
    places = packing.plan(counts, capacity)
    key, each, sequence, offset = (places[c].to_numpy() for c in places.columns)
    out = {}
    for length in range(1, capacity + 1):
        for k in range(counts[length]):
            mine = (length << 48) + k
            at = np.searchsorted(key, mine, side="right") - 1
            d = mine - key[at]
            out.setdefault(int(sequence[at] + d // each[at]), []).append((int(offset[at] + d % each[at] * length), length))
    return out


def assert_gapless(sequences, capacity):
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_reduction_is_never_worse_than_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(150):
        capacity, n = int(rng.integers(5, 25)), int(rng.integers(1, 9))
        items = rng.integers(1, capacity + 1, n)
        counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = np.repeat(np.arange(capacity + 1), rest).tolist()
        best = fewest(items.tolist(), capacity)
        assert sum(times for times, _ in fixed) + (fewest(left, capacity) if left else 0) == best
        sequences = sequences_of(counts, capacity)
        assert_gapless(sequences, capacity)
        assert best <= len(sequences) <= best + 1


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(2)
    items = np.minimum(4096, (rng.lognormal(6, 1, 50_000) + 1).astype(int))
    counts = np.bincount(items, minlength=4097).astype(np.int64)
    small, large = packing.plan(counts, 4096), packing.plan(counts * 1000, 4096)
    assert len(large) < 3 * len(small)
    assert large["sequence"].max() + 1 <= 1.01 * -(-int(items.sum()) * 1000 // 4096)


def test_plan_of_few_lengths_is_small():
    """Two equal items beside each long one, and other small sets of lengths, in any number."""
    for lengths in ({2100: 100_000, 900: 200_000}, {2100: 100_001, 900: 200_003, 1000: 77}, {1300: 300_000}, {2000: 50_000, 1000: 99_999, 48: 7}):
        counts = np.zeros(4097, np.int64)
        for length, n in lengths.items():
            counts[length] = n
        places = packing.plan(counts, 4096)
        assert len(places) < 100
        assert places["sequence"].max() < 1.4 * sum(k * n for k, n in lengths.items()) / 4096 + 1
    small = np.zeros(25, np.int64)
    for capacity, a, b in ((24, 10, 7), (24, 12, 6), (23, 7, 7), (20, 9, 5)):
        for n, m in ((1, 2), (2, 3), (3, 4), (2, 5)):
            small[:] = 0
            small[a] += n
            small[b] += m
            items = np.repeat(np.arange(25), small).tolist()
            fixed, rest = packing.reduce_by_dominance(small[: capacity + 1], capacity)
            left = np.repeat(np.arange(capacity + 1), rest).tolist()
            assert sum(t for t, _ in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)


def test_new_words_of_letters_and_marks_go_through_the_library_together(monkeypatch):
    """One call of the model for each new word was most of the time of op9."""
    made, make = [], encoder._Chunks._make
    monkeypatch.setattr(encoder._Chunks, "_make", lambda self, chunk: made.append(chunk) or make(self, chunk))
    mine = encoder.Encoder(encoder.vocabulary_path("word_bpe_49k.json"), False)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinrstTHÉßÿü") for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", ",", ".", "!!", "***", "'"])
    texts = [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(200))) for _ in range(60)]
    got = [ids.tolist() for ids in mine.encode_all(pa.array(texts))]
    assert got == [w.ids for w in mine.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not made


def test_pieces_at_odd_characters_and_block_ends(monkeypatch):
    rng = random.Random(12)
    parts = ["a", "B", "é", "É", "Þ", "×", "ª", "µ", " ", " ", "\n", "\r\n", "\t", "\xa0", "\u3000", "\x1c", "\u0301", "\u0331", "\u0338", "'", "'s", "'T"]
    parts += ["l", "12", "<", "=", "</w>", "<|endoftext|>", "<|endof", "_", "İ", "Σ", "ſ", "ﬁ", "漢", "😀", "\x00", "H", "-", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 30]))) for _ in range(2000)] + ["é" * 20_000 + "." * 900, "", " ", "\n"]
    for block, kept in ((encoder.BLOCK, encoder.KEPT), (300, 2000), (1, 0)):
        monkeypatch.setattr(encoder, "BLOCK", block)
        monkeypatch.setattr(encoder, "KEPT", kept)
        mine = encoder.Encoder(encoder.vocabulary_path("word_bpe_49k.json"), False)
        some = texts if block > 1 else texts[:200]
        got = [ids.tolist() for ids in mine.encode_all(pa.array(some))]
        assert got == [w.ids for w in mine.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_documents(hard, nothing):
    rows, df = hard
    tokenizer = encoder.Encoder(encoder.vocabulary_path("word_bpe_49k.json"), False).tokenizer
    wanted = []
    for r in rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted.append((r[0], k, at, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(df).collect()
    order = lambda r: (smallest(r[0]), *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(wanted, key=order)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert_gapless(sequences, 4096)
    assert len(sequences) <= -(-sum(w[3] for w in wanted) // 4096) + 1
    assert packing.pack(nothing).collect() == []
