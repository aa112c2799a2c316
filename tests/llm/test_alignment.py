import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hard import frame

from rewardloom.llm import alignment
from rewardloom.llm.encoder import vocabulary_path


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def decoded(token):
    """The bytes of a byte-level token, by the table that byte-level decoders use."""
    table = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    symbols, n = {chr(b): b for b in table}, 0
    for b in range(256):
        if b not in table:
            symbols[chr(256 + n)] = b
            n += 1
    return bytes(symbols[c] for c in token)


def piece(text):
    return bytes([int(text[3:5], 16)]) if len(text) == 6 and text.startswith("<0x") else text.replace("▁", " ").encode()


def expected(tokenizers, texts):
    a, b = tokenizers
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a, raw_b = [decoded(a.id_to_token(k)) for k in ids_a], [piece(b.id_to_piece(k)) for k in ids_b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(None)
            continue
        spans_a, spans_b = (list(zip(np.r_[0, np.cumsum([*map(len, raw)])[:-1]].tolist(), np.cumsum([*map(len, raw)]).tolist())) for raw in (raw_a, raw_b))
        links = [(x, y) for x, (s, e) in zip(ids_a, spans_a) for y, (t, f) in zip(ids_b, spans_b) if s < f and t < e]
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, begin = [], 0
        for end in cuts:
            mine = [",".join(str(k) for k, (s, e) in zip(ids, spans) if begin <= s and e <= end) for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))]
            groups.append("|".join(mine))
            begin = end
        docs.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(link for d in docs if d for link in d[3])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            best = sum(counts[x] == highest[x[1]] for x in links)
            out.append((n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def odd_texts():
    rng = random.Random(8)
    letters = list("aZé ÅΣσ'’s.,!?:;0½²\t\n\r\x0b\x1c\x85\xa0 　 ñ漢字_-<>|İß😀​▁") + ["<|endoftext|>", "'s", " the", "<s>", "</s>", "<unk>", "<0x41>", "  ", " and", "\x00"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + [" ", "  ", "\n", "a ", " a", "a  b", "▁", "x" * 500, "né " * 400]


def check(spark, tokenizers, rows):
    got = sorted((tuple(r) for r in alignment.align(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, expected(tokenizers, [r[1] for r in rows]))), key=repr)


def test_odd_texts(spark, tokenizers):
    check(spark, tokenizers, [(k, t, "en", "s", 0) for k, t in enumerate(odd_texts())])


def test_awkward_rows_over_many_runs(spark, tokenizers, hard, nothing, monkeypatch):
    rows, _ = hard
    rows = [r if r[1] is None else (r[0], r[1][:3000], *r[2:]) for r in rows]  # the brute force is quadratic
    check(spark, tokenizers, rows)
    assert alignment.align(nothing).collect() == []
    align = alignment.Aligner(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    held, runs = alignment._Run(len(align.bytes_a)), []
    for doc_id, text, *_ in rows:
        held.add([doc_id], align([text]))
        if held.held > 300:
            runs, held = [*runs, held.cut(len(runs), 5)], alignment._Run(len(align.bytes_a))
    assert len(runs) > 10
    df = spark.createDataFrame([r for b in runs for r in b.to_pylist()], alignment._RUN)
    monkeypatch.setattr(alignment, "MERGED", 7)
    whole = {}
    for b in runs:
        for run, radixes, heads in zip(*(b.column(c).to_pylist() for c in ("run", "radix", "heads"))):
            for radix, head in zip(radixes, heads):
                whole.setdefault(radix, []).append((run, head))
    for heads in whole.values():
        small = list(alignment.count_pairs(heads))
        monkeypatch.setattr(alignment, "MERGED", 1 << 15)
        assert [(r, alignment._open(x)) for r, x in small] == [(r, alignment._open(x)) for r, x in alignment.count_pairs(heads)]
        monkeypatch.setattr(alignment, "MERGED", 7)
    got = alignment.contribute(df, alignment.counted(df)).collect()
    done = sum(len(b.column("docs").to_pylist()) for b in runs)
    assert done == len(runs) and len(got) == len(rows) - len(held.rows)


def test_forgotten_chunks_change_nothing(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    align = alignment.Aligner(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    texts = [" ".join(f"word{k % 23 + j}, and" for k in range(200)) for j in range(5)] + odd_texts()[:50]
    want = [(*w[:4], w[6]) for w in expected(tokenizers, texts)]
    assert [align([t])[0][0] for t in texts + texts] == want + want
    assert align(texts)[0] == want


def test_other_files_take_the_library(tokenizers, tmp_path):
    """A first tokenizer that is not of the plain byte-level kind, and a text that ends every way."""
    from tokenizers import pre_tokenizers

    a = tokenizers[0].from_file(vocabulary_path("byte_bpe_50k.json"))
    a.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), a.pre_tokenizer])
    a.save(str(tmp_path / "digits.json"))
    align = alignment.Aligner(str(tmp_path / "digits.json"), vocabulary_path("piece_bpe_32k.model"))
    assert align._ranked is None
    a.encode_special_tokens = True
    texts = ["in 1984 it was 12,345", "a  b\n", " x ", "1"]
    assert align(texts)[0] == [(*w[:4], w[6]) for w in expected((a, tokenizers[1]), texts)]
