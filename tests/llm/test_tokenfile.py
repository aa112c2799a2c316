import random
import zlib

import numpy as np
import pyarrow as pa
from hard import smallest

from rewardloom.llm import encoder, tokenfile


def test_encoder_gives_the_ids_of_the_library():
    rng = random.Random(1)
    letters = list("aZé ÅΣσς'’s.,!?:;0½²\t\n\r\x0b\x0c\x1c\x1d\x85\xa0 　 ñ漢字éͅǅ_-<>|İß😀​؀") + ["<|endoftext|>", "'s", " the", "ẛ̣"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["x" * 5000, " " * 3000]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        mine = encoder.Encoder(encoder.vocabulary_path(name), spaces)
        for text, whole in zip(texts, mine.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.ids, ascii(text)


def test_added_tokens_have_their_own_ids(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    rng = random.Random(2)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", " ", "  ", "\n", "b's", "é", "<|ENDOFTEXT|>", "\x1c", "endoftext"]
    texts = ["a <|endoftext|> b", "", "<|endoftext|>"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(2000)]
    odd = Tokenizer.from_file(encoder.vocabulary_path("byte_bpe_50k.json"))
    odd.add_tokens([AddedToken("endoftext", lstrip=True, normalized=True), "b's"])
    odd.save(str(tmp_path / "odd.json"))
    paths = [(encoder.vocabulary_path("byte_bpe_50k.json"), True), (encoder.vocabulary_path("word_bpe_49k.json"), False), (str(tmp_path / "odd.json"), True)]
    for path, spaces in paths:
        mine, library = encoder.Encoder(path, spaces), Tokenizer.from_file(path)
        for text in texts:
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(encoder, "REMEMBERED", 1000)
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        mine = encoder.Encoder(encoder.vocabulary_path(name), spaces)
        for text in (" ".join(f"word{k % 23}, and" for k in range(200)), "\n".join(f"line {k % 19}: it's" for k in range(300))):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids
        for kept in (mine._chunks, mine._spaced):
            assert sum(encoder.COST + len(k) + len(v) for k, v in kept.items()) <= 1000 + encoder.COST + 100


def test_encoder_on_single_spaces():
    """The way of most texts: words at single spaces, with line ends, marks and odd white space inside and at the ends."""
    rng = random.Random(5)
    words = ["a", "The", "it's", "end.", "x\ny", "p.\n\nq", "\t", "tab\tz", "ñandú,", "漢字", "12", "3.5%", "--", "😀", "e\u0301", "\n", "(b)", "q\x85r", "\u3000w", "'ll", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + rng.choice(["", " ", "\n", " \n"]) for _ in range(3000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        mine = encoder.Encoder(encoder.vocabulary_path(name), spaces)
        for text, whole in zip(texts, mine.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.ids, ascii(text)


def test_many_texts_at_once_have_the_ids_of_the_library(monkeypatch):
    rng = random.Random(7)
    words = ["a", "The", "it's", "end.", "x\ny", "p.\n\nq", "\t", "tab\tz", "\nz", "z\n", "", " ", "ñandú,", "漢字", "12", "😀", "e\u0301", "\x1c", "q\x85r", "\u3000w", "Ġ", "\xa0", "'ll", "<|endoftext|>", "\x00"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) + rng.choice(["", " ", "\n", " \n"]) for _ in range(3000)]
    plain = [" ".join(rng.choice(words[:6] + words[12:17]) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    for block, kept in ((encoder.BLOCK, encoder.KEPT), (5000, encoder.KEPT), (5000, 3000), (5000, 100)):
        monkeypatch.setattr(encoder, "BLOCK", block)
        monkeypatch.setattr(encoder, "KEPT", kept)
        for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
            mine = encoder.Encoder(encoder.vocabulary_path(name), spaces)
            for some in (texts, plain, ["", " ", "\n"], ["x" * 9000, "", "a b"], []):
                whole = mine.tokenizer.encode_batch(some, add_special_tokens=False)
                for kind in (pa.string(), pa.large_string()):
                    got = [ids.tolist() for ids in mine.encode_all(pa.array(["dropped", *some], kind)[1:])]
                    assert got == [w.ids for w in whole]
                    assert mine._known.nbytes + mine._known_ids.nbytes <= kept


def test_words_met_for_the_first_time_go_through_the_library_together(monkeypatch):
    """One call of the model for each new word was most of the time of op4."""
    made, make = [], encoder._Chunks._make
    monkeypatch.setattr(encoder._Chunks, "_make", lambda self, chunk: made.append(chunk) or make(self, chunk))
    mine = encoder.Encoder(encoder.vocabulary_path("byte_bpe_50k.json"), True)
    texts = [" ".join("".join(chr(97 + (k * 31 + j * 7 + i * i) % 26) for i in range(3 + (k + j) % 9)) + ",."[j % 2] for j in range(200)) for k in range(40)]
    got = [ids.tolist() for ids in mine.encode_all(pa.array(texts))]
    assert got == [w.ids for w in mine.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(made) <= 2 * len(texts)  # of first words, which have no space before them


def test_perfect_hash_fills_every_slot_once():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000, 4097):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        displacements, slots = tokenfile.perfect_hash(keys)
        assert sorted(slots.tolist()) == list(range(n))
        assert (tokenfile.slots_of(keys, displacements, n) == slots).all()


def test_documents_come_back_by_key(spark, hard, nothing):
    rows, df = hard
    tokenizer = encoder.Encoder(encoder.vocabulary_path("byte_bpe_50k.json"), True).tokenizer
    coded = [(r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")) for r in rows]
    got = tokenfile.token_report(df).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, i in coded), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in rows), key=smallest)
    assert tokenfile.token_report(nothing).collect() == []


def test_keys_that_are_not_there_give_nothing(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(0, 400, 2)], "doc_id long, text string")
    index, buckets = tokenfile.build_index(tokenfile.write_shards(docs))
    keys = spark.range(400).selectExpr("id AS doc_id", "0 AS repeat")
    assert sorted(r.doc_id for r in tokenfile.find(keys, index, buckets).collect()) == list(range(0, 400, 2))
