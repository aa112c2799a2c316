import zlib

import numpy as np

from rewardloom.llm import language as lid

FRENCH = "Le chat dort dans la maison et les enfants jouent avec une balle près de la rivière où ça coule"
ENGLISH = "The cat sleeps in the house and the children play with a ball near the river where it flows through"


def rows(n=240):
    out = []
    for k in range(n):
        words = (FRENCH if k % 3 == 0 else ENGLISH).split()
        rng = np.random.default_rng(k)
        out.append((k, " ".join(rng.choice(words, 40)), "fr" if k % 3 == 0 else "en", "s", 0))
    return out


def test_gradients_agree_with_differences():
    model = lid.ByteTagger(["a", "b", "c"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    windows, lengths, _ = lid.cut_windows([b"hello wor", b"ab", b"xyzxyzxyzxyz"], size=12)
    labels, rng = np.array([0, 1, 2]), np.random.default_rng(0)
    _, found = model.gradients(windows, lengths, labels)
    for name, weights in model.weights.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            if name == "table":
                at = (at[0], int(b"helo"[rng.integers(4)]), at[2])
            losses = []
            for step in (1e-4, -2e-4):
                weights[at] += step
                losses.append(model.gradients(windows, lengths, labels)[0])
            weights[at] += 1e-4
            assert abs((losses[0] - losses[1]) / 2e-4 - found[name][at]) < 1e-5


def test_windows_hold_every_byte_once():
    texts = [b"", b"a", b"b" * 128, b"c" * 129, b"d" * 1000]
    windows, lengths, owner = lid.cut_windows(texts)
    for k, text in enumerate(texts):
        assert b"".join(bytes(w[:n].astype(np.uint8)) for w, n, o in zip(windows, lengths, owner) if o == k) == text


def test_neighbours_in_a_batch_do_not_matter():
    model, texts = lid.ByteTagger(["a", "b"]), [b"first text", b"x" * 700, b"mid" * 50]
    together = model.pooled(texts)
    for text, row in zip(texts, together):
        np.testing.assert_allclose(model.pooled([text])[0], row, atol=1e-5)


def test_learns_and_handles_gaps(spark, nothing):
    from hard import SCHEMA

    odd = [(900, None, "en", None, None), (901, "", "en", "s", 0), (902, "12 -- 34 ²", None, "s", 0), (None, FRENCH, None, "s", 0), (903, FRENCH * 2000, None, "s", 0), (903, FRENCH * 2000, None, "s", 0)]
    df = spark.createDataFrame(rows() + odd, SCHEMA)
    got = lid.predict(df).collect()
    assert len(got) == 246
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[k] for k in (900, 901, 902, None, 903)] == ["und", "und", "und", "fr", "fr"]
    right = [by_id[r[0]] == r[2] for r in rows() if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean(right) > 0.95
    kept = lid.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(by_id) - {900, 901, 902}
    assert lid.predict(nothing).collect() == [] and lid.keep_known(nothing).collect() == []


def test_labels_of_held_out_documents_are_not_used(spark):
    from hard import SCHEMA

    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    some = spark.createDataFrame([(r[0], r[1], "xx" if held(r[0]) else r[2], r[3], 0) for r in rows()], SCHEMA)
    assert {r.lang_pred for r in lid.predict(some).collect()} == {"en", "fr"}
    none = spark.createDataFrame([(r[0], r[1], None, r[3], 0) for r in rows(20)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in lid.predict(none).collect()} == {("und", 0.0)}


def test_every_byte_has_a_label():
    assert len(lid.ByteTagger(["a", "b"]).labels("é" * 100)) == 200


def test_repeated_labelled_ids_send_one_row(spark, monkeypatch):
    """The sample is bounded by ids: a labelled id that stands thousands of times is one of them."""
    from rewardloom.llm import language

    texts = {"en": "the cat sat on the mat and then it ran away", "fr": "le chat est sur la table et puis il court"}
    rows = [(k, f"{texts[lang]} {k}", lang) for k in range(40) for lang in texts]
    ids = [r[0] for r in rows]
    rows += [rows[ids.index(3)]] * 3000
    docs = spark.createDataFrame([(2 * k + (lang == "fr"), t, lang) for k, t, lang in rows], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language.ByteTagger, "fit", lambda self, cut, lengths, labels: seen.append(len(labels)))
    assert language.train(docs, documents=10) is not None
    assert seen and seen[0] <= 2 * 10 * language.SAMPLE_WINDOWS
