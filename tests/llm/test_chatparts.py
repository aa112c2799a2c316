import hashlib

from pyspark.sql import functions as F

from rewardloom.llm import chatparts as cp

TURNS = f"conv_id long, turn long, role string, parts array<{cp.PART}>"


def test_escapes_are_undone_and_hide_controls(spark):
    texts = ["", "\\", "\\\\<s>", "<\\s>", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<<s>", "<|image|>\\<|image|>", "a\\", "<|im_end|<|im_end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cp.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", cp.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(mark in r.e for mark in cp.CONTROL)


def test_parts_become_placeholders(spark):
    parts = [("text", "look <|image|>: ", None, None), ("image", None, "img-1", 2), ("audio", "x", "snd", None), ("other", "odd", None, 1), ("document", None, None, 3), (None, None, None, None)]
    rows = [(1, 1, "assistant", [("text", "fine", None, None)]), (1, 0, "user", parts), (2, 0, None, None), (None, 5, "a\nb", []), (1, 1, "assistant", [("text", "fine", None, None)])]
    got = {r.conv_id: r for r in cp.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1].formatted == (
        "<|im_start|>user\nlook <\\|image|>: <|image|><|audio|>odd<|document|><|im_end|>\n" + 2 * "<|im_start|>assistant\nfine<|im_end|>\n"
    )
    assert [tuple(a) for a in got[1].attachments] == [("image", "img-1", 512), ("audio", "snd", 25), ("document", None, 1800)]
    assert got[1].attachment_tokens == 2337
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans] == ["fine", "fine"]
    assert got[2].formatted == "<|im_start|>\n<|im_end|>\n" and got[2].loss_spans == []
    back = spark.createDataFrame([(got[None].formatted,)], "f string").select(cp.read_turns(F.col("f")).alias("t")).first().t
    assert [tuple(t) for t in back] == [("a\nb", "")]


def test_digest(spark):
    rows = [(1, 1, "assistant", "é" * 3), (1, 0, "user", None), (1, 2, "assistant", "</s>"), (3, 0, None, "x"), (None, 0, "assistant", "n" * 50_000), (1, 1, "assistant", "a tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in cp.chat_digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 3, None, -1}
    assert got[1].turns_sha256 == sha("user\n\nassistant\na tie\nassistant\néée\n".replace("éée", "ééé") + "assistant\n</s>\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 12, sha("a tieééé</s>"))
    assert (got[3].loss_chars, got[3].loss_sha256) == (0, sha(""))
    probe = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].loss_sha256) == (2, sha(probe))
    assert got[-1].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n")
    assert cp.chat_digest(df.limit(0)).count() == 1
