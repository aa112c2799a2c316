"""Awkward documents: nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_row", "_size", "_salt", "fingerprint", "component_id", "tie", "_KEY", "copies", "length", "a.b"]


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, count=60):
    """Rows with shared passages, exact copies, near copies and every kind of gap; ids are not dense."""
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(45, 90)) for _ in range(6)]
    rows = []
    for k in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        rows.append((7 * k, " ".join(parts), rng.choice(["en", "fr"]), f"src{rng.randrange(4)}", 0))
    copied = rows[3]
    rows += [
        (1001, copied[1], "en", "src0", 1),
        (1002, copied[1].replace(" ", "  \n"), "en", "src1", 1),
        (1003, copied[1] + " tail", "fr", "src0", 1),
        (1004, None, "en", "src2", None),
        (1005, "", None, None, 0),
        (1006, " \t\n\x0b\x0c\r ", "fr", "src3", 0),
        (1007, "ÀÉ ß 漢字 😀 ñ", "fr", "src1", 0),
        (1008, "12 34 --", "en", None, 0),
        (1009, words(rng, 30_000), "en", "src2", 0),
        (1010, "A", "en", "src2", 0),
        (None, "no id here", "en", "src1", 0),
        (None, "no id here", "en", "src1", 0),
        (None, None, None, None, None),
    ]
    return rows + rows[5:8] + [rows[5]]


def frame(spark, rows, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        df = df.select("*", *[F.lit(f"extra {name}").alias(name) for name in CLASHING])
    return df.repartition(3)


def smallest(doc_id):
    """Order of ids with null first."""
    return (doc_id is not None, doc_id or 0)
