"""Distinct keys across runs."""

from pyspark.sql import functions as F

from rewardloom.operators.keyindex import KeyIndex, distinct_across_runs, first_rows, key_digest
from rewardloom.streaming import live


def docs(spark, a, b):
    prompt = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 41 == 1, F.lit(None)).otherwise(F.concat(F.lit("p"), F.col("id") % 37))
    return spark.range(a, b).select("id", prompt.alias("prompt"))


def wanted(spark, n):
    return sorted(r.i for r in docs(spark, 0, n).groupBy("prompt").agg(F.min("id").alias("i")).collect())


def test_runs_together_equal_one_distinct(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index"), buckets=3)
    firsts = {}
    for a in (0, 50, 100, 50):  # one of the runs is repeated
        firsts[a] = sorted(r.id for r in first_rows(docs(spark, a, a + 50), index, ["prompt"], "id", f"from {a}'").collect())
    assert sorted(i for ids in firsts.values() for i in ids) == wanted(spark, 150)
    keys = index.keys().collect()
    assert len(keys) == len({bytes(r.digest) for r in keys}) == len(wanted(spark, 150))


def test_an_index_is_opened_again(spark, tmp_path):
    path = str(tmp_path / "index")
    digest = key_digest(F.col("prompt"))
    KeyIndex(spark, path, buckets=3).add(docs(spark, 0, 60), digest, "id", "a")
    spark.sql(f"DROP TABLE {KeyIndex(spark, path).name}")  # as in a new session, which knows no such table
    again = KeyIndex(spark, path, buckets=50)
    assert again.buckets == 3
    again.add(docs(spark, 60, 120), digest, "id", "b")
    assert sorted(r.first_id for r in again.keys().collect()) == wanted(spark, 120)


def test_history_is_not_moved(spark, tmp_path):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    index = KeyIndex(spark, str(tmp_path / "index"), buckets=5)
    digest = key_digest(F.col("prompt"))
    for k in range(3):
        index.add(docs(spark, 100 * k, 100 * k + 100), digest, "id", f"r{k}")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        text = index.unseen(docs(spark, 300, 400), digest, "id", "r3")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)
    own, history = text.split("FileScan", 1)[0], text[text.rindex("SortMergeJoin") :]
    assert "Bucketed: true" in text and "SelectedBucketsCount: 5 out of 5" in text
    # The history is the second child of the join: between join and scan nothing is exchanged.
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines = history.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert above and not any("Exchange" in line for line in above) and "Exchange" in own


def test_stream_remembers_every_key(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    index = KeyIndex(spark, str(tmp_path / "index"), buckets=3)
    for a in (0, 80):
        docs(spark, a, a + 80).coalesce(1).write.mode("append").parquet(folder)
        distinct_across_runs(live.read_stream(spark, folder, docs(spark, 0, 1).schema), index, ["prompt"], "id", log)
    assert sorted(r.first_id for r in index.keys().collect()) == wanted(spark, 160)


def test_digest_tells_nulls_and_borders_apart(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), (None, "b"), ("-", "b"), ("a", None), (None, None)], "x string, y string")
    assert rows.select(key_digest(F.col("x"), F.col("y")).alias("d")).distinct().count() == 6
