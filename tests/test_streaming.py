"""Streaming forms over files that land in several batches."""

import pytest
from pyspark.sql import functions as F

from rewardloom.functions import scorers
from rewardloom.operators.groups import with_advantages
from rewardloom.streaming import live


def _land(spark, folder, parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)


def _scored(spark, n=240):
    """Groups of eight, three groups per hour; one group takes a third of an hour's rows more."""
    return spark.range(n).select(
        F.col("id").alias("rollout_id"),
        F.floor(F.col("id") / 8).cast("bigint").alias("group_id"),
        F.timestamp_seconds(F.lit(1_700_000_000 - 1_700_000_000 % 3600) + F.floor(F.col("id") / 24) * 3600).alias("ts"),
        (F.col("id") * 7 % 5).cast("double").alias("reward"),
    )


def test_group_advantages_equal_batch_over_many_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = _scored(spark)
    _land(spark, folder, [rows.where(F.col("rollout_id").between(k, k + 59)) for k in range(0, 240, 60)])
    stream = live.read_stream(spark, folder, rows.schema, files_per_batch=1)
    got = {r.rollout_id: r.advantage for r in live.group_advantage_stream(stream, "1 hour", "2 hours").collect()}
    batch = {r.rollout_id: r.advantage for r in with_advantages(rows).collect()}
    last = max(batch) // 24
    finished = {k: v for k, v in batch.items() if k // 24 < last - 2}
    assert set(finished) <= set(got)
    assert len(got) == len(set(got))
    for key, value in got.items():
        assert value == pytest.approx(batch[key])


def test_scores_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "<think>a</think><answer>b</answer>"), (2, "x")], "rollout_id bigint, completion string")
    _land(spark, folder, [rows.where("rollout_id = 1"), rows.where("rollout_id = 2")])
    score = lambda df: df.select("rollout_id", scorers.format_reward(F.col("completion")).alias("r"))
    streamed = live.score_stream(live.read_stream(spark, folder, rows.schema, files_per_batch=1), score)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, score(rows).collect()))


def test_running_totals_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(30).select(F.when(F.col("id") % 3 == 0, "eval").otherwise("train").alias("mode"), "id")
    _land(spark, folder, [rows.where("id < 10"), rows.where("id >= 10")])
    stream = live.read_stream(spark, folder, rows.schema, files_per_batch=1)
    got = {r["mode"]: r.total for r in live.running_totals(stream, F.col("id"), "mode").collect()}
    assert got == {"eval": sum(range(0, 30, 3)), "train": sum(i for i in range(30) if i % 3)}


def test_late_rows_are_kept_apart(spark, tmp_path):
    folder, home = (str(tmp_path / n) for n in ("in", "home"))
    at = lambda h, n: spark.range(n).select(F.timestamp_seconds(F.lit(h * 3600)).alias("ts"))
    schema = at(0, 1).schema
    for part in (at(100, 3), at(90, 2).union(at(99, 1)), at(101, 1)):
        _land(spark, folder, [part])
        counts = live.window_counts(live.read_stream(spark, folder, schema), "1 hour", "5 hours", home)
    got = {int(r.window_start.timestamp()) // 3600: r.points for r in counts.collect()}
    assert sorted(got.values()) == [1, 1, 3] and len(got) == 3
    late = live.late_rows(spark, home, schema).collect()
    assert [(r.reason, r.window_at, r.ts.timestamp()) for r in late] == [("window closed", 90 * 3600, 90 * 3600.0)] * 2


def test_accepted_and_late_rows_are_all_rows(spark, tmp_path):
    """Over four runs of shuffled rows, some without a time; what is accepted is exactly what a windowed aggregate keeps."""
    folder, home = (str(tmp_path / n) for n in ("in", "home"))
    rows = spark.range(400).select("id", F.when(F.col("id") % 50 != 7, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 977 % 400 * 900)).alias("ts"))
    for k in range(4):
        _land(spark, folder, [rows.where(F.col("id") % 4 == k)])
        stream = live.read_stream(spark, folder, rows.schema)
        counts = live.window_counts(stream, "1 hour", "30 hours", home)
    split = live.split_late(stream, "1 hour", "30 hours", home).collect()
    assert sorted(r.id for r in split) == list(range(400))
    late = live.late_rows(spark, home, rows.schema).collect()
    assert {r.id for r in late if r.reason == live.NO_TIME} == set(range(7, 400, 50))
    closed = {r.id for r in late if r.reason == live.WINDOW_CLOSED}
    assert closed and not closed & set(range(0, 400, 4))
    assert counts.agg(F.sum("points")).first()[0] == 400 - len(late)
    times = {r.id: r.ts for r in rows.collect()}
    mark = max(t for i, t in times.items() if t and i % 4 == 0).timestamp() - 30 * 3600
    assert {i for i in closed if i % 4 == 1} == {i for i, t in times.items() if t and i % 4 == 1 and t.timestamp() // 3600 * 3600 + 3600 <= mark}


def test_rows_after_the_end_are_late(spark, tmp_path):
    folder, home = (str(tmp_path / n) for n in ("in", "home"))
    rows = _scored(spark)
    for part, last in ((rows.where("rollout_id < 120"), True), (rows.where("rollout_id >= 120"), False)):
        _land(spark, folder, [part])
        done = live.group_advantage_stream(live.read_stream(spark, folder, rows.schema), "1 hour", "2 hours", home=home, last=last)
    assert sorted(r.rollout_id for r in done.collect()) == list(range(120))
    assert sorted(r.rollout_id for r in live.late_rows(spark, home, rows.schema).collect()) == list(range(120, 240))


def test_a_repeated_epoch_writes_its_rows_once(spark, tmp_path, monkeypatch):
    folder, home = (str(tmp_path / n) for n in ("in", "home"))
    rows = _scored(spark)
    _land(spark, folder, [rows])
    once = live.each_available

    def twice(stream, sink, checkpoint, mode="append"):
        once(stream, lambda batch, epoch: (sink(batch, epoch), sink(batch, epoch)), checkpoint, mode)

    monkeypatch.setattr(live, "each_available", twice)
    assert live.split_late(live.read_stream(spark, folder, rows.schema), "1 hour", "2 hours", home).count() == 240



def test_distinct_prompts_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([(k, f"p{k % 4}") for k in range(12)], "k bigint, prompt string")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("k")))
    _land(spark, folder, [rows.where("k < 6"), rows.where("k >= 6")])
    stream = live.read_stream(spark, folder, rows.schema, files_per_batch=1)
    got = live.distinct_stream(stream, "1 hour", "prompt").collect()
    assert sorted(r.prompt for r in got) == ["p0", "p1", "p2", "p3"]


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    """Two runs over two landings equal one batch, and the end closes what is open."""
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    rows = _scored(spark)
    for k, last in ((0, False), (120, True)):
        _land(spark, folder, [rows.where(F.col("rollout_id").between(k, k + 119))])
        stream = live.read_stream(spark, folder, rows.schema)
        got = live.group_advantage_stream(stream, "1 hour", "2 hours", home=home, last=last).collect()
        points = stream.select("ts", F.lit("m").alias("metric"), F.col("reward").alias("value"))
        means = live.metric_windows(points, "1 hour", "2 hours", "metric", home=home + "-means", last=last)
        totals = live.running_totals(stream, F.col("rollout_id"), "group_id", home=home + "-totals")
        first = live.distinct_stream(stream.select("ts", "reward"), "10 days", "reward", home=home + "-first")
    batch = {r.rollout_id: r.advantage for r in with_advantages(rows).collect()}
    assert len(got) == 240 and {r.rollout_id for r in got} == set(batch)
    for r in got:
        assert r.advantage == pytest.approx(batch[r.rollout_id])
    assert means.count() == 10 and means.agg(F.sum("points")).first()[0] == 240
    assert totals.count() == 30 and totals.agg(F.sum("total")).first()[0] == sum(range(240))
    assert sorted(r.reward for r in first.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_finished_windows_alone_are_read(spark, tmp_path):
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    rows = _scored(spark)
    _land(spark, folder, [rows])
    live.group_advantage_stream(live.read_stream(spark, folder, rows.schema), "1 hour", "0 seconds", home=home)
    hours = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "home" / "rows").glob("epoch=*/late=-/window_at=*"))
    assert len(hours) == 10 and hours[1] - hours[0] == 3600
