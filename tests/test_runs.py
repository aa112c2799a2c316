"""Sinks that can be repeated."""

import pytest
from pyspark.sql import functions as F

from rewardloom.sources import logs, runs


def save(df, folder):
    df.write.parquet(folder)


def read(spark, path):
    found = runs.read_runs(spark, path, lambda folders: spark.read.schema("id bigint").parquet(*folders), "id bigint")
    return sorted(r.id for r in found.collect())


def test_a_run_written_twice_is_read_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        runs.write_run(spark.range(5), path, "steps 0/4", save)
    runs.write_run(spark.range(5, 8), path, "steps 5/7", save)
    assert read(spark, path) == list(range(8))
    runs.write_run(spark.range(3), path, "steps 0/4", save)  # the last complete attempt counts
    assert read(spark, path) == [0, 1, 2, 5, 6, 7]


def test_a_failed_attempt_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.write_run(spark.range(3), path, "a", save)

    def half(df, folder):
        df.write.parquet(folder)
        raise OSError("lost")

    for run in ("a", "b"):
        with pytest.raises(OSError):
            runs.write_run(spark.range(100), path, run, half)
    assert read(spark, path) == [0, 1, 2]
    assert runs.remove_leftovers(spark, path) == 2 and read(spark, path) == [0, 1, 2]


def test_merged_runs_stay_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        runs.write_run(spark.range(10 * k, 10 * k + 2), path, f"r{k}", save)
    load = lambda folders: spark.read.schema("id bigint").parquet(*folders)
    runs.merge_runs(spark, path, "all", load, save)
    assert read(spark, path) == [0, 1, 10, 11, 20, 21] and len(runs.committed(spark, path)) == 1
    runs.write_run(spark.range(10, 12), path, "r1", save)  # a late repeat of what was merged
    runs.write_run(spark.range(30, 31), path, "r3", save)
    assert read(spark, path) == [0, 1, 10, 11, 20, 21, 30]
    runs.merge_runs(spark, path, "all", load, save)
    assert read(spark, path) == [0, 1, 10, 11, 20, 21, 30] and len(runs.committed(spark, path)) == 1


def test_names_and_empty_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for bad in ("", "_x", ".x"):
        with pytest.raises(ValueError):
            runs.write_run(spark.range(1), path, bad, save)
    runs.write_run(spark.range(0), path, "nothing é %", save)
    assert read(spark, path) == []
    runs.write_run(spark.range(2), path, "b", save, replaces=["nothing é %", "b2"])
    runs.write_run(spark.range(9), path, "b2", save)
    assert read(spark, path) == [0, 1]


def test_logs_of_a_run_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"<think>t{k}\n") for k in range(6)], "rollout_id bigint, value string")
    for name in ("samples", "text"):
        path = str(tmp_path / name)
        write = logs.write_samples if name == "samples" else lambda df, p, run: logs.write_text(df.select(F.concat(F.lit("### Sample "), "value").alias("value")), p, run)
        for _ in range(2):
            write(rows, path, "r")
        write(rows.where("rollout_id < 2"), path, "s")
        got = logs.read_samples(spark, path) if name == "samples" else logs.read_text(spark, path, logs.BLOCK_MARK)
        assert got.count() == 8
    metrics = rows.select(F.lit("train").alias("mode"), F.col("rollout_id").alias("step"), F.lit("m").alias("metric"), F.lit(1.0).alias("value"))
    path = str(tmp_path / "metrics")
    for _ in range(3):
        logs.write_metrics(metrics, path, "r")
    assert logs.read_metrics(spark, path).count() == 6
    logs.write_metrics(metrics, path)  # without a name the rows are a run of their own
    assert logs.read_metrics(spark, path).count() == 12


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([("### Sample 1\nx",)], "value string").write.text(path)
    assert [r.value for r in logs.read_text(spark, path, logs.BLOCK_MARK).collect()] == ["### Sample 1\nx"]
