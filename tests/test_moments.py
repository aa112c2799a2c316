"""Metrics that grow by step equal the whole recomputation."""

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import metrics, moments


def rows(spark):
    return spark.createDataFrame(
        [(k % 7 if k % 50 else None, k % 21, f"s{k % 3}", None if k % 11 == 0 else 1e9 + (k * 37 % 101) / 7, float("nan") if k % 13 == 0 else float(k % 5)) for k in range(700)],
        "step bigint, group_id bigint, source string, big double, small double",
    )


def near(found, wanted):
    found, wanted = ({tuple(r)[:-1]: r[-1] for r in x} for x in (found, wanted))
    assert found.keys() == wanted.keys()
    for key, value in wanted.items():
        assert found[key] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-6)), key


def test_three_increments_equal_one_pass(spark, tmp_path):
    df = rows(spark)
    table = moments.MomentTable(spark, str(tmp_path / "m"), {"step": "bigint"})
    values = {"big": F.col("big"), "small": F.col("small")}
    for k in (0, 1, 2, 1):  # parts cut across steps, and one comes twice
        table.add(df.where(F.col("group_id") % 3 == k), values, f"part {k}")
    whole = metrics.reward_metrics(df, ["big", "small"], ["step"]).select("step", "metric", "value").collect()
    near(moments.reward_metrics(table).collect(), whole)
    table.compact()
    table.add(df.where(F.col("group_id") % 3 == 2), values, "part 2")  # a late repeat
    near(moments.reward_metrics(table).collect(), whole)
    over_all = metrics.reward_metrics(df.withColumn("one", F.lit(1)), ["big", "small"], ["one"]).select("metric", "value").collect()
    near(moments.reward_metrics(table, []).collect(), over_all)


def test_groups_and_summary(spark, tmp_path):
    df = rows(spark).withColumn("reward", F.col("group_id") % 4 - F.lit(1.0))
    groups = moments.MomentTable(spark, str(tmp_path / "g"), {"step": "bigint", "group_id": "bigint"})
    summary = moments.MomentTable(spark, str(tmp_path / "s"), {"step": "bigint", "source": "string"})
    for k in range(3):
        part = df.where(F.coalesce(F.col("step") % 3, F.lit(0)) == k)
        groups.add(part, {"reward": F.col("big")}, f"{k}")
        summary.add(part, {"reward": F.col("reward"), "success": F.when(F.col("reward") > 0, 1.0).otherwise(0.0)}, f"{k}")
    whole = metrics.group_reward_metrics(df, ["step"], reward="big").select("step", "reward").collect()
    near(moments.group_reward_metrics(groups, ["step"]).select("step", "reward").collect(), whole)
    once = df.where("step IS NOT NULL")  # a rollup cannot tell a null step from its total
    table = moments.MomentTable(spark, str(tmp_path / "o"), {"step": "bigint", "source": "string"})
    table.add(once, {"reward": F.col("reward"), "success": F.when(F.col("reward") > 0, 1.0).otherwise(0.0)}, "once")
    found = moments.reward_summary(table, [["step", "source"], ["step"], []])
    for column in ("rows", "mean_reward", "success_rate"):
        near(found.select("step", "source", column).collect(), metrics.reward_summary(once).select("step", "source", column).collect())


def test_nothing_added(spark, tmp_path):
    table = moments.MomentTable(spark, str(tmp_path / "m"), {"step": "bigint"})
    table.add(rows(spark).limit(0), {"big": F.col("big")}, "none")
    assert moments.reward_metrics(table).collect() == []
    table.compact()
    assert table.read().collect() == []


@pytest.mark.parametrize("wide", [True, False])
def test_an_increment_is_not_one_task(spark, tmp_path, wide):
    """Parts below the smallest size are one file; where parts stay apart, each is merged and written by its own task."""
    table = moments.MomentTable(spark, str(tmp_path / "w"), {"k": "bigint"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not wide).lower())
    try:
        table.add(spark.range(800).selectExpr("id % 400 AS k"), {"v": F.col("k")}, "one")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "w").glob("attempt=*/*.parquet"))
    assert len(files) > 1 if wide else len(files) == 1
    assert table.read().agg(F.sum("n")).first()[0] == 800
