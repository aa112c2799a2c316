"""Physical plans: what must and must not be in them at scale."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rewardloom.catalog import QUERIES
from rewardloom.operators import groups, leak, mix
from rewardloom.session import shared_dir, spread

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_nested_loops_and_no_row_wise_python(spark, no_auto_broadcast, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@needs_tables
def test_narrow_scans(spark):
    text = plan(QUERIES["fraction_head"](spark, FOLDER))
    assert "text:string" not in text
    text = plan(QUERIES["group_advantage"](spark, FOLDER))
    assert "l_shipdate" not in text and "l_returnflag" not in text


@needs_tables
def test_scoring_is_one_pass_without_exchange(spark):
    from rewardloom.catalog.standins import rollouts
    from rewardloom.plans.scoring import score

    text = plan(score(rollouts(spark, FOLDER), ["format", "tag_count", "reasoning_steps", "cosine", "accuracy"]))
    assert "Exchange" not in text and text.count("FileScan") == 1


def test_hot_groups_are_split_in_the_join_back(spark, no_auto_broadcast):
    keys = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") / 8).cast("bigint")
        df = spark.range(400_000).select("id", hot.alias("group_id"), F.rand(1).alias("reward")).repartition(8)
        rows = groups.with_advantages(df).agg(F.count(F.lit(1)).alias("n"), F.sum("advantage").alias("a"))
        assert rows.collect()[0].n == 400_000
        text = plan(rows)
        assert "SortMergeJoin(skew=true)" in text and "Window" not in text
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_heads_do_not_move_the_table(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("payload"), (F.col("id") % 3).cast("string").alias("s"))
    text = plan(mix.fraction_head(df, "s", "id", {"0": 0.5, "1": 0.1}))
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text  # cuts are written before
    assert "Sort [id" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.lit("a").alias("text")).write.parquet(path)
    text = plan(mix.unique_prompts(spark.read.parquet(path).withColumnRenamed("id", "gen_idx")).select("gen_idx"))
    assert "EqualTo(id,0)" in text and "text" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_held_out_lookup_moves_no_training_gram(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "id bigint, text string")
    held = spark.createDataFrame([("a b c d e f g h",)], "text string")
    assert leak.leaked_ids(docs, held, "id", "text").count() == 1


def test_large_tables_are_not_spread(spark, monkeypatch):
    from rewardloom import session

    df = spark.range(10)
    assert "RoundRobin" in plan(spread(df))
    monkeypatch.setattr(session, "BYTES_PER_TASK", 0)
    assert "RoundRobin" not in plan(spread(df))


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
