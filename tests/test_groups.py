"""Rewards in groups, the registry, metrics, logs."""

import statistics
import warnings

import pytest
from pyspark.sql import functions as F

from rewardloom.config import RewardConfig, RewardPlan
from rewardloom.operators import groups, metrics
from rewardloom.plans.scoring import REGISTRY, custom_reward, score, score_with_advantages, select_rewards
from rewardloom.sources import logs


def test_weighted_sum_skips_missing(spark):
    rows = [(1.0, None), (None, None), (float("nan"), 2.0), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r.v for r in df.select(groups.weighted_reward(["a", "b"], [1.0, 0.5]).alias("v")).collect()] == [1.0, 0.0, 1.0, 2.0]
    assert groups.unscored(df, ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        groups.weighted_reward(["a", "b"], [1.0])


def test_advantages_with_a_dominant_group(spark):
    rows = [(0 if i % 3 == 0 else i % 50 + 1, float(i % 11)) for i in range(3000)] + [(999, 5.0)]
    df = spark.createDataFrame(rows, "group_id bigint, reward double")
    got = groups.with_advantages(df).collect()
    assert len(got) == len(rows)
    by_group = {}
    for g, r in rows:
        by_group.setdefault(g, []).append(r)
    for r in got:
        values = by_group[r.group_id]
        if len(values) == 1:
            assert r.advantage is None
            continue
        expected = (r.reward - statistics.mean(values)) / (statistics.stdev(values) + 1e-4)
        assert r.advantage == pytest.approx(expected)
    sums = groups.with_advantages(df, scale=False).groupBy("group_id").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-6 for r in sums)


def test_group_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "group_id bigint")
    assert [r.group_id for r in groups.incomplete_groups(df, 2).collect()] == [2]


def test_selection_of_rewards():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert select_rewards(["format", "no_such_reward", "cosine"]) == ["format", "cosine"]
        assert select_rewards(["nothing"]) == ["accuracy"]
    assert len(seen) == 3
    assert len(REGISTRY) == 13


def test_weights_must_match_the_rewards_in_use():
    with pytest.raises(ValueError):
        RewardPlan(("format", "tag_count"), (1.0,)).resolved_weights()
    assert RewardPlan(("format", "tag_count")).resolved_weights() == (1.0, 1.0)


GOOD = "<think>\na\n</think>\n<answer>\n2\n</answer>"


def _rollouts(spark):
    rows = [(i, i // 2, i // 4, GOOD if i % 2 else "no " + "x" * i, "$2$", 3.0, [1, 2], 0.5, [{"role": "a", "content": "c"}]) for i in range(8)]
    schema = (
        "rollout_id bigint, group_id bigint, batch_id bigint, completion string, solution string, target double, "
        "nums array<bigint>, code_pass_rate double, extra array<struct<role:string,content:string>>"
    )
    return spark.createDataFrame(rows, schema).withColumn("step", F.lit(0).cast("bigint"))


def test_every_registered_reward_runs(spark):
    df = score(_rollouts(spark), list(REGISTRY))
    rows = df.orderBy("rollout_id").collect()
    assert df.columns == ["rollout_id", "group_id", "step", *REGISTRY]
    assert rows[1].format == 1.0 and rows[1].tag_count == 1.0 and rows[1].accuracy == 1.0 and rows[1].code == 0.5
    assert rows[0].accuracy == 0.0 and rows[0].print == 0.0
    assert all(r[n] is not None for r in rows for n in REGISTRY)


def test_conversational_completions_score_like_plain_ones(spark):
    plain = _rollouts(spark)
    turns = plain.withColumn(
        "completion", F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))
    )
    names = ["format", "tag_count", "length", "cosine"]
    assert sorted(map(tuple, score(plain, names).collect())) == sorted(map(tuple, score(turns, names).collect()))


def test_custom_rewards_mix_with_built_in_ones(spark):
    def length_parity(prompts, completions, **columns):
        return [None if len(c) % 4 == 1 else 1.0 for c in completions]

    own = custom_reward(length_parity, prompts="solution", completions="completion")
    shout = F.when(F.col("completion").contains("no"), 1.0)
    rows = score(_rollouts(spark), ["format"], custom={"parity": own, "shout": shout}).collect()
    assert {r.parity for r in rows} == {None, 1.0} and {r.shout for r in rows} == {None, 1.0}


def test_plan_end_to_end(spark):
    df = score_with_advantages(_rollouts(spark), RewardPlan(("format", "print"), (1.0, 0.0)))
    rows = {r.rollout_id: r for r in df.collect()}
    assert rows[1].reward == 1.0 and rows[0].reward == 0.0
    assert rows[1].advantage == pytest.approx(0.5 / (statistics.stdev([0, 1]) + 1e-4))


def test_reward_config_checks():
    for wrong in ({"repetition_max_penalty": 0.1}, {"repetition_n_grams": 0}, {"cosine_max_len": 0}):
        with pytest.raises(ValueError):
            RewardConfig(**wrong)


# ---- metrics --------------------------------------------------------------------------------------------------


def test_running_total_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "STEPS_PER_BLOCK", 7)
    totals = spark.range(100).select(F.col("id").alias("step"), (F.col("id") % 5).alias("n"))
    got = {r.step: r.run for r in metrics.running_total(totals, "step", "n", "run").collect()}
    expected, run = {}, 0
    for i in range(100):
        run += i % 5
        expected[i] = run
    assert got == expected


def test_reward_metrics_ignore_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (0, 3.0), (1, 2.0)], "step bigint, r double")
    got = {(r.step, r.metric): r.value for r in metrics.reward_metrics(df, ["r"], ["step"]).collect()}
    assert got[(0, "rewards/r/mean")] == 2.0
    assert got[(0, "rewards/r/std")] == pytest.approx(statistics.stdev([1, 3]))
    assert got[(1, "rewards/r/std")] is None


def test_phrases(spark):
    df = spark.createDataFrame([(0, "Wait, actually. WAIT, ACTUALLY! Let’s pause and reassess."), (0, "none")], "step int, text string")
    got = {r.phrase: (r.hits, r.rows) for r in metrics.phrase_counts(df, F.col("text"), ["step"]).collect()}
    assert got == {"wait, actually": (2, 1), "let's pause and reassess": (1, 1)}
    assert len(metrics.REFLECTION_PHRASES) == 31


# ---- logs -----------------------------------------------------------------------------------------------------


def test_samples_survive_the_text_file(spark, tmp_path):
    texts = ["plain", "ends with line\n", "two\n\nparagraphs", "=====", "\n\nleading", "é｜▁", "x" * 100_000]
    df = spark.createDataFrame([(i, "<think>" + t) for i, t in enumerate(texts)], "rollout_id bigint, value string")
    path = str(tmp_path / "log")
    logs.write_samples(df, path)
    assert sorted(r.value for r in logs.read_samples(spark, path).collect()) == sorted("<think>" + t for t in texts)


def test_sampling_is_seeded_and_close_to_its_share(spark):
    ids = spark.range(20_000)
    kept = {r.id for r in ids.where(logs.sampled(F.col("id"), 1)).collect()}
    assert kept == {r.id for r in ids.repartition(11).where(logs.sampled(F.col("id"), 1)).collect()}
    assert 1800 < len(kept) < 2200


def test_unique_prompts_with_a_dominant_prompt(spark):
    rows = [(i, i % 2, "hot" if i % 3 else f"p{i % 12}", f"c{i}", 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "rollout_id bigint, step bigint, prompt string, completion string, reward double")
    got = {(int(r.step), r.prompt): r.rollout_id for r in logs.completions_table(df, unique_prompts=True).collect()}
    expected = {}
    for i, step, prompt, _, _ in rows:
        expected.setdefault((step, prompt), i)
    assert got == expected


def test_metrics_are_partitioned_by_mode(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, "loss", 0.5), ("eval", 1, "loss", 0.25)], "mode string, step bigint, metric string, value double")
    path = str(tmp_path / "m")
    logs.write_metrics(df, path)
    read = logs.read_metrics(spark, path).where("mode = 'eval'")
    assert [tuple(r) for r in read.collect()] == [("eval", 1, "loss", 0.25)]
    assert "PartitionFilters: [isnotnull(mode" in read._jdf.queryExecution().executedPlan().toString()


def test_pass_rate(spark):
    rows = [(1, 0, 0, " 4\n", "4"), (1, 1, 1, "4", "4"), (1, 2, 0, "5", "4"), (2, 0, 0, "x", "x")]
    df = spark.createDataFrame(rows, "rollout_id bigint, case_id bigint, return_code int, stdout string, expected string")
    assert {r.rollout_id: r.code_pass_rate for r in logs.pass_rate(df).collect()} == {1: pytest.approx(1 / 3), 2: 1.0}


def test_run_scope_removes_what_was_staged(spark):
    from pathlib import Path

    from rewardloom.session import run_scope, stage

    with run_scope(spark) as folder:
        total = stage(spark.range(10), "numbers").count()
        assert any(Path(folder).iterdir())
    assert total == 10 and not Path(folder).exists()
    with run_scope(spark, keep=True) as folder:
        kept = stage(spark.range(10), "numbers")
    assert kept.count() == 10 and Path(folder).exists()


def test_local_cluster_needs_a_shared_folder():
    from rewardloom.session import _ONE_MACHINE

    assert all(_ONE_MACHINE.fullmatch(m) for m in ("local", "local[4]", "local[*]", "local[2, 3]"))
    assert not any(_ONE_MACHINE.fullmatch(m) for m in ("local-cluster[2,1,1024]", "yarn", "spark://a:7077"))


def test_popular_prompt_leaves_texts_in_place(spark):
    from rewardloom.operators.groups import pair

    rollouts = spark.range(300).selectExpr("id AS rollout_id", "IF(id % 3 = 0, 0, id) AS prompt_id", "repeat('x', 10) AS completion")
    tasks = spark.range(300).selectExpr("id AS prompt_id", "concat('p', id) AS text")
    assert "BroadcastHashJoin" in pair(rollouts, tasks)._jdf.queryExecution().executedPlan().toString()
    shuffled = pair(rollouts, tasks, broadcast_bytes=0)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, pair(rollouts, tasks).collect()))


def test_keys_without_a_weighted_reward_keep_their_row(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "b", 5.0), (3, "a", None)], "rollout_id bigint, reward_name string, value double")
    got = {r.rollout_id: r.reward for r in groups.weighted_reward_long(rows, {"a": 10.0}).collect()}
    assert got == {1: 20.0, 2: 0.0, 3: 0.0}


def test_running_total_keeps_null_steps_and_keys(spark):
    rows = spark.createDataFrame([(None, "x", 5), (0, "x", 1), (5000, "x", 2), (1, None, 7), (2, None, 1)], "step bigint, k string, n bigint")
    got = {(r.k, r.step): r.total for r in metrics.running_total(rows, "step", "n", "total", ["k"]).collect()}
    assert got == {("x", None): 5, ("x", 0): 6, ("x", 5000): 8, (None, 1): 7, (None, 2): 8}
    one = {r.step: r.total for r in metrics.running_total(rows.where("k = 'x'"), "step", "n", "total").collect()}
    assert one == {None: 5, 0: 6, 5000: 8}


def test_phrase_hits_equal_a_scan_per_phrase(spark):
    import random

    rng = random.Random(6)
    phrases = ("ab", "aba", "b", "bb", "abab", "a b", "é")
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, text string")
    got = {r.i: {h.phrase: h.hits for h in r.hits} for r in df.select("i", metrics.phrase_hits(F.col("text"), phrases).alias("hits")).collect()}
    assert got == {k: {p: t.count(p) for p in phrases if t and p in t} for k, t in enumerate(texts)}


def test_size_in_memory_counts_texts(spark):
    from rewardloom.session import memory_size

    df = spark.createDataFrame([(1, "x" * 1000, ["ab"]), (2, None, None), (None, "é", [])], "id bigint, text string, list array<string>")
    rows, size = memory_size(df)
    assert rows == 3 and 1000 + 2 + 3 * 3 * 16 <= size < 1300
    assert memory_size(df.limit(0)) == (0, 0)


def test_unpaired_rollouts_can_be_kept(spark):
    rollouts = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "rollout_id bigint, prompt_id bigint")
    tasks = spark.createDataFrame([(10, "t")], "prompt_id bigint, solution string")
    for limit in (0, 1 << 20):
        assert [r.rollout_id for r in groups.pair(rollouts, tasks, broadcast_bytes=limit).collect()] == [1]
        kept = {r.rollout_id: r.solution for r in groups.pair(rollouts, tasks, broadcast_bytes=limit, how="left").collect()}
        assert kept == {1: "t", 2: None, 3: None}
    with pytest.raises(ValueError):
        groups.pair(rollouts, tasks, how="outer")
