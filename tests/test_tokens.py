"""Token-array columns against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from rewardloom.config import LossConfig
from rewardloom.functions import tokens as tk

ROWS = [
    (0, [5, 6, 2, 7, 2], [-0.1, -0.9, -0.3, -0.2, -0.1], [-0.2, -0.2, -0.9, -0.2, -0.3], [-0.5, -0.1, -0.3, -0.7, -0.2], 1.5),
    (0, [5, 6], [-0.4, -0.8], [-0.4, -0.1], [-0.1, -0.9], -1.0),
    (1, [2], [-0.4], [-0.3], [-1.4], -0.5),
    (1, [], [], [], [], 0.7),
]
SCHEMA = (
    "step bigint, completion_ids array<bigint>, logps array<double>, old_logps array<double>, ref_logps array<double>, "
    "advantage double"
)


def one(spark, column, ids):
    return spark.createDataFrame([(ids,)], "ids array<bigint>").select(column.alias("v")).first().v


def test_truncation_and_padding(spark):
    ids = F.col("ids")
    assert one(spark, tk.keep_last(ids, 2), [1, 2, 3]) == [2, 3]
    assert one(spark, tk.keep_last(ids, 5), [1, 2, 3]) == [1, 2, 3]
    assert one(spark, tk.keep_last(ids, 5), []) == []
    assert one(spark, tk.pad_to(ids, 5, 0, left=True), [1, 2]) == [0, 0, 0, 1, 2]
    assert one(spark, tk.pad_to(ids, 3, 9, left=False), [1, 2]) == [1, 2, 9]
    assert one(spark, tk.pad_to(ids, 1, 9, left=False), [1, 2]) == [1, 2]


def test_masks(spark):
    ids = F.col("ids")
    assert one(spark, tk.eos_mask(ids, 2), [5, 2, 7, 2]) == [1, 1, 0, 0]
    assert one(spark, tk.eos_mask(ids, 2), [5, 7]) == [1, 1]
    assert one(spark, tk.eos_mask(ids, 2), []) == []
    assert one(spark, tk.attention_mask(F.array(F.lit(8)), tk.eos_mask(ids, 2)), [2, 3]) == [1, 1, 0]
    assert one(spark, tk.label_mask(ids, 0), [0, 151652, 5, 151655]) == [-100, -100, 5, -100]


@pytest.mark.parametrize("cfg", [LossConfig(0.04, 0.2, 0.3), LossConfig(0.0, 0.2)])
def test_batch_means(spark, cfg):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.step: r for r in tk.token_mean(tk.row_statistics(df, cfg, eos=2), ["step"]).collect()}
    for step in (0, 1):
        loss = kl = clip = n = 0.0
        for s, ids, lp, old, ref, adv in ROWS:
            if s != step:
                continue
            kept = ids.index(2) + 1 if 2 in ids else len(ids)
            for k in range(kept):
                c = math.exp(lp[k] - old[k])
                bounded = min(max(c, 1 - cfg.epsilon_low), 1 + cfg.upper)
                d = ref[k] - lp[k]
                token_kl = math.exp(d) - d - 1
                loss += -min(c * adv, bounded * adv) + cfg.beta * token_kl
                kl += token_kl
                clip += (c < 1 - cfg.epsilon_low and adv < 0) or (c > 1 + cfg.upper and adv > 0)
                n += 1
        assert got[step].tokens == n
        assert got[step].mean_loss == pytest.approx(loss / n)
        assert got[step].mean_clip == pytest.approx(clip / n)
        assert got[step].mean_kl == (pytest.approx(kl / n) if cfg.beta else None)


def test_single_use_ratio_is_one(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.v for r in df.select(tk.ratio(F.col("logps"), None).alias("v")).collect()][1] == [1.0, 1.0]
