"""One scoring step over tables: advantages meet token statistics, metrics come out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rewardloom.config import LossConfig
from rewardloom.functions.tokens import ratio_statistics, token_mean, with_loss
from rewardloom.operators.metrics import group_reward_metrics
from rewardloom.session import stage


def step_metrics(scored: DataFrame, tokens: DataFrame, cfg: LossConfig, eos: int, keys: list[str]) -> DataFrame:
    """Mean reward, spread, loss, divergence and clip ratio per step.

    ``scored`` holds ``rollout_id``, ``group_id``, the keys, ``reward`` and ``advantage``; ``tokens`` holds
    ``rollout_id`` and the token arrays. Both sides of the join are a few numbers per rollout.
    """
    scored = stage(scored, "scored-step")
    numbers = ratio_statistics(tokens, cfg, eos)
    loss = with_loss(numbers.join(scored.select("rollout_id", *keys, "advantage"), "rollout_id"), cfg)
    return group_reward_metrics(scored, keys).join(token_mean(loss, keys), keys)
