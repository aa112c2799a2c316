"""The reward registry and the scoring plan: completions in, rewards and advantages out."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.config import RewardConfig, RewardPlan
from rewardloom.functions import scorers
from rewardloom.functions.answers import EXPRESSION, LATEX, agree, read_answer
from rewardloom.functions.equations import countdown_equation_reward
from rewardloom.operators.groups import weighted_reward, with_advantages, with_aggregates
from rewardloom.session import stage

Cols = Mapping[str, Column]
Builder = Callable[[Cols, RewardConfig], Column]

DEFAULT_REWARD = "accuracy"


@dataclass(frozen=True)
class Reward:
    """A named reward. ``reads`` names the answer readings it needs, ``batch_relative`` marks the length reward."""

    build: Builder
    reads: str | None = None
    batch_relative: bool = False


REGISTRY: dict[str, Reward] = {
    "accuracy": Reward(lambda c, cfg: scorers.accuracy_reward(c["gold_ok"], c["correct"]), reads=EXPRESSION),
    "format": Reward(lambda c, cfg: scorers.format_reward(c["text"])),
    "reasoning_steps": Reward(lambda c, cfg: scorers.reasoning_steps_reward(c["text"])),
    "length": Reward(
        lambda c, cfg: scorers.length_reward(c["length"], c["shortest"], c["longest"], ~c["gold_ok"] | c["correct"]),
        reads=LATEX,
        batch_relative=True,
    ),
    "code": Reward(lambda c, cfg: c["code_pass_rate"]),
    "tag_count": Reward(lambda c, cfg: scorers.tag_count_reward(c["text"])),
    "judge": Reward(lambda c, cfg: scorers.text_match_reward(c["text"], c["solution"])),
    "countdown_format": Reward(lambda c, cfg: scorers.countdown_format_reward(c["text"])),
    "countdown_equation": Reward(
        lambda c, cfg: countdown_equation_reward(c["text"], c["target"], c["nums"], cfg.max_power_bits)
    ),
    "cosine": Reward(
        lambda c, cfg: scorers.cosine_reward(c["length"], c["correct"], c["gold_ok"], cfg), reads=LATEX
    ),
    "repetition_penalty": Reward(
        lambda c, cfg: scorers.repetition_penalty_reward(
            c["text"], cfg.repetition_n_grams, cfg.repetition_max_penalty
        )
    ),
    "code_format": Reward(lambda c, cfg: scorers.code_format_reward(c["text"], cfg.code_language)),
    "print": Reward(lambda c, cfg: scorers.zero_reward()),
}


def select_rewards(names: list[str] | tuple[str, ...]) -> list[str]:
    """Known names in order; unknown ones are skipped with a warning, and none left means accuracy."""
    known = [n for n in names if n in REGISTRY]
    for name in names:
        if name not in REGISTRY:
            warnings.warn(f"unknown reward {name} is skipped", stacklevel=2)
    if not known:
        warnings.warn(f"no known reward named; using {DEFAULT_REWARD}", stacklevel=2)
        return [DEFAULT_REWARD]
    return known


def custom_reward(fn: Callable[..., list], **columns: Column | str) -> Column:
    """A Python reward ``fn(prompts, completions, **columns) -> list`` as an Arrow-batched column; None becomes null."""
    names = list(columns)

    def call(*series: pd.Series) -> pd.Series:
        return pd.Series(fn(**{n: s.tolist() for n, s in zip(names, series)}), dtype="float64")

    udf = F.pandas_udf(call, "double")
    return udf(*[F.col(c) if isinstance(c, str) else c for c in columns.values()])


def _with_readings(df: DataFrame, mode: str) -> DataFrame:
    """Read both answers once; every reward of that mode shares the columns."""
    answer, gold = f"_answer_{mode}", f"_gold_{mode}"
    read = df.withColumns(
        {
            answer: read_answer(F.col("_text"), mode),
            gold: read_answer(F.col("solution"), mode, gold=True),
        }
    )
    return read.withColumns(
        {f"_gold_ok_{mode}": F.col(gold).isNotNull(), f"_correct_{mode}": agree(F.col(answer), F.col(gold))}
    ).drop(answer, gold)


def score(
    rollouts: DataFrame,
    rewards: list[str] | tuple[str, ...],
    cfg: RewardConfig = RewardConfig(),
    custom: Mapping[str, Column] | None = None,
    keep: tuple[str, ...] = ("rollout_id", "group_id", "step"),
    batch: str = "batch_id",
) -> DataFrame:
    """Reward columns per rollout, without the completion text.

    All row-wise work happens in one pass before any exchange. Only the length reward needs its batch; the pass is
    then written once, narrow, and the batch extremes are aggregated and joined back.
    """
    names = select_rewards(rewards) if rewards or not custom else []
    df = rollouts.withColumn("_text", scorers.completion_text(rollouts.schema))
    for mode in sorted({REGISTRY[n].reads for n in names if REGISTRY[n].reads}):
        df = _with_readings(df, mode)

    def cols(mode: str | None) -> dict[str, Column]:
        found = {c: F.col(c) for c in df.columns if not c.startswith("_")}
        found |= {"text": F.col("_text"), "length": F.length("_text")}
        if mode:
            found |= {"gold_ok": F.col(f"_gold_ok_{mode}"), "correct": F.col(f"_correct_{mode}")}
        return found

    relative = [n for n in names if REGISTRY[n].batch_relative]
    row_wise = [n for n in names if n not in relative]
    out = {n: REGISTRY[n].build(cols(REGISTRY[n].reads), cfg).cast("double") for n in row_wise}
    out |= dict(custom or {})
    kept = [c for c in dict.fromkeys([*keep, *([batch] if relative else [])])]
    extra = [F.length("_text").alias("_length"), f"_gold_ok_{LATEX}", f"_correct_{LATEX}"] if relative else []
    scored = df.select(*kept, *[value.alias(name) for name, value in out.items()], *extra)
    if relative:
        scored = with_aggregates(
            stage(scored, "scored"), [batch], _shortest=F.min("_length"), _longest=F.max("_length")
        )
        values = {
            "length": F.col("_length"),
            "shortest": F.col("_shortest"),
            "longest": F.col("_longest"),
            "gold_ok": F.col(f"_gold_ok_{LATEX}"),
            "correct": F.col(f"_correct_{LATEX}"),
        }
        for name in relative:
            scored = scored.withColumn(name, REGISTRY[name].build(values, cfg))
    return scored.select(*keep, *names, *(custom or {}))


def score_with_advantages(
    rollouts: DataFrame,
    plan: RewardPlan,
    cfg: RewardConfig = RewardConfig(),
    keep: tuple[str, ...] = ("rollout_id", "group_id", "step"),
    scale: bool = True,
    custom: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rewards, their weighted sum and the group advantage per rollout.

    ``custom`` holds a column (a builder's or ``custom_reward``'s) for every name in ``plan.custom``; these rewards are
    weighted and summed like the registered ones. Texts are read once: the narrow scores are written to the shared
    folder, then grouped and joined.
    """
    custom = dict(custom or {})
    if set(custom) != set(plan.custom):
        raise ValueError(f"the plan names {sorted(plan.custom)}, columns are given for {sorted(custom)}")
    registered = select_rewards(plan.names) if plan.names or not custom else []
    names = [*registered, *plan.custom]
    weights = plan.resolved_weights(names)
    scored = score(rollouts, registered, cfg, {n: custom[n].cast("double") for n in plan.custom}, keep=keep)
    scored = scored.withColumn("reward", weighted_reward(names, weights))
    return with_advantages(stage(scored, "rewards"), scale=scale)
