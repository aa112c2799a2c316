"""Group-relative statistics and advantages.

Statistics are grouped aggregates joined back to their rows, not windows: partial aggregates combine on the map side, so
a group that holds a third of all rows ships a few numbers per task. The join back is an equi join between two shuffled
tables, the shape whose hot partitions adaptive execution splits. It does not split a join that sits directly on an
aggregate with the same keys, so the statistics, one short row per group, are written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.session import memory_size, stage

BROADCAST_BYTES = 128 << 20  # of a table in memory
STD_FLOOR = 1e-4  # fixed value added to the spread of a group


def weighted_reward(names: list[str] | tuple[str, ...], weights: list[float] | tuple[float, ...] | None = None) -> Column:
    """Weighted sum over the rewards that apply to a row; 0.0 when none does."""
    weights = [1.0] * len(names) if weights is None else weights
    if len(weights) != len(names):
        raise ValueError(f"{len(weights)} weights for {len(names)} rewards")
    terms = [F.coalesce(F.nanvl(F.col(n), F.lit(None)) * F.lit(float(w)), F.lit(0.0)) for n, w in zip(names, weights)]
    return sum(terms, F.lit(0.0))


def with_aggregates(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Add aggregates of each row's group to the row. Rows whose key is null form a group, as in GROUP BY; none is lost."""
    stats = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(*[value.alias(name) for name, value in aggregates.items()])
    stats = stage(stats, "group-statistics")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(stats, same).select(*df.columns, *aggregates)


def with_advantages(scored: DataFrame, group: str = "group_id", reward: str = "reward", scale: bool = True) -> DataFrame:
    """Reward minus the group mean, over the sample spread of the group when scaled.

    A group of one row has no spread: its scaled advantage is null. A reward that is not a number counts as null: it
    takes no part in its group, and its row has no advantage.
    """
    value = F.nanvl(F.col(reward), F.lit(None))
    joined = with_aggregates(scored, [group], group_mean=F.avg(value), group_std=F.stddev_samp(value))
    advantage = value - F.col("group_mean")
    if scale:
        advantage = advantage / (F.col("group_std") + F.lit(STD_FLOOR))
    return joined.withColumn("advantage", advantage)


def unscored(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows to which no reward applies."""
    return df.where(F.coalesce(*[F.nanvl(F.col(n), F.lit(None)) for n in names]).isNull())


def incomplete_groups(df: DataFrame, size: int, group: str = "group_id") -> DataFrame:
    """Groups whose number of rows is not the planned one."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") != size)


def pair(rollouts: DataFrame, tasks: DataFrame, on: str = "prompt_id", broadcast_bytes: int = BROADCAST_BYTES, how: str = "inner") -> DataFrame:
    """Rollouts with their task's columns.

    Tasks are the small side. They are written first, and where they take at most ``broadcast_bytes`` in memory they are
    sent to the rollouts, whose long texts then stay where they are, however popular one prompt is. Larger tables meet
    the rollouts in a shuffle join, whose hot partitions adaptive execution splits. A rollout without a task is left out;
    with ``how`` 'left' it stays, with nulls.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    tasks = stage(tasks, "tasks")
    return rollouts.join(F.broadcast(tasks) if memory_size(tasks)[1] <= broadcast_bytes else tasks, on, how)


def weighted_reward_long(rewards: DataFrame, weights: dict[str, float], key: str = "rollout_id") -> DataFrame:
    """The weighted sum over a long table ``(key, reward_name, value)``.

    One weight row per reward function; the list comes from the configuration, so it is always small enough to send. A
    reward without a weight adds nothing; a key that has no other keeps its row, with 0.0.
    """
    rows = rewards.sparkSession.createDataFrame(list(weights.items()), "reward_name string, weight double")
    joined = rewards.join(F.broadcast(rows), "reward_name", "left")
    return joined.groupBy(key).agg(F.sum(F.coalesce(F.nanvl(F.col("value"), F.lit(None)) * F.col("weight"), F.lit(0.0))).alias("reward"))
