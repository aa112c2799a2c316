"""Metrics over scored rollouts, as long tables ``(mode, step, metric, value)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_BLOCK = 4096

# Phrases that mark a model reflecting on its own reasoning.
REFLECTION_PHRASES = (
    "Let’s think step by step.",
    "Let’s go through this one step at a time.",
    "Breaking it down step by step...",
    "Thinking about it logically, first...",
    "Step 1: Let’s figure out the starting point.",
    "If we follow the steps carefully, we get...",
    "To solve this, lets analyze it piece by piece.",
    "Going through this systematically, we have...",
    "Okay, lets solve this gradually.",
    "Does that make sense?",
    "Is this correct?",
    "Wait, does that check out?",
    "Am I missing something?",
    "Hmm does that work?",
    "Let me verify that.",
    "That makes sense, right?",
    "Hold on, is this right?",
    "Lets double-check this.",
    "Wait, actually...",
    "Oh, hold on...",
    "Wait a second...",
    "Actually, let me rethink that.",
    "Hmm, let me go back for a moment.",
    "I might need to check this again.",
    "Let’s pause and reassess.",
    "Lets check by doing the reverse.",
    "Let’s verify by working backward.",
    "Can we check this by reversing the process?",
    "To confirm, let’s undo the steps.",
    "A good way to verify is by reversing it.",
    "If we undo the operations, do we get the same result?",
)


def metric_rows(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Unpivot metric columns into ``metric, value`` rows."""
    return wide.unpivot(keys, metrics, "metric", "value")


def reward_metrics(scored: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Mean and sample spread of every reward over the rows it applies to."""
    aggregates, metrics = [], []
    for name in names:
        value = F.nanvl(F.col(name).cast("double"), F.lit(None))
        for label, fn in (("mean", F.avg), ("std", F.stddev_samp)):
            metrics.append(f"rewards/{name}/{label}")
            aggregates.append(fn(value).alias(metrics[-1]))
    return metric_rows(scored.groupBy(*keys).agg(*aggregates), keys, [f"`{m}`" for m in metrics])


def group_reward_metrics(scored: DataFrame, keys: list[str], group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Mean of group means and mean of group spreads."""
    groups = scored.groupBy(*keys, group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"))
    return groups.groupBy(*keys).agg(F.avg("_mean").alias("reward"), F.avg("_std").alias("reward_std"))


def prefixed(metrics: DataFrame, mode: str = "mode", metric: str = "metric") -> DataFrame:
    """Evaluation metrics carry the prefix ``eval_``."""
    name = F.when(F.col(mode) == "eval", F.concat(F.lit("eval_"), F.col(metric))).otherwise(F.col(metric))
    return metrics.withColumn(metric, name)


def running_total(totals: DataFrame, step: str, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Running sum of one value per step.

    Steps are summed in blocks: a window per block of 4,096 steps, and one over the block totals, so no task holds
    more than a block or the list of blocks however long the run is.
    """
    keys = keys or []
    blocked = totals.withColumn("_block", F.floor(F.col(step) / STEPS_PER_BLOCK))
    blocks = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "_block", F.coalesce(F.sum("_sum").over(over_blocks), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    named = [*keys, "_block"]
    offsets = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in named], "_offset")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in named]
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, same)
        .select(*totals.columns, (F.col("_inside") + F.col("_offset")).alias(name))
    )


def token_totals(tokens: DataFrame, size: Column, step: str = "step", mode: str = "mode") -> DataFrame:
    """Running number of attended tokens over the training steps."""
    per_step = tokens.where(F.col(mode) == "train").groupBy(step).agg(F.sum(size).alias("tokens"))
    return running_total(per_step, step, "tokens", "num_tokens")


def log_windows(metrics: DataFrame, every: int, keys: tuple[str, ...] = ("mode", "metric")) -> DataFrame:
    """Mean of every metric since the last log line."""
    window = F.floor(F.col("step") / every).cast("bigint")
    return metrics.groupBy(*keys, window.alias("log_window")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("points")
    )


def row_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split, as ``<split>_samples`` metrics."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counts.select(F.concat(F.col(split), F.lit("_samples")).alias("metric"), "value")


def reward_summary(scored: DataFrame, reward: str = "reward") -> DataFrame:
    """Success by step and source, with totals per step and over all."""
    return scored.rollup("step", "source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(reward).alias("mean_reward"),
        F.avg(F.when(F.col(reward) > 0, 1.0).otherwise(0.0)).alias("success_rate"),
    )


def plain_phrase(phrase: str) -> str:
    """Lower case, straight apostrophes, without the outer quotes and the trailing dots."""
    return phrase.lower().replace("’", "'").strip('"').rstrip(".")


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """array<struct<phrase, hits>> of the phrases in a text, Arrow-batched: one automaton over all of them reads it once.

    Hits of one phrase do not overlap, hits of different phrases may.
    """
    known = tuple(dict.fromkeys(phrases))

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, phrase in enumerate(known):
            automaton.add_word(phrase, k)
        automaton.make_automaton()
        for texts in batches:
            out = []
            for value in texts:
                hits: dict[int, int] = {}
                ends: dict[int, int] = {}
                for end, k in automaton.iter(value) if value else ():
                    if end - len(known[k]) >= ends.get(k, -1):
                        hits[k] = hits.get(k, 0) + 1
                        ends[k] = end
                out.append([{"phrase": known[k], "hits": n} for k, n in hits.items()])
            yield pd.Series(out)

    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "array<struct<phrase:string,hits:bigint>>")(text)


def phrase_counts(df: DataFrame, text: Column, keys: list[str], phrases: tuple[str, ...] = REFLECTION_PHRASES) -> DataFrame:
    """Occurrences of every reflection phrase and the rows holding it, per key.

    The phrases are one automaton, so the cost does not depend on their number. Each text is read where it lies and
    emits one row per phrase found; no join, and counts combine on the map side.
    """
    folded = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    found = phrase_hits(folded, tuple(plain_phrase(p) for p in phrases))
    return (
        df.select(*keys, found.alias("_hits"))
        .select(*keys, F.explode("_hits").alias("_found"))
        .groupBy(*keys, F.col("_found.phrase").alias("phrase"))
        .agg(F.sum("_found.hits").alias("hits"), F.count(F.lit(1)).alias("rows"))
    )
