"""Checks of configurations that are kept as tables: what a run would refuse, before one is started."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mix_problems(proposals: DataFrame, mix: str = "mix_id", source: str = "source", fraction: str = "fraction", config: str | None = None) -> DataFrame:
    """``mix, sources, problem`` of every proposed mix; the problem is null where ``MixConfig`` would accept it.

    ``proposals`` has a row per source of a mix; a row without a source names a mix that has none. In order of weight:
    no source, a source twice, a fraction outside [0, 1], configurations for some of the sources only.
    """
    named = F.col(source).isNotNull()
    bad = named & ~F.coalesce(F.col(fraction).between(0.0, 1.0), F.lit(False))
    configured = F.count_if(named & F.col(config).isNotNull()) if config else F.lit(0)
    found = proposals.groupBy(mix).agg(
        F.count(source).alias("sources"), F.countDistinct(source).alias("_names"), F.count_if(bad).alias("_bad"), configured.alias("_configured")
    )
    problem = (
        F.when(F.col("sources") == 0, "no source")
        .when(F.col("_names") < F.col("sources"), "a source twice")
        .when(F.col("_bad") > 0, "a fraction outside [0, 1]")
        .when((F.col("_configured") > 0) & (F.col("_configured") < F.col("sources")), "configs for some sources only")
    )
    return found.select(mix, "sources", problem.alias("problem"))


def weight_problem(rewards: Column, weights: Column) -> Column:
    """What ``RewardPlan`` says to numbers of rewards and of weights, null where they fit; no weights fit every plan."""
    counts = F.concat(weights.cast("string"), F.lit(" weights for "), rewards.cast("string"), F.lit(" rewards"))
    return F.when((F.coalesce(weights, F.lit(0)) != 0) & (weights != rewards), counts)
