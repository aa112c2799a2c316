"""Metrics that grow by step: a table of mergeable moments that new steps are added to.

A moment row is a key, the name of a value, and count, mean and sum of squared deviations of that value. Rows of one key
merge into one exactly, so a metric over all steps reads the table and never the rollouts again. Every increment is a
run (``sources/runs.py``): a repeated one replaces itself, and many can be merged into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.operators.groups import with_aggregates
from rewardloom.sources.runs import merge_runs, read_runs, write_run

_MOMENTS = ("n", "mean", "m2")


def moments(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``keys, name, n, mean, m2`` of every value. Nulls and what is not a number take no part; null keys are keys."""
    own = {name: F.nanvl(value.cast("double"), F.lit(None)) for name, value in values.items()}
    columns = [(F.count(v), F.avg(v), F.var_pop(v) * F.count(v)) for v in own.values()]
    wide = df.groupBy(*keys).agg(*[c.alias(f"_{k}_{m}") for k, cs in enumerate(columns) for c, m in zip(cs, _MOMENTS)])
    rows = [F.struct(F.lit(name).alias("name"), *[F.col(f"_{k}_{m}").alias(m) for m in _MOMENTS]) for k, name in enumerate(own)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and name. Deviations are taken from the merged mean, so large means cancel nothing."""
    weight = F.col("n").cast("double")
    mean = F.try_divide(F.sum(weight * F.col("mean")), F.sum(weight))
    rows = with_aggregates(parts, [*keys, "name"], _mean=mean)
    gap = F.col("mean") - F.col("_mean")
    inside = F.coalesce(F.sum(F.col("m2") + weight * gap * gap), F.lit(0.0))
    return rows.groupBy(*keys, "name").agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), inside.alias("m2"))


def mean_and_spread() -> tuple[Column, Column]:
    """Mean and sample spread of moment rows; null where no, or only one, value is there."""
    return F.col("mean"), F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))


class MomentTable:
    """Moment rows in a folder, an increment per run."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str]):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = ", ".join([*[f"`{k}` {t}" for k, t in keys.items()], "name string, n bigint, mean double, m2 double"])

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders)

    def add(self, df: DataFrame, values: dict[str, Column], run: str) -> None:
        """Merge in the rows of an increment; the same run again takes its place. Adaptive execution merges small parts of
        it, so a small increment is one file and a large one is written by as many tasks as it fills."""
        write_run(moments(df, self.keys, values), self.path, run, lambda rows, folder: rows.write.parquet(folder))

    def read(self, keys: list[str] | None = None) -> DataFrame:
        """Moments by ``keys``, by default those of the table; fewer keys merge further."""
        return merged(read_runs(self.spark, self.path, self._load, self.schema), self.keys if keys is None else keys)

    def compact(self, run: str = "compacted") -> None:
        """One run of all increments so far."""
        merge_runs(self.spark, self.path, run, lambda folders: merged(self._load(folders), self.keys), lambda rows, folder: rows.write.parquet(folder))


def reward_metrics(table: MomentTable, keys: list[str] | None = None) -> DataFrame:
    """``keys, metric, value``: mean and spread of every value, named as ``operators/metrics.py`` names them."""
    keys = table.keys if keys is None else keys
    mean, spread = mean_and_spread()
    name = lambda label: F.concat(F.lit("rewards/"), F.col("name"), F.lit(f"/{label}")).alias("metric")
    rows = F.array(F.struct(name("mean"), mean.alias("value")), F.struct(name("std"), spread.alias("value")))
    return table.read(keys).select(*keys, F.inline(rows))


def group_reward_metrics(table: MomentTable, keys: list[str], value: str = "reward") -> DataFrame:
    """Mean of group means and of group spreads from a table that is keyed by ``keys`` and the group."""
    mean, spread = mean_and_spread()
    groups = table.read().where(F.col("name") == value).select(*keys, mean.alias("_mean"), spread.alias("_std"))
    return groups.groupBy(*keys).agg(F.avg("_mean").alias("reward"), F.avg("_std").alias("reward_std"))


def reward_summary(table: MomentTable, levels: list[list[str]]) -> DataFrame:
    """Rows, mean reward and success rate at each level of keys, from the values ``reward`` and ``success``; absent keys
    are null, as in a rollup."""
    every = None
    for keys in levels:
        found = table.read(keys).groupBy(*keys).pivot("name", ["reward", "success"]).agg(F.first("n").alias("n"), F.first("mean").alias("mean"))
        own = [F.col(k) if k in keys else F.lit(None).cast(dict(_types(table))[k]).alias(k) for k in table.keys]
        rows = found.select(*own, F.col("success_n").alias("rows"), F.col("reward_mean").alias("mean_reward"), F.col("success_mean").alias("success_rate"))
        every = rows if every is None else every.unionByName(rows)
    return every


def _types(table: MomentTable) -> list[tuple[str, str]]:
    schema = table.spark.createDataFrame([], table.schema).schema
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
