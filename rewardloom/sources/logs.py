"""Rollout logs, completion samples, completion tables and metrics: the files a run leaves behind.

Every sink takes the name of the run it writes. A run that is written again replaces its earlier rows (``sources/runs.py``);
without a name the rows are a run of their own. Readers see committed runs only, or a plain folder as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions.text import strip
from rewardloom.session import near_rows, stage
from rewardloom.sources.runs import read_runs, write_run

LOG_SHARE = 0.1  # fixed value: share of batches or rows that are logged
# Rules of the text files.
SAMPLE_MARK = "\n\n==============\n"
SAMPLE_PREFILL = "<think>"
HEAVY_RULE = "=" * 50
LIGHT_RULE = "-" * 50

_SHARE_STEPS = 1_000_000


def sampled(key: Column, seed: int, share: float = LOG_SHARE, salt: str = "log") -> Column:
    """True for a seeded share of the keys, the same on every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), key)), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % _SHARE_STEPS) < F.lit(int(share * _SHARE_STEPS))


# ---- rollout log ----------------------------------------------------------------------------------------------


def rollout_log(rollouts: DataFrame, stamp: Column, seed: int, batch: str = "batch_id") -> DataFrame:
    """One text block per rollout of the logged batches."""
    block = F.concat(
        F.lit("\n" + HEAVY_RULE + "\n["),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
        F.lit("]\nPrompt:\n"),
        F.col("prompt"),
        F.lit("\n" + LIGHT_RULE + "\nCompletion:\n"),
        F.col("completion"),
    )
    return rollouts.where(sampled(F.col(batch), seed)).select("rollout_id", block.alias("value"))


def write_text(blocks: DataFrame, path: str, run: str | None = None) -> None:
    write_run(blocks.select("value"), path, run or uuid.uuid4().hex, lambda df, folder: df.write.text(folder))


ROLLOUT_MARK = "\n" + HEAVY_RULE + "\n["
BLOCK_MARK = "### Sample "


def read_text(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """The blocks of a log in which each block begins with ``mark``."""
    pieces = read_runs(spark, path, spark.read.option("lineSep", mark).text, "value string").where(F.col("value") != "")
    return pieces.select(F.concat(F.lit(mark), F.regexp_replace("value", r"(?d)\n\z", "")).alias("value"))


# ---- completion samples ---------------------------------------------------------------------------------------


def completion_samples(rollouts: DataFrame, seed: int, success: Column | None = None) -> DataFrame:
    """Sample records of a seeded share of the rows, or of the successful rows only."""
    kept = rollouts if success is None else rollouts.where(success)
    salt = "sample" if success is None else "success"
    record = F.concat(F.lit(SAMPLE_PREFILL), F.col("completion"))
    return kept.where(sampled(F.col("rollout_id"), seed, salt=salt)).select("rollout_id", record.alias("value"))


def write_samples(samples: DataFrame, path: str, run: str | None = None) -> None:
    """Records each led by the sample mark, in text files."""
    marked = samples.select(F.concat(F.lit(SAMPLE_MARK), F.col("value")).alias("value"))
    write_run(marked, path, run or uuid.uuid4().hex, lambda df, folder: df.write.option("lineSep", "\n").text(folder))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Records of a sample log; the empty piece before the first mark is dropped."""
    pieces = read_runs(spark, path, spark.read.option("lineSep", SAMPLE_MARK).text, "value string")
    return pieces.select(F.regexp_replace("value", r"(?d)\n\z", "").alias("value")).where(F.col("value") != "")


# ---- completion tables ----------------------------------------------------------------------------------------


def completions_table(scored: DataFrame, unique_prompts: bool = False) -> DataFrame:
    """``step, prompt, completion, reward``; with ``unique_prompts`` the first rollout of every prompt in a step.

    First rows are found on (step, digest, id) alone with a map-side combined minimum and written; up to two million of
    them are sent to the texts, which then only pass a filter. More meet the texts in a shuffle join.
    """
    rows = scored
    if unique_prompts:
        first = scored.groupBy("step", F.sha2("prompt", 256).alias("_digest")).agg(
            F.min("rollout_id").alias("rollout_id")
        )
        first = near_rows(stage(first.select("step", "rollout_id"), "first-rollouts"))
        rows = scored.join(first, ["step", "rollout_id"], "left_semi")
    return rows.select("rollout_id", F.col("step").cast("string").alias("step"), "prompt", "completion", "reward")


def log_blocks(scored: DataFrame, index: Column) -> DataFrame:
    """Markdown block per sample with its reward in four decimals."""
    block = F.concat(
        F.lit("### Sample "),
        index.cast("string"),
        F.lit("\n\n**Prompt**:  \n"),
        F.col("prompt"),
        F.lit("\n\n**Completion**:  \n"),
        F.col("completion"),
        F.lit("\n\n**Reward**:  \n"),
        F.format_string("%.4f", F.col("reward")),
        F.lit("\n\n---\n"),
    )
    return scored.select("rollout_id", block.alias("value"))


def console_sample(scored: DataFrame, rows: int) -> DataFrame:
    """First rows by id: a bounded top-k report."""
    return scored.orderBy("rollout_id").limit(rows)


def write_metrics(metrics: DataFrame, path: str, run: str | None = None) -> None:
    """Metric rows ``(mode, step, metric, value)``, partitioned by mode."""
    rows = metrics.select("mode", "step", "metric", "value")
    write_run(rows, path, run or uuid.uuid4().hex, lambda df, folder: df.write.partitionBy("mode").parquet(folder))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    schema = "step bigint, metric string, value double, mode string"
    read = spark.read.schema(schema).option("basePath", path)
    rows = read_runs(spark, path, lambda folders: read.parquet(*folders), schema)
    return rows.select("mode", "step", "metric", "value")


# ---- execution results ----------------------------------------------------------------------------------------


def cases_json(test_cases: Column) -> Column:
    return F.to_json(test_cases)


def cases_from_json(payload: Column) -> Column:
    return F.from_json(payload, "array<struct<input:string,output:string>>")


def explode_cases(rollouts: DataFrame, test_cases: Column) -> DataFrame:
    """One row per test case: ``rollout_id, case_id, expected``."""
    return rollouts.select("rollout_id", F.posexplode(test_cases).alias("case_id", "_case")).select(
        "rollout_id",
        F.col("case_id").cast("bigint").alias("case_id"),
        F.col("_case.input").alias("input"),
        F.col("_case.output").alias("expected"),
    )


def pass_rate(results: DataFrame, key: str = "rollout_id") -> DataFrame:
    """Share of cases with return code 0 and the expected output, from a table of execution results."""
    passed = (F.col("return_code") == 0) & (strip(F.col("stdout")) == strip(F.col("expected")))
    return results.groupBy(key).agg(
        F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("code_pass_rate"), F.count(F.lit(1)).alias("cases")
    )
