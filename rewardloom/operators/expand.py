"""Repeated sampling plans: which prompt is generated when, where and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.config import SamplingConfig
from rewardloom.operators.rank import hash_key, with_rank


def repeat_plan(
    prompts: DataFrame, prompt_id: str, seed: int, copies: int, batch_size: int = 1, repeats: int = 1
) -> DataFrame:
    """Seeded permutation cut into batches; every batch ``repeats`` times, every prompt ``copies`` times in a row.

    A last short batch is dropped. Only ids travel; join the prompt's columns to the plan afterwards.
    """
    if min(copies, batch_size, repeats) < 1:
        raise ValueError("copies, batch_size and repeats must be at least 1")
    ids = prompts.select(F.col(prompt_id).alias("prompt_id"))
    ranked = with_rank(ids, hash_key(seed, "prompt_id"), total="rows")
    total = F.lit(batch_size)
    full = (
        ranked.withColumn("chunk", F.floor(F.col("rank") / total).cast("bigint"))
        .withColumn("slot", F.col("rank") % total)
        .where((F.col("chunk") + 1) * total <= F.col("rows"))
    )

    def counter(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    expanded = full.withColumn("repeat_idx", counter(repeats)).withColumn("gen_idx", counter(copies)).drop("rank", "rows")
    block = batch_size * copies
    position = (F.col("chunk") * repeats + F.col("repeat_idx")) * block + F.col("slot") * copies + F.col("gen_idx")
    return expanded.withColumn("position", position.cast("bigint"))


def train_plan(prompts: DataFrame, prompt_id: str, cfg: SamplingConfig) -> DataFrame:
    """Placement of every generation of a training run: step, device, slot, and whether it is generated or reused."""
    plan = repeat_plan(
        prompts, prompt_id, cfg.seed, cfg.num_generations, cfg.prompts_per_batch, cfg.num_iterations
    )
    return with_reuse(with_placement(plan, cfg), cfg)


def eval_plan(prompts: DataFrame, prompt_id: str, cfg: SamplingConfig) -> DataFrame:
    """Every prompt once, with its generations in a row."""
    return repeat_plan(prompts, prompt_id, cfg.seed, cfg.num_generations)


def with_placement(plan: DataFrame, cfg: SamplingConfig) -> DataFrame:
    """Position to (step, device, slot on the device)."""
    at = F.col("position")
    return (
        plan.withColumn("step", F.floor(at / cfg.rows_per_step).cast("bigint"))
        .withColumn("device", (F.floor(at / cfg.per_device_batch_size) % cfg.num_processes).cast("bigint"))
        .withColumn("device_slot", (at % cfg.per_device_batch_size).cast("bigint"))
    )


def with_reuse(plan: DataFrame, cfg: SamplingConfig) -> DataFrame:
    """Optimizer step, buffer slot and the step whose completions are used."""
    accumulation, iterations = cfg.gradient_accumulation_steps, cfg.num_iterations
    global_step = F.floor(F.col("step") / accumulation).cast("bigint")
    return (
        plan.withColumn("global_step", global_step)
        .withColumn("buffer_slot", (F.col("step") % accumulation).cast("bigint"))
        .withColumn("is_reuse", (F.col("global_step") % iterations) != 0)
        .withColumn(
            "generated_at",
            (F.col("step") - (F.col("global_step") % iterations) * accumulation).cast("bigint"),
        )
    )
