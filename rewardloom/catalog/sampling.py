"""Repeated sampling plans over the documents as prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import register, table
from rewardloom.catalog.standins import WITH_ROLLOUTS, rollouts
from rewardloom.config import SamplingConfig
from rewardloom.operators import expand, mix

CFG = SamplingConfig(
    num_generations=3, per_device_batch_size=4, num_processes=3, gradient_accumulation_steps=3, num_iterations=2
)


def _plan_sql(seed: int, copies: int, batch: int, repeats: int) -> str:
    block = batch * copies
    return f"""ranked AS (SELECT doc_id AS prompt_id, row_number() OVER (ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR))) - 1 AS rk,
  count(*) OVER () AS n FROM documents),
 plan AS (SELECT prompt_id, rk // {batch} AS chunk, rk % {batch} AS slot, r.i AS repeat_idx, g.i AS gen_idx,
  (rk // {batch} * {repeats} + r.i) * {block} + rk % {batch} * {copies} + g.i AS position
  FROM ranked, (SELECT unnest(range({repeats})) AS i) r, (SELECT unnest(range({copies})) AS i) g
  WHERE (rk // {batch} + 1) * {batch} <= n)"""


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id")


@register("repeat_sampler", f"WITH {_plan_sql(42, 2, 3, 4)} SELECT * FROM plan")
def repeat_sampler(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of three prompts, each four times, every prompt twice in a row; the short last batch is dropped."""
    return expand.repeat_plan(_prompts(spark, folder), "doc_id", 42, copies=2, batch_size=3, repeats=4)


_TRAIN = _plan_sql(CFG.seed, CFG.num_generations, CFG.prompts_per_batch, CFG.num_iterations)
_STEPPED = f"""WITH {_TRAIN}, stepped AS (SELECT *, position // {CFG.rows_per_step} AS step,
 position // {CFG.per_device_batch_size} % {CFG.num_processes} AS device, position % {CFG.per_device_batch_size} AS device_slot FROM plan)"""


@register(
    "train_sampling_plan",
    f"{_STEPPED} SELECT prompt_id, position, step, gen_idx FROM stepped",
)
def train_sampling_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = expand.train_plan(_prompts(spark, folder), "doc_id", CFG)
    return plan.select("prompt_id", "position", "step", "gen_idx")


@register("eval_sampling_plan", f"WITH {_plan_sql(CFG.seed, CFG.num_generations, 1, 1)} SELECT prompt_id, position, gen_idx FROM plan")
def eval_sampling_plan(spark: SparkSession, folder: str) -> DataFrame:
    return expand.eval_plan(_prompts(spark, folder), "doc_id", CFG).select("prompt_id", "position", "gen_idx")


@register("device_placement", f"{_STEPPED} SELECT position, step, device, device_slot FROM stepped")
def device_placement(spark: SparkSession, folder: str) -> DataFrame:
    plan = expand.train_plan(_prompts(spark, folder), "doc_id", CFG)
    return plan.select("position", "step", "device", "device_slot")


@register(
    "reuse_schedule",
    f"""{_STEPPED} SELECT DISTINCT step, step // {CFG.gradient_accumulation_steps} AS global_step,
 step % {CFG.gradient_accumulation_steps} AS buffer_slot,
 step // {CFG.gradient_accumulation_steps} % {CFG.num_iterations} <> 0 AS is_reuse,
 step - step // {CFG.gradient_accumulation_steps} % {CFG.num_iterations} * {CFG.gradient_accumulation_steps} AS generated_at FROM stepped""",
)
def reuse_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Which steps generate and which reuse the completions of an earlier step."""
    plan = expand.train_plan(_prompts(spark, folder), "doc_id", CFG)
    return plan.select("step", "global_step", "buffer_slot", "is_reuse", "generated_at").distinct()


@register(
    "repeat_inputs_per_generation",
    f"""WITH {_plan_sql(CFG.seed, CFG.num_generations, 1, 1)} SELECT p.prompt_id, p.gen_idx, d.source, d.lang, d.n_chars
 FROM plan p JOIN documents d ON p.prompt_id = d.doc_id""",
)
def repeat_inputs_per_generation(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of a prompt beside each of its generations."""
    plan = expand.eval_plan(_prompts(spark, folder), "doc_id", CFG)
    columns = table(spark, folder, "documents").select(F.col("doc_id").alias("prompt_id"), "source", "lang", "n_chars")
    return plan.select("prompt_id", "gen_idx").join(columns, "prompt_id")


@register("unique_prompts", f"{WITH_ROLLOUTS} SELECT rollout_id, group_id FROM rollouts WHERE gen_idx = 0")
def unique_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt per group, as sent to a generation server."""
    return mix.unique_prompts(rollouts(spark, folder)).select("rollout_id", "group_id")


@register(
    "required_columns",
    f"{WITH_ROLLOUTS} SELECT solution, answer, target, n1, n2, n3 FROM rollouts",
)
def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Reward inputs: every column but the keys and the completion."""
    df = rollouts(spark, folder)
    return mix.keep_columns(df, ["solution", "answer", "target", "n1", "n2", "n3", "prompt"])
