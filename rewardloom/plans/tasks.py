"""From datasets to tasks: mix, split, cut for debugging, format. One lazy plan up to the sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.config import MixConfig
from rewardloom.functions import chat
from rewardloom.operators import mix
from rewardloom.operators.rank import hash_key
from rewardloom.sources.datasets import load_mix

Formatter = Callable[[DataFrame], DataFrame]
KEYS = ("source", "split", "row_id")


def _formatted(df: DataFrame, **outputs) -> DataFrame:
    return mix.map_rows(df, **{k: F.col(k) for k in KEYS}, **outputs)


def countdown(df: DataFrame) -> DataFrame:
    messages = chat.countdown_messages(F.col("nums"), F.col("target"))
    prompt = chat.render(messages, chat.chatml_template(), continue_final_message=True)
    return _formatted(df, prompt=prompt, target=F.col("target"), nums=F.col("nums"))


def math(df: DataFrame, system: str | None = None, instruction: str | None = None) -> DataFrame:
    return _formatted(
        df, messages=chat.math_messages(F.col("problem"), system, instruction), solution=F.col("solution")
    )


def multimodal(df: DataFrame, system: str | None = None) -> DataFrame:
    return _formatted(
        df,
        messages=chat.multimodal_instruct(F.col("problem"), system),
        image=F.col("image"),
        solution=chat.wrap_solution(F.col("solution")),
    )


def grade_school(df: DataFrame) -> DataFrame:
    return _formatted(
        df, messages=chat.grade_school_messages(F.col("question")), answer=chat.hash_answer(F.col("answer"))
    )


FORMATTERS: dict[str, Formatter] = {
    "countdown": countdown,
    "math": math,
    "multimodal": multimodal,
    "grade_school": grade_school,
}


def prepare_tasks(
    spark: SparkSession,
    cfg: MixConfig,
    formatter: str | Formatter,
    test_size: float | None = None,
    debug: bool = False,
) -> DataFrame:
    """Formatted tasks of a mix. ``test_size`` splits off a test set when no source brings one."""
    apply = FORMATTERS[formatter] if isinstance(formatter, str) else formatter
    # Order does not matter to the split, so rows are sorted once, at the end.
    rows = load_mix(spark, replace(cfg, shuffle=False))
    brings_test = any("test" in split and "train" not in split for s in cfg.sources for split in s.splits)
    if test_size is not None and not brings_test:
        rows = mix.split_train_test(rows, cfg.seed, test_size, "source", "row_id")
    if debug:
        order = hash_key(cfg.seed, "source", "split", "row_id") if cfg.shuffle else F.col("row_id")
        rows = mix.debug_head(rows, order)
    return apply(mix.shuffled(rows, cfg.seed, "source", "split", "row_id") if cfg.shuffle else rows)
