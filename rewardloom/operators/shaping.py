"""Task shaping: message columns to the text columns a training task reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.chat import (
    ChatTemplate,
    has_message_type,
    insert_empty_system,
    is_message_list,
    preference_texts,
    render,
)

TASKS = ("sft", "generation", "rm", "dpo", "orpo")


def _require(df: DataFrame, task: str, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"task {task} needs the columns {', '.join(columns)}; missing: {', '.join(missing)}")
    wrong = [c for c in columns if not has_message_type(df.schema[c].dataType)]
    if wrong:
        raise ValueError(f"task {task} needs message lists in: {', '.join(wrong)}")


def shape_for_task(df: DataFrame, task: str, template: ChatTemplate, insert_system: bool = True) -> DataFrame:
    """Add the text columns of ``task``; all other columns stay."""
    if task not in TASKS:
        raise ValueError(f"task {task} is not one of {', '.join(TASKS)}")

    def shown(name: str, **options):
        messages = F.col(name)
        return render(insert_empty_system(messages, template) if insert_system else messages, template, **options)

    if task in ("sft", "generation"):
        _require(df, task, "messages")
        return df.withColumn("text", shown("messages", add_generation_prompt=task == "generation"))
    _require(df, task, "chosen", "rejected")
    if task == "rm":
        return df.withColumns({"text_chosen": shown("chosen"), "text_rejected": shown("rejected")})
    for name in ("chosen", "rejected"):
        problem = F.raise_error(F.lit(f"task {task} needs role and content in every message of {name}"))
        df = df.withColumn(name, F.when(is_message_list(F.col(name)), F.col(name)).otherwise(problem))
    prompt = F.col("prompt") if "prompt" in df.columns and has_message_type(df.schema["prompt"].dataType) else None
    return df.withColumns(preference_texts(F.col("chosen"), F.col("rejected"), template, prompt, insert_system))
