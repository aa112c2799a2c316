"""Verdicts on short answers, many of which come again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.answers import EXPRESSION, agree, read_answer
from rewardloom.session import near_rows, stage


def with_verdicts(df: DataFrame, answer: str, gold: str, verdict: str, mode: str = EXPRESSION) -> DataFrame:
    """Add ``verdict``, whether the texts ``answer`` and ``gold`` agree; false where either is missing.

    Each distinct pair is read once, in a projection of its own, since ``agree`` looks at a reading many times. The pairs
    join back to the rows: sent to every executor while they are few, else by a shuffle of both sides.
    """
    pairs = df.select(F.col(answer).alias("_answer"), F.col(gold).alias("_gold")).dropna().distinct()
    read = pairs.withColumns({"_a": read_answer(F.col("_answer"), mode), "_g": read_answer(F.col("_gold"), mode, gold=True)})
    judged = stage(read.select("_answer", "_gold", agree(F.col("_a"), F.col("_g")).alias("_verdict")), "verdicts")
    rows = df.join(near_rows(judged), (F.col(answer) == F.col("_answer")) & (F.col(gold) == F.col("_gold")), "left")
    return rows.select(*df.columns, F.coalesce("_verdict", F.lit(False)).alias(verdict))
