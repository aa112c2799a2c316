"""Countdown equations: column checks first, a small safe evaluator for what survives them."""

from __future__ import annotations

import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.scorers import flag
from rewardloom.functions.text import SPACE_CLASS, between, strip
from rewardloom.session import stage

TOLERANCE = 1e-5
ALLOWED = r"\A(?:[0-9+\-*/().]|" + SPACE_CLASS + r")+\z"
MAX_POWER_BITS = 1 << 20  # default of RewardConfig.max_power_bits
MAX_PARENTHESES = 200  # fixed value: deeper nesting is no valid expression in Python

_TOKEN = re.compile(r"[ \t\f]*(?:([0-9]*\.[0-9]+|[0-9]+\.|0+(?![0-9])|[1-9][0-9]*(?!\.))|(\*\*|//|[-+*/()]))")
_BINARY = {
    "+": (1, operator.add),
    "-": (1, operator.sub),
    "*": (2, operator.mul),
    "/": (2, operator.truediv),
    "//": (2, operator.floordiv),
    "**": (4, None),
}
_SIGN = 3
_SIGNS = {"+": operator.pos, "-": operator.neg}


class RefusedError(ArithmeticError):
    """A power whose integer result would have more bits than allowed."""


def _power(base, exponent, max_bits: int):
    """A power as Python has it; 0, 1 and -1 are exact for every exponent, other integers up to ``max_bits`` bits."""
    if isinstance(base, int) and isinstance(exponent, int) and exponent >= 0:
        if base in (0, 1) or exponent == 0:
            return base if exponent else 1
        if base == -1:
            return 1 - 2 * (exponent % 2)
        if (abs(base).bit_length() - 1) * exponent > max_bits:
            raise RefusedError
    return base**exponent


def _postfix(text: str) -> list:
    """Numbers, and operators as (name, operands), in order of evaluation. Works on a stack, so depth is no limit."""
    out, waiting, operand, depth, at = [], [], False, 0, 0
    text = text.rstrip()
    while at < len(text):
        token = _TOKEN.match(text, at)
        if not token:
            raise SyntaxError(text[:40])
        at = token.end()
        number, mark = token.groups()
        if number is not None:
            if operand:
                raise SyntaxError(number)
            out.append(float(number) if "." in number else int(number))
            operand = True
        elif mark == "(":
            depth += 1
            if operand or depth > MAX_PARENTHESES:
                raise SyntaxError(mark)
            waiting.append((mark, 0))
        elif mark == ")":
            if not operand or not depth:
                raise SyntaxError(mark)
            depth -= 1
            while waiting[-1][0] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif operand:
            rank = _BINARY[mark][0]
            while waiting and (waiting[-1][0] != "(" and (_rank(waiting[-1]) > rank or _rank(waiting[-1]) == rank != 4)):
                out.append(waiting.pop())
            waiting.append((mark, 2))
            operand = False
        elif mark in _SIGNS:
            waiting.append((mark, 1))
        else:
            raise SyntaxError(mark)
    if not operand or depth:
        raise SyntaxError(text[:40])
    return out + waiting[::-1]


def _rank(waiting: tuple[str, int]) -> int:
    return _SIGN if waiting[1] == 1 else _BINARY[waiting[0]][0]


def arithmetic(equation: str | None, max_bits: int = MAX_POWER_BITS) -> tuple[float | None, bool]:
    """Value of a plain arithmetic text, or None when it has none; and whether it was refused instead of computed."""
    if not equation:
        return None, False
    try:
        stack: list = []
        for item in _postfix(equation):
            if not isinstance(item, tuple):
                stack.append(item)
            elif item[1] == 1:
                stack.append(_SIGNS[item[0]](stack.pop()))
            else:
                right, left = stack.pop(), stack.pop()
                stack.append(_power(left, right, max_bits) if item[0] == "**" else _BINARY[item[0]][1](left, right))
        return float(stack[0]), False
    except RefusedError:
        return None, True
    except (ArithmeticError, SyntaxError, TypeError, ValueError, MemoryError):
        return None, False


def arithmetic_value(equation: str | None) -> float | None:
    return arithmetic(equation)[0]


def evaluated(equation: Column, max_bits: int = MAX_POWER_BITS) -> Column:
    """struct<value, refused>, Arrow-batched; each distinct equation of a batch is evaluated once."""

    def evaluate(equations: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(equations, use_na_sentinel=True)
        found = [arithmetic(text, max_bits) for text in distinct] + [(None, False)]
        values = pd.Series([found[code][0] for code in codes], dtype="float64")
        return pd.DataFrame({"value": values, "refused": [found[code][1] for code in codes]})

    return F.pandas_udf(evaluate, "value double, refused boolean")(equation)


def evaluate_equation(equation: Column, max_bits: int = MAX_POWER_BITS) -> Column:
    return evaluated(equation, max_bits)["value"]


def answer_line(text: Column) -> Column:
    """Stripped body of the first answer block that stays on one line, '' without one. Each line is searched once."""
    bodies = F.filter(F.transform(F.split(text, "\n"), lambda line: between(line, "<answer>", "</answer>")), lambda b: b.isNotNull())
    return F.when(F.contains(text, F.lit("</answer>")), F.coalesce(strip(F.get(bodies, F.lit(0))), F.lit(""))).otherwise(F.lit(""))


def number_bag(equation: Column) -> Column:
    """Sorted digit runs without leading zeros, as text, so that no run can overflow."""
    runs = F.regexp_extract_all(equation, F.lit(r"([0-9]+)"), F.lit(1))
    return F.array_sort(F.transform(runs, lambda d: F.regexp_replace(d, r"^0+(?=[0-9])", "")))


def usable_equation(equation: Column, nums: Column) -> Column:
    """The equation when it uses exactly ``nums`` and only arithmetic characters, else null."""
    wanted = F.array_sort(F.transform(nums, lambda n: n.cast("string")))
    return F.when(equation.rlike(ALLOWED) & (number_bag(equation) == wanted), equation)


def hits_target(value: Column, target: Column) -> Column:
    """Not-a-number compares as false here, as it does in Python."""
    gap = F.abs(value - target.cast("double"))
    return flag((gap < F.lit(TOLERANCE)) & ~F.isnan(gap))


def countdown_equation_reward(text: Column, target: Column, nums: Column, max_bits: int = MAX_POWER_BITS) -> Column:
    """1.0 when the answer uses every number once and reaches the target; null when its value was refused."""
    found = evaluated(usable_equation(answer_line(text), nums), max_bits)
    return F.when(~found["refused"], hits_target(found["value"], target))


def evaluate_distinct(
    df: DataFrame, equation: str = "equation", value: str = "equation_value", max_bits: int = MAX_POWER_BITS
) -> DataFrame:
    """Evaluate each distinct equation once and join its value back, with ``{value}_refused``.

    ``df`` is narrow (ids, target, equation) and written once, so the texts it comes from are read once. The distinct
    pass combines on the map side, so a text that fills a third of the table still ships one row per task; the join
    back is an equi join whose hot partitions adaptive execution splits. Rows without an equation take no part in it.
    """
    df = stage(df, "equations")
    refused = f"{value}_refused"
    known = df.where(F.col(equation).isNotNull())
    values = known.select(equation).distinct().withColumn("_found", evaluated(F.col(equation), max_bits))
    values = values.select(equation, F.col("_found.value").alias(value), F.col("_found.refused").alias(refused))
    values = stage(values, "equation-values")
    missing = df.where(F.col(equation).isNull()).withColumns({value: F.lit(None).cast("double"), refused: F.lit(False)})
    return known.join(values, equation, "left").select(*df.columns, value, refused).unionByName(missing)
