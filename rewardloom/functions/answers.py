"""Answer equivalence as columns: find the answer, bring it to a canonical form, compare.

Supported forms: boxed answers with braces nested to any depth, ``$..$`` and ``\\(..\\)`` spans, fractions, decimals,
percentages, thousands separators, scientific notation, square roots of numbers, multiples of pi, the right side of an
equation, unit words and spacing commands; tuples and sets are compared element by element. Two answers agree when both
have a number and the numbers agree, or when neither has one and the canonical texts agree, or else, if both can be
expressions, when these are algebraically equal (``functions/algebra.py``).

Two readings of a text exist. ``EXPRESSION`` accepts any of the forms above and falls back to the last number of the
text. ``LATEX`` accepts marked answers only: a boxed or ``$..$`` gold answer, and in a completion a boxed one or one
announced as the answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.algebra import equal_answers
from rewardloom.functions.text import SPACE_CLASS, after_last, between, let, strip

EXPRESSION = "expression"
LATEX = "latex"
RELATIVE_TOLERANCE = 1e-9

# Number grammar and the markup removed before comparing.
PLAIN_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
GROUPED_NUMBER = r"[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
SPACING = r"\\left|\\right|\\displaystyle|\\[!,;: ]|\$|\\\(|\\\)|\\\[|\\\]"
WORD_COMMAND = r"\\(?:text|mathrm|textbf|mbox)\{([^{}]*)\}"
UNIT_AFTER_VALUE = r"([0-9}])\\(?:text|mathrm|textbf|mbox)\{[^{}]*\}"
DEGREES = r"\^\{?\\circ\}?|degrees?"
FRACTION_COMMANDS = r"\\[dtc]frac"
FRACTION = r"\A([+-]?)\\frac\{(-?[0-9]+(?:\.[0-9]+)?)\}\{(-?[0-9]+(?:\.[0-9]+)?)\}\z"
RATIO = r"\A([+-]?[0-9]+(?:\.[0-9]+)?)/([0-9]+(?:\.[0-9]+)?)\z"
PERCENT = r"\A(" + PLAIN_NUMBER + r")\\?%\z"
SCIENTIFIC = r"\A([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))(?:[eE]|(?:\\times|\\cdot)10\^\{?)([+-]?[0-9]{1,3})\}?\z"
ROOT = r"\A([+-]?)([0-9]*(?:\.[0-9]+)?)\\sqrt\{?([0-9]+(?:\.[0-9]+)?)\}?\z"
PI = r"\A([+-]?)(?:\\frac\{)?([0-9]*(?:\.[0-9]+)?)\\pi(?:(?:\}\{|/)([0-9]+)\}?)?\z"
RIGHT_SIDE = r"\A[A-Za-z](?:_\{?[A-Za-z0-9]+\}?)?=([^=]+)\z"
SHORT_FRACTIONS = ((r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}"), (r"\\frac([0-9])\{", r"\\frac{$1}{"), (r"\\frac(\{[^{}]*\})([0-9])", r"\\frac$1{$2}"))
ELEMENTS = r"\A(\(|\[|\\?\{)([^()\[\]]*)(\)|\]|\})\z"
ANNOUNCED = r"(?i)answer(?: is)?:? \$([^$]+)\$"
SPAN = r"\$([^$]+)\$"
PROSE = r"(?:\A|[^\\A-Za-z])[A-Za-z]{7,}|[`~@#?\"'&]"  # no name of a function is as long, and no expression has these
OPERATION = r"[\\^*/+=<>|!_,-]|[0-9)][A-Za-z(]|[^\x00-\x7F]"
NUMBER_RUN = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"


def boxed(text: Column) -> Column:
    """Content of the last box, braces matched to any depth; null without a closed box.

    The text after the mark is cut at closing braces. The box ends at the first piece up to which as many braces were
    opened as pieces were passed.
    """

    def with_end(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("opened"), F.lit(0).alias("passed"), F.lit(0).alias("end"))

        def step(state: Column, piece: Column) -> Column:
            opened = state["opened"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
            closes = (state["end"] == 0) & (opened == state["passed"])
            return F.struct(
                opened.alias("opened"),
                (state["passed"] + 1).alias("passed"),
                F.when(closes, state["passed"] + 1).otherwise(state["end"]).alias("end"),
            )

        # The last piece has no closing brace after it.
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.struct(pieces.alias("pieces"), F.aggregate(closed, zero, step, lambda state: state["end"]).alias("end"))

    # One lambda after the other, none inside another: expressions of that kind can be the input of a Python step.
    cut = let(F.split(after_last(text, "\\boxed{"), r"\}"), with_end)
    content = let(cut, lambda c: F.when(c["end"] > 0, F.array_join(F.slice(c["pieces"], F.lit(1), c["end"]), "}")))
    return F.when(F.contains(text, F.lit("\\boxed{")), content)


def last_match(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def last_number(text: Column) -> Column:
    return last_match(text, "(" + NUMBER_RUN + ")", 1)


def canonical(answer: Column) -> Column:
    """Answer text without spacing, units and a closing full stop."""
    plain = F.regexp_replace(answer, SPACING + "|" + SPACE_CLASS + "+", "")
    plain = F.regexp_replace(plain, UNIT_AFTER_VALUE, "$1")
    plain = F.regexp_replace(plain, WORD_COMMAND, "$1")
    plain = F.regexp_replace(plain, DEGREES, "")
    plain = F.regexp_replace(plain, FRACTION_COMMANDS, r"\\frac")
    for pattern, form in SHORT_FRACTIONS:
        plain = F.regexp_replace(plain, pattern, form)
    plain = F.regexp_replace(plain, r"\.\z", "")
    return F.regexp_replace(plain, RIGHT_SIDE, "$1")


def by_element(canon: Column) -> Column:
    """A tuple, an interval or a set with every number in it in one form; the elements of a set in order."""
    opening, body, closing = (F.regexp_extract(canon, ELEMENTS, i) for i in (1, 2, 3))
    body = F.rtrim(body, F.lit("\\"))  # the one before a closing brace
    read = F.transform(F.split(body, ","), lambda e: F.struct(e.alias("text"), number(e).alias("num")))
    elements = F.transform(read, lambda e: F.coalesce((e["num"] + F.lit(0.0)).cast("string"), e["text"]))
    elements = F.when(F.endswith(opening, F.lit("{")), F.array_sort(F.array_distinct(elements))).otherwise(elements)
    written = F.concat(opening, F.array_join(elements, ","), closing)
    return F.when(F.contains(canon, F.lit(",")) & canon.rlike(ELEMENTS), written).otherwise(canon)


def number(canon: Column) -> Column:
    """Numeric value of a canonical answer, null when it is not a number."""

    def group(pattern: str, index: int) -> Column:
        return F.regexp_extract(canon, pattern, index).try_cast("double")

    sign = F.when(F.regexp_extract(canon, FRACTION, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(canon.rlike(r"\A" + PLAIN_NUMBER + r"\z"), canon.try_cast("double"))
        .when(canon.rlike(r"\A" + GROUPED_NUMBER + r"\z"), F.regexp_replace(canon, ",", "").try_cast("double"))
        .when(canon.rlike(FRACTION), F.try_divide(sign * group(FRACTION, 2), group(FRACTION, 3)))
        .when(canon.rlike(RATIO), F.try_divide(group(RATIO, 1), group(RATIO, 2)))
        .when(canon.rlike(PERCENT), group(PERCENT, 1) / F.lit(100.0))
        .when(canon.rlike(SCIENTIFIC), F.concat(F.regexp_extract(canon, SCIENTIFIC, 1), F.lit("e"), F.regexp_extract(canon, SCIENTIFIC, 2)).try_cast("double"))
        .when(canon.rlike(ROOT), _signed(canon, ROOT) * F.coalesce(group(ROOT, 2), F.lit(1.0)) * F.sqrt(group(ROOT, 3)))
        .when(canon.rlike(PI), F.try_divide(_signed(canon, PI) * F.coalesce(group(PI, 2), F.lit(1.0)) * F.pi(), F.coalesce(group(PI, 3), F.lit(1.0))))
    )


def _signed(canon: Column, pattern: str) -> Column:
    return F.when(F.regexp_extract(canon, pattern, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))


def _first_reading(*candidates: tuple[Column, bool]) -> Column:
    """struct(canon, num) of the first candidate that gives one, null when none does.

    A candidate marked True counts only when it is a number as a whole. All candidates pass through the same lambdas, so the
    canonical form and the number grammar occur once in the plan.
    """
    listed = F.array(*[F.struct(src.alias("src"), F.lit(strict).alias("strict")) for src, strict in candidates])

    given = F.filter(listed, lambda c: c["src"].isNotNull())
    canons = F.transform(given, lambda c: F.struct(canonical(c["src"]).alias("canon"), c["strict"].alias("strict")))
    read = F.transform(canons, lambda c: F.struct(c["canon"].alias("canon"), number(c["canon"]).alias("num"), c["strict"].alias("strict")))
    usable = F.filter(read, lambda r: (r["canon"] != "") & (~r["strict"] | r["num"].isNotNull()))
    return F.try_element_at(usable, F.lit(1))


def read_answer(text: Column, mode: str = EXPRESSION, gold: bool = False) -> Column:
    """struct(canon, num, ..) of the answer a text gives, null when it gives none."""
    box = (boxed(text), False)
    if mode == LATEX:
        return _first_reading(box, (last_match(text, SPAN if gold else ANNOUNCED, 1), False))
    if mode != EXPRESSION:
        raise ValueError(f"mode must be {EXPRESSION} or {LATEX}")
    tag = between(text, "<answer>", "</answer>")
    # Tagged text is read as a number, else as the last number in it, else as text.
    candidates = [box, (tag, True), (last_number(tag), False), (tag, False)]
    if gold:
        bare_latex = F.when(strip(text).startswith("\\"), text)
        candidates += [(last_match(text, SPAN, 1), False), (bare_latex, False), (text, True)]
    # The last number of a whole text is searched only when nothing marked was found.
    return F.coalesce(_first_reading(*candidates), _first_reading((last_number(text), False)))


def agree(answer: Column, gold: Column) -> Column:
    """Equality of two readings; false when either is missing. They are used many times here: name them in a projection first."""
    near = F.abs(answer["num"] - gold["num"]) <= F.lit(RELATIVE_TOLERANCE) * F.greatest(
        F.lit(1.0), F.abs(gold["num"])
    )
    texts = answer["num"].isNull() & gold["num"].isNull() & (by_element(answer["canon"]) == by_element(gold["canon"]))
    numbers = answer["num"].isNotNull() & gold["num"].isNotNull()
    plain = F.coalesce(F.when(numbers, near).otherwise(texts), F.lit(False))
    # Python sees only pairs that differ as texts and that can be expressions.
    either = answer["canon"].rlike(OPERATION) | gold["canon"].rlike(OPERATION)
    open_ = ~numbers & (answer["canon"] != gold["canon"]) & either & ~answer["canon"].rlike(PROSE) & ~gold["canon"].rlike(PROSE)
    return plain | equal_answers(F.when(open_, answer["canon"]), F.when(open_, gold["canon"]))
