"""Reward columns against literal cases and against plain-Python statements of the same rules."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from rewardloom.config import RewardConfig
from rewardloom.functions import scorers
from rewardloom.functions.text import PY_SPACE, SPACE_CLASS, strip, words

PIECES = [
    "<think>", "</think>", "<answer>", "</answer>", "<reasoning>", "</reasoning>", "\n", "\n\n", " ", "\r", "\u0085",
    " ", " ", "\x1c", "\t", "Step 1:", "Step 22:", "1.", "7.", "- ", "* ", "First,", "Second,", "Next,", "Finally,",
    "```python\n", "```", "code", "a", "b", "A", "the", "é", "ß", "42", "0", "x y", "<", ">", "</", "think>", ".", ",",
]


def generated(count, seed, lead=()):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        body = [rng.choice(PIECES) for _ in range(rng.randint(0, 16))]
        if lead and rng.random() < 0.7:
            body = list(rng.choice(lead)) + body
            for k in range(len(body)):
                if rng.random() < 0.05:
                    body[k] = rng.choice(PIECES)
        out.append("".join(body))
    return out


THINK = [
    ("<think>", "a", "</think>", "\n", "<answer>", "42", "</answer>"),
    ("<think>\n", "a", "\n</think>\n", "<answer>\n", "42", "\n</answer>"),
    ("<think>\n", "a", "\n</think>\n<answer>\n", "```python\n", "code", "```", "\n</answer>"),
    ("a", "</think>\n<answer>", "42", "</answer>"),
    ("a", "</think>\n<answer>", "42", "</answer>\n"),
    ("<reasoning>\n", "a", "\n</reasoning>\n<answer>\n", "42", "\n</answer>\n"),
    ("<reasoning>", "a", "</reasoning>", " ", "<answer>", "42", "</answer>"),
]
CASES = generated(4000, 7, THINK)


def yes(found, worth=1.0):
    return worth if found else 0.0


def same(evaluate, build, expected, cases=CASES):
    got = evaluate(build, cases)
    wrong = [(c, g, e) for c, g, e in zip(cases, got, (expected(c) for c in cases)) if g != pytest.approx(e, abs=1e-12)]
    assert not wrong, wrong[:3]


# ---- literal cases --------------------------------------------------------------------------------------------


def test_format_layouts(evaluate):
    good = "<think>\nsome thoughts\n</think>\n<answer>\nan answer\n</answer>"
    bad = ["<think>no answer</think>", "<answer>no thoughts</answer>", "plain", "<think>open</think><answer>open",
           "<think>swapped</answer><answer>swapped</think>"]
    assert evaluate(scorers.format_reward, [good, *bad]) == [1.0, 0, 0, 0, 0, 0]


def test_reasoning_steps(evaluate):
    cases = ["Step 1: a\nStep 2: b\nStep 3: c", "First, a\nSecond, b\nFinally, c", "Step 1: a", "First, a\nFinally, b", "text",
             "text\n1. a", "1. a"]
    assert evaluate(scorers.reasoning_steps_reward, cases) == pytest.approx([1, 1, 1 / 3, 2 / 3, 0, 0, 1 / 3])


def test_repetition_by_hand(evaluate):
    score = evaluate(lambda t: scorers.repetition_penalty_reward(t, 3, -1.0), ["a b c A b c d", "", "a b", "a b c"])
    assert score == pytest.approx([-0.2, 0, 0, 0])
    with pytest.raises(ValueError):
        scorers.repetition_penalty_reward(F.col("text"), 3, 0.5)


def test_xml_count_exceeds_by_a_thousandth(evaluate):
    assert evaluate(scorers.xml_count_reward, ["x\n</answer>"]) == pytest.approx([0.125 + 0.001])


def test_null_text(evaluate):
    builders = [scorers.format_reward, scorers.tag_count_reward, scorers.countdown_format_reward, scorers.code_format_reward]
    for build in builders:
        assert evaluate(build, [None]) == [0.0]
    assert evaluate(scorers.extract_answer, [None]) == [""]


# ---- agreement with Python's own text rules -------------------------------------------------------------------


def test_space_rules(evaluate):
    odd = [c + "x" + c + "y" + c for c in PY_SPACE] + ["x​y", "", " \n "]
    assert evaluate(strip, odd) == [t.strip() for t in odd]
    assert evaluate(words, odd) == [t.split() for t in odd]
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert evaluate(lambda t: t.rlike(r"\A" + SPACE_CLASS + r"\z"), every) == [c.isspace() for c in every]


def test_format_agrees(evaluate):
    pattern = re.compile(r"<think>.*?</think>\s*<answer>.*?</answer>", re.S)
    same(evaluate, scorers.format_reward, lambda t: yes(pattern.match(t)))


def test_tags_agree(evaluate):
    same(evaluate, scorers.tag_count_reward, lambda t: sum(0.25 for tag in scorers.THINK_TAGS if t.count(tag) == 1))


def test_steps_agree(evaluate):
    markers = re.compile(r"Step [0-9]+:|\A[0-9]+\.|\n-|\n\*|First,|Second,|Next,|Finally,")
    same(evaluate, scorers.reasoning_steps_reward, lambda t: min(1.0, len(markers.findall(t)) / 3))


def test_countdown_format_agrees(evaluate):
    def expected(t):
        head, closed, tail = t.partition("</think>")
        fits = closed and "<think>" not in head and tail.startswith("\n<answer>")
        return yes(fits and (tail.endswith("</answer>") or tail.endswith("</answer>\n")))

    same(evaluate, scorers.countdown_format_reward, expected)


@pytest.mark.parametrize("language", ["python", "bash"])
def test_code_format_agrees(evaluate, language):
    fence = "```" + language
    pattern = re.compile(rf"<think>\n.*?\n</think>\n<answer>\n.*?{fence}.*?```.*?\n</answer>$", re.S | re.M)
    same(evaluate, lambda t: scorers.code_format_reward(t, language), lambda t: yes(pattern.match(t)))


def test_code_language_is_checked():
    with pytest.raises(ValueError):
        scorers.code_format_reward(F.col("text"), "cobol")
    with pytest.raises(ValueError):
        RewardConfig(code_language="cobol")


def test_strict_and_soft_agree(evaluate):
    strict = re.compile(r"<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n$")
    soft = re.compile(r"<reasoning>.*?</reasoning>\s*<answer>.*?</answer>")
    same(evaluate, scorers.strict_format_reward, lambda t: yes(strict.match(t), 0.5))
    same(evaluate, scorers.soft_format_reward, lambda t: yes(soft.match(t), 0.5))


def test_xml_count_agrees(evaluate):
    def expected(t):
        first, second, third, fourth = (t.count(tag) == 1 for tag in scorers.REASONING_TAGS)
        score = 0.125 * (first + second + third + fourth)
        if third:
            score -= 0.001 * len(t.split("\n</answer>\n")[-1])
        if fourth:
            score -= 0.001 * (len(t.split("\n</answer>")[-1]) - 1)
        return score

    same(evaluate, scorers.xml_count_reward, expected)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_repetition_agrees(evaluate, size):
    def expected(t):
        w = t.lower().split()
        runs = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        return (1 - len(set(runs)) / len(runs)) * -0.7 if runs else 0.0

    same(evaluate, lambda t: scorers.repetition_penalty_reward(t, size, -0.7), expected)


def test_extraction_agrees(evaluate):
    def first(t):
        found = re.search(r"<answer>(.*?)</answer>", t, re.S)
        return (found.group(1) if found else t).strip()

    def code(t):
        found = re.findall(r"```python\n(.*?)```", t, re.S)
        return found[-1] if found else ""

    for build, expected in (
        (scorers.extract_answer, first),
        (scorers.last_answer, lambda t: t.rsplit("<answer>", 1)[-1].split("</answer>", 1)[0].strip()),
        (scorers.extract_code, code),
    ):
        assert evaluate(build, CASES) == [expected(t) for t in CASES]


def test_normalized_text(evaluate):
    def expected(t):
        bare = "".join(c for c in t.lower() if c not in string.punctuation)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", bare).split())

    cases = [*CASES, "The cat, an owl; a bee!", "A-a the_the aé an x"]
    assert evaluate(scorers.normalized_text, cases) == [expected(t) for t in cases]


# ---- schedules ------------------------------------------------------------------------------------------------


def test_cosine_schedule(spark):
    rows = [(0, True, True), (1000, True, True), (500, False, True), (0, False, True), (7, False, False)]
    df = spark.createDataFrame(rows, "n int, right boolean, ok boolean")
    got = [r.v for r in df.select(scorers.cosine_reward(F.col("n"), F.col("right"), F.col("ok")).alias("v")).collect()]
    assert got == pytest.approx([1.0, 0.5, -0.25, 0.0, 1.0])


def test_length_reward(spark):
    rows = [(10, 10, 20, True), (20, 10, 20, True), (20, 10, 20, False), (10, 10, 20, False), (5, 5, 5, True)]
    df = spark.createDataFrame(rows, "n int, lo int, hi int, right boolean")
    value = scorers.length_reward(F.col("n"), F.col("lo"), F.col("hi"), F.col("right"))
    assert [r.v for r in df.select(value.alias("v")).collect()] == pytest.approx([0.5, -0.5, -0.5, 0.0, 0.0])


# ---- hostile inputs -------------------------------------------------------------------------------------------

HOSTILE = [
    "<" * 200_000,
    "<think>" + "<answer>" * 20_000,
    "<think>" + "</think><answer>" * 10_000,
    "<think>" + "</think> " * 20_000,
    "a\n" * 100_000 + "</think>\n<answer>",
    " " * 300_000 + "x" + " " * 300_000,
    "```python\n" * 20_000,
    "\\boxed{" * 20_000 + "}" * 20_000,
    "<answer>(" + "1," * 50_000 + "</answer>",
    "</answer>\n" + "<answer>" * 25_000,
    "<reasoning>" + "</reasoning><answer>" * 10_000 + "\n</answer>",
    "<reasoning>" + "</reasoning> " * 20_000 + "\n" * 50_000 + "<answer>" * 20_000 + "\n</answer>",
]


def test_hostile_texts_neither_overflow_nor_stall(evaluate):
    from rewardloom.functions.answers import agree, read_answer
    from rewardloom.functions.equations import answer_line

    builders = [
        scorers.format_reward, scorers.tag_count_reward, scorers.reasoning_steps_reward, scorers.countdown_format_reward,
        scorers.code_format_reward, scorers.strict_format_reward, scorers.soft_format_reward, scorers.xml_count_reward,
        scorers.repetition_penalty_reward, scorers.extract_answer, scorers.last_answer, scorers.extract_code,
        scorers.normalized_text, answer_line, read_answer, lambda t: agree(read_answer(t), read_answer(t, gold=True)),
    ]
    for build in builders:
        began = time.perf_counter()
        assert len(evaluate(build, HOSTILE)) == len(HOSTILE)
        assert time.perf_counter() - began < 30, build
