"""Answer equivalence and countdown equations."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from rewardloom.catalog import QUERIES
from rewardloom.functions.answers import EXPRESSION, LATEX, agree, boxed, read_answer
from rewardloom.functions.equations import arithmetic, arithmetic_value, countdown_equation_reward, evaluate_distinct
from rewardloom.functions.scorers import accuracy_reward, countdown_format_reward
from rewardloom.operators.verdicts import with_verdicts


def verdicts(spark, pairs, mode=EXPRESSION):
    df = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(pairs)], "i int, c string, s string")
    read = df.select(
        "i", read_answer(F.col("c"), mode).alias("a"), read_answer(F.col("s"), mode, gold=True).alias("g")
    )
    value = accuracy_reward(F.col("g").isNotNull(), agree(F.col("a"), F.col("g")))
    return [r.v for r in read.orderBy("i").select(value.alias("v")).collect()]


def test_fractions(spark):
    gold = r"\frac{63}{400}"
    assert verdicts(spark, [(rf"\boxed{{{gold}}}", gold), (r"\boxed{\frac{64}{400}}", gold)]) == [1.0, 0.0]


def test_equal_forms(spark):
    pairs = [
        ("so it is 0.5", "$1/2$"),
        (r"\boxed{50\%}", "0.5"),
        ("<answer>1,234</answer>", "1234"),
        ("<answer>The total is 42 apples.</answer>", "42"),
        (r"$\boxed{\dfrac{-3}{4}}$", "-0.75"),
        (r"\boxed{5\text{ cm}}", "5"),
        (r"\boxed{x+1}", "$x + 1$"),
        (r"\boxed{\text{none}}", r"\text{none}"),
        ("I think 12. No, 13", "13"),
        ("5", "$x = 5$"),
        ("0.5", r"\frac12"),
        ("1000", "$1e3$"),
        (r"\boxed{3.2\times 10^{4}}", "32000"),
        ("2", r"\sqrt{4}"),
        (r"\boxed{\frac{6\pi}{4}}", r"$1.5\pi$"),
        (r"\boxed{(1, 2)}", "$(1.0,2)$"),
        (r"\boxed{\{3, 1, 1\}}", r"$\{1,3.0\}$"),
        (r"\boxed{[0, \frac{1}{2})}", "$[0,0.5)$"),
    ]
    assert verdicts(spark, pairs) == [1.0] * len(pairs)


def test_unequal_and_unreadable(spark):
    pairs = [("no number", "42"), ("42", "no number"), (r"\boxed{x}", "$y$"), ("1/0", r"$\frac{1}{0}$"), ("7", "8")]
    assert verdicts(spark, pairs) == [0.0, 0.25, 0.0, 0.0, 0.0]


def test_marked_answers_only(spark):
    pairs = [("it is 42", "$42$"), ("The answer is $42$.", "$42$"), (r"\boxed{42}", "$42$"), ("42", "42")]
    assert verdicts(spark, pairs, LATEX) == [0.0, 1.0, 1.0, 0.25]


def test_braces_nest_to_any_depth(evaluate):
    deep = "{" * 50 + "x" + "}" * 50
    cases = [r"\boxed{" + deep + "} rest}", r"\boxed{a} and \boxed{b}", r"\boxed{open", "none", r"\boxed{}"]
    assert evaluate(boxed, cases) == [deep, "b", None, None, ""]


def test_arithmetic():
    good = {"(1 + 2) / 3": 1.0, "7//2": 3.0, "2**10": 1024.0, "-3 + +4": 1.0, "1.5*2": 3.0}
    for text, value in good.items():
        assert arithmetic_value(text) == value
    powers = {"1**5000+64": 65.0, "(1)**4097": 1.0, "2**4097//2**4096+63": 65.0, "(-1)**4097": -1.0, "0**99999": 0.0, "-2**2": -4.0, "2**-1**2": 0.5,
              "2**3**2": 512.0, "7-2-1": 4.0, "-3//2*4": -8.0, "2*-3+1": -5.0, "00+.5+2.": 2.5, "07.5": 7.5}
    for text, value in powers.items():
        assert arithmetic_value(text) == value, text
    assert arithmetic_value("+".join(["1"] * 5000)) == 5000.0
    assert arithmetic_value("+".join(["1"] * 100_000)) == 100_000.0
    assert arithmetic_value("(" * 150 + "2" + ")" * 150) == 2.0
    assert arithmetic("9**9**9") == (None, True) and arithmetic("9**9**9+") == (None, False)
    assert arithmetic("2**100", max_bits=50) == (None, True)
    for text in ["07+1", "1/0", "2(3)", "()", "...", "(-8)**0.5", "9**9**9", "a+1", "1 1", "(" * 5000, "1" * 400 + " / 3", "", None,
                 "__import__('os')", "True", "1_0 if 1 else 2", "1.2.3", "1+", "*1", "(1", "1)", "1 \n2", "(" * 201 + "1" + ")" * 201]:
        assert arithmetic_value(text) is None, text


def _tasks(spark, rows):
    return spark.createDataFrame(rows, "i int, text string, target double, nums array<bigint>")


SAMPLES = [
    ("One way is 55 + 36 - 19 + 7... </think>\n<answer> 55 + 36 - 7 - 19 </answer>", 1.0, 1.0),
    (" ... </think>\n<answer> 55 + 36 - 7 - 19 </answer>", 1.0, 1.0),
    ("User: use [19, 36, 55, 7] to make 65.", 0.0, 0.0),
    ("95 + 88\n<think> 183 - 104 = 79 </think><think> x </think><answer> 183 - 104 = 79 </answer>", 0.0, 0.0),
    (" ... </think>\n<answer> 55 + 36 - 7 - 18 </answer>", 1.0, 0.0),
]


def test_countdown_samples(spark):
    df = _tasks(spark, [(i, t, 65.0, [19, 36, 55, 7]) for i, (t, _, _) in enumerate(SAMPLES)])
    got = df.orderBy("i").select(
        countdown_format_reward(F.col("text")).alias("f"),
        countdown_equation_reward(F.col("text"), F.col("target"), F.col("nums")).alias("e"),
    )
    assert [(r.f, r.e) for r in got.collect()] == [(f, e) for _, f, e in SAMPLES]


@pytest.mark.parametrize(
    "answer, target, nums, reward",
    [
        ("1.5 + 2", 3.5, [1, 5, 2], 1.0),  # a decimal uses its digits as two numbers
        ("2\n+ 3", 5.0, [2, 3], 0.0),  # must stay on one line
        ("2 + 3 + 3", 8.0, [2, 3], 0.0),
        ("3 + 2", 5.0, [2, 3], 1.0),
        ("2 / 3", 0.6666666, [2, 3], 1.0),  # within the tolerance
        ("2 / 3", 0.66, [2, 3], 0.0),
        ("02 + 3", 5.0, [2, 3], 0.0),
        ("2 ** 3", 8.0, [2, 3], 1.0),
        ("99999999999999999999 - 99999999999999999999", 0.0, [1], 0.0),
        ("2 + 3 = 5", 5.0, [2, 3, 5], 0.0),
    ],
)
def test_countdown_rules(spark, answer, target, nums, reward):
    df = _tasks(spark, [(0, f"x</think>\n<answer>{answer}</answer>", target, nums)])
    value = countdown_equation_reward(F.col("text"), F.col("target"), F.col("nums"))
    assert df.select(value.alias("v")).first().v == reward


def test_first_one_line_answer_counts(spark):
    df = _tasks(spark, [(0, "<answer>\n9\n</answer> <answer>2 + 3</answer> <answer>1</answer>", 5.0, [3, 2])])
    assert df.select(countdown_equation_reward(F.col("text"), F.col("target"), F.col("nums")).alias("v")).first().v == 1.0


def test_hot_equation_is_evaluated_once_and_joined_back(spark):
    rows = [(i, "1 + 1" if i % 3 else None if i % 2 else f"{i} + 1") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, equation string")
    got = {r.i: r.equation_value for r in evaluate_distinct(df).collect()}
    assert got == {i: (None if e is None else float(eval(e))) for i, e in rows}


def test_evaluator_agrees_with_python():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "2", "3", "0", "7", "+", "-", "*", "/", "//", "**", "(", ")", ".", " "]) for _ in range(rng.randrange(1, 9)))
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                wanted = float(eval(text, {"__builtins__": {}}))  # noqa: S307
        except Exception:  # noqa: BLE001
            wanted = None
        found, refused = arithmetic(text)
        assert refused or found == wanted, text


def test_refused_equations_are_null(spark):
    df = spark.createDataFrame([("<answer>9**9**9</answer>", 1.0, [9, 9, 9]), ("<answer>9**9-9</answer>", 387420480.0, [9, 9, 9])], "text string, target double, nums array<bigint>")
    got = df.select(countdown_equation_reward(F.col("text"), F.col("target"), F.col("nums")).alias("r")).collect()
    assert [r.r for r in got] == [None, 1.0]


def test_verdicts_of_repeated_pairs(spark):
    """Rows are kept, as often as they come; missing texts do not agree; Python sees no row, only distinct pairs."""
    pairs = [("It is 3", "$x = 3$"), ("It is 3", "$x = 4$"), (r"\boxed{2x}", "$x+x$"), (None, "3"), ("3", None), (None, None), ("", "")]
    df = spark.createDataFrame([(i, *pairs[i % 7]) for i in range(70)], "i int, c string, s string")
    found = with_verdicts(df, "c", "s", "v")
    assert {(r.i, r.c, r.s, r.v) for r in found.collect()} == {(i, *pairs[i % 7], i % 7 in (0, 2)) for i in range(70)}
    assert found.count() == 70
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["answer_equivalence_forms", "answer_equivalence_algebra"])
def test_spellings_are_read_once_per_pair(spark, tmp_path, name):
    spark.range(90).selectExpr("id AS l_orderkey", "id % 7 AS l_linenumber", "id % 11 AS l_partkey", "nullif(id % 5, 4) AS l_suppkey").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    found = QUERIES[name](spark, str(tmp_path))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 90 and found.where("correct IS NULL").count() == 0
