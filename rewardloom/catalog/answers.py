"""Answer equivalence and the three rewards built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import SQL_SPACE as SP
from rewardloom.catalog.registry import register, table
from rewardloom.catalog.rewards import sql_round
from rewardloom.catalog.standins import WITH_ROLLOUTS, rollouts
from rewardloom.config import RewardConfig
from rewardloom.functions import algebra
from rewardloom.functions import answers as A
from rewardloom.functions.text import between, round6
from rewardloom.operators.verdicts import with_verdicts
from rewardloom.plans.scoring import score

# ---- the same reading in SQL: one row per candidate, canonical form and number in steps ------------------------

_BOX = r"'^((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}'"
_MARK = r"'\boxed{'"
_SPAN = r"'\$([^$]+)\$'"
_ANNOUNCED = r"'(?i)answer(?: is)?:? \$([^$]+)\$'"
_RUN = r"'([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)'"
_PLAIN = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"


def _boxed(text: str) -> str:
    tail = f"list_extract(string_split({text}, {_MARK}), -1)"
    found = f"regexp_matches({tail}, {_BOX})"
    return f"CASE WHEN contains({text}, {_MARK}) AND {found} THEN regexp_extract({tail}, {_BOX}, 1) END"


def _last(text: str, pattern: str) -> str:
    return f"list_extract(regexp_extract_all({text}, {pattern}, 1), -1)"


def _tag(text: str) -> str:
    pattern = "'(?s)<answer>(.*?)</answer>'"
    return f"CASE WHEN regexp_matches({text}, {pattern}) THEN regexp_extract({text}, {pattern}, 1) END"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{SP}+|{SP}+$', '', 'g')"


def _canon(text: str) -> str:
    steps = [
        (rf"\\left|\\right|\\displaystyle|\\[!,;: ]|\$|\\\(|\\\)|\\\[|\\\]|{SP}+", ""),
        (r"([0-9}])\\(?:text|mathrm|textbf|mbox)\{[^{}]*\}", r"\1"),
        (r"\\(?:text|mathrm|textbf|mbox)\{([^{}]*)\}", r"\1"),
        (r"\^\{?\\circ\}?|degrees?", ""),
        (r"\\[dtc]frac", r"\\frac"),
        (r"\\frac([0-9])([0-9])", r"\\frac{\1}{\2}"),
        (r"\\frac([0-9])\{", r"\\frac{\1}{"),
        (r"\\frac(\{[^{}]*\})([0-9])", r"\\frac\1{\2}"),
    ]
    for pattern, repl in steps:
        text = f"regexp_replace({text}, '{pattern}', '{repl}', 'g')"
    text = f"regexp_replace({text}, '\\.$', '')"
    return rf"regexp_replace({text}, '^[A-Za-z](?:_\{{?[A-Za-z0-9]+\}}?)?=([^=]+)$', '\1')"


_NUMBER = rf"""CASE
 WHEN regexp_full_match(canon, '{_PLAIN}') THEN TRY_CAST(canon AS DOUBLE)
 WHEN regexp_full_match(canon, '[+-]?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?') THEN TRY_CAST(replace(canon, ',', '') AS DOUBLE)
 WHEN regexp_full_match(canon, '[+-]?\\frac\{{-?[0-9]+(?:\.[0-9]+)?\}}\{{-?[0-9]+(?:\.[0-9]+)?\}}')
  THEN (CASE WHEN starts_with(canon, '-') THEN -1e0 ELSE 1e0 END)
   * TRY_CAST(regexp_extract(canon, '\{{([^{{}}]*)\}}', 1) AS DOUBLE)
   / nullif(TRY_CAST(regexp_extract(canon, '\}}\{{([^{{}}]*)\}}', 1) AS DOUBLE), 0e0)
 WHEN regexp_full_match(canon, '[+-]?[0-9]+(?:\.[0-9]+)?/[0-9]+(?:\.[0-9]+)?')
  THEN TRY_CAST(split_part(canon, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(canon, '/', 2) AS DOUBLE), 0e0)
 WHEN regexp_full_match(canon, '{_PLAIN}\\?%') THEN TRY_CAST(regexp_extract(canon, '^[^%\\]*') AS DOUBLE) / 100e0
 END"""

_SIDES = ("completion", "solution")
_CANDIDATES = {
    "box": _boxed,
    "tag": _tag,
    "tagrun": lambda t: _last(_tag(t), _RUN),
    "span": lambda t: _last(t, _SPAN),
    "said": lambda t: _last(t, _ANNOUNCED),
    "bare": lambda t: f"CASE WHEN starts_with({_stripped(t)}, chr(92)) THEN {t} END",
    "whole": lambda t: t,
    "run": lambda t: _last(t, _RUN),
}
_LISTED = " UNION ALL ".join(
    f"SELECT rollout_id, '{side}' AS side, '{name}' AS kind, {make(side)} AS src FROM rollouts"
    for side in _SIDES
    for name, make in _CANDIDATES.items()
)


def _pick(*order: str) -> str:
    """coalesce over candidates as structs; a candidate with empty canonical text counts as none."""
    return "coalesce(" + ", ".join(order) + ")"


_TAGGED = "CASE WHEN tag.num IS NULL AND tag IS NOT NULL THEN coalesce(tagrun, tag) ELSE tag END"
_WHOLE = "CASE WHEN whole.num IS NOT NULL THEN whole END"
READINGS = f"""{WITH_ROLLOUTS},
 listed AS ({_LISTED}),
 canoned AS (SELECT rollout_id, side, kind, {_canon('src')} AS canon FROM listed WHERE src IS NOT NULL),
 numbered AS (SELECT rollout_id, side, kind, struct_pack(canon := canon, num := {_NUMBER}) AS r FROM canoned WHERE canon <> ''),
 wide AS (SELECT rollout_id, side, {', '.join(f"any_value(r) FILTER (WHERE kind = '{k}') AS {k}" for k in _CANDIDATES)}
  FROM numbered GROUP BY rollout_id, side),
 tagged AS (SELECT *, {_TAGGED} AS tagged FROM wide),
 picked AS (SELECT rollout_id, side,
  CASE side WHEN 'completion' THEN {_pick('box', 'tagged', 'run')} ELSE {_pick('box', 'tagged', 'span', 'bare', _WHOLE, 'run')} END AS expr,
  CASE side WHEN 'completion' THEN {_pick('box', 'said')} ELSE {_pick('box', 'span')} END AS latex FROM tagged),
 paired AS (SELECT r.rollout_id, r.batch_id, length(r.completion) AS len, c.expr AS ca, s.expr AS cg, c.latex AS la, s.latex AS lg
  FROM rollouts r LEFT JOIN (SELECT * FROM picked WHERE side = 'completion') c ON r.rollout_id = c.rollout_id
  LEFT JOIN (SELECT * FROM picked WHERE side = 'solution') s ON r.rollout_id = s.rollout_id)"""


def _agree(a: str, g: str) -> str:
    return (
        f"coalesce(CASE WHEN {a}.num IS NOT NULL AND {g}.num IS NOT NULL "
        f"THEN abs({a}.num - {g}.num) <= 0.000000001e0 * greatest(1e0, abs({g}.num)) "
        f"ELSE {a}.num IS NULL AND {g}.num IS NULL AND {a}.canon = {g}.canon END, FALSE)"
    )


def _verdicts(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    df = rollouts(spark, folder, heavy=True)
    read = df.select(
        "rollout_id",
        A.read_answer(F.col("completion"), mode).alias("a"),
        A.read_answer(F.col("solution"), mode, gold=True).alias("g"),
    )

    def shown(name: str) -> list[Column]:
        side = "answer" if name == "a" else "gold"
        return [F.col(name)["canon"].alias(f"{side}_text"), (F.col(name)["num"] + F.lit(0.0)).alias(f"{side}_number")]

    return read.select(
        "rollout_id",
        *shown("a"),
        *shown("g"),
        F.col("g").isNotNull().alias("gold_ok"),
        A.agree(F.col("a"), F.col("g")).alias("correct"),
    )


def _verdict_sql(a: str, g: str) -> str:
    return (
        f"{READINGS} SELECT rollout_id, {a}.canon AS answer_text, {a}.num + 0e0 AS answer_number, "
        f"{g}.canon AS gold_text, {g}.num + 0e0 AS gold_number, {g} IS NOT NULL AS gold_ok, "
        f"{_agree(a, g)} AS correct FROM paired"
    )


@register("answer_equivalence_expression", _verdict_sql("ca", "cg"))
def answer_equivalence_expression(spark: SparkSession, folder: str) -> DataFrame:
    """Answers read in any supported form."""
    return _verdicts(spark, folder, A.EXPRESSION)


@register("answer_equivalence_latex", _verdict_sql("la", "lg"))
def answer_equivalence_latex(spark: SparkSession, folder: str) -> DataFrame:
    """Answers read from marked forms only."""
    return _verdicts(spark, folder, A.LATEX)


@register(
    "reward_accuracy",
    f"{READINGS} SELECT rollout_id, {sql_round(f'CASE WHEN cg IS NULL THEN 0.25 WHEN {_agree('ca', 'cg')} THEN 1.0 ELSE 0.0 END')} AS reward FROM paired",
)
def reward_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    scored = score(rollouts(spark, folder, heavy=True), ["accuracy"], keep=("rollout_id",))
    return scored.select("rollout_id", round6(F.col("accuracy")).alias("reward"))


_COSINE = f"""CASE WHEN lg IS NULL THEN 1.0
 WHEN {_agree('la', 'lg')} THEN 0.5 + 0.5 * (1.0 - 0.5) * (1.0 + cos(len / 1000e0 * pi()))
 ELSE -0.5 + 0.5 * (0.0 - -0.5) * (1.0 + cos(len / 1000e0 * pi())) END"""


@register("reward_cosine", f"{READINGS} SELECT rollout_id, {sql_round(_COSINE)} AS reward FROM paired")
def reward_cosine(spark: SparkSession, folder: str) -> DataFrame:
    scored = score(rollouts(spark, folder, heavy=True), ["cosine"], RewardConfig(), keep=("rollout_id",))
    return scored.select("rollout_id", round6(F.col("cosine")).alias("reward"))


_SHARE = "0.5 - CAST(len - lo AS DOUBLE) / nullif(hi - lo, 0)"
_LENGTH = f"""CASE WHEN hi = lo THEN 0.0 WHEN lg IS NULL OR {_agree('la', 'lg')} THEN {_SHARE}
 ELSE least(0.0, {_SHARE}) END"""


@register(
    "reward_length",
    f"""{READINGS}, ranged AS (SELECT *, min(len) OVER (PARTITION BY batch_id) AS lo, max(len) OVER (PARTITION BY batch_id) AS hi FROM paired)
 SELECT rollout_id, {sql_round(_LENGTH)} AS reward FROM ranged""",
)
def reward_length(spark: SparkSession, folder: str) -> DataFrame:
    """Batch extremes are aggregated and joined back to the narrow scores."""
    scored = score(rollouts(spark, folder, heavy=True), ["length"], keep=("rollout_id",))
    return scored.select("rollout_id", round6(F.col("length")).alias("reward"))


@register(
    "batch_length_extremes",
    f"{WITH_ROLLOUTS} SELECT batch_id, min(length(completion)) AS shortest, max(length(completion)) AS longest, count(*) AS rollouts "
    "FROM rollouts GROUP BY batch_id",
)
def batch_length_extremes(spark: SparkSession, folder: str) -> DataFrame:
    lengths = rollouts(spark, folder).select("batch_id", F.length("completion").cast("bigint").alias("n"))
    return lengths.groupBy("batch_id").agg(
        F.min("n").alias("shortest"), F.max("n").alias("longest"), F.count(F.lit(1)).alias("rollouts")
    )


# Gold and answer per form, made from two numbers of the row; the last entry says when they agree.
_FORMS = (
    ("concat('$x = ', a, '$')", "concat('It is ', b)", "a = b"),
    ("concat(bs, 'frac', 1 + a % 9, 1 + b % 9)", "concat(bs, 'boxed{', 1 + a % 9, '/', 1 + b % 9, '}')", "TRUE"),
    ("concat('$', a, 'e3$')", "concat(b, '000')", "a = b"),
    ("concat('$', bs, 'sqrt{', a * a, '}$')", "concat(b)", "a = b"),
    ("concat('$', 2 * a, bs, 'pi$')", "concat('<answer>', bs, 'frac{', 4 * b, bs, 'pi}{2}</answer>')", "a = b"),
    ("concat('$(', a, ', ', b, ')$')", "concat(bs, 'boxed{(', a, '.0,', b, '.00)}')", "TRUE"),
    ("concat('$', bs, '{', a, ',', b, bs, '}$')", "concat(bs, 'boxed{', bs, '{', b, ', ', a, bs, '}}')", "TRUE"),
    ("concat('$(', a, ',', b, ')$')", "concat(bs, 'boxed{(', b, ',', a, ')}')", "a = b"),
)


@register(
    "answer_equivalence_forms",
    "SELECT l_orderkey, l_linenumber, form, CASE form "
    + " ".join(f"WHEN {k} THEN {agrees}" for k, (_, _, agrees) in enumerate(_FORMS))
    + f""" END AS correct FROM (SELECT l_orderkey, l_linenumber, l_partkey % {len(_FORMS)} AS form,
  1 + l_suppkey % 4 AS a, 1 + l_linenumber % 4 AS b FROM lineitem) made""",
)
def answer_equivalence_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Two spellings of an answer per line item, in every wider form."""
    made = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"l_partkey % {len(_FORMS)} AS form", "1 + l_suppkey % 4 AS a", "1 + l_linenumber % 4 AS b", "chr(92) AS bs"
    )

    def side(index: int) -> str:
        return "CASE form " + " ".join(f"WHEN {k} THEN {form[index]}" for k, form in enumerate(_FORMS)) + " END"

    made = made.selectExpr("l_orderkey", "l_linenumber", "form", f"{side(0)} AS gold", f"{side(1)} AS answer")
    return with_verdicts(made, "answer", "gold", "correct").select("l_orderkey", "l_linenumber", "form", "correct")


# Gold and answer per algebraic form, made from two numbers of the row; the last entry says when they agree.
_ALGEBRA = (
    ("concat('$', bs, 'frac{', a, bs, 'sqrt{3}}{', b, '}$')", "concat(bs, 'boxed{', b, bs, 'sqrt{3}/', a, '}')", "a = b"),
    ("concat('$', a, bs, 'frac{1}{2}$')", "concat('It is ', b, '.5')", "a = b"),
    ("concat('$2^{', 10 * a, '}$')", "concat(bs, 'boxed{4^{', 5 * b, '}}')", "a = b"),
    ("concat('$(x+', a, ')^2$')", "concat(bs, 'boxed{x^2 + ', 2 * b, 'x + ', a * a, '}')", "a = b"),
    ("concat('$', a, 'x + ', b, '$')", "concat(bs, 'boxed{', b, '+', a, 'x}')", "TRUE"),
    ("concat('$', bs, 'frac{', a, '}{', bs, 'sqrt{', 2 * b, '}}$')", "concat(bs, 'boxed{', bs, 'frac{', a, bs, 'sqrt{', 2 * b, '}}{', 2 * b, '}}')", "TRUE"),
    ("concat('$', bs, '{x + ', a, ', ', b, bs, '}$')", "concat(bs, 'boxed{', bs, '{', b, ', ', b, ' + x', bs, '}}')", "a = b"),
    ("concat('$2^{x + ', a, '}$')", "concat(bs, 'boxed{2^', b, bs, 'cdot 2^x}')", "a = b"),
    ("concat('$y = ', a, 'x + ', b, '$')", "concat(bs, 'boxed{2y - ', 2 * a, 'x = ', 2 * a, '}')", "a = b"),
    ("concat('$(-', bs, 'infty, ', a, ') ', bs, 'cup (', a + b, ', ', bs, 'infty)$')", "concat(bs, 'boxed{(', b, '+', a, ',', bs, 'infty)', bs, 'cup(-', bs, 'infty,', b, ')}')", "a = b"),
    ("concat('$', bs, 'sin(', a, 't) + ', bs, 'pi r^2$')", "concat(bs, 'boxed{r', bs, 'cdot r', bs, 'pi + ', bs, 'sin(t + ', b - 1, 't)}')", "a = b"),
)


@register(
    "answer_equivalence_algebra",
    "SELECT l_orderkey, l_linenumber, form, CASE form "
    + " ".join(f"WHEN {k} THEN {agrees}" for k, (_, _, agrees) in enumerate(_ALGEBRA))
    + f""" END AS correct FROM (SELECT l_orderkey, l_linenumber, l_partkey % {len(_ALGEBRA)} AS form,
  2 + l_suppkey % 4 AS a, 2 + l_linenumber % 4 AS b FROM lineitem) made""",
)
def answer_equivalence_algebra(spark: SparkSession, folder: str) -> DataFrame:
    """Two expressions per line item that are equal, or not, by algebra only."""
    made = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"l_partkey % {len(_ALGEBRA)} AS form", "2 + l_suppkey % 4 AS a", "2 + l_linenumber % 4 AS b", "chr(92) AS bs"
    )

    def side(index: int) -> str:
        return "CASE form " + " ".join(f"WHEN {k} THEN {form[index]}" for k, form in enumerate(_ALGEBRA)) + " END"

    made = made.selectExpr("l_orderkey", "l_linenumber", "form", f"{side(0)} AS gold", f"{side(1)} AS answer")
    return with_verdicts(made, "answer", "gold", "correct").select("l_orderkey", "l_linenumber", "form", "correct")


_S = "(rollout_id * 7) % 100"


@register(
    "answer_algebra_values",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, {sql_round(f"""CASE layout
  WHEN 0 THEN {_S} WHEN 1 THEN {_S} WHEN 4 THEN n1 + n2 - n3 WHEN 9 THEN {_S} + 1 WHEN 10 THEN n1 * n2 - n3 WHEN 11 THEN n1 + n2 - n3
  WHEN 12 THEN n1 / n2 + n3 WHEN 14 THEN {_S} WHEN 15 THEN {_S} END""")} AS value FROM rollouts""",
)
def answer_algebra_values(spark: SparkSession, folder: str) -> DataFrame:
    """Value of each rollout's tagged answer as an expression; null where it is none."""
    df = rollouts(spark, folder, heavy=True)
    canon = A.canonical(between(F.col("completion"), "<answer>", "</answer>"))
    usable = F.when(~canon.rlike(A.PROSE), canon)
    return df.select("rollout_id", round6(algebra.answer_value(usable)).alias("value"))
