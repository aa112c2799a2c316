"""Reward queries over the rollouts stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import SQL_SPACE as SP
from rewardloom.catalog.registry import literal, register, table
from rewardloom.catalog.standins import WITH_ROLLOUTS, rollouts
from rewardloom.config import RewardConfig, RewardPlan
from rewardloom.functions import equations, scorers
from rewardloom.functions.chat import message, messages_of, number_list
from rewardloom.functions.text import round6
from rewardloom.operators.groups import pair
from rewardloom.plans.scoring import custom_reward, score, score_with_advantages, select_rewards


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SP}+|{SP}+$', '', 'g')"


def sql_round(value: str) -> str:
    return f"round(CAST({value} AS DOUBLE), 6) + 0.0"


def sql_once(text: str, tag: str, worth: float) -> str:
    tag_sql = literal(tag)
    return (
        f"CASE WHEN (length({text}) - length(replace({text}, {tag_sql}, ''))) = {len(tag)} "
        f"THEN CAST({worth} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    )


def reward_sql(value: str) -> str:
    return f"{WITH_ROLLOUTS} SELECT rollout_id, {sql_round(value)} AS reward FROM rollouts"


def reward_frame(spark: SparkSession, folder: str, build) -> DataFrame:
    return rollouts(spark, folder, heavy=True).select("rollout_id", round6(build(F.col("completion"))).alias("reward"))


def simple_reward(name: str, build, value_sql: str) -> None:
    register(name, reward_sql(value_sql))(lambda spark, folder: reward_frame(spark, folder, build))


def yes(condition: str, worth: float = 1.0) -> str:
    return f"CASE WHEN {condition} THEN {worth} ELSE 0.0 END"


# ---- layout and text rewards ----------------------------------------------------------------------------------

simple_reward(
    "reward_format",
    scorers.format_reward,
    yes(f"regexp_matches(completion, '^(?s:<think>.*?</think>{SP}*<answer>.*?</answer>)')"),
)
simple_reward(
    "reward_tag_count",
    scorers.tag_count_reward,
    " + ".join(sql_once("completion", tag, 0.25) for tag in scorers.THINK_TAGS),
)
simple_reward(
    "reward_reasoning_steps",
    scorers.reasoning_steps_reward,
    r"least(1.0, len(regexp_extract_all(completion, "
    r"'Step [0-9]+:|^[0-9]+\.|\n-|\n\*|First,|Second,|Next,|Finally,')) / 3.0)",
)
simple_reward(
    "reward_countdown_format",
    scorers.countdown_format_reward,
    yes(
        "contains(completion, '</think>') AND NOT contains(string_split(completion, '</think>')[1], '<think>') "
        "AND regexp_matches(substr(completion, instr(completion, '</think>')), "
        r"'^(?s:</think>\n<answer>.*</answer>\n?)$')"
    ),
)
simple_reward(
    "reward_code_format",
    scorers.code_format_reward,
    yes(
        r"regexp_matches(completion, "
        r"'^(?s:<think>\n.*?\n</think>\n<answer>\n.*?```python.*?```.*?\n</answer>)(?:\n|$)')"
    ),
)
simple_reward(
    "reward_strict_format",
    scorers.strict_format_reward,
    yes(
        r"regexp_matches(completion, '^<reasoning>\n[^\n]*\n</reasoning>\n<answer>\n[^\n]*\n</answer>\n\n?$')", 0.5
    ),
)
simple_reward(
    "reward_soft_format",
    scorers.soft_format_reward,
    yes(
        rf"regexp_matches(completion, '^<reasoning>[^\n]*?</reasoning>{SP}*<answer>[^\n]*?</answer>')", 0.5
    ),
)


@register(
    "reward_soft_format_one_line",
    f"{WITH_ROLLOUTS}, flat AS (SELECT rollout_id, replace(completion, chr(10), '') AS t FROM rollouts) "
    f"SELECT rollout_id, {sql_round(yes(rf'''regexp_matches(t, '^<reasoning>[^\n]*?</reasoning>{SP}*<answer>[^\n]*?</answer>')''', 0.5))} "
    "AS reward FROM flat",
)
def soft_format_one_line(spark: SparkSession, folder: str) -> DataFrame:
    """Completions with their line ends removed, so that the soft layout can hold."""
    return reward_frame(spark, folder, lambda t: scorers.soft_format_reward(F.replace(t, F.lit("\n"), F.lit(""))))


_XML = (
    f"{sql_once('completion', scorers.REASONING_TAGS[0], 0.125)} + {sql_once('completion', scorers.REASONING_TAGS[1], 0.125)}"
    f" + CASE WHEN {sql_once('completion', scorers.REASONING_TAGS[2], 1)} = 1 THEN 0.125 - 0.001 * "
    f"length(list_extract(string_split(completion, {literal(chr(10) + '</answer>' + chr(10))}), -1)) ELSE 0.0 END"
    f" + CASE WHEN {sql_once('completion', scorers.REASONING_TAGS[3], 1)} = 1 THEN 0.125 - 0.001 * "
    f"(length(list_extract(string_split(completion, {literal(scorers.REASONING_TAGS[3])}), -1)) - 1) ELSE 0.0 END"
)
simple_reward("reward_xml_count", scorers.xml_count_reward, _XML)


_NGRAMS = f"""
SELECT rollout_id,
 list_filter(string_split(regexp_replace(lower(completion), '{SP}+', ' ', 'g'), ' '), lambda w: w <> '') AS w
FROM rollouts
"""


@register(
    "reward_repetition_penalty",
    f"""{WITH_ROLLOUTS}, split AS ({_NGRAMS}), grams AS (
 SELECT rollout_id, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
 FROM split WHERE len(w) >= 3),
 counts AS (SELECT rollout_id, count(*) AS n, count(DISTINCT g) AS d FROM grams GROUP BY rollout_id)
 SELECT s.rollout_id, {sql_round('CASE WHEN c.n IS NULL THEN 0.0 ELSE -(1.0 - CAST(c.d AS DOUBLE) / c.n) END')} AS reward
 FROM split s LEFT JOIN counts c ON s.rollout_id = c.rollout_id""",
)
def repetition_penalty(spark: SparkSession, folder: str) -> DataFrame:
    cfg = RewardConfig()
    return reward_frame(
        spark,
        folder,
        lambda t: scorers.repetition_penalty_reward(t, cfg.repetition_n_grams, cfg.repetition_max_penalty),
    )


simple_reward("reward_print", lambda t: scorers.zero_reward(), "CAST(0 AS DOUBLE)")


# ---- extraction -----------------------------------------------------------------------------------------------


@register(
    "extract_answer",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, CASE WHEN regexp_matches(completion, '(?s)<answer>.*?</answer>')
 THEN {sql_strip("regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1)")} ELSE {sql_strip('completion')} END AS answer
 FROM rollouts""",
)
def extract_answer(spark: SparkSession, folder: str) -> DataFrame:
    return rollouts(spark, folder).select("rollout_id", scorers.extract_answer(F.col("completion")).alias("answer"))


_LAST = sql_strip(
    "string_split(list_extract(string_split(completion, '<answer>'), -1), '</answer>')[1]"
)


@register("extract_last_answer", f"{WITH_ROLLOUTS} SELECT rollout_id, {_LAST} AS answer FROM rollouts")
def extract_last_answer(spark: SparkSession, folder: str) -> DataFrame:
    return rollouts(spark, folder).select("rollout_id", scorers.last_answer(F.col("completion")).alias("answer"))


@register(
    "extract_code",
    rf"""{WITH_ROLLOUTS} SELECT rollout_id,
 coalesce(list_extract(regexp_extract_all(completion, '(?s)```python\n(.*?)```', 1), -1), '') AS code FROM rollouts""",
)
def extract_code(spark: SparkSession, folder: str) -> DataFrame:
    return rollouts(spark, folder).select("rollout_id", scorers.extract_code(F.col("completion")).alias("code"))


@register(
    "extract_code_last_message",
    rf"""{WITH_ROLLOUTS} SELECT rollout_id,
 coalesce(list_extract(regexp_extract_all(completion, '(?s)```python\n(.*?)```', 1), -1), '') AS code FROM rollouts""",
)
def extract_code_last_message(spark: SparkSession, folder: str) -> DataFrame:
    """Code of a conversational completion stands in its last message."""
    said = messages_of(message("assistant", F.lit("```python\nfirst\n```")), message("assistant", F.col("completion")))
    df = rollouts(spark, folder).withColumn("completion", said)
    return df.select("rollout_id", scorers.extract_code(scorers.completion_text(df.schema, last=True)).alias("code"))


@register(
    "reward_exact_answer",
    reward_sql(f"CASE WHEN {_LAST} IS NOT DISTINCT FROM answer THEN 2.0 ELSE 0.0 END"),
)
def exact_answer(spark: SparkSession, folder: str) -> DataFrame:
    return reward_frame(spark, folder, lambda t: scorers.exact_answer_reward(t, F.col("answer")))


simple_reward("reward_integer_answer", scorers.integer_answer_reward, yes(f"regexp_matches({_LAST}, '^[0-9]+$')", 0.5))

_WORD = r"[\p{L}\p{N}\p{M}_]"
_NOT_WORD = r"[^\p{L}\p{N}\p{M}_]"


def sql_normalized(text: str) -> str:
    bare = f"translate(lower({text}), {literal(scorers.PUNCTUATION)}, '')"
    articles = f"(^|{_NOT_WORD})(?:a|an|the)($|{_NOT_WORD})"
    twice = bare
    for _ in range(2):
        twice = f"regexp_replace({twice}, '{articles}', '\\1 \\2', 'g')"
    return sql_strip(f"regexp_replace({twice}, '{SP}+', ' ', 'g')")


@register(
    "reward_judge_text_match",
    f"""{WITH_ROLLOUTS}, normal AS (SELECT rollout_id, {sql_normalized('completion')} AS said,
 {sql_normalized('replace(completion, chr(10), chr(9))')} AS expected, {sql_normalized('solution')} AS gold FROM rollouts)
 SELECT rollout_id, said AS normalized, {sql_round(yes('said = expected'))} AS same_text, {sql_round(yes('said = gold'))} AS reward FROM normal""",
)
def judge_text_match(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("completion")
    respaced = F.translate(text, "\n", "\t")
    return rollouts(spark, folder, heavy=True).select(
        "rollout_id",
        scorers.normalized_text(text).alias("normalized"),
        round6(scorers.text_match_reward(text, respaced)).alias("same_text"),
        round6(scorers.text_match_reward(text, F.col("solution"))).alias("reward"),
    )


# ---- countdown ------------------------------------------------------------------------------------------------


def _nums():
    return F.array("n1", "n2", "n3")


# Layouts 4, 10 and 12 hold an equation over the row's numbers that reaches the row's target by construction;
# layout 11 writes a leading zero, which is no valid number.
_COUNTDOWN = reward_sql(yes("layout IN (4, 10, 12)"))


@register("reward_countdown_equation", _COUNTDOWN)
def countdown_equation(spark: SparkSession, folder: str) -> DataFrame:
    df = rollouts(spark, folder)
    reward = equations.countdown_equation_reward(F.col("completion"), F.col("target"), _nums())
    return df.select("rollout_id", round6(reward).alias("reward"))


@register("join_distinct_equations", _COUNTDOWN)
def join_distinct_equations(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct equation is evaluated once and joined back."""
    usable = equations.usable_equation(equations.answer_line(F.col("completion")), _nums())
    df = rollouts(spark, folder).select("rollout_id", "target", usable.alias("equation"))
    valued = equations.evaluate_distinct(df)
    hit = equations.hits_target(F.col("equation_value"), F.col("target"))
    return valued.select("rollout_id", round6(hit).alias("reward"))


@register(
    "countdown_equation_values",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, CASE layout WHEN 4 THEN round(CAST(n1 + n2 - n3 AS DOUBLE), 6) + 0.0
 WHEN 10 THEN round(CAST(n1 * n2 - n3 AS DOUBLE), 6) + 0.0
 WHEN 12 THEN round(CAST(n1 AS DOUBLE) / n2 + n3, 6) + 0.0 END AS equation_value
 FROM rollouts WHERE layout IN (4, 10, 11, 12)""",
)
def countdown_equation_values(spark: SparkSession, folder: str) -> DataFrame:
    """Value of every usable equation."""
    usable = equations.usable_equation(equations.answer_line(F.col("completion")), _nums())
    df = rollouts(spark, folder).select("rollout_id", usable.alias("equation")).where(F.col("equation").isNotNull())
    return df.select("rollout_id", round6(equations.evaluate_equation(F.col("equation"))).alias("equation_value"))


@register(
    "countdown_power_equations",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, CASE rollout_id % 4 WHEN 0 THEN CAST(1 + n1 AS DOUBLE)
 WHEN 1 THEN CAST(CASE WHEN n1 % 2 = 0 THEN n2 ELSE -n2 END AS DOUBLE) WHEN 2 THEN CAST(pow(2, 1 + n1) + n2 AS DOUBLE) END AS equation_value,
 rollout_id % 4 = 3 AS refused FROM rollouts""",
)
def countdown_power_equations(spark: SparkSession, folder: str) -> DataFrame:
    """Powers of 1 and -1 with any exponent, quotients of large powers, and powers that are refused."""
    texts = """CASE rollout_id % 4 WHEN 0 THEN concat('1**', 5000 + n1, '+', n1) WHEN 1 THEN concat('(-1)**', 4096 + n1, '*', n2)
     WHEN 2 THEN concat('2**', 4097 + n1, '//2**4096+', n2) ELSE concat('9**9**', 9 + n1) END AS equation"""
    valued = equations.evaluate_distinct(rollouts(spark, folder).selectExpr("rollout_id", texts))
    return valued.select("rollout_id", round6(F.col("equation_value")).alias("equation_value"), F.col("equation_value_refused").alias("refused"))


# ---- pairing joins --------------------------------------------------------------------------------------------


@register(
    "join_completion_solution",
    f"""{WITH_ROLLOUTS} SELECT r.rollout_id, length(r.completion) AS completion_length, t.solution
 FROM rollouts r JOIN (SELECT rollout_id AS prompt_id, solution FROM rollouts) t ON r.group_id = t.prompt_id""",
)
def join_completion_solution(spark: SparkSession, folder: str) -> DataFrame:
    """Rollouts of a group take the solution of the group's task; lengths travel, completions do not."""
    df = rollouts(spark, folder)
    tasks = df.select(F.col("rollout_id").alias("prompt_id"), "solution")
    done = df.select("rollout_id", F.col("group_id").alias("prompt_id"), F.length("completion").alias("completion_length"))
    return pair(done, tasks).select(
        "rollout_id", F.col("completion_length").cast("bigint").alias("completion_length"), "solution"
    )


@register(
    "join_completion_target_numbers",
    f"""{WITH_ROLLOUTS} SELECT r.rollout_id, {sql_round('t.target')} AS target,
 '[' || CAST(t.n1 AS VARCHAR) || ', ' || CAST(t.n2 AS VARCHAR) || ', ' || CAST(t.n3 AS VARCHAR) || ']' AS nums,
 {sql_round('CASE WHEN abs(r.n1 + r.n2 - r.n3 - t.target) < 0.00001 THEN 1.0 ELSE 0.0 END')} AS on_target
 FROM rollouts r JOIN rollouts t ON r.group_id = t.rollout_id""",
)
def join_completion_target_numbers(spark: SparkSession, folder: str) -> DataFrame:
    df = rollouts(spark, folder)
    tasks = df.select(
        F.col("rollout_id").alias("prompt_id"), "target", F.array("n1", "n2", "n3").alias("nums")
    )
    mine = df.select(
        "rollout_id", F.col("group_id").alias("prompt_id"), (F.col("n1") + F.col("n2") - F.col("n3")).alias("value")
    )
    joined = pair(mine, tasks)
    return joined.select(
        "rollout_id",
        round6(F.col("target")).alias("target"),
        number_list(F.col("nums")).alias("nums"),
        round6(equations.hits_target(F.col("value"), F.col("target"))).alias("on_target"),
    )


@register(
    "join_prompt_completion",
    f"""{WITH_ROLLOUTS}, prompts AS (SELECT group_id AS prompt_id, 'Task of ' || source || ': ' || solution || chr(10) AS text FROM rollouts WHERE gen_idx = 0)
 SELECT r.rollout_id, p.prompt_id, p.text || r.completion AS full_text FROM rollouts r JOIN prompts p ON r.group_id = p.prompt_id""",
)
def join_prompt_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and completion of every rollout as one text."""
    df = rollouts(spark, folder)
    text = F.concat(F.lit("Task of "), "source", F.lit(": "), "solution", F.lit("\n")).alias("text")
    prompts = df.where("gen_idx = 0").select(F.col("group_id").alias("prompt_id"), text)
    done = df.select("rollout_id", F.col("group_id").alias("prompt_id"), "completion")
    return pair(done, prompts).select("rollout_id", "prompt_id", F.concat("text", "completion").alias("full_text"))


# ---- registry -------------------------------------------------------------------------------------------------

_FORMAT = yes(f"regexp_matches(completion, '^(?s:<think>.*?</think>{SP}*<answer>.*?</answer>)')")
_TAGS = " + ".join(sql_once("completion", tag, 0.25) for tag in scorers.THINK_TAGS)
_STEPS = (
    r"least(1.0, len(regexp_extract_all(completion, "
    r"'Step [0-9]+:|^[0-9]+\.|\n-|\n\*|First,|Second,|Next,|Finally,')) / 3.0)"
)


@register(
    "registry_plain_rewards",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, {sql_round(_FORMAT)} AS "format", {sql_round(_TAGS)} AS tag_count,
 {sql_round(_STEPS)} AS reasoning_steps, {sql_round(yes('layout IN (4, 10, 12)'))} AS countdown_equation FROM rollouts""",
)
def registry_plain_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards picked by name from the registry; an unknown name is skipped."""
    known = select_rewards(["format", "tag_count", "no_such_reward", "reasoning_steps", "countdown_equation"])
    df = rollouts(spark, folder, heavy=True).withColumn("nums", _nums())
    scored = score(df, known, keep=("rollout_id",))
    return scored.select("rollout_id", *[round6(F.col(n)).alias(n) for n in known])


@register(
    "registry_configured_rewards",
    rf"""{WITH_ROLLOUTS}, split AS ({_NGRAMS}), grams AS (
 SELECT rollout_id, unnest(list_transform(range(1, CAST(len(w) AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1])) AS g
 FROM split WHERE len(w) >= 2),
 counts AS (SELECT rollout_id, count(*) AS n, count(DISTINCT g) AS d FROM grams GROUP BY rollout_id)
 SELECT r.rollout_id,
 {sql_round('CASE WHEN c.n IS NULL THEN 0.0 ELSE -0.5 * (1.0 - CAST(c.d AS DOUBLE) / c.n) END')} AS repetition_penalty,
 {sql_round(yes(r"regexp_matches(completion, '^(?s:<think>\n.*?\n</think>\n<answer>\n.*?```bash.*?```.*?\n</answer>)(?:\n|$)')"))} AS code_format,
 CAST(0 AS DOUBLE) AS "print"
 FROM rollouts r LEFT JOIN counts c ON r.rollout_id = c.rollout_id""",
)
def registry_configured_rewards(spark: SparkSession, folder: str) -> DataFrame:
    cfg = RewardConfig(repetition_n_grams=2, repetition_max_penalty=-0.5, code_language="bash")
    names = ["repetition_penalty", "code_format", "print"]
    scored = score(rollouts(spark, folder, heavy=True), names, cfg, keep=("rollout_id",))
    return scored.select("rollout_id", *[round6(F.col(n)).alias(n) for n in names])


def _share_of_answer(prompts: list[str], completions: list[str]) -> list[float | None]:
    return [len(p) / len(c) if c else None for p, c in zip(prompts, completions)]


@register(
    "custom_python_reward",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, {sql_round('CAST(length(solution) AS DOUBLE) / nullif(length(completion), 0)')} AS share,
 {sql_round(_FORMAT)} AS "format" FROM rollouts""",
)
def custom_python_reward(spark: SparkSession, folder: str) -> DataFrame:
    """A Python reward beside a built-in one."""
    share = custom_reward(_share_of_answer, prompts="solution", completions="completion")
    scored = score(rollouts(spark, folder), ["format"], custom={"share": share}, keep=("rollout_id",))
    return scored.select("rollout_id", round6(F.col("share")).alias("share"), round6(F.col("format")).alias("format"))


_FLAGSHIP_SQL = f"""{WITH_ROLLOUTS}, scored AS (
 SELECT rollout_id, group_id, step, CAST({_FORMAT} AS DOUBLE) AS f, {_TAGS} AS t FROM rollouts),
 summed AS (SELECT *, f * 1.0e0 + t * 0.5e0 AS reward FROM scored),
 stats AS (SELECT group_id, avg(reward) AS m, stddev_samp(reward) AS s FROM summed GROUP BY group_id)
 SELECT rollout_id, summed.group_id, {sql_round('reward')} AS reward, {sql_round('m')} AS group_mean, {sql_round('s')} AS group_std,
 {sql_round('(reward - m) / (s + 0.0001e0)')} AS advantage
 FROM summed JOIN stats ON summed.group_id = stats.group_id"""


@register("advantage_from_rewards", _FLAGSHIP_SQL)
def advantage_from_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: layout rewards, weighted sum, group-relative advantage."""
    plan = RewardPlan(("format", "tag_count"), (1.0, 0.5))
    df = score_with_advantages(rollouts(spark, folder, heavy=True), plan)
    return df.select(
        "rollout_id", "group_id", *[round6(F.col(c)).alias(c) for c in ("reward", "group_mean", "group_std", "advantage")]
    )


@register(
    "advantage_with_custom_reward",
    f"""{WITH_ROLLOUTS}, scored AS (
 SELECT rollout_id, group_id, CAST({_FORMAT} AS DOUBLE) AS f, CAST(length(solution) AS DOUBLE) / nullif(length(completion), 0) AS share,
  CASE WHEN doc_id % 3 = 0 THEN CAST(n1 AS DOUBLE) / 50 END AS sparse FROM (SELECT *, rollout_id AS doc_id FROM rollouts)),
 summed AS (SELECT *, f + share * 2e0 + coalesce(sparse * 0.5e0, 0e0) AS reward FROM scored),
 stats AS (SELECT group_id, avg(reward) AS m, stddev_samp(reward) AS s FROM summed GROUP BY group_id)
 SELECT rollout_id, {sql_round('share')} AS share, {sql_round('reward')} AS reward, {sql_round('(reward - m) / (s + 0.0001e0)')} AS advantage
 FROM summed JOIN stats ON summed.group_id = stats.group_id""",
)
def advantage_with_custom_reward(spark: SparkSession, folder: str) -> DataFrame:
    """A Python reward and a column of the caller, weighted and summed with a registered one."""
    custom = {
        "share": custom_reward(_share_of_answer, prompts="solution", completions="completion"),
        "sparse": F.when(F.col("rollout_id") % 3 == 0, F.col("n1").cast("double") / 50),
    }
    plan = RewardPlan(("format",), (1.0, 2.0, 0.5), custom=("share", "sparse"))
    df = score_with_advantages(rollouts(spark, folder), plan, custom=custom)
    return df.select("rollout_id", *[round6(F.col(n)).alias(n) for n in ("share", "reward", "advantage")])
