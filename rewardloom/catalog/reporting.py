"""Group statistics, metrics, logs and execution results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import SQL, literal, register, table, text_table
from rewardloom.catalog.rewards import sql_once, sql_round, sql_strip
from rewardloom.catalog.standins import (
    WITH_LINES,
    WITH_ROLLOUTS,
    WITH_SPARSE,
    rollouts,
    scored_lines,
    sparse_rewards,
)
from rewardloom.functions import equations, scorers
from rewardloom.functions.text import round6
from rewardloom.operators import groups, metrics, moments
from rewardloom.operators.keyindex import KeyIndex, key_digest
from rewardloom.session import fresh_path, near_rows, stage
from rewardloom.sources import logs

SEED = 42
NAMES = ["quality", "toxic", "brevity"]
WEIGHTS = [1.0, -0.5, 0.25]
_SUM = " + ".join(f"coalesce({n} * {w}e0, 0e0)" for n, w in zip(NAMES, WEIGHTS))

# ---- reward sums and groups -----------------------------------------------------------------------------------


@register("weighted_reward_sum", f"{WITH_SPARSE} SELECT rollout_id, {sql_round(_SUM)} AS reward FROM sparse")
def weighted_reward_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Missing rewards do not count; a row without any gets 0."""
    df = sparse_rewards(spark, folder)
    return df.select("rollout_id", round6(groups.weighted_reward(NAMES, WEIGHTS)).alias("reward"))


@register("join_reward_weights", f"{WITH_SPARSE} SELECT rollout_id, {sql_round(_SUM)} AS reward FROM sparse")
def join_reward_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The same sum over a long layout, weights joined by name."""
    long = sparse_rewards(spark, folder).unpivot(["rollout_id"], NAMES, "reward_name", "value")
    summed = groups.weighted_reward_long(long, dict(zip(NAMES, WEIGHTS)))
    return summed.select("rollout_id", round6(F.col("reward")).alias("reward"))


@register("unscored_rows", f"{WITH_SPARSE} SELECT rollout_id, source FROM sparse WHERE coalesce(quality, toxic, brevity) IS NULL")
def unscored_rows(spark: SparkSession, folder: str) -> DataFrame:
    return groups.unscored(sparse_rewards(spark, folder), NAMES).select("rollout_id", "source")


# Labels of a third of the documents have no group, some groups hold one row, and some rewards are not numbers.
_GAPPY = "CASE WHEN rollout_id % 3 <> 0 THEN group_id END AS group_id, CASE WHEN rollout_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE quality END AS reward"


@register(
    "group_advantage_with_gaps",
    f"""{WITH_SPARSE}, gappy AS (SELECT rollout_id, {_GAPPY} FROM sparse),
 valued AS (SELECT rollout_id, group_id, CASE WHEN isnan(reward) THEN NULL ELSE reward END AS reward FROM gappy),
 stats AS (SELECT *, avg(reward) OVER g AS m, stddev_samp(reward) OVER g AS s FROM valued WINDOW g AS (PARTITION BY group_id))
 SELECT rollout_id, group_id, {sql_round('m')} AS group_mean, {sql_round('(reward - m) / (s + 0.0001e0)')} AS advantage FROM stats""",
)
def group_advantage_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a group form one, no row is lost, and what is not a number takes no part."""
    rows = sparse_rewards(spark, folder).selectExpr("rollout_id", *_GAPPY.replace("CASE WHEN rollout_id % 7", "|CASE WHEN rollout_id % 7").split(", |"))
    df = groups.with_advantages(rows)
    return df.select("rollout_id", "group_id", round6(F.col("group_mean")).alias("group_mean"), round6(F.col("advantage")).alias("advantage"))


@register("weighted_rewards_not_numbers", f"{WITH_SPARSE} SELECT rollout_id, {sql_round('coalesce(toxic * 2e0, 0e0)')} AS reward FROM sparse")
def weighted_rewards_not_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """A reward that is not a number does not count in the long layout either."""
    rows = sparse_rewards(spark, folder).select("rollout_id", "toxic", F.lit(float("nan")).alias("broken"))
    summed = groups.weighted_reward_long(rows.unpivot(["rollout_id"], ["toxic", "broken"], "reward_name", "value"), {"toxic": 2.0, "broken": 1.0})
    return summed.select("rollout_id", round6(F.col("reward")).alias("reward"))


_LINE_REWARD = "r_quantity * 0.1e0 + r_discount - r_tax * 2e0"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return scored_lines(spark, folder).withColumn(
        "reward", F.col("r_quantity") * 0.1 + F.col("r_discount") - F.col("r_tax") * 2.0
    )


@register(
    "group_reward_statistics",
    f"""{WITH_LINES} SELECT group_id, count(*) AS rows, {sql_round(f'avg({_LINE_REWARD})')} AS group_mean,
 {sql_round(f'stddev_samp({_LINE_REWARD})')} AS group_std FROM lines GROUP BY group_id""",
)
def group_reward_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("rows"),
        round6(F.avg("reward")).alias("group_mean"),
        round6(F.stddev_samp("reward")).alias("group_std"),
    )


def _advantage_sql(value: str) -> str:
    return f"""{WITH_LINES}, summed AS (SELECT *, {_LINE_REWARD} AS reward FROM lines),
 stats AS (SELECT *, avg(reward) OVER g AS m, stddev_samp(reward) OVER g AS s FROM summed WINDOW g AS (PARTITION BY group_id))
 SELECT group_id, l_partkey, l_suppkey, l_linenumber, {sql_round('reward')} AS reward, {sql_round(value)} AS advantage FROM stats"""


def _advantages(spark: SparkSession, folder: str, scale: bool) -> DataFrame:
    rows = groups.with_advantages(_lines(spark, folder), scale=scale)
    return rows.select(
        "group_id",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        round6(F.col("reward")).alias("reward"),
        round6(F.col("advantage")).alias("advantage"),
    )


@register("group_advantage", _advantage_sql("(reward - m) / (s + 0.0001e0)"))
def group_advantage(spark: SparkSession, folder: str) -> DataFrame:
    """Group-relative advantage over groups of very different sizes; single rows have none."""
    return _advantages(spark, folder, scale=True)


@register("group_advantage_unscaled", _advantage_sql("reward - m"))
def group_advantage_unscaled(spark: SparkSession, folder: str) -> DataFrame:
    return _advantages(spark, folder, scale=False)


@register(
    "incomplete_groups",
    f"{WITH_LINES} SELECT group_id, count(*) AS rows FROM lines GROUP BY group_id HAVING count(*) <> 4",
)
def incomplete_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.incomplete_groups(scored_lines(spark, folder), 4)


# ---- metrics --------------------------------------------------------------------------------------------------

_METRIC_ROWS = " UNION ALL ".join(
    f"SELECT step, 'rewards/{n}/{label}' AS metric, {sql_round(f'{fn}({n})')} AS value FROM sparse GROUP BY step"
    for n in NAMES
    for label, fn in (("mean", "avg"), ("std", "stddev_samp"))
)


@register("reward_function_metrics", f"{WITH_SPARSE} {_METRIC_ROWS}")
def reward_function_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and spread of every reward over the rows it applies to, per step."""
    rows = metrics.reward_metrics(sparse_rewards(spark, folder), NAMES, ["step"])
    return rows.select("step", "metric", round6(F.col("value")).alias("value"))


@register(
    "mean_group_metrics",
    f"""{WITH_LINES}, per AS (SELECT step, group_id, avg({_LINE_REWARD}) AS m, stddev_samp({_LINE_REWARD}) AS s FROM lines GROUP BY step, group_id)
 SELECT step, {sql_round('avg(m)')} AS reward, {sql_round('avg(s)')} AS reward_std FROM per GROUP BY step""",
)
def mean_group_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.group_reward_metrics(_lines(spark, folder), ["step"])
    return rows.select("step", round6(F.col("reward")).alias("reward"), round6(F.col("reward_std")).alias("reward_std"))


def _event_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Events as metric points: ten users' worth per step, errors belong to evaluation."""
    return table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", "eval").otherwise("train").alias("mode"),
        F.floor(F.col("event_id") / 40).cast("bigint").alias("step"),
        F.concat(F.lit("rewards/"), "event_type").alias("metric"),
        "value",
    )


_EVENTS = """WITH points AS (SELECT CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS mode, event_id // 40 AS step,
 'rewards/' || event_type AS metric, value FROM events)"""


@register(
    "log_window_average",
    f"""{_EVENTS} SELECT mode, metric, step // 5 AS log_window, round(avg(value), 9) AS value, count(*) AS points
 FROM points GROUP BY mode, metric, step // 5""",
)
def log_window_average(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of every metric between two log lines."""
    rows = metrics.log_windows(_event_metrics(spark, folder), 5)
    # Means of a power of two of values with two decimals often end at the seventh place: six would round ties.
    return rows.select("mode", "metric", "log_window", F.round("value", 9).alias("value"), "points")


@register(
    "eval_metric_prefix",
    f"{_EVENTS} SELECT CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric, count(*) AS points FROM points GROUP BY 1",
)
def eval_metric_prefix(spark: SparkSession, folder: str) -> DataFrame:
    named = metrics.prefixed(_event_metrics(spark, folder))
    return named.groupBy("metric").agg(F.count(F.lit(1)).alias("points"))


@register("metrics_sink", f"{_EVENTS} SELECT mode, step, metric, value FROM points")
def metrics_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of all modes, written by mode and read back."""
    path = fresh_path(spark, "metrics")
    logs.write_metrics(_event_metrics(spark, folder), path)
    return logs.read_metrics(spark, path)


@register("metrics_sink_repeated", f"{_EVENTS} SELECT mode, step, metric, value FROM points")
def metrics_sink_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs, the second one written twice; every point is read once."""
    path, points = fresh_path(spark, "metrics"), _event_metrics(spark, folder)
    odd = F.coalesce(F.col("step") % 2 == 1, F.lit(False))
    for run, rows in (("even", points.where(~odd)), ("odd", points.where(odd)), ("odd", points.where(odd))):
        logs.write_metrics(rows, path, run)
    return logs.read_metrics(spark, path)


_TAGS = " + ".join(sql_once("completion", tag, 0.25) for tag in scorers.THINK_TAGS)


@register(
    "reward_summary",
    f"""{WITH_ROLLOUTS}, scored AS (SELECT step, source, {_TAGS} AS reward FROM rollouts)
 SELECT step, source, count(*) AS rows, {sql_round('avg(reward)')} AS mean_reward,
 {sql_round('avg(CASE WHEN reward > 0 THEN 1e0 ELSE 0e0 END)')} AS success_rate FROM scored GROUP BY ROLLUP (step, source)""",
)
def reward_summary(spark: SparkSession, folder: str) -> DataFrame:
    scored = rollouts(spark, folder, heavy=True).select("step", "source", scorers.tag_count_reward(F.col("completion")).alias("reward"))
    rows = metrics.reward_summary(scored)
    return rows.select(
        "step",
        "source",
        "rows",
        round6(F.col("mean_reward")).alias("mean_reward"),
        round6(F.col("success_rate")).alias("success_rate"),
    )


# ---- the same metrics, grown by increments of steps ----------------------------------------------------------------


def _grown(spark: SparkSession, name: str, keys: dict[str, str], rows: DataFrame, values: dict[str, Column]) -> moments.MomentTable:
    """A moment table after three increments of steps, one of them written twice, and merged into one run half way."""
    grown = moments.MomentTable(spark, fresh_path(spark, name), keys)
    for part in (0, 1, 1, 2):
        own = F.coalesce(F.col("step") % 3, F.lit(0)) == part
        grown.add(rows.where(own), values, f"part-{part}")
        if part == 1:
            grown.compact()
    return grown


@register("reward_metrics_by_increment", SQL["reward_function_metrics"])
def reward_metrics_by_increment(spark: SparkSession, folder: str) -> DataFrame:
    grown = _grown(spark, "reward-moments", {"step": "bigint"}, sparse_rewards(spark, folder), {n: F.col(n) for n in NAMES})
    return moments.reward_metrics(grown).select("step", "metric", round6(F.col("value")).alias("value"))


@register("group_metrics_by_increment", SQL["mean_group_metrics"])
def group_metrics_by_increment(spark: SparkSession, folder: str) -> DataFrame:
    grown = _grown(spark, "group-moments", {"step": "bigint", "group_id": "bigint"}, _lines(spark, folder), {"reward": F.col("reward")})
    rows = moments.group_reward_metrics(grown, ["step"])
    return rows.select("step", round6(F.col("reward")).alias("reward"), round6(F.col("reward_std")).alias("reward_std"))


@register("log_window_by_increment", SQL["log_window_average"])
def log_window_by_increment(spark: SparkSession, folder: str) -> DataFrame:
    points = _event_metrics(spark, folder).withColumn("log_window", F.floor(F.col("step") / 5).cast("bigint"))
    grown = _grown(spark, "window-moments", {"mode": "string", "metric": "string", "log_window": "bigint"}, points, {"value": F.col("value")})
    return grown.read().select("mode", "metric", "log_window", F.round("mean", 9).alias("value"), F.col("n").alias("points"))


@register("reward_summary_by_increment", SQL["reward_summary"])
def reward_summary_by_increment(spark: SparkSession, folder: str) -> DataFrame:
    reward = scorers.tag_count_reward(F.col("completion"))
    values = {"reward": F.col("reward"), "success": F.when(F.col("reward") > 0, 1.0).otherwise(0.0)}
    rows = rollouts(spark, folder, heavy=True).select("step", "source", reward.alias("reward"))
    grown = _grown(spark, "summary-moments", {"step": "bigint", "source": "string"}, rows, values)
    found = moments.reward_summary(grown, [["step", "source"], ["step"], []])
    return found.select("step", "source", "rows", round6(F.col("mean_reward")).alias("mean_reward"), round6(F.col("success_rate")).alias("success_rate"))


# ---- reflection phrases ---------------------------------------------------------------------------------------

_SAID = {
    0: "Wait, actually... let me see.",
    1: "LET’S THINK STEP BY STEP. Let's think step by step.",
    2: "Is this correct? is this correct?",
    3: "Hold on, is this right? Wait a second...",
    4: "If we undo the operations, do we get the same result?",
}
_PHRASES = ", ".join(f"({literal(metrics.plain_phrase(p))})" for p in metrics.REFLECTION_PHRASES)
_SPOKEN = "text || ' ' || CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in _SAID.items()) + " ELSE '' END"


@register(
    "reflection_phrases",
    f"""WITH spoken AS (SELECT doc_id // 128 AS step, replace(lower({_SPOKEN}), '’', '''') AS t FROM documents),
 hits AS (SELECT step, phrase, (length(t) - length(replace(t, phrase, ''))) // length(phrase) AS h
  FROM spoken, (VALUES {_PHRASES}) p(phrase) WHERE contains(t, phrase))
 SELECT step, phrase, CAST(sum(h) AS BIGINT) AS hits, count(*) AS rows FROM hits GROUP BY step, phrase""",
)
def reflection_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """How often a model's texts reflect on themselves, per phrase and step."""
    ending = F.lit("")
    for k, v in _SAID.items():
        ending = F.when(F.col("doc_id") % 7 == k, v).otherwise(ending)
    docs = text_table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 128).cast("bigint").alias("step"), F.concat("text", F.lit(" "), ending).alias("said")
    )
    return metrics.phrase_counts(docs, F.col("said"), ["step"])


# ---- execution results ----------------------------------------------------------------------------------------

_CASES = """cases AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 results AS (SELECT doc_id AS rollout_id, i AS case_id, line AS input, CAST(length(line) AS VARCHAR) AS expected,
  CASE WHEN (doc_id + i) % 5 = 0 THEN 1 ELSE 0 END AS return_code,
  CASE WHEN i % 4 = 3 THEN 'none' ELSE ' ' || CAST(length(line) AS VARCHAR) || chr(10) END AS stdout FROM cases)"""
_PASSED = f"return_code = 0 AND {sql_strip('stdout')} = {sql_strip('expected')}"


def _with_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a document as test cases: the expected output is the length of the line."""

    def case(line: Column) -> Column:
        return F.struct(line.alias("input"), F.length(line).cast("string").alias("output"))

    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("rollout_id"), F.transform(F.split("text", "\n"), case).alias("test_cases"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """A table of execution results as a runner would leave it."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("rollout_id"), F.posexplode(F.split("text", "\n")).alias("case_id", "line")
    )
    return rows.select(
        "rollout_id",
        F.col("case_id").cast("bigint").alias("case_id"),
        F.when((F.col("rollout_id") + F.col("case_id")) % 5 == 0, 1).otherwise(0).alias("return_code"),
        F.when(F.col("case_id") % 4 == 3, "none")
        .otherwise(F.concat(F.lit(" "), F.length("line").cast("string"), F.lit("\n")))
        .alias("stdout"),
    )


@register(
    "test_case_payload",
    f"WITH {_CASES} SELECT rollout_id, case_id, input, expected FROM results",
)
def test_case_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Test cases written as JSON text, read back and exploded."""
    rows = _with_cases(spark, folder).withColumn("payload", logs.cases_json(F.col("test_cases")))
    return logs.explode_cases(rows, logs.cases_from_json(F.col("payload")))


@register(
    "join_code_test_cases",
    f"WITH {_CASES} SELECT rollout_id, case_id, {_PASSED} AS passed FROM results",
)
def join_code_test_cases(spark: SparkSession, folder: str) -> DataFrame:
    cases = logs.explode_cases(_with_cases(spark, folder), F.col("test_cases")).drop("input")
    joined = cases.join(_results(spark, folder), ["rollout_id", "case_id"])
    passed = (F.col("return_code") == 0) & (scorers.strip(F.col("stdout")) == scorers.strip(F.col("expected")))
    return joined.select("rollout_id", "case_id", passed.alias("passed"))


@register(
    "reward_code_pass_rate",
    f"""WITH {_CASES} SELECT rollout_id, {sql_round(f'avg(CASE WHEN {_PASSED} THEN 1e0 ELSE 0e0 END)')} AS reward,
 count(*) AS cases FROM results GROUP BY rollout_id""",
)
def reward_code_pass_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of passed cases per rollout, from the results table."""
    cases = logs.explode_cases(_with_cases(spark, folder), F.col("test_cases")).drop("input")
    rates = logs.pass_rate(cases.join(_results(spark, folder), ["rollout_id", "case_id"]))
    return rates.select("rollout_id", round6(F.col("code_pass_rate")).alias("reward"), "cases")


# ---- logs and tables ------------------------------------------------------------------------------------------


def _sampled_sql(key: str, salt: str) -> str:
    digits = f"substr(md5('{salt}:{SEED}:' || CAST({key} AS VARCHAR)), 1, 8)"
    return f"CAST('0x' || {digits} AS BIGINT) % 1000000 < 100000"


@register(
    "rollout_log",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, chr(10) || repeat('=', 50) || chr(10) || '[' ||
 strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(step), '%Y-%m-%d %H:%M:%S') || ']' || chr(10) || 'Prompt:' || chr(10) || source || chr(10)
 || repeat('-', 50) || chr(10) || 'Completion:' || chr(10) || completion AS value FROM rollouts WHERE {_sampled_sql('batch_id', 'log')}""",
)
def rollout_log(spark: SparkSession, folder: str) -> DataFrame:
    """Text blocks of the logged batches, stamped with the time of their step."""
    stamp = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("step").cast("int"))
    rows = rollouts(spark, folder).withColumn("prompt", F.col("source"))
    return logs.rollout_log(rows, stamp, SEED)


@register("rollout_log_file", f"SELECT value FROM ({SQL['rollout_log']}) logged")
def rollout_log_file(spark: SparkSession, folder: str) -> DataFrame:
    """The rollout log written as text and read back block by block."""
    path = fresh_path(spark, "rollout-log")
    logs.write_text(rollout_log(spark, folder), path)
    return logs.read_text(spark, path, logs.ROLLOUT_MARK)


@register("rollout_log_repeated", f"SELECT value FROM ({SQL['rollout_log']}) logged")
def rollout_log_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The log in two runs, by the parity of the rollout, each written twice and read once."""
    path, rows = fresh_path(spark, "rollout-log"), rollout_log(spark, folder)
    for run in ("0", "1", "0", "1"):
        logs.write_text(rows.where(F.col("rollout_id") % 2 == int(run)), path, run)
    return logs.read_text(spark, path, logs.ROLLOUT_MARK)


@register(
    "completion_samples",
    f"{WITH_ROLLOUTS} SELECT rollout_id, '<think>' || completion AS value FROM rollouts WHERE {_sampled_sql('rollout_id', 'sample')}",
)
def completion_samples(spark: SparkSession, folder: str) -> DataFrame:
    return logs.completion_samples(rollouts(spark, folder), SEED)


_SUCCESS = f"layout IN (4, 10, 12) AND {_sampled_sql('rollout_id', 'success')}"


@register(
    "success_samples",
    f"{WITH_ROLLOUTS} SELECT rollout_id, '<think>' || completion AS value FROM rollouts WHERE {_SUCCESS}",
)
def success_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A share of the rollouts whose equation is right."""
    nums = F.array("n1", "n2", "n3")
    right = equations.countdown_equation_reward(F.col("completion"), F.col("target"), nums) == 1.0
    return logs.completion_samples(rollouts(spark, folder), SEED, right)


@register(
    "sample_log_source",
    f"{WITH_ROLLOUTS} SELECT '<think>' || completion AS value FROM rollouts WHERE {_sampled_sql('rollout_id', 'sample')}",
)
def sample_log_source(spark: SparkSession, folder: str) -> DataFrame:
    """Samples written as marked text files and read back as records."""
    path = fresh_path(spark, "samples")
    logs.write_samples(logs.completion_samples(rollouts(spark, folder), SEED), path)
    return logs.read_samples(spark, path)


def _prompted(spark: SparkSession, folder: str) -> DataFrame:
    rows = rollouts(spark, folder)
    return rows.select(
        "rollout_id", "step", F.col("source").alias("prompt"), "completion",
        round6(scorers.tag_count_reward(F.col("completion"))).alias("reward"),
    )


_PROMPTED = f"{WITH_ROLLOUTS}, prompted AS (SELECT rollout_id, step, source AS prompt, completion, {sql_round(_TAGS)} AS reward FROM rollouts)"


@register(
    "completions_table",
    f"{_PROMPTED} SELECT rollout_id, CAST(step AS VARCHAR) AS step, prompt, completion, reward FROM prompted",
)
def completions_table(spark: SparkSession, folder: str) -> DataFrame:
    return logs.completions_table(_prompted(spark, folder))


_FIRST = "row_number() OVER (PARTITION BY step, prompt ORDER BY rollout_id)"


@register(
    "completions_table_unique_prompts",
    f"""{_PROMPTED} SELECT rollout_id, CAST(step AS VARCHAR) AS step, prompt, completion, reward
 FROM (SELECT *, {_FIRST} AS rn FROM prompted) WHERE rn = 1""",
)
def completions_table_unique_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """First rollout of every prompt in a step."""
    return logs.completions_table(_prompted(spark, folder), unique_prompts=True)


@register("distinct_prompts", "SELECT text AS prompt, min(doc_id) AS first_id, count(*) AS rows FROM documents GROUP BY text")
def distinct_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Every prompt text once, with its first row."""
    docs = table(spark, folder, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")
    )
    first = near_rows(stage(first.drop("digest"), "first-prompts"))
    return docs.select(F.col("doc_id").alias("first_id"), F.col("text").alias("prompt")).join(first, "first_id").select("first_id", "rows", "prompt")


_RUNS = 3


@register(
    "distinct_prompts_across_runs",
    "SELECT min(doc_id) AS first_id, sha256(coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS digest FROM documents GROUP BY text",
)
def distinct_prompts_across_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts that land in three runs, in order of their ids, the second one twice: every prompt once, with its first row."""
    docs = table(spark, folder, "documents")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    run = F.least(F.floor(F.coalesce("doc_id", F.lit(0)) * _RUNS / (last + 1)), F.lit(_RUNS - 1))
    index = KeyIndex(spark, fresh_path(spark, "prompt-index"), buckets=8)
    for k in (0, 1, 1, 2):
        index.add(docs.where(run == k), key_digest(F.col("text")), "doc_id", f"run-{k}")
    return index.keys().select("first_id", F.lower(F.hex("digest")).alias("digest"))


@register(
    "log_blocks",
    f"""{_PROMPTED} SELECT rollout_id, '### Sample ' || CAST(rollout_id % 128 + 1 AS VARCHAR) || chr(10) || chr(10) || '**Prompt**:  ' || chr(10) || prompt
 || chr(10) || chr(10) || '**Completion**:  ' || chr(10) || completion || chr(10) || chr(10) || '**Reward**:  ' || chr(10) || printf('%.4f', reward)
 || chr(10) || chr(10) || '---' || chr(10) AS value FROM prompted""",
)
def log_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown block per sample, numbered inside its step."""
    return logs.log_blocks(_prompted(spark, folder), F.col("rollout_id") % 128 + 1)


@register("log_blocks_file", f"SELECT value FROM ({SQL['log_blocks']}) logged")
def log_blocks_file(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown log written as text and read back block by block."""
    path = fresh_path(spark, "log-blocks")
    logs.write_text(log_blocks(spark, folder), path)
    return logs.read_text(spark, path, logs.BLOCK_MARK)


@register("console_sample", f"{_PROMPTED} SELECT * FROM prompted ORDER BY rollout_id LIMIT 5")
def console_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of a step's table, for the console."""
    return logs.console_sample(_prompted(spark, folder), 5)
