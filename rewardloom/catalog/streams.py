"""Streaming queries; each must give the rows of its batch counterpart."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import register, table
from rewardloom.catalog.rewards import _FORMAT, _STEPS, _TAGS, sql_round
from rewardloom.catalog.standins import ROLLOUTS, WITH_ROLLOUTS
from rewardloom.functions import scorers
from rewardloom.functions.text import round6
from rewardloom.plans.scoring import score
from rewardloom.session import fresh_path
from rewardloom.streaming import live

_TIME = "yyyy-MM-dd HH:mm:ss"


def _landings(spark: SparkSession, folder: str, name: str, second: Column) -> Iterator[tuple[DataFrame, bool]]:
    """A table that lands in two parts: the stream to run after each, and whether it is the last one."""
    rows, inbox = table(spark, folder, name), fresh_path(spark, f"inbox-{name}")
    second = F.coalesce(second, F.lit(True))  # rows without an id or a time land last
    for last in (False, True):
        rows.where(second if last else ~second).write.mode("append").parquet(inbox)
        yield live.read_stream(spark, inbox, rows.schema), last


def _documents(spark: SparkSession, folder: str) -> Iterator[tuple[DataFrame, bool]]:
    """Documents of the later steps land last."""
    middle = (table(spark, folder, "documents").agg(F.max("doc_id")).first()[0] or 0) // 2
    return _landings(spark, folder, "documents", F.col("doc_id") > middle)


def _rollouts(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return spark.sql(ROLLOUTS, documents=documents)


def _step_time(step: Column) -> Column:
    """All rollouts of a step carry the step's hour."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + step * 3600)


@register(
    "stream_scores",
    f"""{WITH_ROLLOUTS} SELECT rollout_id, {sql_round(_FORMAT)} AS "format", {sql_round(_TAGS)} AS tag_count,
 {sql_round(_STEPS)} AS reasoning_steps FROM rollouts""",
)
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    names = ["format", "tag_count", "reasoning_steps"]
    home = fresh_path(spark, "live-scores")
    for documents, _ in _documents(spark, folder):
        scored = live.score_stream(_rollouts(spark, documents), lambda df: score(df, names, keep=("rollout_id",)), home)
    return scored.select("rollout_id", *[round6(F.col(n)).alias(n) for n in names])


@register(
    "stream_group_advantage",
    f"""{WITH_ROLLOUTS}, scored AS (SELECT rollout_id, group_id, step, {_TAGS} AS reward FROM rollouts),
 stats AS (SELECT step, group_id, avg(reward) AS m, stddev_samp(reward) AS s FROM scored GROUP BY step, group_id)
 SELECT rollout_id, r.group_id, {sql_round('reward')} AS reward, {sql_round('(reward - m) / (s + 0.0001e0)')} AS advantage
 FROM scored r JOIN stats t ON r.step = t.step AND r.group_id = t.group_id""",
)
def stream_group_advantage(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of all steps: those the watermark closes in either run, and the open ones at the end."""
    home = fresh_path(spark, "live-advantages")
    for documents, last in _documents(spark, folder):
        scored = _rollouts(spark, documents).select(
            "rollout_id",
            "group_id",
            _step_time(F.col("step")).alias("ts"),
            scorers.tag_count_reward(F.col("completion")).alias("reward"),
        )
        done = live.group_advantage_stream(scored, "1 hour", "0 seconds", home=home, last=last)
    return done.select(
        "rollout_id", "group_id", round6(F.col("reward")).alias("reward"), round6(F.col("advantage")).alias("advantage")
    )


@register(
    "stream_metric_windows",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'rewards/' || event_type AS metric,
 round(avg(value), 9) AS value, count(*) AS points FROM events GROUP BY 1, 2""",
)
def stream_metric_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly means of every metric, over two runs and an end."""
    home, middle = fresh_path(spark, "live-metrics"), _middle(spark, folder)
    for events, last in _landings(spark, folder, "events", F.col("ts") >= middle):
        metric = F.concat(F.lit("rewards/"), "event_type").alias("metric")
        points = events.select(F.col("ts").cast("timestamp").alias("ts"), metric, "value")
        means = live.metric_windows(points, "1 hour", "10 minutes", "metric", home=home, last=last)
    return means.select(
        F.date_format("window_start", _TIME).alias("window_start"),
        "metric",
        F.round("value", 9).alias("value"),
        "points",
    )


def _middle(spark: SparkSession, folder: str):
    return table(spark, folder, "events").agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("m")).first()["m"]


@register(
    "stream_running_total",
    "SELECT CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS mode, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1",
)
def stream_running_total(spark: SparkSession, folder: str) -> DataFrame:
    """Running token totals per mode over two runs; user ids stand in for token counts."""
    home, middle = fresh_path(spark, "live-totals"), _middle(spark, folder)
    mode = F.when(F.col("event_type") == "error", "eval").otherwise("train")
    for events, _ in _landings(spark, folder, "events", F.col("ts") >= middle):
        totals = live.running_totals(events.select(mode.alias("mode"), "user_id"), F.col("user_id"), "mode", home=home)
    return totals


_LATE = """WITH marked AS (SELECT date_trunc('hour', ts) AS w, ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS first_run,
 (SELECT max(ts) FROM events) - INTERVAL 20 DAY AS mark FROM events)
 SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS points FROM marked
 WHERE first_run OR w + INTERVAL 1 HOUR > mark GROUP BY w"""


@register("stream_late_rollouts", _LATE)
def stream_late_rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """The later half of the events arrives first, the earlier half in a second run: what lies behind the watermark is
    kept apart, the rest still counts."""
    home, middle = fresh_path(spark, "late-counts"), _middle(spark, folder)
    for events, _ in _landings(spark, folder, "events", F.col("ts") < middle):
        done = live.window_counts(events.select(F.col("ts").cast("timestamp").alias("ts")), "1 hour", "20 days", home)
    return done.select(F.date_format("window_start", _TIME).alias("window_start"), "points")


@register(
    "stream_late_table",
    """WITH marked AS (SELECT *, date_trunc('hour', ts) AS w, ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS first_run,
 (SELECT max(ts) FROM events) - INTERVAL 20 DAY AS mark FROM events)
 SELECT event_id, event_type, value, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, 'window closed' AS reason FROM marked
 WHERE NOT first_run AND w + INTERVAL 1 HOUR <= mark""",
)
def stream_late_table(spark: SparkSession, folder: str) -> DataFrame:
    """The events that came too late for their window, as rows with the reason, over the same two runs."""
    home, middle = fresh_path(spark, "late-table"), _middle(spark, folder)
    for events, _ in _landings(spark, folder, "events", F.col("ts") < middle):
        points = events.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
        live.split_late(points, "1 hour", "20 days", home)
    late = live.late_rows(spark, home, points.schema)
    window = F.date_format(F.timestamp_seconds("window_at"), _TIME).alias("window_start")
    return late.select("event_id", "event_type", "value", window, "reason")


@register(
    "stream_late_advantage",
    f"""{WITH_ROLLOUTS}, scored AS (SELECT rollout_id, group_id, step, {_TAGS} AS reward,
  rollout_id > (SELECT max(doc_id) // 2 FROM documents) AS first_run FROM rollouts),
 top AS (SELECT max(step) AS top FROM scored WHERE first_run),
 marked AS (SELECT *, first_run OR step + 1 > top - 2 AS accepted FROM scored, top),
 stats AS (SELECT step, group_id, avg(reward) AS m, stddev_samp(reward) AS s FROM marked WHERE accepted GROUP BY step, group_id)
 SELECT rollout_id, r.group_id, CASE WHEN accepted THEN 'counted' ELSE 'window closed' END AS fate,
  CASE WHEN accepted THEN {sql_round('(reward - m) / (s + 0.0001e0)')} END AS advantage
 FROM marked r LEFT JOIN stats t ON r.step = t.step AND r.group_id = t.group_id""",
)
def stream_late_advantage(spark: SparkSession, folder: str) -> DataFrame:
    """Later rollouts land first: each rollout has an advantage or is late with its reason, and none is missing."""
    home, rows, inbox = fresh_path(spark, "late-advantages"), table(spark, folder, "documents"), fresh_path(spark, "inbox-late")
    middle = (rows.agg(F.max("doc_id")).first()[0] or 0) // 2
    for last in (False, True):
        part = F.coalesce(F.col("doc_id") > middle, F.lit(False))
        rows.where(~part if last else part).write.mode("append").parquet(inbox)
        scored = _rollouts(spark, live.read_stream(spark, inbox, rows.schema)).select(
            "rollout_id", "group_id", _step_time(F.col("step")).alias("ts"), scorers.tag_count_reward(F.col("completion")).alias("reward")
        )
        done = live.group_advantage_stream(scored, "1 hour", "2 hours", home=home, last=last)
    counted = done.select("rollout_id", "group_id", F.lit("counted").alias("fate"), round6(F.col("advantage")).alias("advantage"))
    late = live.late_rows(spark, home, scored.schema)
    return counted.unionByName(late.select("rollout_id", "group_id", F.col("reason").alias("fate"), F.lit(None).cast("double").alias("advantage")))


@register("stream_distinct_prompts", "SELECT DISTINCT md5(text) AS prompt FROM documents")
def stream_distinct_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Every prompt once over two runs; the delay covers the whole table, so no key is forgotten."""
    home = fresh_path(spark, "live-distinct")
    for documents, _ in _documents(spark, folder):
        prompts = documents.select(F.md5("text").alias("prompt"), _step_time(F.floor(F.col("doc_id") / 128)).alias("ts"))
        done = live.distinct_stream(prompts, "36500 days", "prompt", home=home)
    return done.select("prompt")
