"""Token-array queries. The words of a document are its completion tokens; ids and log-probabilities follow from word
lengths and positions, so arrays are made row by row from whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import register, text_table
from rewardloom.catalog.rewards import _TAGS, sql_round
from rewardloom.catalog.standins import WITH_ROLLOUTS, rollouts
from rewardloom.config import LossConfig, RewardPlan
from rewardloom.functions import tokens as tk
from rewardloom.functions.text import round6
from rewardloom.operators import metrics
from rewardloom.operators.groups import with_aggregates
from rewardloom.plans.scoring import score_with_advantages
from rewardloom.plans.step import step_metrics

EOS, PAD, PROMPT_LENGTH, IMAGE_IDS = 11, 3, 64, (5, 13)
CFG = LossConfig(beta=0.04, epsilon_low=0.2, epsilon_high=0.28)

LONG = f"""words AS (SELECT doc_id, unnest(range(len(l))) AS i, len(l) AS n, unnest(l) AS w
  FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS BIGINT)) AS l FROM documents)),
 tokens AS (SELECT doc_id, doc_id // 128 AS step, doc_id % 4 AS device, i, n, w % 20 AS id,
  -(0.1e0 + 0.05e0 * ((w * 3 + i) % 17)) AS lp, -(0.1e0 + 0.05e0 * ((w * 5 + i * 2) % 19)) AS rf,
  -(0.1e0 + 0.05e0 * ((w * 7 + i) % 13)) AS old, (doc_id * 7 % 11 - 5) / 5e0 AS adv,
  coalesce(min(i) FILTER (WHERE w % 20 = {EOS}) OVER (PARTITION BY doc_id) + 1, n) AS kept FROM words)"""
_LOW, _HIGH = 1.0 - CFG.epsilon_low, 1.0 + CFG.upper
MEASURED = f"""{LONG}, measured AS (SELECT *, exp(rf - lp) - (rf - lp) - 1 AS kl, exp(lp - old) AS ratio,
  least(greatest(exp(lp - old), {_LOW}e0), {_HIGH}e0) AS clipped FROM tokens),
 lossy AS (SELECT *, -least(ratio * adv, clipped * adv) + {CFG.beta}e0 * kl AS loss,
  CASE WHEN (ratio < {_LOW}e0 AND adv < 0) OR (ratio > {_HIGH}e0 AND adv > 0) THEN 1e0 ELSE 0e0 END AS was_clipped FROM measured)"""


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    sizes = F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint"))
    rows = text_table(spark, folder, "documents").select("doc_id", sizes.alias("sizes"))

    def logps(weight: int, pace: int, modulus: int) -> Column:
        return F.transform(
            "sizes", lambda w, i: -(F.lit(0.1) + F.lit(0.05) * ((w * weight + i * pace) % modulus))
        )

    return rows.select(
        "doc_id",
        F.floor(F.col("doc_id") / 128).cast("bigint").alias("step"),
        (F.col("doc_id") % 4).alias("device"),
        F.transform("sizes", lambda w: w % 20).alias("completion_ids"),
        logps(3, 1, 17).alias("logps"),
        logps(5, 2, 19).alias("ref_logps"),
        logps(7, 1, 13).alias("old_logps"),
        ((F.col("doc_id") * 7 % 11 - 5) / F.lit(5.0)).alias("advantage"),
    )


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_rows(spark, folder).select("doc_id", "step", F.col("completion_ids").alias("ids"))


def _shown(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


_JOINED = "string_agg(CAST({value} AS VARCHAR), ',' ORDER BY i)"


@register(
    "token_left_truncation",
    f"WITH {LONG} SELECT doc_id, {_JOINED.format(value='id')} AS ids FROM tokens WHERE i >= n - {PROMPT_LENGTH} GROUP BY doc_id",
)
def token_left_truncation(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts keep their last ids."""
    return _ids(spark, folder).select("doc_id", _shown(tk.keep_last(F.col("ids"), PROMPT_LENGTH)).alias("ids"))


@register(
    "token_padding",
    f"""WITH {LONG}, sized AS (SELECT doc_id, any_value(step) AS step, any_value(least(n, {PROMPT_LENGTH})) AS p, any_value(kept) AS kept,
  string_agg(CASE WHEN i >= n - {PROMPT_LENGTH} THEN ',' || CAST(id AS VARCHAR) ELSE '' END, '' ORDER BY i) AS prompt,
  string_agg(CASE WHEN i < kept THEN CAST(id AS VARCHAR) || ',' ELSE '' END, '' ORDER BY i) AS done FROM tokens GROUP BY doc_id),
 wide AS (SELECT *, max(kept) OVER (PARTITION BY step) AS width FROM sized)
 SELECT doc_id, substr(repeat(',{PAD}', {PROMPT_LENGTH} - p) || prompt, 2) AS prompt_ids,
  regexp_replace(done || repeat('{PAD},', width - kept), ',$', '') AS completion_ids FROM wide""",
)
def token_padding(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts padded on the left to a fixed width, completions on the right to the longest of their batch."""
    rows = _ids(spark, folder).select(
        "doc_id",
        "step",
        tk.keep_last(F.col("ids"), PROMPT_LENGTH).alias("prompt"),
        F.slice("ids", F.lit(1), tk.kept_length(F.col("ids"), EOS).cast("int")).alias("done"),
    )
    rows = with_aggregates(rows, ["step"], width=F.max(F.size("done")))
    return rows.select(
        "doc_id",
        _shown(tk.pad_to(F.col("prompt"), PROMPT_LENGTH, PAD, left=True)).alias("prompt_ids"),
        _shown(tk.pad_to(F.col("done"), F.col("width"), PAD, left=False)).alias("completion_ids"),
    )


@register(
    "token_end_mask",
    f"WITH {LONG} SELECT doc_id, {_JOINED.format(value='CASE WHEN i < kept THEN 1 ELSE 0 END')} AS mask, any_value(kept) AS kept FROM tokens GROUP BY doc_id",
)
def token_end_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Ones up to and including the first end mark."""
    ids = F.col("ids")
    return _ids(spark, folder).select(
        "doc_id", _shown(tk.eos_mask(ids, EOS)).alias("mask"), tk.kept_length(ids, EOS).alias("kept")
    )


@register(
    "token_attention_mask",
    f"""WITH {LONG} SELECT doc_id, repeat('1,', any_value(least(n, {PROMPT_LENGTH}))) || {_JOINED.format(value='CASE WHEN i < kept THEN 1 ELSE 0 END')} AS mask
 FROM tokens GROUP BY doc_id""",
)
def token_attention_mask(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.col("ids")
    mask = tk.attention_mask(tk.keep_last(ids, PROMPT_LENGTH), tk.eos_mask(ids, EOS))
    return _ids(spark, folder).select("doc_id", _shown(mask).alias("mask"))


_IGNORED = f"CASE WHEN id IN ({PAD}, {', '.join(map(str, IMAGE_IDS))}) THEN -100 ELSE id END"


@register(
    "token_label_mask",
    f"WITH {LONG} SELECT doc_id, {_JOINED.format(value=_IGNORED)} AS labels FROM tokens GROUP BY doc_id",
)
def token_label_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Padding and image ids are not learnt."""
    return _ids(spark, folder).select("doc_id", _shown(tk.label_mask(F.col("ids"), PAD, IMAGE_IDS)).alias("labels"))


def _summary(values: Column) -> list[Column]:
    return [
        round6(F.aggregate(values, F.lit(0.0), lambda t, v: t + v)).alias("total"),
        round6(F.array_max(values)).alias("largest"),
        F.size(values).cast("bigint").alias("tokens"),
    ]


def _summary_sql(value: str) -> str:
    return (
        f"WITH {MEASURED} SELECT doc_id, {sql_round(f'sum({value})')} AS total, {sql_round(f'max({value})')} AS largest, "
        "count(*) AS tokens FROM lossy GROUP BY doc_id"
    )


@register("token_divergence", _summary_sql("kl"))
def token_divergence(spark: SparkSession, folder: str) -> DataFrame:
    kl = tk.divergence(F.col("ref_logps"), F.col("logps"))
    return token_rows(spark, folder).select("doc_id", kl.alias("v")).select("doc_id", *_summary(F.col("v")))


@register("token_ratio", _summary_sql("ratio"))
def token_ratio(spark: SparkSession, folder: str) -> DataFrame:
    v = tk.ratio(F.col("logps"), F.col("old_logps"))
    return token_rows(spark, folder).select("doc_id", v.alias("v")).select("doc_id", *_summary(F.col("v")))


@register("token_ratio_clipped", _summary_sql("clipped"))
def token_ratio_clipped(spark: SparkSession, folder: str) -> DataFrame:
    v = F.transform(tk.ratio(F.col("logps"), F.col("old_logps")), lambda c: tk.clamp(c, CFG))
    return token_rows(spark, folder).select("doc_id", v.alias("v")).select("doc_id", *_summary(F.col("v")))


@register("token_loss", _summary_sql("loss"))
def token_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_rows(spark, folder)
    kl = tk.divergence(F.col("ref_logps"), F.col("logps"))
    ratio = tk.ratio(F.col("logps"), F.col("old_logps"))
    v = tk.token_loss(ratio, F.col("advantage"), CFG, kl)
    return rows.select("doc_id", v.alias("v")).select("doc_id", *_summary(F.col("v")))


_MEANS = "count(*) AS tokens, " + ", ".join(
    f"{sql_round(f'sum({v}) / count(*)')} AS mean_{n}" for n, v in (("loss", "loss"), ("kl", "kl"), ("clip", "was_clipped"))
)


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    return tk.row_statistics(token_rows(spark, folder), CFG, EOS)


def _rounded_means(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tokens", *[round6(F.col(c)).alias(c) for c in ("mean_loss", "mean_kl", "mean_clip")])


@register("batch_token_means", f"WITH {MEASURED} SELECT step, {_MEANS} FROM lossy WHERE i < kept GROUP BY step")
def batch_token_means(spark: SparkSession, folder: str) -> DataFrame:
    """Loss, divergence and clip ratio as means over the kept tokens of a batch."""
    return _rounded_means(tk.token_mean(_sums(spark, folder), ["step"]), "step")


@register(
    "clip_ratio",
    f"WITH {MEASURED} SELECT device, {sql_round('sum(was_clipped) / count(*)')} AS clip_ratio FROM lossy WHERE i < kept GROUP BY device",
)
def clip_ratio(spark: SparkSession, folder: str) -> DataFrame:
    means = tk.token_mean(_sums(spark, folder), ["device"])
    return means.select("device", round6(F.col("mean_clip")).alias("clip_ratio"))


@register(
    "device_mean_metrics",
    f"""WITH {MEASURED}, per_device AS (SELECT step, device, sum(kl) / count(*) AS kl, sum(was_clipped) / count(*) AS clip FROM lossy
 WHERE i < kept GROUP BY step, device) SELECT step, {sql_round('avg(kl)')} AS kl, {sql_round('avg(clip)')} AS clip_ratio,
 count(*) AS devices FROM per_device GROUP BY step""",
)
def device_mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over devices of each device's token mean."""
    per_device = tk.token_mean(_sums(spark, folder), ["step", "device"])
    return per_device.groupBy("step").agg(
        round6(F.avg("mean_kl")).alias("kl"),
        round6(F.avg("mean_clip")).alias("clip_ratio"),
        F.count(F.lit(1)).alias("devices"),
    )


@register(
    "completion_length_metric",
    f"""WITH {LONG}, per AS (SELECT doc_id, any_value(step) AS step, any_value(kept) AS kept FROM tokens GROUP BY doc_id)
 SELECT step, {sql_round('avg(kept)')} AS completion_length FROM per GROUP BY step""",
)
def completion_length_metric(spark: SparkSession, folder: str) -> DataFrame:
    kept = _ids(spark, folder).select("step", tk.kept_length(F.col("ids"), EOS).alias("kept"))
    return kept.groupBy("step").agg(round6(F.avg("kept")).alias("completion_length"))


@register(
    "running_token_total",
    f"""WITH {LONG}, per AS (SELECT doc_id, any_value(step) AS step, any_value(kept + least(n, {PROMPT_LENGTH})) AS t FROM tokens
  WHERE doc_id % 10 <> 0 GROUP BY doc_id),
 steps AS (SELECT step, CAST(sum(t) AS BIGINT) AS tokens FROM per GROUP BY step)
 SELECT step, tokens, CAST(sum(tokens) OVER (ORDER BY step) AS BIGINT) AS num_tokens FROM steps""",
)
def running_token_total(spark: SparkSession, folder: str) -> DataFrame:
    """Attended tokens of training rows, summed over the run; every tenth row is an evaluation row."""
    ids = F.col("ids")
    rows = _ids(spark, folder).select(
        "step",
        F.when(F.col("doc_id") % 10 == 0, "eval").otherwise("train").alias("mode"),
        (tk.kept_length(ids, EOS) + F.least(F.size(ids), F.lit(PROMPT_LENGTH))).alias("n"),
    )
    return metrics.token_totals(rows, F.col("n"))


@register(
    "scoring_step_metrics",
    f"""{WITH_ROLLOUTS}, scored AS (SELECT rollout_id, group_id, step, {_TAGS} AS reward FROM rollouts),
 stats AS (SELECT *, avg(reward) OVER g AS m, stddev_samp(reward) OVER g AS s FROM scored WINDOW g AS (PARTITION BY step, group_id)),
 rewarded AS (SELECT rollout_id, group_id, step, m, s, (reward - m) / (s + 0.0001e0) AS a FROM stats),
 grouped AS (SELECT step, avg(m) AS reward, avg(s) AS reward_std FROM (SELECT DISTINCT step, group_id, m, s FROM rewarded) GROUP BY step),
 {MEASURED},
 priced AS (SELECT r.step, -least(ratio * a, clipped * a) + {CFG.beta}e0 * kl AS loss, kl,
  CASE WHEN (ratio < {_LOW}e0 AND a < 0) OR (ratio > {_HIGH}e0 AND a > 0) THEN 1e0 ELSE 0e0 END AS clip
  FROM measured t JOIN rewarded r ON t.doc_id = r.rollout_id WHERE i < kept),
 means AS (SELECT step, count(*) AS tokens, avg(loss) AS loss, avg(kl) AS kl, avg(clip) AS clip FROM priced GROUP BY step)
 SELECT g.step, {sql_round('g.reward')} AS reward, {sql_round('g.reward_std')} AS reward_std, tokens,
 {sql_round('loss')} AS mean_loss, {sql_round('kl')} AS mean_kl, {sql_round('clip')} AS mean_clip FROM grouped g JOIN means m ON g.step = m.step""",
)
def scoring_step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A whole step: texts are scored, token arrays reduced, and only numbers meet."""
    scored = score_with_advantages(rollouts(spark, folder, heavy=True), RewardPlan(("tag_count",)))
    arrays = token_rows(spark, folder).select(
        F.col("doc_id").alias("rollout_id"), "completion_ids", "logps", "old_logps", "ref_logps"
    )
    rows = step_metrics(scored, arrays, CFG, EOS, ["step"])
    names = ("reward", "reward_std", "mean_loss", "mean_kl", "mean_clip")
    return rows.select("step", "tokens", *[round6(F.col(c)).alias(c) for c in names])


def _means_sql(loss: str, kl: str, clip: str) -> str:
    """Means over kept tokens where one device's rows have no advantage."""
    return f"""WITH {MEASURED.replace("(doc_id * 7 % 11 - 5) / 5e0 AS adv", "CASE WHEN doc_id % 4 <> 1 THEN (doc_id * 7 % 11 - 5) / 5e0 END AS adv")},
 priced AS (SELECT step, {loss} AS loss, {kl} AS kl, CASE WHEN adv IS NOT NULL THEN {clip} END AS clip FROM lossy WHERE i < kept)
 SELECT step, count(*) AS tokens, {sql_round('avg(loss)')} AS mean_loss, {sql_round('avg(kl)')} AS mean_kl, {sql_round('avg(clip)')} AS mean_clip
 FROM priced GROUP BY step"""


def _partly_scored(spark: SparkSession, folder: str) -> DataFrame:
    advantage = F.when(F.col("device") != 1, F.col("advantage"))
    return token_rows(spark, folder).withColumn("advantage", advantage)


@register("token_means_no_advantage", _means_sql("loss", "kl", "was_clipped"))
def token_means_no_advantage(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of groups of one have no advantage: their tokens count for the divergence alone."""
    sums = tk.row_statistics(_partly_scored(spark, folder), CFG, EOS)
    return _rounded_means(tk.token_mean(sums, ["step"]), "step")


@register("token_means_one_iteration", _means_sql(f"-adv + {CFG.beta}e0 * kl", "kl", "0e0"))
def token_means_one_iteration(spark: SparkSession, folder: str) -> DataFrame:
    """Every batch is used once, so there are no old log-probabilities and the ratio is 1."""
    rows = _partly_scored(spark, folder)
    numbers = tk.ratio_statistics(rows.drop("old_logps", "advantage"), CFG, EOS)
    sums = tk.with_loss(numbers.join(rows.select("doc_id", "advantage"), "doc_id"), CFG)
    return _rounded_means(tk.token_mean(sums, ["step"]), "step")


@register("token_means_no_reference", _means_sql("-least(ratio * adv, clipped * adv)", "CAST(NULL AS DOUBLE)", "was_clipped"))
def token_means_no_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Without a weight on the divergence no reference model is asked."""
    cfg = LossConfig(beta=0.0, epsilon_low=CFG.epsilon_low, epsilon_high=CFG.epsilon_high)
    sums = tk.row_statistics(_partly_scored(spark, folder).drop("ref_logps"), cfg, EOS)
    return _rounded_means(tk.token_mean(sums, ["step"]), "step")
