"""Token arrays: truncation, padding, masks, divergence, clipping and loss per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.config import LossConfig

IGNORED_LABEL = -100  # fixed value: label the loss skips
# Image token ids of one model family.
IMAGE_TOKEN_IDS = (151652, 151653, 151655)


def keep_last(ids: Column, length: int) -> Column:
    """Left truncation to ``length`` ids."""
    if length < 1:
        raise ValueError("length must be at least 1")
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - F.lit(length - 1)), F.lit(length))


def pad_to(ids: Column, width: Column | int, pad: int, left: bool) -> Column:
    """Pad to ``width``; arrays already that long are unchanged."""
    target = F.lit(width) if isinstance(width, int) else width
    fill = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(0), target - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def kept_length(ids: Column, eos: int) -> Column:
    """Tokens up to and including the first end mark; all without one."""
    at = F.array_position(ids, F.lit(eos).cast("bigint"))
    return F.when(at > 0, at).otherwise(F.size(ids).cast("bigint"))


def eos_mask(ids: Column, eos: int) -> Column:
    kept = kept_length(ids, eos)
    ones = F.array_repeat(F.lit(1), kept.cast("int"))
    return F.concat(ones, F.array_repeat(F.lit(0), (F.size(ids) - kept).cast("int")))


def attention_mask(prompt_ids: Column, completion_mask: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(prompt_ids)), completion_mask)


def label_mask(ids: Column, pad: int, image_ids: tuple[int, ...] = IMAGE_TOKEN_IDS) -> Column:
    ignored = [F.lit(i).cast("bigint") for i in (pad, *image_ids)]
    label = F.lit(IGNORED_LABEL).cast("bigint")
    return F.transform(ids, lambda x: F.when(x.isin(*ignored), label).otherwise(x))


def divergence(ref_logps: Column, logps: Column) -> Column:
    """Per-token estimate ``exp(d) - d - 1`` with ``d = ref - logp``; never negative."""
    return F.zip_with(ref_logps, logps, lambda r, p: F.exp(r - p) - (r - p) - F.lit(1.0))


def ratio(logps: Column, old_logps: Column | None) -> Column:
    """Importance ratio; 1 throughout when a batch is used once and no old values exist."""
    if old_logps is None:
        return F.transform(logps, lambda p: F.lit(1.0))
    return F.zip_with(logps, old_logps, lambda p, o: F.exp(p - o))


def clamp(value: Column, cfg: LossConfig) -> Column:
    return F.least(F.greatest(value, F.lit(1.0 - cfg.epsilon_low)), F.lit(1.0 + cfg.upper))


def token_loss(ratios: Column, advantage: Column, cfg: LossConfig, kl: Column | None = None) -> Column:
    clipped = F.transform(ratios, lambda c: -F.least(c * advantage, clamp(c, cfg) * advantage))
    if cfg.beta == 0.0 or kl is None:
        return clipped
    return F.zip_with(clipped, kl, lambda loss, k: loss + F.lit(cfg.beta) * k)


def clipped_tokens(ratios: Column, advantage: Column, cfg: LossConfig) -> Column:
    """1.0 where the ratio left the trust range in the direction the advantage pushes."""
    return F.transform(
        ratios,
        lambda c: F.when(
            ((c < 1.0 - cfg.epsilon_low) & (advantage < 0)) | ((c > 1.0 + cfg.upper) & (advantage > 0)), 1.0
        ).otherwise(0.0),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def _arrays_of(tokens: DataFrame, cfg: LossConfig) -> tuple[str, ...]:
    """The log-probability columns there are; a divergence with weight needs the reference."""
    if cfg.beta and "ref_logps" not in tokens.columns:
        raise ValueError("ref_logps are needed unless beta is 0")
    return tuple(c for c in ("logps", "old_logps", "ref_logps") if c in tokens.columns)


def row_statistics(tokens: DataFrame, cfg: LossConfig, eos: int) -> DataFrame:
    """Kept tokens and their sums of loss, divergence and clipped tokens per rollout; arrays are dropped.

    Expects ``completion_ids, logps, advantage``, with ``ref_logps`` unless ``cfg.beta`` is 0; without ``old_logps`` the
    ratio is 1. The end mask is always a prefix, so arrays are cut to it first and nothing is computed for tokens that
    do not count.
    """
    arrays = _arrays_of(tokens, cfg)
    prepared = tokens.withColumn("kept", kept_length(F.col("completion_ids"), eos)).withColumns(
        {a: F.slice(a, F.lit(1), F.col("kept").cast("int")) for a in arrays}
    )
    use_kl = cfg.beta != 0.0
    measured = {"_ratio": ratio(F.col("logps"), F.col("old_logps") if "old_logps" in arrays else None)}
    if use_kl:
        measured["_kl"] = divergence(F.col("ref_logps"), F.col("logps"))
    prepared = prepared.withColumns(measured)
    loss = token_loss(F.col("_ratio"), F.col("advantage"), cfg, F.col("_kl") if use_kl else None)
    sums = {
        "loss_sum": total(loss),
        "kl_sum": total(F.col("_kl")) if use_kl else F.lit(None).cast("double"),
        "clip_sum": F.when(F.col("advantage").isNotNull(), total(clipped_tokens(F.col("_ratio"), F.col("advantage"), cfg))),
    }
    return prepared.withColumns(sums).drop("completion_ids", *arrays, *measured)


def ratio_statistics(tokens: DataFrame, cfg: LossConfig, eos: int) -> DataFrame:
    """What the loss needs of the token arrays when the advantage is not known yet: six numbers per rollout.

    The clipped loss of a token is ``-A * min(c, clamp(c))`` for ``A >= 0`` and ``-A * max(c, clamp(c))`` below, so the
    sums of both suffice. Arrays are reduced where they lie and never travel with a join. ``old_logps`` and, where
    ``cfg.beta`` is 0, ``ref_logps`` may be missing.
    """
    arrays = _arrays_of(tokens, cfg)
    kept = tokens.withColumn("kept", kept_length(F.col("completion_ids"), eos)).withColumns(
        {a: F.slice(a, F.lit(1), F.col("kept").cast("int")) for a in arrays}
    )
    old = F.col("old_logps") if "old_logps" in arrays else None
    kl = total(divergence(F.col("ref_logps"), F.col("logps"))) if "ref_logps" in arrays else F.lit(None).cast("double")
    measured = kept.withColumn("_ratio", ratio(F.col("logps"), old))
    c = F.col("_ratio")
    sums = {
        "lower_sum": total(F.transform(c, lambda x: F.least(x, clamp(x, cfg)))),
        "upper_sum": total(F.transform(c, lambda x: F.greatest(x, clamp(x, cfg)))),
        "kl_sum": kl,
        "below": F.size(F.filter(c, lambda x: x < 1.0 - cfg.epsilon_low)).cast("double"),
        "above": F.size(F.filter(c, lambda x: x > 1.0 + cfg.upper)).cast("double"),
    }
    return measured.withColumns(sums).drop("completion_ids", *arrays, "_ratio")


def with_loss(statistics: DataFrame, cfg: LossConfig, advantage: str = "advantage") -> DataFrame:
    """Loss and clip sums per rollout from ``ratio_statistics`` and an advantage column."""
    a = F.col(advantage)
    clipped = -a * F.when(a >= 0, F.col("lower_sum")).otherwise(F.col("upper_sum"))
    loss = clipped + F.lit(cfg.beta) * F.col("kl_sum") if cfg.beta else clipped
    clip = F.when(a < 0, F.col("below")).when(a > 0, F.col("above")).when(a.isNotNull(), F.lit(0.0))
    return statistics.withColumns({"loss_sum": loss, "clip_sum": clip})


def token_mean(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Token means over whole batches: sums of sums over sums of kept tokens.

    A row whose advantage is null (a group of one) has no loss and no clipped share; its tokens count for neither mean,
    while its divergence counts for ``mean_kl``.
    """

    def mean(name: str) -> Column:
        value = F.col(f"{name}_sum")
        return F.try_divide(F.sum(value), F.sum(F.when(value.isNotNull(), F.col("kept")))).alias(f"mean_{name}")

    return sums.groupBy(*keys).agg(F.sum("kept").cast("bigint").alias("tokens"), *[mean(m) for m in ("loss", "kl", "clip")])
