"""Mixing, splitting and shuffling task datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.operators.rank import flag_first, hash_key, id_key, keep_first, with_rank

DEBUG_ROWS = 100


def route_split(split: Column) -> Column:
    """``train`` or ``test`` by the name of a split, ``train`` tested first; other names are an error."""
    return (
        F.when(split.contains("train"), F.lit("train"))
        .when(split.contains("test"), F.lit("test"))
        .otherwise(F.raise_error(F.concat(F.lit("split is neither train nor test: "), split)))
    )


def keep_columns(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> DataFrame:
    """Keep the wanted columns a table has; absent ones are ignored."""
    return df.select(*[c for c in df.columns if c in wanted])


def map_rows(df: DataFrame, **outputs: Column) -> DataFrame:
    """Formatter output only: inputs are dropped unless they are among the outputs."""
    return df.select(*[value.alias(name) for name, value in outputs.items()])


def fraction_head(
    df: DataFrame, source: str, row_id: str, fractions: dict[str, float], id_bits: int = 64
) -> DataFrame:
    """First ``int(fraction * rows)`` rows of every source in id order; sources without a fraction are dropped.

    ``id_bits`` below 64 promises non-negative ids of that many bits and saves passes; a larger id fails the job.
    """
    bad = [name for name, f in fractions.items() if not 0.0 <= f <= 1.0]
    if bad:
        raise ValueError(f"fractions must lie in [0, 1]: {', '.join(bad)}")
    fraction = F.coalesce(*[F.when(F.col("_by") == name, F.lit(float(f))) for name, f in fractions.items()], F.lit(0.0))
    return keep_first(df, id_key(row_id, id_bits), F.floor(fraction * F.col("_rows")), by=F.col(source), digits=id_bits // 4)


def debug_head(df: DataFrame, order: str | Column, split: str = "split", rows: int = DEBUG_ROWS) -> DataFrame:
    """First rows of each of the two splits, each a bounded top-k."""
    heads = [df.where(F.col(split) == name).orderBy(order).limit(rows) for name in ("train", "test")]
    return reduce(DataFrame.unionByName, heads)


def shuffled(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """Rows in seeded order."""
    return df.withColumn("_key", hash_key(seed, *ids)).orderBy("_key").drop("_key")


def shuffle_positions(df: DataFrame, seed: int, *ids: str, name: str = "position") -> DataFrame:
    """Position of every row in the seeded order, as a column instead of a physical sort."""
    return with_rank(df, hash_key(seed, *ids), name)


def random_subset(df: DataFrame, seed: int, rows: int, *ids: str) -> DataFrame:
    """The first ``rows`` of the seeded order, or all when there are fewer."""
    return keep_first(df, hash_key(seed, *ids), F.least(F.lit(rows), F.col("_rows")), hashed=True)


def split_train_test(df: DataFrame, seed: int, test_size: float, *ids: str, name: str = "split") -> DataFrame:
    """Label ``ceil(test_size * rows)`` rows of the seeded order as test, the rest as train."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")
    wanted = F.ceil(F.lit(test_size) * F.col("_rows"))
    marked = flag_first(df, hash_key(seed, *ids), wanted, hashed=True, name="_test")
    return marked.withColumn(name, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def preview(df: DataFrame, seed: int, *ids: str, rows: int = 2) -> DataFrame:
    """A few rows in seeded order: a bounded top-k."""
    return df.withColumn("_key", hash_key(seed, *ids)).orderBy("_key").limit(rows).drop("_key")


def concatenate(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union by name; schemas must agree unless missing columns are allowed."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def missing_images(df: DataFrame, image: str = "image") -> DataFrame:
    """Quality report: rows and rows without an image."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(image).isNull()).cast("bigint").alias("missing_images")
    )


def require_images(df: DataFrame, image: str = "image") -> DataFrame:
    """Fail the job at the first row without an image."""
    problem = F.raise_error(F.lit("a multimodal batch holds a row without an image"))
    return df.withColumn(image, F.when(F.col(image).isNull(), problem).otherwise(F.col(image)))


def unique_prompts(rollouts: DataFrame, gen_idx: str = "gen_idx") -> DataFrame:
    """One row per prompt of a repeated batch: the first generation of each group."""
    return rollouts.where(F.col(gen_idx) == 0)
