"""Task datasets: one folder per source and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rewardloom.config import MixConfig, TaskSource
from rewardloom.operators.mix import concatenate, fraction_head, keep_columns, route_split, shuffled


def read_source(
    spark: SparkSession,
    source: TaskSource,
    columns: tuple[str, ...] | None = None,
    schema: StructType | None = None,
    config: str | None = None,
) -> DataFrame:
    """All splits of one source with ``source``, ``split`` and ``row_id`` columns."""
    frames = []
    for split in source.splits:
        path = source.layout.format(root=source.root, split=split, config=config or "")
        reader = spark.read.schema(schema) if schema is not None else spark.read
        rows = reader.parquet(path)
        row_id = F.col(source.id_column).cast("bigint").alias("row_id")
        kept = keep_columns(rows, columns) if columns is not None else rows
        names = [F.col(c) for c in kept.columns if c not in ("source", "split", "row_id")]
        frames.append(
            rows.select(F.lit(source.name).alias("source"), route_split(F.lit(split)).alias("split"), row_id, *names)
        )
    return concatenate(frames)


def load_mix(spark: SparkSession, cfg: MixConfig, schema: StructType | None = None) -> DataFrame:
    """Training rows by fraction and all test rows of every source, in seeded order when shuffled.

    A fraction belongs to its source and cuts training rows only.
    """
    configs = cfg.configs or tuple(None for _ in cfg.sources)
    frames = [read_source(spark, s, cfg.columns_to_keep, schema, c) for s, c in zip(cfg.sources, configs)]
    rows = concatenate(frames)
    fractions = {s.name: s.fraction for s in cfg.sources}
    if any(f < 1.0 for f in fractions.values()):
        train = fraction_head(rows.where(F.col("split") == "train"), "source", "row_id", fractions)
        rows = train.unionByName(rows.where(F.col("split") == "test"))
    return shuffled(rows, cfg.seed, "source", "split", "row_id") if cfg.shuffle else rows
