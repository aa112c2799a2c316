"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
_BEFORE = (Window.unboundedPreceding, -1)
SALTS = 4099  # fixed number of sub-buckets of a group; a prime, so that evenly stepped ids spread


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that no name of theirs can clash with a working column."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_row")


def key_text(column: str) -> Column:
    """A text that stands for a nullable key: '=' and the key, or '' for null. Equi joins on it keep null keys."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def id_salt(column: str) -> Column:
    """Sub-bucket of a row by its integer id; null ids share one."""
    return F.coalesce(F.pmod(F.col(column).cast("long"), F.lit(SALTS)), F.lit(-1)).cast("int")


def scan_tasks(df: DataFrame) -> int:
    """Partitions for a shuffle that moves whole rows: as set for the session, or one per 64 MB beyond that."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (64 << 20) + 1, 100_000))


def with_group_rank(df: DataFrame, group: list[str], level: str | None, salt: str, order: list[Column], rank: str) -> DataFrame:
    """Add ``rank``, the row's place (from 0) in its group by level, salt and ``order``, without a window over a group.

    Counts per (group, level, salt) are combined on the map side; offsets are running sums of those counts, first over
    the levels of a group, then over the at most SALTS + 1 salts of a level. Rows are numbered only inside one
    (group, level, salt), so a group that holds a third of the table is dealt to thousands of tasks. The key columns
    must not be null.
    """
    keys = [*group, *([level] if level else [])]
    cells = stage(df.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("_cell")), "rank-cells")
    in_level = Window.partitionBy(*keys).orderBy(salt).rowsBetween(*_BEFORE)
    offsets = cells.select(*keys, salt, F.coalesce(F.sum("_cell").over(in_level), F.lit(0)).alias("_off"))
    if level:
        levels = cells.groupBy(*keys).agg(F.sum("_cell").alias("_cell"))
        in_group = Window.partitionBy(*group).orderBy(level).rowsBetween(*_BEFORE)
        levels = levels.select(*keys, F.coalesce(F.sum("_cell").over(in_group), F.lit(0)).alias("_base"))
        offsets = offsets.join(levels, keys).select(*keys, salt, (F.col("_off") + F.col("_base")).alias("_off"))
    offsets = stage(offsets, "rank-offsets")
    inside = Window.partitionBy(*keys, salt).orderBy(*order)
    numbered = df.withColumn("_in", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, salt])
    return joined.select(*df.columns, (F.col("_off") + F.col("_in") - 1).alias(rank))



_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a task as one batch of a schema such as 'doc_id long, text string'. Null ids stay exact integers."""
    names, kinds = zip(*[column.split() for column in schema.split(", ")])
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))
