"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}  # folders of local sessions that name none
_ONE_MACHINE = re.compile(r"local(\[[^\]]*\])?")  # not local-cluster, whose executors share no folder with the driver
_RUN: ContextVar[str | None] = ContextVar("run", default=None)  # folder of the run scope that is open
NEAR_ROWS = 2_000_000  # keys that are sent to every executor
NEAR_BYTES = 128 << 20  # and their size in memory
CELL_BYTES = 16  # of a value in a row, besides its letters
BYTES_PER_TASK = 128 * 1024 * 1024  # Spark's default size of one scan partition


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rewardloom") -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="rewardloom-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local folder would be
    lost with its executor, so there the setting is required.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not _ONE_MACHINE.fullmatch(spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="rewardloom-")
    return _LOCAL_DIRS[application]


@contextmanager
def run_scope(spark: SparkSession, name: str = "run", keep: bool = False) -> Iterator[str]:
    """Everything staged inside goes to one folder, which is removed at the end unless it is to be kept.

    Results read from staged tables have to be written or collected inside. Scopes may nest.
    """
    folder = fresh_path(spark, name)
    before = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(before)
        if not keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_RUN.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a narrow intermediate table once and read it back.

    Used where one expensive row-wise pass (scoring long texts) feeds both an aggregate and the join back to
    its rows. The written table cuts lineage, survives lost executors and keeps column pruning.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def memory_size(df: DataFrame) -> tuple[int, int]:
    """Rows of a staged table and about the bytes they take in memory, from the lengths of their texts; files are
    compressed and several times smaller."""
    parts = [F.lit(CELL_BYTES * len(df.columns)).cast("bigint")]
    for field in df.schema.fields:
        column, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(reduce(Column.__add__, parts))).first()
    return rows, size or 0


def near_rows(keys: DataFrame) -> DataFrame:
    """A staged table of keys, marked to be sent to the other side of a join while it is small in rows and in bytes."""
    rows, size = memory_size(keys)
    return F.broadcast(keys) if rows <= NEAR_ROWS and size <= NEAR_BYTES else keys


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows of a small table with few row groups over the cores before work that is heavy per row.

    A table larger than one scan partition per core already fills the cores and is returned as it is, so no large
    table is ever moved by this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * BYTES_PER_TASK else df
