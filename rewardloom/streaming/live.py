"""Rollouts as they arrive: stateless scoring, group advantages, metric windows, running totals, de-duplication.

Every function works in one folder, ``home``, which holds its result and its checkpoint. A run reads the files that have
landed since the last one and stops, so a scheduled job that names the same folder goes on where it stopped; without a
name a fresh folder is taken. A bounded input ends with ``last=True``: one mark far in the future moves the watermark
past every row, so that the windows still open are finished. Rows that land afterwards are late.

Windowed functions first split what arrives: rows whose window the watermark has closed, and rows without a time, go to
a table of their own with the reason (``late_rows``), all others are counted. Accepted and late rows together are all
rows that arrived, whatever happens to a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rewardloom.operators.groups import STD_FLOOR
from rewardloom.session import fresh_path

END = "9000-01-01 00:00:00"  # the time of an end mark


def read_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_available(stream: DataFrame, path: str, checkpoint: str, *partition_by: str) -> DataFrame:
    """Append all available results to a table and read it."""
    query = (
        stream.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def each_available(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


WINDOW_CLOSED, NO_TIME = "window closed", "no time"


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def split_late(stream: DataFrame, window: str, delay: str, home: str, last: bool = False, by_window: bool = False) -> DataFrame:
    """All rows of ``stream(ts, ..)`` so far, with ``epoch``, ``late`` (the reason or '-') and ``window_at``.

    A row is late when its window ended at or before the largest time of the epochs before its own, less ``delay``: the
    rule by which the engine's watermark drops rows, so that no row accepted here is dropped by a windowed aggregate
    that reads them. An epoch writes its rows once, partitioned by lateness (and by window, if single windows are to be
    read), and its mark, the largest time so far; a repeated epoch overwrites both. After ``last`` every window is
    closed. Null times: late.
    """
    spark, rows, marks = stream.sparkSession, f"{home}/rows", f"{home}/marks"
    timed = F.window(F.coalesce("ts", F.timestamp_seconds(F.lit(0))), window)  # a null time would drop the row

    def mark_of(name: str):
        return spark.read.parquet(f"{marks}/{name}").first()["mark"] if _exists(spark, f"{marks}/{name}") else None

    def write(batch: DataFrame, epoch: int) -> None:
        before = mark_of("end") or mark_of(f"epoch={epoch - 1}")
        closed = span_end <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL '{delay}'") if before else F.lit(False)
        late = F.when(F.col("ts").isNull(), NO_TIME).when(closed, WINDOW_CLOSED).otherwise("-")
        path = f"{rows}/epoch={epoch}"
        split = batch.withColumn("_span", timed).withColumns({"late": late, "window_at": F.unix_seconds("_span.start")}).drop("_span")
        split.write.mode("overwrite").partitionBy("late", *(["window_at"] if by_window else [])).parquet(path)
        largest = spark.read.schema(split.schema).parquet(path).agg(F.max("ts").alias("mark"))
        largest.select(F.greatest("mark", F.lit(before).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")

    span_end = F.col("_span.end")
    folder = spark._jvm.org.apache.hadoop.fs.Path(rows)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # nothing may have arrived yet
    each_available(stream, write, f"{home}/rows-log")
    if last:
        spark.range(1).select(F.to_timestamp(F.lit(END)).alias("mark")).write.mode("overwrite").parquet(f"{marks}/end")
    return spark.read.schema(_split_schema(stream.schema)).option("basePath", rows).parquet(rows)


def _split_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("epoch", "long").add("late", "string").add("window_at", "long")


def _accepted(stream: DataFrame, window: str, delay: str, home: str, last: bool, by_window: bool = False) -> DataFrame:
    """The accepted rows as a stream, after what has arrived was split."""
    spark, schema = stream.sparkSession, stream.schema
    split_late(stream, window, delay, home, last, by_window)
    found = spark.readStream.schema(_split_schema(schema)).option("basePath", f"{home}/rows").parquet(f"{home}/rows")
    return found.where(F.col("late") == "-").select(*[f.name for f in schema.fields])


def late_rows(spark: SparkSession, home: str, schema: StructType) -> DataFrame:
    """The late rows of a folder, with ``reason`` and ``window_at``; ``schema`` is that of the stream."""
    rows = spark.read.schema(_split_schema(schema)).option("basePath", f"{home}/rows").parquet(f"{home}/rows")
    return rows.where(F.col("late") != "-").withColumnRenamed("late", "reason").drop("epoch")


def _home(spark: SparkSession, home: str | None, name: str) -> str:
    return home.rstrip("/") if home else fresh_path(spark, name)


def _with_end(stream: DataFrame, home: str, last: bool) -> DataFrame:
    """The stream and a second source of end marks: rows with a time far in the future and nothing else."""
    spark, marks = stream.sparkSession, f"{home}/end-marks"
    empty = spark.createDataFrame([], stream.schema)
    empty.coalesce(1).write.mode("append").parquet(marks)
    if last:
        end = [F.to_timestamp(F.lit(END)).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
        spark.range(1).select(*end).coalesce(1).write.mode("append").parquet(marks)
    return stream.unionByName(read_stream(spark, marks, stream.schema))


def _write_epoch(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent: a repeated epoch overwrites its own folder."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _read_epochs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    with_epoch = StructType([*schema.fields]).add("epoch", "long")
    return spark.read.schema(with_epoch).option("basePath", path).parquet(path)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], home: str | None = None) -> DataFrame:
    """Scores of all rollouts so far; scoring is stateless, so batch and stream share the scorer."""
    home = _home(stream.sparkSession, home, "live-scores")
    return append_available(scorer(stream), f"{home}/result", f"{home}/log")


def group_advantage_stream(
    scored: DataFrame,
    window: str,
    delay: str,
    group: str = "group_id",
    reward: str = "reward",
    scale: bool = True,
    home: str | None = None,
    last: bool = False,
) -> DataFrame:
    """Advantages of the groups whose time window is complete.

    ``scored`` holds ``ts``, the group and the reward, and all rollouts of a step carry the step's time. Streaming state
    is three numbers per group: rows are written to a table as they come, partitioned by window; the statistics of a
    finished window leave the state once, and only then are joined to the rows of the finished windows, the only ones
    read. A hot group is a skewed partition of that batch join, never one value in the state. Rows that come after their
    window was finished stand in ``late_rows(spark, home, scored.schema)``.
    """
    spark = scored.sparkSession
    home = _home(spark, home, "live-advantages")
    span = F.window("ts", window)
    arriving = _with_end(_accepted(scored, window, delay, home, last, by_window=True), home, last)
    rows = spark.read.schema(_split_schema(scored.schema)).option("basePath", f"{home}/rows").parquet(f"{home}/rows")
    rows = rows.where(F.col("late") == "-").drop("epoch", "late")
    stats = (
        arriving.withWatermark("ts", delay)
        .groupBy(span.alias("span"), group)
        .agg(F.avg(reward).alias("group_mean"), F.stddev_samp(reward).alias("group_std"))
        .select(F.unix_seconds("span.start").alias("window_at"), F.col(group).alias("_group"), "group_mean", "group_std")
    )

    def finish(done: DataFrame, epoch: int) -> None:
        first, final = done.agg(F.min("window_at"), F.max("window_at")).first()
        finished = rows.where(F.col("window_at").between(first, final)) if first is not None else rows.limit(0)
        done = done.withColumnRenamed("window_at", "_at")
        joined = finished.join(done, (F.col("window_at") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
        gap = F.col(reward) - F.col("group_mean")
        value = gap / (F.col("group_std") + F.lit(STD_FLOOR)) if scale else gap
        _write_epoch(f"{home}/result")(joined.withColumn("advantage", value).drop("_at", "_group"), epoch)

    each_available(stats, finish, f"{home}/log")
    schema = StructType([*rows.schema.fields])
    for name in ("group_mean", "group_std", "advantage"):
        schema = schema.add(name, "double")
    return _read_epochs(spark, f"{home}/result", schema).drop("epoch")


def metric_windows(points: DataFrame, window: str, delay: str, *keys: str, home: str | None = None, last: bool = False) -> DataFrame:
    """Mean of a metric per tumbling window; windows behind the watermark are final and appended once. Late points are kept apart."""
    home = _home(points.sparkSession, home, "live-metrics")
    means = (
        _with_end(_accepted(points, window, delay, home, last), home, last)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("span"), *keys)
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("points"))
    )
    flat = means.select(F.col("span.start").alias("window_start"), *keys, "value", "points")
    return append_available(flat, f"{home}/result", f"{home}/log")


def running_totals(points: DataFrame, amount: Column, *keys: str, home: str | None = None) -> DataFrame:
    """Running sum per key; the state is one number per key and every trigger rewrites the small result.

    Two slots take turns, so the result before is whole while the next one is written, and none older is kept.
    """
    spark = points.sparkSession
    home = _home(spark, home, "live-totals")
    totals = points.groupBy(*keys).agg(F.sum(amount).alias("total"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{home}/result/slot={epoch % 2}")

    each_available(totals, write, f"{home}/log", mode="complete")
    slots = spark.read.schema(StructType([*totals.schema.fields]).add("epoch", "long").add("slot", "integer")).parquet(f"{home}/result")
    return slots.groupBy(*keys).agg(F.max_by("total", "epoch").alias("total"))


def window_counts(points: DataFrame, window: str, delay: str, home: str) -> DataFrame:
    """Rows accepted per window so far. Rows whose window lies behind the watermark are late and are kept apart."""
    counts = (
        _accepted(points, window, delay, home, False)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("span"))
        .agg(F.count(F.lit(1)).alias("points"))
        .select(F.col("span.start").alias("window_start"), "points")
    )
    each_available(counts, _write_epoch(f"{home}/result"), f"{home}/log", mode="update")
    epochs = _read_epochs(points.sparkSession, f"{home}/result", counts.schema)
    return epochs.groupBy("window_start").agg(F.max_by("points", "epoch").alias("points"))


def distinct_stream(stream: DataFrame, delay: str, *keys: str, home: str | None = None) -> DataFrame:
    """First arrival of every key; a key is remembered for the watermark delay and may come again after it."""
    home = _home(stream.sparkSession, home, "live-distinct")
    first = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return append_available(first, f"{home}/result", f"{home}/log")
