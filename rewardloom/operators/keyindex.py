"""Distinct keys across runs: an index of digests that every run joins without moving what earlier runs wrote.

The index is a table partitioned by run and bucketed by digest. A run's own keys are reduced to one row each, dealt into
the same buckets, and anti-joined bucket by bucket with the keys of all other runs, which stay where they are; what is new
becomes the run's partition. A run that is repeated overwrites its own partition and does not see itself as history.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.session import near_rows, stage
from rewardloom.streaming.live import each_available

BUCKETS = 64
_INFO = "_index.json"  # a name that table scans pass over


def key_digest(*keys: Column) -> Column:
    """32 bytes that stand for the keys; null differs from every value."""
    parts = [F.coalesce(F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys]
    return F.unhex(F.sha2(F.concat(*parts), 256))


class KeyIndex:
    """The index in ``path``. The number of buckets is fixed when the folder is first used."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._kept_buckets(buckets)
        self.name = "key_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, first_id BIGINT, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.catalog.recoverPartitions(self.name)

    def _kept_buckets(self, buckets: int) -> int:
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_INFO}")
        fs = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(file):
            stream = fs.open(file)
            try:
                return int(json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"])
            finally:
                stream.close()
        stream = fs.create(file, False)
        try:
            stream.write(bytearray(json.dumps({"buckets": buckets}).encode()))
        finally:
            stream.close()
        return buckets

    def history(self, run: str, session: SparkSession | None = None) -> DataFrame:
        """(digest) of all runs but ``run``."""
        return (session or self.spark).table(self.name).where(F.col("run") != run).select("digest")

    def unseen(self, df: DataFrame, digest: Column, row_id: str, run: str) -> DataFrame:
        """(digest, first_id) of the keys that no other run has. Copies combine on the map side, then a row per key moves."""
        own = df.groupBy(digest.alias("digest")).agg(F.min(row_id).cast("bigint").alias("first_id"))
        return own.repartition(self.buckets, "digest").join(self.history(run, df.sparkSession), "digest", "left_anti")

    def add(self, df: DataFrame, digest: Column, row_id: str, run: str) -> DataFrame:
        """Make the new keys of ``df`` the partition of ``run``; (digest, first_id) of these."""
        new = stage(self.unseen(df, digest, row_id, run), "new-keys")
        view = f"new_keys_{hashlib.sha256((self.name + run).encode()).hexdigest()[:20]}"
        new.repartition(self.buckets, "digest").createOrReplaceTempView(view)
        escaped = run.replace("\\", "\\\\").replace("'", "\\'")
        session = new.sparkSession  # a stream's batches have a session of their own
        session.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (run = '{escaped}') SELECT digest, first_id FROM {view}")
        session.catalog.dropTempView(view)
        return new

    def keys(self) -> DataFrame:
        """(digest, first_id, run) of all keys."""
        return self.spark.table(self.name)


def first_rows(df: DataFrame, index: KeyIndex, keys: list[str], row_id: str, run: str) -> DataFrame:
    """The first row, by ``row_id``, of every key that no other run has; the table's other rows are passed over."""
    new = index.add(df, key_digest(*[F.col(k) for k in keys]), row_id, run)
    ids = near_rows(stage(new.select(F.col("first_id").alias(row_id)), "first-rows"))
    return df.join(ids, row_id, "left_semi")


def distinct_across_runs(stream: DataFrame, index: KeyIndex, keys: list[str], row_id: str, checkpoint: str, name: str = "epoch") -> None:
    """Add the keys of everything that has arrived; an epoch is a run, so a repeated one adds nothing twice, and no key is
    ever forgotten."""
    digest = key_digest(*[F.col(k) for k in keys])
    sink: Callable[[DataFrame, int], None] = lambda batch, epoch: index.add(batch, digest, row_id, f"{name}-{epoch}") and None
    each_available(stream, sink, checkpoint)
