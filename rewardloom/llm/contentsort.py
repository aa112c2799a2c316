"""Exact de-duplication by sorting contents. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import SPACES, id_salt, key_text, packed, scan_tasks, whole_text
from rewardloom.session import near_rows, stage

SPLITTER_CHARS = 64  # of a content that take part in range partitioning; the sort and the comparisons use all of it
HOT_COPIES = 1000  # copies of a content from which it may be cut into several runs, if they are a large part of a task


def normalised(column: str = "text") -> Column:
    """The text without the characters space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(whole_text(column), SPACES, "")


def hot_contents(rows: DataFrame, tasks: int) -> DataFrame:
    """(_hash) of the contents whose copies would fill a quarter of a task: at most four per task, from map-side counts."""
    counts = stage(rows.groupBy(F.xxhash64("_content").alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HOT_COPIES), "content-counts")
    total = rows.count()
    return counts.where(F.col("_n") > total // (4 * tasks)).select("_hash")


def content_runs(docs: DataFrame) -> DataFrame:
    """doc_id, _chars, _place, _run, _first, _hot, text_sha256 of every row: its place in its run of equal contents.

    Rows are range-partitioned by the start of the normalised content (splitters are sampled from these starts, which
    keeps the sample that Spark gathers small), then sorted in each partition by start, whole content, length and id;
    the sort spills to disk. Equal contents lie side by side, and a run ends where the full comparison with the
    neighbour differs. Only a content whose copies would fill a task is dealt to several, by a salt of the id.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(whole_text()).alias("_chars"), normalised().alias("_content")
    )
    tasks = scan_tasks(docs)
    hot = near_rows(stage(hot_contents(rows.select("_content"), tasks).withColumn("_hot", F.lit(True)), "hot-contents"))
    rows = rows.withColumn("_hash", F.xxhash64("_content")).join(hot, "_hash", "left").drop("_hash")
    rows = rows.withColumn("_hot", F.coalesce("_hot", F.lit(False))).withColumn("_salt", F.when(F.col("_hot"), id_salt("doc_id")).otherwise(F.lit(0)))
    rows = rows.withColumn("_start", F.substring("_content", 1, SPLITTER_CHARS))
    rows = rows.repartitionByRange(tasks, "_start", "_salt")
    runs = Window.partitionBy("_start", "_salt", "_content")
    run = runs.orderBy(F.col("_chars").desc(), F.col("doc_id").asc())
    rows = rows.select(
        "doc_id",
        "_chars",
        "_hot",
        F.row_number().over(run).alias("_place"),
        F.count(F.lit(1)).over(runs).alias("_run"),
        F.first("doc_id").over(run).alias("_first"),
        F.sha2(F.col("_content"), 256).alias("text_sha256"),
    )
    return stage(rows, "content-runs")


def merged_heads(rows: DataFrame) -> DataFrame:
    """The runs of a hot content as one group, by the digests of their heads, with partial sums first."""
    heads = rows.where("_hot AND _place = 1").groupBy("text_sha256")
    groups = heads.agg(
        F.min(F.struct((-F.col("_chars")).alias("shorter"), F.col("doc_id"))).alias("_best"),
        F.sum("_run").alias("group_size"),
        F.count(F.lit(1)).alias("_runs"),
    )
    columns = [F.col("_best.doc_id").alias("keep_id"), (-F.col("_best.shorter")).alias("_keep_chars"), "group_size", "_runs"]
    return stage(groups.select("text_sha256", *columns), "content-groups")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    A run of equal neighbours is a group (``content_runs``); only the runs of a content that was dealt to several tasks
    are brought together by digest.

    Of equal texts the row with the most code points stays, then the one with the smallest id. Null text: empty. Null
    id: smallest. Fully equal rows: one of them is kept, the others are not. Empty table: empty result.
    """
    rows = content_runs(docs)
    own = rows.where("NOT _hot").select("doc_id", F.col("_first").alias("keep_id"), F.col("_run").alias("group_size"), (F.col("_place") == 1).alias("kept"), "text_sha256")
    kept = (F.col("_place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("_keep_chars"))
    hot = rows.where("_hot").join(merged_heads(rows), "text_sha256")
    return own.unionByName(hot.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows that ``duplicate_groups`` keeps, columns unchanged; cases as there. Of fully equal rows one stays."""
    kept = duplicate_groups(docs).where("kept").select(key_text("doc_id").alias("_key"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(packed(docs), key_text("doc_id").alias("_key"), F.sha2(normalised(), 256).alias("_sha"), F.length(whole_text()).alias("_chars"))
    rows = rows.join(stage(kept, "content-kept"), ["_key", "_sha"], "left_semi")
    # An id normally stands once; among rows of one id and content the longest text is the one that was kept.
    same = Window.partitionBy("_key", "_sha").orderBy(F.col("_chars").desc())
    return rows.withColumn("_place", F.row_number().over(same)).where("_place = 1").select("_row.*")


DEDUP_SQL = r"""
WITH rows AS (
 SELECT doc_id, length(coalesce(text, '')) AS chars,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
 FROM documents)
SELECT doc_id,
 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS FIRST) AS keep_id,
 count(*) OVER (PARTITION BY text_sha256) AS group_size,
 row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS FIRST) = 1 AS kept, text_sha256
FROM rows
"""
