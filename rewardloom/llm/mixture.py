"""Mixing sources to target weights by systematic sampling. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import WORD, id_salt, key_text, packed, whole_text, with_group_rank
from rewardloom.session import stage

CAP = 3  # a target is at most this many times its source's size
WEIGHTS = (1, 2, 3)  # repeating over the sources in code point order, null last
SEED = "mixture-1"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets per source from ``sizes(source, source_size)``, one row per source.

    Targets share the total size by weight; a target that would pass ``cap`` times its source's size stops there and
    the excess is shared again by weight among the others, until none is above. That fixed point is a level: target =
    min(cap x size, weight x level). In ascending order of cap x size / weight the capped sources come first, so the
    level is read off running sums. Windows here run over one short row per source, never over documents.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").isNull(), F.col("source"))
    so_far, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left_size = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(so_far), F.lit(0))
    left_weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(so_far), F.lit(0))
    rows = rows.withColumn("_level", left_size / left_weight).withColumn("_place", F.row_number().over(fill))
    holds = F.col("_cap") >= F.col("_level") * F.col("_w")
    rows = rows.withColumn("_level", F.min_by(F.col("_level"), F.when(holds, F.col("_place"))).over(whole))
    share = F.col("_level") * F.col("_w")
    return rows.select("source", "source_size", F.when(F.col("_cap") < share, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _offset(key: str, seed: str) -> Column:
    """One number in [0, 1) per source, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(rows: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``rows(_row, doc_id, source, _size, _tie)`` with _source_size, _target and _copies.

    Each document of a source expects target / source_size copies. Documents of a source stand in order of size (then
    by id), their expected copies are summed up, one offset per source is added, and a document is taken once for each
    integer its interval crosses. The order by size keeps the words taken within about one document of the target.
    """
    rows = rows.withColumn("_source", key_text("source")).withColumn("_salt", id_salt("doc_id"))
    sums = rows.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(stage(sums, "mix-sizes"), cap, weights)
    targets = stage(
        targets.select(key_text("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")),
        "mix-targets",
    )
    order = [F.col("doc_id").asc(), F.col("_tie").asc()]
    ranked = with_group_rank(rows, ["_source"], "_size", "_salt", order, "_rank").join(targets, "_source")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("_rate", rate).withColumn("_u", _offset("_source", seed))
    upto = F.floor(F.col("_rate") * (F.col("_rank") + 1) + F.col("_u"))
    taken = (upto - F.floor(F.col("_rate") * F.col("_rank") + F.col("_u"))).cast("long")
    return ranked.withColumn("_copies", F.least(taken, F.lit(cap).cast("long")))


def mix(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row repeated as often as the sample takes it, columns unchanged.

    Whole rows are shuffled once, to the cell their rank is taken in, and leave from there.

    Null text: size 0. Null source: a source of its own, last. Null ids: allowed, they come first among equal sizes.
    Empty table: empty result. Rows that repeat are rows of their own. A source without words has target 0 and gives
    no rows. Extra columns of any name are kept.
    """
    tie = F.xxhash64(whole_text())
    rows = docs.select(packed(docs), "doc_id", "source", word_count().alias("_size"), tie.alias("_tie"))
    sampled = with_copies(rows, cap, weights, seed).where(F.col("_copies") > 0)
    return sampled.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken per document; cases as for ``mix``, rows that are not taken have 0."""
    rows = docs.select("doc_id", "source", word_count().alias("_size"), F.lit(0).alias("_tie"))
    rows = with_copies(stage(rows, "mix-rows"))
    return rows.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


MIX_SQL = rf"""
WITH sized AS (
 SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
sources AS (
 SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 3 AS cap,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w
 FROM sized GROUP BY source),
filled AS (
 SELECT *, row_number() OVER fill AS place,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
   / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
 FROM sources
 WINDOW fill AS (ORDER BY cap / w, source NULLS LAST),
  before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
 SELECT source, source_size, CASE WHEN cap < lev * w THEN cap::DOUBLE ELSE lev * w END AS target,
  ('0x' || substr(md5('{SEED}:' || coalesce('=' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
 FROM (SELECT *, (SELECT arg_min(level, place) FROM filled WHERE cap >= level * w) AS lev FROM filled) leveled),
ranked AS (
 SELECT s.doc_id, s.size, t.source_size, t.target, t.u,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size, coalesce(s.doc_id % 4099, -1), s.doc_id) - 1 AS rank
 FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
 least(floor(rate * (rank + 1) + u) - floor(rate * rank + u), 3)::BIGINT * size AS taken
FROM ranked
"""
