"""Stand-in tables derived from the given ones.

Each is one SQL text that both engines run unchanged; ``{name}`` marks a given table. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rewardloom.catalog.registry import table, text_table

_NL = "chr(10)"
_BS = "chr(92)"
_OPEN = "chr(123)"
_CLOSE = "chr(125)"
_S = "CAST((doc_id * 7) % 100 AS STRING)"
_A, _B, _C = "CAST(n1 AS STRING)", "CAST(n2 AS STRING)", "CAST(n3 AS STRING)"
_FRACTION = (
    f"{_BS} || 'frac' || {_OPEN} || CAST(2 * ((doc_id * 7) % 100) AS STRING) || {_CLOSE} || {_OPEN} || '2' || {_CLOSE}"
)

# Rollouts: every document becomes one completion in one of seventeen layouts, eight to a group.
ROLLOUTS = f"""
SELECT rollout_id, group_id, gen_idx, batch_id, step, source, lang, n1, n2, n3, layout,
 CASE layout
  WHEN 0 THEN '<think>' || {_NL} || text || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || {_S} || {_NL} || '</answer>'
  WHEN 1 THEN '<think>' || text || '</think> <answer>' || {_S} || '</answer>'
  WHEN 2 THEN text
  WHEN 3 THEN 'Step 1: ' || text || {_NL} || '- Next, ' || text || {_NL} || 'Finally, ' || {_S}
  WHEN 4 THEN text || '</think>' || {_NL} || '<answer>(' || {_A} || ' + ' || {_B} || ') - ' || {_C} || '</answer>'
  WHEN 5 THEN '<think>' || text || '<answer>' || {_S}
  WHEN 6 THEN text || ' ' || text
  WHEN 7 THEN text || ' The final answer is $' || {_BS} || 'boxed' || {_OPEN} || {_FRACTION} || {_CLOSE} || '$.'
  WHEN 8 THEN '<think>' || {_NL} || text || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || '```python' || {_NL} || 'print(' || {_S} || ')' || {_NL} || '```' || {_NL} || '</answer>'
  WHEN 9 THEN '<think>' || {_NL} || text || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || CAST((doc_id * 7) % 100 + 1 AS STRING) || {_NL} || '</answer>'
  WHEN 10 THEN text || '</think>' || {_NL} || '<answer> ' || {_A} || ' * ' || {_B} || ' - ' || {_C} || ' </answer>' || {_NL}
  WHEN 11 THEN text || '</think>' || {_NL} || '<answer>0' || {_A} || ' + ' || {_B} || ' - ' || {_C} || '</answer>'
  WHEN 12 THEN text || '</think>' || {_NL} || '<answer>' || {_A} || ' / ' || {_B} || ' + ' || {_C} || '</answer>'
  WHEN 13 THEN text || ' Answer: $' || {_FRACTION} || '$'
  WHEN 15 THEN '<reasoning>' || replace(text, {_NL}, ' ') || '</reasoning> ' || {_NL} || '<answer>' || {_S} || '</answer>' || {_NL} || text
  WHEN 16 THEN '<think>' || {_NL} || text || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || '```bash' || {_NL} || 'echo ' || {_S} || {_NL} || '```' || {_NL} || '</answer>'
  ELSE '<reasoning>' || {_NL} || replace(text, {_NL}, ' ') || {_NL} || '</reasoning>' || {_NL} || '<answer>' || {_NL} || {_S} || {_NL} || '</answer>' || {_NL}
 END AS completion,
 CASE doc_id % 5
  WHEN 0 THEN {_S}
  WHEN 1 THEN '$' || {_S} || '$'
  WHEN 2 THEN '$' || {_FRACTION} || '$'
  WHEN 3 THEN 'no closed form'
  ELSE {_S} || '.0' END AS solution,
 {_S} AS answer,
 CASE layout
  WHEN 10 THEN CAST(n1 * n2 - n3 AS DOUBLE)
  WHEN 12 THEN CAST(n1 AS DOUBLE) / CAST(n2 AS DOUBLE) + CAST(n3 AS DOUBLE)
  ELSE CAST(n1 + n2 - n3 AS DOUBLE) END AS target
FROM (SELECT doc_id, doc_id AS rollout_id, text, source, lang,
  CAST(floor(doc_id / 8.0) AS BIGINT) AS group_id, doc_id % 8 AS gen_idx,
  CAST(floor(doc_id / 64.0) AS BIGINT) AS batch_id, CAST(floor(doc_id / 128.0) AS BIGINT) AS step,
  CAST(1 + doc_id % 50 AS BIGINT) AS n1, CAST(1 + (doc_id * 7) % 50 AS BIGINT) AS n2,
  CAST(1 + (doc_id * 13) % 50 AS BIGINT) AS n3,
  CAST((doc_id * 7 + CAST(floor(doc_id / 8.0) AS BIGINT) * 3) % 17 AS BIGINT) AS layout
 FROM {{documents}}) numbered
"""

# Rewards with nulls: labels cover only some of the documents.
SPARSE_REWARDS = """
SELECT d.doc_id AS rollout_id, CAST(floor(d.doc_id / 8.0) AS BIGINT) AS group_id,
 CAST(floor(d.doc_id / 128.0) AS BIGINT) AS step, d.source,
 CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic,
 CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.n_chars % 5 AS DOUBLE) / 4 END AS brevity
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

# Scored rollouts: one row per lineitem, keyed like a long training log.
SCORED_LINES = """
SELECT l_orderkey AS group_id, CAST(floor(l_orderkey / 64.0) AS BIGINT) AS step, l_returnflag AS source,
 l_quantity AS r_quantity, l_discount AS r_discount, l_tax AS r_tax,
 l_partkey, l_suppkey, l_linenumber, l_extendedprice
FROM {lineitem}
"""


def on_duckdb(text: str) -> str:
    """The same text over the tables as views."""
    for name in ("documents", "labels", "lineitem"):
        text = text.replace("{" + name + "}", name)
    return text


def _frame(spark: SparkSession, folder: str, text: str, read_documents=table) -> DataFrame:
    names = [n for n in ("documents", "labels", "lineitem") if "{" + n + "}" in text]
    readers = {"documents": read_documents}
    return spark.sql(text, **{n: readers.get(n, table)(spark, folder, n) for n in names})


def rollouts(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """``heavy`` marks work that is worth spreading a small table over the cores first."""
    return _frame(spark, folder, ROLLOUTS, text_table if heavy else table)


def sparse_rewards(spark: SparkSession, folder: str) -> DataFrame:
    return _frame(spark, folder, SPARSE_REWARDS)


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _frame(spark, folder, SCORED_LINES)


WITH_ROLLOUTS = f"WITH rollouts AS ({on_duckdb(ROLLOUTS)})"
WITH_SPARSE = f"WITH sparse AS ({on_duckdb(SPARSE_REWARDS)})"
WITH_LINES = f"WITH lines AS ({on_duckdb(SCORED_LINES)})"
