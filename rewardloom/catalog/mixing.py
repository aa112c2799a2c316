"""Scans, routing, mixing, splitting and the held-out check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import SQL_SPACE as SP
from rewardloom.catalog.registry import register, table, text_table
from rewardloom.config import MixConfig, TaskSource
from rewardloom.functions.chat import message, messages_of, wrap_solution
from rewardloom.operators import checks, leak, metrics, mix
from rewardloom.plans.tasks import prepare_tasks
from rewardloom.session import fresh_path
from rewardloom.sources.datasets import load_mix, read_source

SEED = 42
FRACTIONS = {f"src{i}": (0.1, 0.5, 1.0)[i % 3] for i in range(20)}
_FRACTION_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN {f}e0" for s, f in FRACTIONS.items()) + " ELSE 0e0 END"


def _documents(folder: str, fraction: float = 1.0) -> TaskSource:
    return TaskSource(
        "documents", folder, fraction, id_column="doc_id", splits=("train",), layout="{root}/documents.parquet"
    )


def _benchmark(folder: str) -> TaskSource:
    return TaskSource("benchmark", folder, id_column="item_id", splits=("test",), layout="{root}/benchmark.parquet")


_SCAN = """SELECT 'documents' AS source, 'train' AS split, doc_id AS row_id, text FROM documents
 UNION ALL SELECT 'benchmark', 'test', item_id, text FROM benchmark"""


@register("scan_multi_source", _SCAN)
def scan_multi_source(spark: SparkSession, folder: str) -> DataFrame:
    """Two sources with their splits, kept columns and row ids."""
    frames = [read_source(spark, s, ("text",)) for s in (_documents(folder), _benchmark(folder))]
    return mix.concatenate(frames)


@register(
    "mixed_dataset",
    f"""WITH scan AS ({_SCAN}), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_id) AS rn,
 count(*) OVER (PARTITION BY source) AS n FROM scan)
 SELECT source, split, row_id, length(text) AS n_text FROM ranked WHERE split = 'test' OR rn <= floor(0.3e0 * n)""",
)
def mixed_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A mix: a fraction of the training source, all of the test source, in seeded order."""
    cfg = MixConfig((_documents(folder, 0.3), _benchmark(folder)), columns_to_keep=("text",), seed=SEED)
    rows = load_mix(spark, cfg)
    return rows.select("source", "split", "row_id", F.length("text").cast("bigint").alias("n_text"))


@register(
    "split_routing",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def split_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Split names are searched for ``train`` first, so ``latest_train`` is a training split."""
    raw = F.element_at(
        F.array(*[F.lit(s) for s in ("train", "train_sft", "latest_train", "test_sft")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return table(spark, folder, "documents").select("doc_id", mix.route_split(raw).alias("split"))


@register("keep_columns", "SELECT doc_id, lang, source FROM documents")
def keep_columns(spark: SparkSession, folder: str) -> DataFrame:
    return mix.keep_columns(table(spark, folder, "documents"), ["source", "doc_id", "lang", "no_such_column"])


@register(
    "map_and_drop_inputs",
    f"""SELECT doc_id, 'Translate: ' || text AS prompt, CASE WHEN regexp_matches(text, '^{SP}*<answer>')
 AND regexp_matches(text, '</answer>{SP}*$') THEN text ELSE '<answer>' || text || '</answer>.' END AS solution FROM documents""",
)
def map_and_drop_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Only what the formatter emits remains."""
    text = F.col("text")
    return mix.map_rows(
        table(spark, folder, "documents"),
        doc_id=F.col("doc_id"),
        prompt=F.concat(F.lit("Translate: "), text),
        solution=wrap_solution(text),
    )


@register(
    "fraction_head",
    f"""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
 count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= floor({_FRACTION_SQL} * n)""",
)
def fraction_head(spark: SparkSession, folder: str) -> DataFrame:
    """First share of every source in id order."""
    rows = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return mix.fraction_head(rows, "source", "doc_id", FRACTIONS, id_bits=48)


_HALVES = "CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END"


@register(
    "debug_head",
    f"""SELECT doc_id, split FROM (SELECT doc_id, {_HALVES} AS split,
 row_number() OVER (PARTITION BY {_HALVES} ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 100""",
)
def debug_head(spark: SparkSession, folder: str) -> DataFrame:
    """First hundred rows of each split."""
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    return mix.debug_head(table(spark, folder, "documents").select("doc_id", split.alias("split")), "doc_id")


@register(
    "seeded_shuffle",
    """SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || source || ':' || CAST(doc_id AS VARCHAR))) - 1 AS position
 FROM documents""",
)
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Position of every row in the seeded order."""
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return mix.shuffle_positions(rows, SEED, "source", "doc_id")


@register(
    "random_subset",
    """SELECT event_id, event_type, round(value, 6) + 0.0 AS value FROM (SELECT *,
 row_number() OVER (ORDER BY md5('42:' || CAST(event_id AS VARCHAR))) AS rn FROM events) WHERE rn <= 2500""",
)
def random_subset(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        "event_id", "event_type", (F.round("value", 6) + F.lit(0.0)).alias("value")
    )
    return mix.random_subset(rows, SEED, 2500, "event_id")


@register(
    "train_test_split",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)))
 <= ceil(0.1e0 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the rows, rounded up, becomes the test split."""
    return mix.split_train_test(table(spark, folder, "orders").select("o_orderkey"), 7, 0.1, "o_orderkey")


@register(
    "preview_rows",
    "SELECT doc_id, source FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) LIMIT 2",
)
def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    return mix.preview(table(spark, folder, "documents").select("doc_id", "source"), SEED, "doc_id")


@register(
    "missing_images",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE p.html IS NULL) AS missing_images
 FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""",
)
def missing_images(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a multimodal table without an image; pages stand in for image bytes."""
    images = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("image"))
    return mix.missing_images(table(spark, folder, "documents").select("doc_id").join(images, "doc_id", "left"))


@register(
    "concatenate_subsets",
    """SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark
 UNION ALL SELECT conv_id * 1000 + turn, text, 'conversations' FROM conversations""",
)
def concatenate_subsets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    items = table(spark, folder, "benchmark").select("text", F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    turns = table(spark, folder, "conversations").select(
        F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return mix.concatenate([docs, items, turns])


_GRAMS = """SELECT DISTINCT {id} AS id, md5(g) AS gram FROM (SELECT {id}, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - 6),
 lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7])) AS g
 FROM (SELECT {id}, list_filter(string_split(regexp_replace(lower(text), '{sp}+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {table})
 WHERE len(w) >= 8)"""
_LEAKED = (
    f"WITH held AS ({_GRAMS.format(id='item_id', table='benchmark', sp=SP)}), "
    f"mine AS ({_GRAMS.format(id='doc_id', table='documents', sp=SP)}), "
    "leaked AS (SELECT DISTINCT id AS doc_id FROM mine WHERE gram IN (SELECT gram FROM held))"
)


@register("leak_check", f"{_LEAKED} SELECT doc_id FROM leaked")
def leak_check(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows that share eight words in a row with a held-out item."""
    return leak.leaked_ids(text_table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "text")


@register("leak_check_filtered", f"{_LEAKED} SELECT doc_id FROM leaked")
def leak_check_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by way of the filter that takes the place of the held-out grams when these are many."""
    return leak.leaked_ids(text_table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "text", near=0)


@register(
    "leak_free_rows",
    f"{_LEAKED} SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaked)",
)
def leak_free_rows(spark: SparkSession, folder: str) -> DataFrame:
    clean = leak.clean_rows(text_table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "text")
    return clean.select("doc_id", "source", "lang")


@register(
    "row_counts_per_split",
    f"SELECT {_HALVES} || '_samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY 1",
)
def row_counts_per_split(spark: SparkSession, folder: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    return metrics.row_counts(table(spark, folder, "documents").select(split.alias("split")))


@register(
    "prepared_tasks",
    """WITH kept AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents),
 mixed AS (SELECT 'documents' AS source, doc_id AS row_id, lang, source AS topic FROM kept WHERE rn <= floor(0.5e0 * n)
  UNION ALL SELECT 'pages', page_id, 'html', url FROM pages),
 ordered AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || source || ':' || CAST(row_id AS VARCHAR))) AS rk, count(*) OVER () AS n FROM mixed)
 SELECT source, row_id, CASE WHEN rk <= ceil(0.1e0 * n) THEN 'test' ELSE 'train' END AS split, 'user' AS role,
 'Name the topic of ' || lang || ': ' || topic AS content FROM ordered""",
)
def prepared_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation: two sources by fraction, a test split, a formatter of the caller."""

    def formatter(df: DataFrame) -> DataFrame:
        asked = F.concat(F.lit("Name the topic of "), "lang", F.lit(": "), "topic")
        return mix.map_rows(
            df, source=F.col("source"), row_id=F.col("row_id"), split=F.col("split"), messages=messages_of(message("user", asked))
        )

    docs = table(spark, folder, "documents").select("doc_id", "lang", F.col("source").alias("topic"))
    pages = table(spark, folder, "pages").select("page_id", F.lit("html").alias("lang"), F.col("url").alias("topic"))
    root = fresh_path(spark, "mix")
    docs.write.parquet(f"{root}/documents/train")
    pages.write.parquet(f"{root}/pages/train")
    sources = (
        TaskSource("documents", f"{root}/documents", 0.5, "doc_id", ("train",)),
        TaskSource("pages", f"{root}/pages", 1.0, "page_id", ("train",)),
    )
    cfg = MixConfig(sources, columns_to_keep=("lang", "topic"), seed=SEED)
    rows = prepare_tasks(spark, cfg, formatter, test_size=0.1)
    first = F.get("messages", F.lit(0))
    return rows.select("source", "row_id", "split", first["role"].alias("role"), first["content"].alias("content"))


@register(
    "mixer_checks",
    """SELECT mix_id, count(source) AS sources, CASE WHEN count(source) = 0 THEN 'no source'
  WHEN count(DISTINCT source) < count(source) THEN 'a source twice'
  WHEN count(*) FILTER (source IS NOT NULL AND (fraction IS NULL OR fraction < 0 OR fraction > 1)) > 0 THEN 'a fraction outside [0, 1]'
  WHEN count(config) FILTER (source IS NOT NULL) > 0 AND count(config) FILTER (source IS NOT NULL) < count(source) THEN 'configs for some sources only' END AS problem
 FROM (SELECT o_custkey AS mix_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS source, (o_orderkey % 43) / 40e0 AS fraction,
  CASE WHEN o_custkey % 3 = 0 OR o_orderstatus = 'F' THEN 'default' END AS config FROM orders) proposed GROUP BY mix_id""",
)
def mixer_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's orders as a proposed mix: what the mixer would refuse, and what it accepts."""
    proposed = table(spark, folder, "orders").selectExpr(
        "o_custkey AS mix_id",
        "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS source",
        "CAST(o_orderkey % 43 AS DOUBLE) / 40 AS fraction",
        "CASE WHEN o_custkey % 3 = 0 OR o_orderstatus = 'F' THEN 'default' END AS config",
    )
    return checks.mix_problems(proposed, config="config")


@register(
    "weight_count_checks",
    """SELECT l_orderkey AS plan_id, CASE WHEN weights <> 0 AND weights <> rewards THEN weights || ' weights for ' || rewards || ' rewards' END AS problem
 FROM (SELECT l_orderkey, count(*) AS rewards, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE max(l_linenumber) + l_orderkey % 2 END AS weights
  FROM lineitem GROUP BY l_orderkey) planned""",
)
def weight_count_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a plan with a reward per line: the plans whose number of weights does not fit."""
    planned = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rewards"), F.max("l_linenumber").alias("top"))
    weights = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("top") + F.col("l_orderkey") % 2)
    return planned.select(F.col("l_orderkey").alias("plan_id"), checks.weight_problem(F.col("rewards"), weights).alias("problem"))
