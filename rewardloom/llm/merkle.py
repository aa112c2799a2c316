"""Merkle manifest of a table: digests per row, a tree per group, one root, and a proof for every row.

A block is ``SIDE`` ** ``LEVELS`` consecutive nodes of a tree. Its nodes are one hex string of fixed width, so a level is
hashed by cutting the string: run i is the substring of ``SIDE`` digests at i * ``SIDE``, its digest the parent, and the
parents' digests joined are the next level's string. The siblings of a node are the substrings left and right of it in
its run. What a block ends in is a node of the next, ``SIDE`` ** ``LEVELS`` times smaller, round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import key_text
from rewardloom.session import stage

SIDE = 8
LEVELS = 3
WIDTH = 64  # hex digits of a digest
BLOCK = SIDE**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field_text(value: Column) -> Column:
    """'-' for null, else byte count, ':' and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*[field_text(v) for v in values]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def path_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``_idx``, a row's place (from 0) in its group by ``order``, and ``_total``, the size of the group.

    Rows are range-partitioned by group and order; a row's place is its place in its partition and an offset from the
    counts per (group, partition). Equal rows are told apart by ``_tie``, a number of their own, so no run of equal
    rows is one task, and there is no window over a group: only over its partitions. ``group`` must not be null.
    """
    rows = stage(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-rows")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *[F.col(c) for c in order], F.col("_tie")]
    rows = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    rows = stage(rows.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)  # the number of the partition, by the definition of that id
    cells = rows.groupBy(group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    parts = Window.partitionBy(group)
    before = parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    cells = cells.select(group, "_part", base.alias("_base"), F.sum("_n").over(parts).alias("_total"))
    joined = rows.withColumn("_part", part).join(stage(cells, "merkle-offsets"), [group, "_part"])
    return joined.withColumn("_idx", F.col("_at") + F.col("_base")).drop("_tie", "_at", "_part", "_base")


def _parents(level: Column) -> Column:
    run = SIDE * WIDTH
    runs = F.ceil(F.length(level) / run).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(F.substr(level, i * run + 1, F.lit(run))))
    return F.array_join(hashed, "")


def _height(total: Column) -> Column:
    """Levels that are hashed inside a block of a tree of ``total`` nodes."""
    small = reduce(lambda found, k: found.when(total <= SIDE**k, k), range(LEVELS), F.when(F.lit(False), 0))
    return small.otherwise(LEVELS)


def blocks(nodes: DataFrame) -> DataFrame:
    """(_group, _block, _total, _rows, _s0 .. , _top) of ``nodes(_group, _idx, _total, _hash, _row)``, staged.

    ``_rows`` are the payloads in order, ``_s0`` the digests of the nodes, ``_s1`` and on those of the levels above them
    within the block, ``_top`` the digest that the block ends in. At most ``BLOCK`` nodes share a key.
    """
    block = F.floor(F.col("_idx") / BLOCK).alias("_block")
    rows = F.sort_array(F.collect_list(F.struct("_idx", "_hash", "_row"))).alias("_rows")
    found = nodes.groupBy("_group", block, "_total").agg(rows)
    found = found.withColumn("_s0", F.array_join(F.transform("_rows", lambda r: r["_hash"]), ""))
    found = found.withColumn("_rows", F.transform("_rows", lambda r: r["_row"]))
    for k in range(1, LEVELS + 1):
        found = found.withColumn(f"_s{k}", F.when(_height(F.col("_total")) >= k, _parents(F.col(f"_s{k - 1}"))))
    top = F.coalesce(*[F.col(f"_s{k}") for k in range(LEVELS, -1, -1)])
    return stage(found.withColumn("_top", top).drop(f"_s{LEVELS}"), "merkle-blocks")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, of what these end in, and so on, until every tree has one block."""
    found = [blocks(nodes)]
    while True:
        more = found[-1].where(F.col("_total") > BLOCK)
        if more.isEmpty():
            return found
        total = F.ceil(F.col("_total") / BLOCK).alias("_total")
        found.append(blocks(more.select("_group", F.col("_block").alias("_idx"), total, F.col("_top").alias("_hash"), F.lit(None).cast("int").alias("_row"))))


def tops(found: list[DataFrame]) -> DataFrame:
    """(_group, _top): the digest each tree ends in."""
    ends = [b.where(F.col("_total") <= BLOCK).select("_group", "_top") for b in found]
    return reduce(DataFrame.unionAll, ends)


def _siblings(level: Column, i: Column) -> Column:
    """The digests left and right of node ``i`` in its run, as substrings of the level."""
    first = i - i % SIDE
    left = F.substr(level, first * WIDTH + 1, (i - first) * WIDTH)
    right = F.substr(level, (i + 1) * WIDTH + 1, (first + SIDE - i - 1) * WIDTH)
    return F.struct(left.alias("left"), right.alias("right"))


def paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """(_group, _row, _leaf, _path, *more) of every node of the first round: its siblings up to the end of all trees.

    ``above(_group, _above, ...)`` has the steps that follow a tree's own, and columns to carry along. Steps are handed
    down round by round, to blocks, of which there are few; rows are opened last, and nothing wide is shuffled.
    """
    carried = above.columns[1:]
    upper = None
    for k in range(len(found) - 1, -1, -1):
        rows = found[k].where(F.col("_total") <= BLOCK).join(above, "_group")
        if upper is not None:
            rows = rows.unionByName(found[k].where(F.col("_total") > BLOCK).join(upper, ["_group", "_block"]))
        opened = rows.select("_group", *[F.col(c) for c in carried], F.inline(_opened(k == 0)))
        if k:
            path = F.concat("_steps", "_above").alias("_above")
            upper = stage(opened.select("_group", F.col("_at").alias("_block"), path, *carried[1:]), "merkle-paths")
        else:
            opened = opened.withColumn("_path", F.concat("_steps", "_above"))
    return opened.drop("_steps", "_above", "_at")


def _opened(payload: bool) -> Column:
    """The nodes of a block with their siblings inside it."""
    height = _height(F.col("_total"))

    def node(row: Column, i: Column) -> Column:
        at = [F.floor(i / SIDE**k).cast("int") for k in range(LEVELS)]
        steps = F.array(*[_siblings(F.col(f"_s{k}"), at[k]) for k in range(LEVELS)])
        own = [row.alias("_row"), F.substr(F.col("_s0"), i * WIDTH + 1, F.lit(WIDTH)).alias("_leaf")] if payload else []
        place = F.col("_block") * BLOCK + i
        return F.struct(place.alias("_at"), *own, F.slice(steps, F.lit(1), height).alias("_steps"))

    return F.transform("_rows", node)


def manifest(docs: DataFrame, more: Callable[[], list[Column]] = list, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, path (siblings up to the root) of every row, and the columns ``more`` asks for.

    A row's leaf is the digest of ``fields``; a tree per ``lang`` over the leaves in order of doc_id, then a tree over
    the trees in order of lang. Groups of any size are hashed in blocks; the number of groups is not bounded either.

    Null doc_id: first in order; ids that stand more than once follow the order of their leaves. Null lang: a group, the
    first. Null or empty text: '-' or '0:' in the leaf. Empty table: empty result. Other columns are ignored.
    """
    own = F.struct(F.col("doc_id"), *more())
    rows = docs.select(key_text("lang").alias("_group"), F.col("doc_id").alias("_id"), leaf_digest([F.col(f) for f in fields]).alias("_hash"), own.alias("_row"))
    trees = rounds(ranked(rows, "_group", ["_id", "_hash"]).drop("_id"))
    groups = tops(trees)
    # '' stands for null and sorts first; other keys start with '=' and sort as their lang does.
    nodes = groups.select(F.lit("").alias("_group"), F.col("_group").alias("_lang"), F.col("_top").alias("_hash"), F.struct(F.col("_group").alias("lang")).alias("_row"))
    forest = rounds(ranked(nodes, "_group", ["_lang"]).drop("_lang"))
    end = tops(forest).select("_group", F.array().cast(_NO_STEPS).alias("_above"), F.col("_top").alias("root"))
    above = paths(forest, end)
    above = stage(above.select(F.col("_row.lang").alias("_group"), F.col("_path").alias("_above"), F.col("_leaf").alias("subroot"), "root"), "merkle-above")
    found = paths(trees, above)
    return found.select("_row.doc_id", F.col("_leaf").alias("leaf"), "subroot", "root", F.col("_path").alias("path"), *[f"_row.{c}" for c in found.schema["_row"].dataType.names[1:]])


def tampered_leaf() -> list[Column]:
    """Where 3 divides the id's crc32, the leaf of the row with A-Z of its text in lower case; else null."""
    changed = leaf_digest([F.translate(f, UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    return [F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed).alias("tampered")]


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; cases as for ``manifest``. A null id is not tampered with."""
    found = manifest(docs, tampered_leaf)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
_TREE = """
{up}(level, g, i, h, n) AS (
  SELECT 0, g, i, h, count(*) OVER (PARTITION BY g) FROM {nodes}
  UNION ALL
  SELECT level + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM {up} WHERE n > 1 GROUP BY level, g, i // 8
),
{up}_steps AS (
  SELECT a.level, a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {up} a JOIN {up} b ON a.level = b.level AND a.g = b.g AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL
)"""

MANIFEST_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, lang, source, n_chars, text, sha256({_LEAF}) AS leaf,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT] || list_transform(range(8), lambda k: -1::BIGINT)))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295::BIGINT) AS crc
  FROM documents
),
leaves AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h,
    CASE WHEN crc % 3 = 0 THEN sha256({_LEAF.replace("text::", f"translate(text, '{UPPER}', '{LOWER}')::")}) ELSE leaf END AS changed
  FROM base
),
{_TREE.format(up="up", nodes="leaves").strip()},
groups AS (SELECT g AS lang, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM up WHERE n = 1),
{_TREE.format(up="top", nodes="groups").strip()},
folded(doc_id, g, i, k, level, h, proof) AS (
  SELECT doc_id, g, i, i, 0, changed, '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.g, f.i, f.k // 8, f.level + 1, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM folded f JOIN up_steps s ON s.level = f.level AND s.g = f.g AND s.i = f.k
),
grouped AS (SELECT f.* FROM folded f JOIN up u ON u.level = f.level AND u.g = f.g AND u.n = 1),
finished(doc_id, g, i, k, level, h, proof) AS (
  SELECT d.doc_id, d.g, d.i, q.i, 0, d.h, d.proof FROM grouped d JOIN groups q ON q.lang = d.g
  UNION ALL
  SELECT f.doc_id, f.g, f.i, f.k // 8, f.level + 1, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM finished f JOIN top_steps s ON s.level = f.level AND s.i = f.k
),
ends AS (SELECT level, h AS root FROM top WHERE n = 1)
SELECT f.doc_id, l.h AS leaf, u.h AS subroot, e.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = e.root AS verified
FROM finished f JOIN ends e ON e.level = f.level JOIN leaves l ON l.g = f.g AND l.i = f.i JOIN up u ON u.g = f.g AND u.n = 1
"""
