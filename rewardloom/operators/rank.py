"""Exact global order at scale: shuffles, heads and splits without a single-task window.

Rows are ordered by a hexadecimal key. ``hash_key`` gives a seeded pseudo-random order that does not depend on
partitioning, ``id_key`` keeps the order of integer ids. Key columns must identify a row.

* ``with_rank`` numbers every row: rows are counted per key prefix, the small table of offsets is summed, and
  ``row_number`` runs inside a prefix only.
* ``keep_first`` keeps the first k rows without sorting or moving the table: a mergeable sketch of the keys bounds the
  cut in one pass, a second one counts below the bounds and looks at the keys inside them, then the table is filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.session import near_rows, stage

HEX_PER_LEVEL = 4  # 65,536 prefixes bound the offset table
ID_DIGITS = 16
ID_STEP = 5  # digits of an id per pass; 1,048,576 counts per part at most
FEW_ROWS = 1 << 20  # rows of one part that one task may number
GRID = 2048  # quantiles that a sketch is asked for
ACCURACY = 10 * GRID  # a sketch's ranks are off by one part in so many, a tenth of the grid's step


def hash_key(seed: int, *columns: Column | str) -> Column:
    """Seeded order of rows, equal on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in columns]))


def id_key(column: Column | str, bits: int = 64) -> Column:
    """Hexadecimal digits in the order of an integer id.

    With fewer than 64 bits ids must be non-negative and fit, else the job fails.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("bigint")
    if bits == 64:
        return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    if bits % 16 or not 0 < bits < 64:
        raise ValueError("bits must be 16, 32, 48 or 64")
    outside = F.raise_error(F.lit(f"an id does not fit into {bits} bits"))
    return F.when((value < 0) | (value >= 2**bits), outside).otherwise(F.lpad(F.hex(value), bits // 4, "0"))


def with_rank(df: DataFrame, key: Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """Zero-based position of every row in key order, and the number of rows under the name ``total``.

    For keys of ``hash_key``, whose first digits spread; ids in order would meet under few prefixes.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, HEX_PER_LEVEL))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,536 rows: one task may sum them, and broadcasting them is safe whatever the table holds.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy()).alias("_rows")
    )
    inside = Window.partitionBy("_bucket").orderBy("_key")
    ranked = (
        keyed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("bigint"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_rows"))
    return ranked.drop("_key", "_bucket", "_row", "_offset", "_rows")


def _part(key: Column, by: Column | None) -> Column:
    """The part of a row; without parts the empty prefix of its key, which all rows share."""
    return F.substring(key, 1, 0) if by is None else by.cast("string")


def _inside(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Keys below the prefix reached so far. The state has one row per part, and parts are named in a configuration."""
    return keys.join(near_rows(state), "_by").where(F.col("_key").startswith(F.col("_prefix")))


def _number(key: Column, hashed: bool) -> Column:
    """A double that never falls while the key rises: the first 52 bits of a hash, or the key's digits as they are."""
    digits = F.conv(F.substring(key, 1, 13 if hashed else 16), 16, 10)
    return digits.cast("decimal(20,0)").cast("double")


def _cut_by_sketch(keys: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Cut keys in two passes: ``_by, _cut`` per part, and the parts that have none though k > 0.

    The first pass counts the rows of every part and sketches their keys; the sketches of all tasks merge, a few
    thousand numbers per part. The k-th key lies between the quantiles around k / rows. While so many rows lie there
    that one task should not number them, those are sketched again. The last pass counts, per part, the rows below the
    lower bound as one number and those inside the bounds by key, so a sketch that broke its promise shows: its part has
    no cut.
    """
    points = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def bounded(parts: DataFrame, k: Column) -> DataFrame:
        """The bounds of the next pass from a part's rows below, rows inside and grid."""
        place = F.floor((k - F.col("_below") - 1) / F.greatest(F.col("_inside"), F.lit(1)) * GRID).cast("int")
        at = lambda i: F.get("_grid", i)
        low = F.when(place >= 1, at(place - 1))
        high = F.when(place + 2 <= GRID, at(place + 2))
        return parts.select("_by", k.cast("bigint").alias("_k"), low.alias("_low"), high.alias("_high"), F.ceil(F.col("_inside") * 3 / GRID).alias("_n"))

    sketch = F.percentile_approx("_num", points, F.lit(ACCURACY)).alias("_grid")
    first = keys.groupBy("_by").agg(F.count(F.lit(1)).alias("_rows"), sketch)
    first = first.withColumns({"_inside": F.col("_rows"), "_below": F.lit(0).cast("bigint")})
    state = stage(bounded(first, wanted).where("_k > 0 AND _by IS NOT NULL"), "cut-bounds")
    before = None
    while True:
        most = state.agg(F.max("_n")).first()[0]
        if most is None or most <= FEW_ROWS or most == before:
            break
        before = most
        within = F.coalesce(F.col("_num") >= F.col("_low"), F.lit(True)) & F.coalesce(F.col("_num") <= F.col("_high"), F.lit(True))
        again = _reached(keys, state).groupBy("_by", "_k").agg(
            F.count_if(F.col("_num") < F.col("_low")).alias("_below"),
            F.count_if(within).alias("_inside"),
            F.percentile_approx(F.when(within, F.col("_num")), points, F.lit(ACCURACY)).alias("_grid"),
        )
        state = stage(bounded(again, F.col("_k")), "cut-bounds")
    # Keys inside the bounds, and for all rows below them one group, whose key is null and comes first.
    key = F.when(F.coalesce(F.col("_num") >= F.col("_low"), F.lit(True)), F.col("_key"))
    counts = _reached(keys, state).groupBy("_by", "_k", key.alias("_inner")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_by").orderBy("_inner").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto)
    hit = counts.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")) & F.col("_inner").isNotNull())
    cuts = stage(hit.select("_by", F.col("_inner").alias("_cut")), "cuts")
    return cuts, state.select("_by").join(cuts, "_by", "left_anti")


def _reached(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Keys up to the upper bound of their part."""
    joined = keys.join(near_rows(state), "_by")
    return joined.where(F.coalesce(F.col("_num") <= F.col("_high"), F.lit(True)))


def _cut_by_digits(keys: DataFrame, wanted: Column, digits: int) -> DataFrame:
    """Cut keys digit run by digit run, for parts whose sketch did not hold; three passes over the ids as a rule.

    The first counts the rows of every part and finds its smallest and largest id, whose common leading digits need no
    pass. Each further pass counts by the next ``ID_STEP`` digits; once the digit run that holds the k-th id has few
    rows, these are numbered instead. So dense ids that span up to 40 bits and ids spread over any width take three passes.
    What is written in between is one row per part.
    """
    low, high = F.min("_key").alias("_low"), F.max("_key").alias("_high")
    bounds = stage(keys.groupBy("_by").agg(F.count(F.lit(1)).alias("_rows"), low, high), "id-bounds")
    shared = F.filter(F.sequence(F.lit(1), F.lit(digits)), lambda i: F.substr("_low", F.lit(1), i) == F.substr("_high", F.lit(1), i))
    prefix = F.substr("_low", F.lit(1), F.coalesce(F.array_max(shared), F.lit(0)))
    state = bounds.select("_by", prefix.alias("_prefix"), wanted.cast("bigint").alias("_k"), F.col("_rows").alias("_n")).where("_k > 0")
    while True:
        most, depth = state.agg(F.max("_n"), F.min(F.length("_prefix"))).first()
        if most is None or depth >= digits:
            return state.select("_by", F.col("_prefix").alias("_cut"))
        if most <= FEW_ROWS:
            place = Window.partitionBy("_by").orderBy("_key")
            numbered = _inside(keys, state).withColumn("_row", F.row_number().over(place))
            return numbered.where(F.col("_row") == F.col("_k")).select("_by", F.col("_key").alias("_cut"))
        digit = F.substr("_key", F.length("_prefix") + 1, F.lit(ID_STEP)).alias("_digit")
        counts = _inside(keys, state).groupBy("_by", "_prefix", "_k", digit).agg(F.count(F.lit(1)).alias("_n"))
        state = stage(_hit(counts), "id-cuts")


def _hit(counts: DataFrame) -> DataFrame:
    """The digit run of every part that holds the k-th key. Windows run over counts, a bounded number per part."""
    earlier = Window.partitionBy("_by").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    hit = (F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n"))
    return counts.where(hit).select("_by", F.concat("_prefix", "_digit").alias("_prefix"), (F.col("_k") - F.col("_before")).alias("_k"), "_n")


def cut_keys(
    df: DataFrame,
    key: Column,
    wanted: Column,
    by: Column | None = None,
    hashed: bool = False,
    digits: int = ID_DIGITS,
) -> DataFrame:
    """Key of the k-th row of every part that keeps any: one row ``_by, _cut`` per part.

    ``wanted`` is k as an expression over ``_rows`` (rows of the part) and ``_by``.
    """
    keys = df.select(_part(key, by).alias("_by"), key.alias("_key"), _number(key, hashed).alias("_num"))
    cuts, missing = _cut_by_sketch(keys, wanted)
    if missing.isEmpty():
        return cuts
    rest = keys.join(near_rows(stage(missing, "cut-parts")), "_by", "left_semi").select("_by", "_key")
    return cuts.unionByName(_cut_by_digits(rest, wanted, 32 if hashed else digits))


def flag_first(
    df: DataFrame,
    key: Column,
    wanted: Column,
    by: Column | None = None,
    hashed: bool = False,
    name: str = "is_first",
    digits: int = ID_DIGITS,
) -> DataFrame:
    """Mark the first k rows of every part; the table is neither sorted nor moved."""
    cuts = cut_keys(df, key, wanted, by, hashed, digits)
    marked = df.withColumn("_by", _part(key, by)).join(near_rows(cuts), "_by", "left")
    return marked.withColumn(name, F.coalesce(key <= F.col("_cut"), F.lit(False))).drop("_by", "_cut")


def keep_first(df: DataFrame, key: Column, wanted: Column, **options) -> DataFrame:
    """Keep the first k rows of every part; options as for ``flag_first``."""
    return flag_first(df, key, wanted, name="_first", **options).where("_first").drop("_first")
