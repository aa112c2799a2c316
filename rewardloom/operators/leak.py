"""Held-out check: training rows that share a long run of words with a held-out item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom import session
from rewardloom.functions.text import let, word_grams, words
from rewardloom.session import near_rows, stage

GRAM_WORDS = 8


#: A filter's words of 64 bits per gram, and at most so many words in all: 128 MB. More grams raise the share of training
#: grams that are looked up further, never the size.
BITS_PER_GRAM = 24
MOST_WORDS = 1 << 24
PROBES = 6
_CHUNK = 1024  # words of a filter in one row


def grams(text: Column, size: int = GRAM_WORDS, hashed: bool = False) -> Column:
    """All runs of ``size`` lower-case words, or their 64-bit hashes, for which every word is hashed once."""

    def runs(w: Column) -> Column:
        if not hashed:
            return F.when(F.size(w) >= size, word_grams(w, size)).otherwise(F.array().cast("array<string>"))
        return let(F.transform(w, lambda x: F.xxhash64(x)), hashes)

    def hashes(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - F.lit(size))
        every = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + F.lit(j)) for j in range(size)]))
        return F.when(F.size(h) >= size, every).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.lower(text)), runs)


def _probe(gram: Column) -> Column:
    """The bits of a gram inside its word of the filter."""
    mixed = F.xxhash64(gram, F.lit("probe"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(mixed, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(PROBES)]
    return reduce(Column.bitwiseOR, bits)


def filter_words(count: int, most: int = MOST_WORDS) -> int:
    """Words of 64 bits for ``count`` grams: a power of two, at least one row of them."""
    wanted = max(_CHUNK, count * BITS_PER_GRAM // 64)
    return min(most, 1 << (wanted - 1).bit_length())


def gram_filter(known: DataFrame, count: int, most: int = MOST_WORDS) -> tuple[DataFrame, int]:
    """A blocked Bloom filter over ``known(gram)``: (chunk, bits), ``_CHUNK`` words a row, and the number of words.

    A gram sets ``PROBES`` bits of one word. Tasks combine the words they have by OR before these are shuffled; words
    that no gram has are zero, so that a place in a row is a place in the filter.
    """
    n = filter_words(count, most)
    own = known.select(F.pmod("gram", F.lit(n)).alias("word"), _probe(F.col("gram")).alias("bits"))
    zero = known.sparkSession.range(n).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    merged = own.unionAll(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = merged.groupBy(F.shiftright("word", 10).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    return stage(rows.select("chunk", F.transform("bits", lambda w: w["bits"]).alias("bits")), "gram-filter"), n


def maybe_known(hashes: DataFrame, known: DataFrame, count: int, most: int = MOST_WORDS) -> DataFrame:
    """The rows of ``hashes(.., gram)`` whose gram passes the filter; it is sent to them, so no other gram moves."""
    rows, n = gram_filter(known, count, most)
    word = F.pmod("gram", F.lit(n))
    placed = hashes.withColumns({"chunk": F.shiftright(word, 10), "_place": word.bitwiseAND(F.lit(_CHUNK - 1)).cast("int"), "_probe": _probe(F.col("gram"))})
    found = placed.join(F.broadcast(rows), "chunk")
    return found.where(F.get("bits", F.col("_place")).bitwiseAND(F.col("_probe")) == F.col("_probe")).select(*hashes.columns)


def leaked_ids(
    train: DataFrame, held_out: DataFrame, row_id: str, text: str, size: int = GRAM_WORDS, near: int | None = None
) -> DataFrame:
    """Distinct ids of training rows sharing a gram with a held-out text.

    First pass: hashes of the training grams are looked up where they are made. The distinct held-out hashes are counted;
    up to two million (``near``) are broadcast. Of more a Bloom filter of at most 128 MB is broadcast, and only the grams that pass
    it, about one in some thousands besides the held-out ones, meet the held-out hashes in a semi join, whose hot partitions adaptive
    execution may split. Second pass: the few rows found are checked on the words themselves, so neither the filter nor
    a hash collision can mark a row.
    """
    known = stage(
        held_out.select(F.explode(grams(F.col(text), size, hashed=True)).alias("gram")).distinct(), "held-out-grams"
    )
    count = known.count()
    hashes = train.select(row_id, F.explode(F.array_distinct(grams(F.col(text), size, hashed=True))).alias("gram"))
    if count <= (session.NEAR_ROWS if near is None else near):
        known = F.broadcast(known)
    else:
        hashes = maybe_known(hashes, known, count)
    suspects = stage(hashes.join(known, "gram", "left_semi").select(row_id).distinct(), "leak-suspects")
    exact = held_out.select(F.explode(grams(F.col(text), size)).alias("gram")).distinct()
    runs = train.join(near_rows(suspects), row_id, "left_semi").select(row_id, F.explode(grams(F.col(text), size)).alias("gram"))
    return runs.join(exact, "gram", "left_semi").select(row_id).distinct()


def clean_rows(train: DataFrame, held_out: DataFrame, row_id: str, text: str, size: int = GRAM_WORDS) -> DataFrame:
    """Training rows that share no gram; up to two million leaked ids go to the texts, more meet them in a shuffle."""
    leaked = stage(leaked_ids(train, held_out, row_id, text, size), "leaked")
    return train.join(near_rows(leaked), row_id, "left_anti")
