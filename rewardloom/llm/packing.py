"""Packing documents into sequences: dominance reduction, then best fit, over the counts of each length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import arrow_batch, id_salt, whole_text, with_group_rank
from rewardloom.llm.encoder import kept_encoder, vocabulary_path
from rewardloom.session import stage

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it) in one sequence


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int | None = None) -> DataFrame:
    """One row per piece of a document; only documents over ``capacity`` tokens have more than one."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = kept_encoder(path, spaces=False, remembered=remembered), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"))):
                ids = coded.tobytes() + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield arrow_batch(rows, _PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(pieces, _PIECES)


def _dominating(j: int, counts: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """Items that may join one item of length ``j`` for good, () for none, or None where nothing is proven.

    With R left beside j, i the longest other item that fits, and every other choice taken to be a set S of items with
    sum(S) <= R: (1) nothing fits: j alone. (2) i = R: the one item i replaces any S. (3) no two others fit together:
    S is one item, and i is the longest. (4) no three fit: let b be the longest item beside i. S = {x >= y} has
    x <= i, and y <= R // 2; if b is at least the longest item up to R // 2, then {i, b} covers x and y in turn. If no
    item fits beside i, {i} still covers S when i is at least the largest sum of two that fit. Replacing S by such a
    set and moving its items to where the replacements lay never needs another sequence, so the choice is optimal.
    """
    room = capacity - j
    counts[j] -= 1
    try:
        fits = np.flatnonzero(counts[: room + 1])
        if not len(fits):
            return ()
        i = int(fits[-1])
        if i == room:
            return (i,)
        low = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
        if len(low) < 2 or low[0] + low[1] > room:
            return (i,)
        if len(low) == 3 and low.sum() <= room:
            return None
        counts[i] -= 1
        beside = np.flatnonzero(counts[: room - i + 1])
        b = int(beside[-1]) if len(beside) else 0
        counts[i] += 1
        half = fits[fits <= room // 2]
        if b and (not len(half) or b >= half[-1]):
            return (i, b)
        if not b:
            at = np.searchsorted(fits, room - fits, side="right") - 1
            sums = [int(x + fits[k]) for x, k in zip(fits, at) if k >= 0 and (fits[k] != x or counts[x] > 1)]
            if i >= max(sums, default=0):
                return (i,)
        return None
    finally:
        counts[j] += 1


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, Pattern]], np.ndarray]:
    """Sequences fixed for good, as (how many, pattern), and the counts that remain."""
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j]:
                others = _dominating(j, counts, capacity)
                if others is None:
                    break
                items = [j, *others]
                need = {x: items.count(x) for x in items}
                # The proof holds for as long as all of these are there: without some of the others, i and b stay the
                # longest that fit, and no three others begin to fit. So the pattern is taken as often as it can be.
                times = min(int(counts[x]) // n for x, n in need.items())
                for x, n in need.items():
                    counts[x] -= n * times
                fixed.append((times, tuple(need.items())))
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit in descending length. Sequences with the same content are one group, so equal lengths go in one step."""
    groups: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, pattern: Pattern) -> None:
        if times:
            if not groups.setdefault(room, []):
                insort(rooms, room)
            groups[room].append((times, pattern))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, pattern = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, pattern = capacity, ()
                times = -(-left // (capacity // length))
            each = room // length
            full, rest = min(times, left // each), 0
            if full < times:
                rest = left - full * each
            put(room - each * length, full, (*pattern, (length, each)))
            if rest:
                put(room - rest * length, 1, (*pattern, (length, rest)))
            put(room, times - full - bool(rest), pattern)
            left -= full * each + rest
    return [group for found in groups.values() for group in found]


def plan(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Where the k-th piece of each length goes: rows (key, each, sequence, offset) in order of key.

    ``key`` is length * 2**48 + the first rank of the row; a row's ranks fill its sequences ``each`` at a time. The
    plan depends on the counts of at most ``capacity`` lengths, never on the number of documents: every length opens,
    fills or splits groups of equal sequences, a bounded number of times.
    """
    fixed, rest = reduce_by_dominance(counts, capacity)
    taken = np.zeros(capacity + 1, np.int64)
    sequence, rows = 0, []
    for times, pattern in fixed + best_fit(rest, capacity):
        offset = 0
        for length, each in pattern:
            rows.append(((length << 48) + int(taken[length]), each, sequence, offset))
            taken[length] += times * each
            offset += length * each
        sequence += times
    assert (taken == counts).all()
    return pd.DataFrame(rows, columns=["key", "each", "sequence", "offset"]).astype("int64").sort_values("key", ignore_index=True)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Texts are encoded where they lie and never shuffled. Pieces (a few numbers each) are counted by length on the map
    side; the counts of at most ``capacity`` lengths go to the driver, which plans. Each piece takes the place of its
    rank among the pieces of its length. Ranks are taken in fixed sub-buckets, so a length that a third of the pieces
    share is not one task. ``remembered``: bytes of chunks that a worker keeps, as in ``encoder``.

    Null text: one piece that holds the end id. Null ids: allowed. Repeated rows: a piece each. Empty table: empty
    result. Other columns are ignored.
    """
    pieces = stage(tokenised_pieces(docs, path or vocabulary_path(VOCABULARY), capacity, end_id, remembered), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    places = plan(counts, capacity)
    key, each, sequence, offset = (places[c].to_numpy() for c in places.columns)
    ranked = with_group_rank(
        pieces.withColumn("_salt", id_salt("doc_id")), ["length"], None, "_salt", [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], "_rank"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            mine = (length << 48) + batch.column("_rank").to_numpy()
            at = np.searchsorted(key, mine, side="right") - 1
            k = mine - key[at]
            found = [pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + (k % each[at]) * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [c.split()[0] for c in _PACKED.split(", ")])

    return ranked.drop("_salt").select(*[c.split()[0] for c in _PIECES.split(", ")], "_rank").mapInArrow(place, _PACKED)
