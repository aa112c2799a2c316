"""Near-duplicates by SimHash: multi-index hashing over segments, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import key_text, packed, whole_text
from rewardloom.llm.components import components
from rewardloom.session import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Per segment, the flips that are tried. Two fingerprints that differ in at most 4 bits cannot differ in 2 or more bits
#: of the first, 2 or more of the second and 1 or more of the third segment, as that makes 5.
BALLS = (1, 1, 0)
CROWDED = 4096  # fingerprints under one key beyond which the key is refined
_ROW = "bucket long, free long, fingerprint long, probe boolean"


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in over half the XXH64 values of the word shingles. No words: zero."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone, split() the six white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text as a long."""

    def batch(texts):
        import pandas as pd

        return pd.Series([simhash(t) for t in texts], dtype="uint64").astype("int64")

    return F.pandas_udf(batch, "long")(text)


def _segments(free: int) -> list[list[int]]:
    """The free bit places in three runs of nearly equal length."""
    places = [b for b in range(64) if free >> b & 1]
    cuts = [0, -(-len(places) // 3), -(-2 * len(places) // 3), len(places)]
    return [places[a:b] for a, b in zip(cuts, cuts[1:])]


def _mixed(bucket: np.ndarray, segment: int, key: np.ndarray) -> np.ndarray:
    """A bucket number from the one before, the segment and its bits. Buckets that meet by chance only cost comparisons."""
    with np.errstate(over="ignore"):
        x = bucket * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(segment + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def segment_rows(rows: DataFrame) -> DataFrame:
    """One level of the index: each row of ``rows(bucket, free, fingerprint, probe)`` under the keys of three segments.

    A row of the table side goes under its own bits of each segment, a probe under every key of the segment's ball.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, free, fingerprint, probe = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            bucket, fingerprint = bucket.view(np.uint64), fingerprint.view(np.uint64)
            for mask in np.unique(free).tolist():
                segments = _segments(mask & (1 << 64) - 1)
                for side in (False, True):
                    mine = (free == mask) & (probe == side)
                    b, f = bucket[mine], fingerprint[mine]
                    for number, (places, radius) in enumerate(zip(segments, BALLS)):
                        own = np.uint64(sum(1 << p for p in places))
                        left = np.int64(np.uint64(mask & (1 << 64) - 1) & ~own)
                        flips = [c for r in range((radius if side else 0) + 1) for c in combinations(places, r)]
                        for flip in flips:
                            key = (f ^ np.uint64(sum(1 << p for p in flip))) & own
                            columns = [_mixed(b, number, key).view(np.int64), np.full(len(b), left), f.view(np.int64), np.full(len(b), side)]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "free", "fingerprint", "probe"])

    return rows.mapInArrow(expand, _ROW)


def _forest(members: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs (member, probe) within ``distance``, compared in blocks."""
    nodes, at = np.unique(np.concatenate([members, probes]), return_inverse=True)
    own, others = at[: len(members)], at[len(members) :]
    label, links = np.arange(len(nodes)), []
    step = max(1, (1 << 20) // len(members))
    for begin in range(0, len(probes), step):
        near = np.bitwise_count(members[:, None] ^ probes[None, begin : begin + step]) <= distance
        for i in np.flatnonzero(near.any(1)).tolist():
            met = others[begin : begin + step][near[i]]
            new, first = np.unique(label[met], return_index=True)
            apart = new != label[own[i]]
            if apart.any():
                links += [(int(members[i]), int(nodes[met[k]])) for k in first[apart].tolist()]
                label[np.isin(label, new[apart])] = label[own[i]]
    return links


def bucket_links(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) per bucket: links that connect what the pairs of table row and probe within ``distance`` connect.

    Rows of a bucket are read as a stream, table rows first; there are at most a few thousand of these. A link is left
    out only where others of the same bucket already connect its ends, so buckets give no more links than rows.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, members, out = None, [], []
        for batch in batches:
            b, f, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.diff(b)) + 1
            for at, end in zip([0, *edges], [*edges, len(b)]):
                if at == end:
                    continue
                if b[at] != bucket:
                    bucket, members = b[at], []
                first = int(at + np.searchsorted(p[at:end], True))
                if first > at:
                    members.append(f[at:first].view(np.uint64))
                if members and end > first:
                    held = np.concatenate(members) if len(members) > 1 else members[0]
                    probes = f[first:end].view(np.uint64)
                    if len(held) > 1 or len(probes) > 1 or held[0] != probes[0]:
                        out += _forest(held, probes, distance)
            if len(out) > 1 << 16:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    rows = rows.select("bucket", "fingerprint", "probe").repartition("bucket").sortWithinPartitions("bucket", "probe")
    return rows.mapInArrow(link, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])


def fingerprint_links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links between ``distinct(fingerprint)``, no fingerprint twice, that connect all pairs within ``DISTANCE`` bits.

    Multi-index hashing: pairs meet under a segment's key or its ball, and whole distances decide. A key with more than
    ``crowded`` fingerprints, and every key whose ball reaches it, is refined: its rows go under three segments of the
    bits that are still free, again with balls (1, 1, 0), since the distance over the free bits is at most 4 as well. A
    refined key holds rows that agree in ever more bits, so crowds end, at the latest when no bits are left.
    """
    base = distinct.select(F.lit(0).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("free"), "fingerprint")
    base = base.withColumn("probe", F.explode(F.array(F.lit(False), F.lit(True))))
    links = None
    while True:
        rows, table = segment_rows(base), segment_rows(base.where(~F.col("probe")))
        sizes = table.where(F.bit_count("free") > 8).groupBy("bucket").count()
        full = stage(sizes.where(F.col("count") > crowded).select("bucket"), "crowded")
        if full.isEmpty():
            found = bucket_links(rows)
            return stage(found if links is None else links.unionByName(found), "simhash-links")
        rows = stage(rows, "simhash-rows")
        reached = rows.where("probe").join(full, "bucket").select("fingerprint", "free").distinct()
        reached = rows.where(~F.col("probe")).join(reached, ["fingerprint", "free"]).select("bucket")
        hot = stage(full.unionByName(reached).distinct(), "hot-buckets")
        found = stage(bucket_links(rows.join(hot, "bucket", "left_anti")), "simhash-links")
        links = found if links is None else links.unionByName(found)
        base = stage(rows.join(hot, "bucket", "left_semi").distinct(), "simhash-rows")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Rows are first brought together by equal fingerprint, with partial minima, so copies cost one row per task and are
    never paired. Only distinct fingerprints are indexed and linked. component_id is the smallest doc_id reachable.

    Null or wordless text: fingerprint zero, linked like any other. Null id: ignored as a component id where a
    component has other ids. Repeated rows: same values. Empty table: empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(whole_text()).alias("fingerprint"))
    rows = stage(rows, "simhash")
    text = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return rows.join(named_components(rows), "fingerprint").select("doc_id", text, "component_id")


def named_components(rows: DataFrame) -> DataFrame:
    """(fingerprint, first, root, component_id) of each distinct fingerprint of ``rows(doc_id, fingerprint)``.

    ``first`` is the smallest id with that fingerprint, ``root`` names the component among fingerprints.
    """
    firsts = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = stage(components(fingerprint_links(firsts.select("fingerprint"))), "simhash-roots")
    nodes = firsts.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    nodes = nodes.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = stage(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    return stage(nodes.join(least, "root"), "simhash-components")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, the one whose id names it, columns unchanged; cases as for ``near_duplicates``."""
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("doc_id"), fingerprints(whole_text()).alias("fingerprint"))
    named = named_components(stage(rows.select("doc_id", "fingerprint"), "simhash"))
    chosen = named.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("fingerprint").alias("fingerprint"))
    chosen = stage(chosen.select(key_text("component_id").alias("_key"), "fingerprint"), "simhash-kept")
    rows = rows.withColumn("_key", key_text("doc_id")).join(chosen, ["_key", "fingerprint"], "left_semi")
    same = Window.partitionBy("_key", "fingerprint").orderBy(F.xxhash64("_row.text"))  # an id normally stands once
    return rows.withColumn("_place", F.row_number().over(same)).where("_place = 1").select("_row.*")
