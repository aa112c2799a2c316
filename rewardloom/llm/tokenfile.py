"""Token ids in binary shards, with a minimal perfect hash index from document keys to places in the shards.

Format. A shard is one row of a Parquet table: ``part`` (its number, in order of ids), ``payload`` (raw little-endian
ids, two bytes each when the vocabulary has at most 65,536 ids, else four), ``width`` (those bytes), and per document in
order ``doc_ids``, ``repeats`` (0, 1, ... for rows that share an id) and ``n_tokens``. Shards are bucketed by part, so
reads by part move no payload. The index is a second table: one row per bucket of about ``PER_BUCKET`` keys with the
displacements of its perfect hash and, per slot, the key's fingerprint, shard, first id in the shard, number of ids and
first id in the corpus.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import arrow_batch, scan_tasks, whole_text
from rewardloom.llm.encoder import kept_encoder, vocabulary_path
from rewardloom.session import fresh_path, stage

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
PER_BUCKET = 1024
_SHARD = "part int, width int, payload binary, doc_ids array<bigint>, repeats array<int>, n_tokens array<bigint>"
_INDEX = "bucket long, displacements binary, fingerprints binary, parts binary, firsts binary, counts binary, starts binary"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_PLACE = "doc_id long, part int, first long, n_tokens long, start long"


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts and write them in ascending order of doc_id (null first); the written table.

    Rows are range-partitioned and sorted by id, so one task writes one shard: texts move once, ids never. A shard is
    as large as the session's partitions. The writer's commit makes a repeated task harmless.
    """
    vocabulary = path or vocabulary_path(VOCABULARY)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = kept_encoder(vocabulary, spaces=True)
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        ids, repeats, counts, payload = [], [], [], bytearray()
        for batch in batches:
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"))):
                repeats.append(repeats[-1] + 1 if ids and doc_id == ids[-1] else 0)
                ids.append(doc_id)
                counts.append(len(coded) + 1)
                payload += coded.astype(kind).tobytes() + end
        if ids:
            part = TaskContext.get().partitionId()
            columns = [pa.array([part], pa.int32()), pa.array([int(kind[-1])], pa.int32()), pa.array([bytes(payload)], pa.binary())]
            columns += [pa.array([ids], pa.list_(pa.int64())), pa.array([repeats], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SHARD.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    tasks = scan_tasks(docs)
    rows = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    name, spark = f"token_shards_{uuid.uuid4().hex}", docs.sparkSession
    written = rows.mapInArrow(shards, _SHARD).write.option("path", fresh_path(spark, "token-shards"))
    written.option("compression", "zstd").bucketBy(tasks, "part").saveAsTable(name)
    return spark.table(name)


def key_hashes(doc_id: Column, repeat: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a document key: the first picks bucket and fingerprint, the second the slot."""
    return F.xxhash64(doc_id, repeat), F.xxhash64(F.lit("slot"), repeat, doc_id)


def _mix(keys: np.ndarray, displacement: np.ndarray | int, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ (np.asarray(displacement).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(slots)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per group of keys and the slot of each key: every slot of 0..len(keys)-1 is taken once.

    Groups of about four keys are placed from the largest down, each by the first displacement that sends all its keys
    to free slots. A group of one key stores its slot itself, as -slot - 1.
    """
    n = len(keys)
    groups = -(-n // 4)
    of = (keys % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=groups)
    begins = np.cumsum(sizes) - sizes
    displacements, slots, free = np.zeros(groups, np.int64), np.empty(n, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        mine = order[begins[g] : begins[g] + sizes[g]]
        if len(mine) < 2:
            break
        tried = 0
        while True:
            tries = np.arange(tried, tried + 64)
            at = _mix(keys[mine][None, :], tries[:, None], n)
            ok = free[at].all(1) & (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
            if ok.any():
                k = int(ok.argmax())
                displacements[g], slots[mine] = tried + k, at[k]
                free[at[k]] = False
                break
            tried += 64
            if tried > 1 << 24:
                raise ValueError("two document keys have the same hash")
    single = np.flatnonzero(sizes == 1)
    slots[order[begins[single]]] = spare = np.flatnonzero(free)[: len(single)]
    displacements[single] = -spare - 1
    return displacements, slots


def slots_of(keys: np.ndarray, displacements: np.ndarray, slots: int) -> np.ndarray:
    mine = displacements[(keys % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(mine < 0, -mine - 1, _mix(keys, np.maximum(mine, 0), slots))


def _runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows of one key at a time, from frames that are sorted by it."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        edges = np.flatnonzero(np.diff(frame[key].to_numpy())) + 1
        for rows in np.split(np.arange(len(frame)), edges):
            if not len(rows):
                continue
            run = frame.iloc[rows[0] : rows[-1] + 1]
            if held and held[0][key].iloc[0] != run[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(run)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def build_index(shards: DataFrame) -> tuple[DataFrame, int]:
    """The index over every document of ``shards`` and its number of buckets. The payload is not read."""
    parts = shards.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda n, x: n + x).alias("n"), F.size("doc_ids").alias("docs"))
    parts = stage(parts, "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = stage(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-bases")
    buckets = int(parts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]) // PER_BUCKET + 1

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n_tokens"], np.int64)
                first = np.cumsum(counts) - counts
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["repeats"], pa.int32()), pa.array(np.full(len(counts), row["part"], np.int32))]
                columns += [pa.array(first), pa.array(counts), pa.array(row["base"] + first)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "repeat", *[c.split()[0] for c in _PLACE.split(", ")[1:]]])

    rows = shards.select("part", "doc_ids", "repeats", "n_tokens").join(bases, "part")
    rows = rows.select("part", "base", "doc_ids", "repeats", "n_tokens").mapInArrow(entries, _PLACE.replace("doc_id long", "doc_id long, repeat int"))
    first, second = key_hashes(F.col("doc_id"), F.col("repeat"))
    rows = rows.select(F.pmod(first, F.lit(buckets)).alias("bucket"), first.alias("h1"), second.alias("h2"), "part", "first", "n_tokens", "start")

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames, "bucket"):
            displacements, slots = perfect_hash(run["h2"].to_numpy().view(np.uint64))
            kept = [np.empty(len(run), t) for t in ("<u4", "<i4", "<i8", "<i8", "<i8")]
            kept[0][slots] = run["h1"].to_numpy().view(np.uint64) >> np.uint64(32)
            for values, name in zip(kept[1:], ("part", "first", "n_tokens", "start")):
                values[slots] = run[name].to_numpy()
            row = [run["bucket"].iloc[0], displacements.astype("<i4").tobytes(), *(values.tobytes() for values in kept)]
            yield pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])

    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return stage(rows.mapInPandas(build, _INDEX), "token-index"), buckets


def find(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Places of ``keys(doc_id, repeat)``; a key that the index does not hold gives no row (but for 1 in 2**32).

    A key is hashed to its bucket and there to its one slot, whose fingerprint decides. Keys and index rows of a bucket
    meet in one task, many buckets to a task, each read as a stream.
    """
    first, second = key_hashes(F.col("doc_id"), F.col("repeat"))
    index_columns = [tuple(c.split()) for c in _INDEX.split(", ")][1:]
    none = [F.lit(None).cast(t).alias(c) for c, t in index_columns]
    own = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), first.alias("h1"), second.alias("h2")]
    zero = [F.lit(0).cast("long").alias("doc_id"), F.lit(True).alias("no_id"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2")]]
    asked = keys.select(F.pmod(first, F.lit(buckets)).alias("bucket"), F.lit(1).alias("asked"), *own, *none)
    held = index.select("bucket", F.lit(0).alias("asked"), *zero, *[c for c, _ in index_columns])
    rows = held.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "asked")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames, "bucket"):
            head, asked = run.iloc[0], run.iloc[1:]
            if head["asked"] or not len(asked):
                continue
            kept = [np.frombuffer(head[c], t) for c, t in zip((c for c, _ in index_columns), ("<i4", "<u4", "<i4", "<i8", "<i8", "<i8"))]
            at = slots_of(asked["h2"].to_numpy().view(np.uint64), kept[0].astype(np.int64), len(kept[1]))
            same = kept[1][at] == asked["h1"].to_numpy().view(np.uint64) >> np.uint64(32)
            at = at[same]
            ids = pd.arrays.IntegerArray(asked["doc_id"].to_numpy()[same], asked["no_id"].to_numpy()[same])
            columns = [ids, *(values[at] for values in kept[2:])]
            yield pd.DataFrame(dict(zip([c.split()[0] for c in _PLACE.split(", ")], columns)))

    return rows.mapInPandas(look, _PLACE)


def read_documents(places: DataFrame, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each place, from the payload of its shard.

    The places of a shard are collected next to it; shards are bucketed by part, so only places move. A shard and its
    places fit a task by construction: one task wrote them.
    """
    asked = places.groupBy("part").agg(F.collect_list(F.struct("doc_id", "first", "n_tokens", "start")).alias("asked"))
    rows = shards.select("part", "width", "payload").join(asked, "part").select("width", "payload", "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                out = []
                for place in row["asked"]:
                    part = ids[place["first"] : place["first"] + place["n_tokens"]]
                    out.append((place["doc_id"], place["start"], place["n_tokens"], zlib.crc32(part)))
                yield arrow_batch(out, _READ)

    return rows.mapInArrow(read, _READ)


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents, index them, then look every document up by its key and read it back.

    Null text: the end id alone. Null id: first in order. Rows that share an id: in order of a hash of their text, each
    with its own key (id, repeat). Empty table: empty result. Other columns are ignored.
    """
    shards = write_shards(docs, path)
    index, buckets = build_index(shards)
    keys = shards.select(F.inline(F.arrays_zip("doc_ids", "repeats"))).toDF("doc_id", "repeat")
    return read_documents(find(keys, index, buckets), shards)
