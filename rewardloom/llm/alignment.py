"""Alignment of two tokenizers over the same bytes, and counts of the id pairs that they link.

Tasks encode documents and gather pair-document records. Whenever ``RECORDS`` of them are held, they are sorted and
leave as a run: radix parts by the B id, each with a head (its distinct pairs in order of B id, then A id, with the
number of links in the run) and its records (which document of the run holds which pair how often), all zstd. Heads of
one radix part meet in one task, where a heap of runs merges them block by block, counts each pair, and, as all pairs of
a B id stand together, finds the B id's highest count; what it found goes back to every run in the order of its head.
There each record gives its part to its document. Heads hold a pair once per run, so a pair that all documents share is
small work, and records never leave their run.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import arrow_batch
from rewardloom.llm.encoder import vocabulary_path
from rewardloom.session import stage

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
RECORDS = 2_000_000  # pair-document records a run gathers before it is cut
DOCUMENTS = 50_000  # documents a run gathers at most
MERGED = 1 << 15  # pairs of a run that are unpacked at once while heads are merged
TOGETHER = 1 << 20  # characters of the documents that are aligned at once, or more in one document
REMEMBERED = 250_000  # stretches of text that a worker keeps, some 300 bytes each
# Fixed value: where byte-level vocabularies of this kind cut a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = "run long, docs binary, radix array<int>, heads array<binary>, records array<binary>"
_COUNTED = "run long, radix int, found binary"
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _open(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


class Aligner:
    """Tokens, groups and linked pairs of texts, worked out once per stretch that both tokenizers cut on its own.

    A space is put before a text, and the whole is cut before every space that follows something other than white
    space. The first tokenizer starts a piece there, and the second has no piece with a space behind another character,
    so neither has a token across a cut. What a stretch gives is kept in arrays for the next ``REMEMBERED`` of them;
    those that are new in some documents are encoded together. Where the second model does have such pieces, the first
    file is of another kind, or a stretch's bytes do not come back, the text is one stretch.
    """

    _CUT = re.compile(r"(?<=\S)(?= )")

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * self.a.get_vocab_size()
        plain = _byte_of_symbol()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        single = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := single.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self._ranked = self._ranks()
        self.cuts = self._ranked is not None and not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def _ranks(self):
        """The same byte-level merges in a faster library, where the file is of the plain kind and the results agree."""
        import json

        import tiktoken

        kind = json.loads(self.a.to_str())
        pre, special = kind["pre_tokenizer"] or {}, {t["id"] for t in kind["added_tokens"]}
        if kind["model"]["type"] != "BPE" or kind["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            return None
        ranks = {token: k for k, token in enumerate(self.bytes_a) if k not in special}
        if any(bytes([k]) not in ranks for k in range(256)):
            return None
        found = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = " It's 1,234 words; ñandú  Straße 漢字\t😀 of the<|endoftext|> x_y\r\n antidisestablishmentarianism \u00a0\x1c."
        return found if found.encode_ordinary(probe) == self.a.encode(probe, add_special_tokens=False).ids else None

    def encode_a(self, text: str) -> list[int]:
        return self._ranked.encode_ordinary(text) if self._ranked else self.a.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.n_pairs = (np.zeros(0, np.int64) for _ in range(4))
        self.pairs = np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text, each without the space it starts with."""
        if not self.cuts:
            return [text]
        words = text.split(" ")
        # Most texts have single spaces only; otherwise white space decides where a stretch may start.
        if any([not w or w[-1].isspace() for w in words]):
            return [w[1:] for w in self._CUT.split(" " + text)]
        return words

    def learn(self, new: list[str]) -> None:
        """Add new stretches. They are aligned as one text, as both tokenizers end a token where each of them ends."""
        raw = [(" " + w).encode("utf-8", "surrogatepass") for w in new]
        many_b = self.b.encode(new, num_threads=1)
        if not self.cuts or any(w[-1:].isspace() or not w for w in new):
            many_a = [self.encode_a(" " + w) for w in new]
            count_a = np.array([len(x) for x in many_a], np.int64)
            a = np.fromiter((k for x in many_a for k in x), np.int64, int(count_a.sum()))
        else:
            a = np.array(self.encode_a(" " + " ".join(new)), np.int64)
            ends = np.cumsum(self.length_a[a])
            count_a = np.diff(np.r_[0, np.searchsorted(ends, np.cumsum([len(x) for x in raw])) + 1])
        count_b = np.array([len(x) for x in many_b], np.int64)
        b = np.fromiter((k for x in many_b for k in x), np.int64, int(count_b.sum()))
        exact = np.ones(len(new), bool)
        bytes_a, bytes_b = ([t[k] for k in ids.tolist()] for t, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        whole = b"".join(raw)
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole or self._ends(self.length_b[b], count_b, raw):
            at_a = at_b = 0
            for k, (n, m, text) in enumerate(zip(count_a.tolist(), count_b.tolist(), raw)):
                exact[k] = b"".join(bytes_a[at_a : at_a + n]) == text and b"".join(bytes_b[at_b : at_b + m]) == text
                at_a, at_b = at_a + n, at_b + m
            a, b = a[np.repeat(exact, count_a)], b[np.repeat(exact, count_b)]
        sizes = np.where(exact, [len(x) for x in raw], 0)
        self._add(new, exact, a, b, np.where(exact, count_a, -1), np.where(exact, count_b, 0), np.cumsum(sizes), sizes > 0)

    @staticmethod
    def _ends(lengths: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> bool:
        """Whether some stretch's tokens have another length than the stretch."""
        total = np.r_[0, np.cumsum(lengths)]
        return bool((np.diff(np.r_[0, total[np.cumsum(counts)]]) != [len(x) for x in raw]).any())

    def _add(self, new, exact, a, b, count_a, count_b, stops, some) -> None:
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        borders = np.union1d(ends_a, ends_b)  # between two of these lies the overlap of one pair
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        pairs = b[np.searchsorted(ends_b, borders)] << 32 | a[np.searchsorted(ends_a, borders)]
        edges = stops[some]
        per_chunk = np.zeros((2, len(new)), np.int64)
        for row, cut in zip(per_chunk, (borders, common)):
            row[some] = np.diff(np.r_[0, np.searchsorted(cut, edges, "right")])
        # Tokens in order of group, side and place, each with the mark that follows it.
        group = np.concatenate([np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)])
        last = np.concatenate([np.isin(ends_a, common, assume_unique=True), np.isin(ends_b, common, assume_unique=True)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        names = self.names
        marks = [",|", ",;"]
        parts = [names[k] + marks[s][e] for k, s, e in zip(np.concatenate([a, b])[order].tolist(), side[order].tolist(), last[order].astype(int).tolist())]
        text = "".join(parts)
        lengths = np.cumsum([len(p) for p in parts])
        begin = 0
        tokens = np.cumsum(np.where(exact, count_a + count_b, 0))
        for n in tokens.tolist():
            end = int(lengths[n - 1]) if n else 0
            self.groups.append(text[begin:end])
            begin = end
        self.known.update(zip(new, range(len(self.n_a), len(self.n_a) + len(new))))
        self.n_a, self.n_b = np.r_[self.n_a, count_a], np.r_[self.n_b, count_b]
        self.n_pairs, self.n_groups = np.r_[self.n_pairs, per_chunk[0]], np.r_[self.n_groups, per_chunk[1]]
        self.pairs = np.r_[self.pairs, pairs]

    def __call__(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_groups, n_links, digest of groups); and of all linked pairs the text's number and the
        pair, as B id * 2**32 + A id."""
        cut = [self.stretches(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.forget()
            new = set().union(*cut)
        if new:
            self.learn(sorted(new))
        ids = [np.fromiter(map(self.known.__getitem__, c), np.int64, len(c)) for c in cut]
        # A text with a stretch that does not come back is taken whole, and if that does not come back either, is empty.
        lossy = [k for k, i in enumerate(ids) if len(i) and (self.n_a[i] < 0).any()]
        if lossy:
            wholes = sorted({texts[k] for k in lossy} - self.known.keys())
            if wholes:
                self.learn(wholes)
            for k in lossy:
                at = self.known[texts[k]]
                ids[k] = np.array([at] if self.n_a[at] >= 0 else [], np.int64)
        every = np.concatenate([*ids, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        sums = [np.bincount(owner, weights=t[every], minlength=len(ids)).astype(np.int64) for t in (self.n_a, self.n_b, self.n_groups, self.n_pairs)]
        groups = self.groups
        digests = [hashlib.sha256("".join([groups[k] for k in i.tolist()])[:-1].encode()).hexdigest() if len(i) else "" for i in ids]
        n = self.n_pairs[every]
        begins = (np.cumsum(self.n_pairs) - self.n_pairs)[every]
        at = np.arange(int(n.sum())) + np.repeat(begins - (np.cumsum(n) - n), n)
        rows = list(zip(*(x.tolist() for x in sums), digests))
        return rows, np.repeat(owner, n), self.pairs[at]


def _byte_of_symbol() -> dict[str, int]:
    """The symbols that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in shown]
    return {**{chr(k): k for k in shown}, **{chr(256 + n): k for n, k in enumerate(rest)}}


def kept_aligner(path_a: str, path_b: str) -> Aligner:
    kept = sys.modules.setdefault("_rewardloom_aligners", ModuleType("_rewardloom_aligners")).__dict__
    key = f"{path_a}|{path_b}"
    if key not in kept:
        kept[key] = Aligner(path_a, path_b)
    return kept[key]


class _Run:
    """Documents and pair-document records that a task holds."""

    def __init__(self, size_a: int):
        self.size_a = size_a
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.slots: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: list[int | None], found: tuple[list[tuple], np.ndarray, np.ndarray]) -> None:
        """Documents, and a record per document and distinct pair."""
        rows, owner, pairs = found
        # One number per record: document, B id, A id.
        packed, times = np.unique((owner << 42) + (pairs >> 32) * self.size_a + (pairs & 0xFFFFFFFF), return_counts=True)
        pair = packed & (1 << 42) - 1
        self.keys.append(pair // self.size_a << 32 | pair % self.size_a)
        self.slots.append(((packed >> 42) + len(self.rows)).astype(np.int32))
        self.times.append(times.astype(np.int32))
        self.rows += [(doc_id, *row[:4], 0, 0, row[4]) for doc_id, row in zip(ids, rows)]
        self.held += len(pair)

    def cut(self, run: int, radixes: int) -> pa.RecordBatch:
        """The run: documents, and per radix part head and records."""
        keys, slots, times = (np.concatenate(x) for x in (self.keys, self.slots, self.times))
        radix = ((keys >> 32) % radixes).astype(np.int32)
        order = np.lexsort((keys, radix))  # stable, so the documents of a pair ascend
        keys, slots, times, radix = keys[order], slots[order], times[order], radix[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        counts, spans = np.add.reduceat(times, first, dtype=np.int64) if len(keys) else first, np.diff(np.r_[first, len(keys)])
        pairs, parts = keys[first], radix[first]
        found, at = np.unique(parts, return_index=True)
        heads, records = [], []
        for begin, end in zip(at.tolist(), [*at[1:].tolist(), len(pairs)]):
            heads.append(_squeeze(pairs[begin:end], counts[begin:end]))
            rows = slice(first[begin], first[end] if end < len(first) else len(keys))
            records.append(_squeeze(spans[begin:end].astype(np.int32), slots[rows], times[rows]))
        docs = arrow_batch(self.rows, _DOC)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(docs)
        columns = [pa.array([run], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([found.tolist()], pa.list_(pa.int32()))]
        columns += [pa.array([heads], pa.list_(pa.binary())), pa.array([records], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RUN.split(", ")])


def write_runs(docs: DataFrame, path_a: str, path_b: str, radixes: int) -> DataFrame:
    """The runs of all documents, staged. Texts are encoded where they lie."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, number = kept_aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        held, ids, texts, size = _Run(len(align.bytes_a)), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= TOGETHER or len(texts) >= TOGETHER >> 6:
                    held.add(ids, align(texts))
                    ids, texts, size = [], [], 0
                    if held.held >= RECORDS or len(held.rows) >= DOCUMENTS:
                        yield held.cut(number, radixes)
                        number, held = number + 1, _Run(len(align.bytes_a))
        if texts:
            held.add(ids, align(texts))
        if held.rows:
            yield held.cut(number, radixes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(runs, _RUN), "alignment-runs")


class _Head:
    """A run's head of one radix part, unpacked ``MERGED`` pairs at a time."""

    def __init__(self, run: int, blob: bytes):
        import zstandard

        self.run, self.size = run, zstandard.frame_content_size(blob) // 16
        self._keys, self._counts = (self._stream(blob, at) for at in (0, 8 * self.size))
        self.read = 0
        self.counts: list[np.ndarray] = []

    @staticmethod
    def _stream(blob: bytes, at: int):
        import zstandard

        reader = zstandard.ZstdDecompressor().stream_reader(blob)
        left = at
        while left:
            left -= len(reader.read(min(left, 1 << 16)))
        return reader

    def block(self) -> tuple[np.ndarray, np.ndarray]:
        n = min(MERGED, self.size - self.read)
        self.read += n
        return tuple(np.frombuffer(reader.read(8 * n), np.int64) for reader in (self._keys, self._counts))


def merged(heads: list[_Head]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in ascending order with their counts over all heads, a block at a time.

    The heap holds the last pair of each run's open block. Up to the smallest of these no closed block can hold a pair,
    so what the open blocks hold up to it is counted and leaves; the run at the top opens its next block.
    """
    opened, heap = {}, []
    for k, head in enumerate(heads):
        opened[k] = head.block()
        heapq.heappush(heap, (int(opened[k][0][-1]), k))
    while heap:
        last, _ = heap[0]
        keys, counts = [], []
        for k, (pairs, n) in opened.items():
            upto = int(np.searchsorted(pairs, last, "right"))
            if upto:
                keys.append(pairs[:upto])
                counts.append(n[:upto])
                opened[k] = (pairs[upto:], n[upto:])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        yield found, total
        while heap and heap[0][0] == last:
            _, k = heapq.heappop(heap)
            if heads[k].read < heads[k].size:
                opened[k] = heads[k].block()
                heapq.heappush(heap, (int(opened[k][0][-1]), k))
            else:
                del opened[k]


def count_pairs(blobs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(run, counts and marks of the pairs of its head, in order) for all heads of a radix part.

    A count is stored negated where it is the highest of its B id.
    """
    keys, counts = zip(*merged([_Head(run, blob) for run, blob in blobs]))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    begins = np.flatnonzero(np.r_[True, (keys[1:] >> 32) != (keys[:-1] >> 32)])
    highest = np.repeat(np.maximum.reduceat(counts, begins), np.diff(np.r_[begins, len(keys)]))
    found = np.where(counts == highest, -counts, counts)
    for run, blob in blobs:
        pairs = np.frombuffer(_open(blob), np.int64)
        yield run, _squeeze(found[np.searchsorted(keys, pairs[: len(pairs) // 2])])


def counted(runs: DataFrame) -> DataFrame:
    """For every run and radix part the counts of its pairs over all runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for radix, run, head in zip(*(batch.column(c).to_pylist() for c in ("radix", "run", "head"))):
                if radix != at and held:
                    yield from replies(at, held)
                    held = []
                at = radix
                held.append((run, head))
        if held:
            yield from replies(at, held)

    def replies(radix: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for run, found in count_pairs(held):
            yield arrow_batch([(run, radix, found)], _COUNTED)

    heads = runs.select("run", F.inline(F.arrays_zip("radix", "heads"))).withColumnRenamed("heads", "head")
    return heads.repartition("radix").sortWithinPartitions("radix", "run").mapInArrow(count, _COUNTED)


def contribute(runs: DataFrame, replies: DataFrame) -> DataFrame:
    """The documents of every run with what their records get from the counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("docs", "radix", "records", "replies")}
                docs = pa.ipc.open_stream(row["docs"].as_py()).read_all().combine_chunks().to_batches()[0]
                best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
                found = {reply["radix"]: reply["found"] for reply in row["replies"].as_py() or []}
                for radix, records in zip(row["radix"].as_py(), row["records"]):
                    counts = np.frombuffer(_open(found[radix]), np.int64)
                    records = np.frombuffer(_open(records.as_py()), np.int32)
                    spans = records[: len(counts)]
                    slots, times = records[len(counts) :].reshape(2, -1)
                    counts = np.repeat(counts, spans)
                    np.add.at(total, slots, np.abs(counts) * times)
                    np.add.at(best, slots, np.where(counts < 0, times, 0))
                columns = dict(zip(docs.schema.names, docs.columns))
                columns |= {"n_best": pa.array(best), "count_sum": pa.array(total)}
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    own = replies.groupBy("run").agg(F.collect_list(F.struct("radix", "found")).alias("replies"))
    rows = runs.select("run", "docs", "radix", "records").join(own, "run", "left")
    return rows.select("docs", "radix", "records", "replies").mapInArrow(add, _DOC)


def radix_parts(docs: DataFrame) -> int:
    """One part per 64 MB of the table as stored, at least the session's shuffle partitions: a part's heads fit a task."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (64 << 20) + 1, 30_000))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null or empty text, and a text whose tokens do not give back its bytes: zeros and ''. Null id: kept. Repeated rows:
    each counts. Empty table: empty result. Other columns are ignored.
    """
    runs = write_runs(docs, path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B), radix_parts(docs))
    return contribute(runs, stage(counted(runs), "alignment-counts"))
