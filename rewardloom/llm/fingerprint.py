"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import arrow_batch, scan_tasks, whole_text
from rewardloom.session import stage

PRIME = np.int64((1 << 31) - 1)
SPAN_BASES = (811_317_637, 1_290_563_821)  # span equality is decided under both
WHOLE_BASES = (*SPAN_BASES, 1_783_940_201, 402_653_189)  # the fingerprint of a whole text uses all four
BLOCK = 24  # code points of a block that is looked for in the other text

_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STAGED = "part int, edge int, text string, " + _COLUMNS


def _fold(x: np.ndarray) -> np.ndarray:
    """The residue of a product or sum below 2**62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)  # at most PRIME + 1
    return np.subtract(x, PRIME, out=x, where=x >= PRIME)


class _Powers:
    """Powers of the bases, and of the inverses of the span bases, as far as the longest text so far needs; a row per base."""

    def __init__(self):
        self.size = 0

    def reach(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = max(1 << 14, 1 << (n - 1).bit_length())

        def powers(base: int) -> np.ndarray:
            out = np.ones(self.size, np.int64)
            done = 1
            while done < self.size:
                take = min(done, self.size - done)
                out[done : done + take] = out[:take] * np.int64(pow(base, done, int(PRIME))) % PRIME
                done += take
            return out

        self.up = np.stack([powers(b) for b in WHOLE_BASES])
        self.down = np.stack([powers(pow(b, -1, int(PRIME))) for b in SPAN_BASES])


class PrefixHashes:
    """Prefix arrays of one text: ``prefix[k, i]`` is the sum of (c_j + 1) * base_k ** j over j < i, modulo PRIME.

    The hash of the span [i, i + n) is (prefix[i + n] - prefix[i]) / base ** i, so equal spans have equal hashes
    wherever they stand, and any span equality costs two lookups per base. Two different spans of n code points agree
    by chance with probability under (n / 2**31) ** 2.
    """

    def __init__(self, text: str, powers: _Powers):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        self.size, self._powers = len(code), powers
        powers.reach(self.size + 1)
        terms = _fold(code * powers.up[:, : self.size])
        self.prefix = np.zeros((len(SPAN_BASES), self.size + 1), np.int64)
        np.cumsum(terms[: len(SPAN_BASES)], axis=1, out=self.prefix[:, 1:])
        self.prefix = _fold(self.prefix)
        totals = terms.sum(1) % PRIME
        self.fingerprint = f"{self.size:08x}" + "".join(f"{t:08x}" for t in totals.tolist())

    def spans(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Hashes of spans, a row per span base."""
        value = self.prefix.take(starts + lengths, 1) - self.prefix.take(starts, 1) + PRIME
        return _fold(value * self._powers.down.take(starts, 1))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length under the first base."""
        n, sums = self.size - length + 1, self.prefix[0]
        return _fold((sums[length:] - sums[:n] + PRIME) * self._powers.down[0, :n])


def common_extensions(a: PrefixHashes, i: np.ndarray, b: PrefixHashes, j: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Lengths of the longest common extensions from places i of a and j of b, by binary search over span equality.

    ``back`` is 1 where the extension runs to the left and 0 where it runs to the right.
    """
    low = np.zeros(len(i), np.int64)
    high = np.where(back, np.minimum(i, j), np.minimum(a.size - i, b.size - j))
    while (low < high).any():
        middle = (low + high + 1) >> 1
        shift = back * middle
        same = (a.spans(i - shift, middle) == b.spans(j - shift, middle)).all(0)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def likeness(a: PrefixHashes, b: PrefixHashes) -> float:
    """2 x (code points of a that lie in maximal spans shared with b) / (both lengths), 0 to 1; equal texts have 1.

    Shared spans are the common start, the common end, and for every aligned block of ``BLOCK`` code points of a that
    stands anywhere in b its extension to both sides. Blocks that follow each other in both texts are extended once.
    What is shared counts at most as often as b is long.
    """
    if a.fingerprint == b.fingerprint:
        return 1.0
    if not a.size or not b.size:
        return 0.0
    # Extensions: from the start to the right, from the end to the left, then of every run of blocks to both sides.
    start, end = common_extensions(a, np.array([0, a.size]), b, np.array([0, b.size]), np.array([0, 1])).tolist()
    spans = [(0, start), (a.size - end, a.size)]
    own = np.arange(0, a.size - BLOCK + 1, BLOCK)
    own = own[(own + BLOCK > start) & (own < a.size - end)]
    if len(own) and b.size >= BLOCK:
        i, j = _shared_blocks(a, b, own)
        if len(i):
            joins = (np.diff(i) == BLOCK) & (np.diff(j) == BLOCK)
            left, right = np.append(True, ~joins), np.append(~joins, True)
            at, of = np.concatenate([i[left], i[right] + BLOCK]), np.concatenate([j[left], j[right] + BLOCK])
            back = np.repeat([1, 0], [left.sum(), right.sum()])
            more = common_extensions(a, at, b, of, back)
            spans += zip((at - more)[back == 1].tolist(), (at + more)[back == 0].tolist())
    shared, reached = 0, 0
    for begin, stop in sorted(spans):
        shared += max(0, stop - max(begin, reached))
        reached = max(reached, stop)
    return 2.0 * min(shared, b.size) / (a.size + b.size)


def _shared_blocks(a: PrefixHashes, b: PrefixHashes, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i of blocks of a that stand in b, in order, and for each the first such place j of b."""
    wanted = a.spans(own, BLOCK)
    marked = np.zeros(1 << 16, bool)
    marked[wanted[0] & 0xFFFF] = True
    maybe = np.flatnonzero(marked[b.windows(BLOCK) & 0xFFFF])
    if not len(maybe):
        return maybe, maybe
    both = lambda rows: (rows[0] << 31) | rows[1]
    found, first = np.unique(both(b.spans(maybe, BLOCK)), return_index=True)
    wanted = both(wanted)
    at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
    hit = found[at] == wanted
    return own[hit], maybe[first[at[hit]]]


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text gives way to as many code points from the start of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(doc_id: int | None, text: str, own: PrefixHashes, following: str, other: PrefixHashes, powers: _Powers) -> tuple:
    edited = edited_text(text, following)
    changed = PrefixHashes(edited, powers)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, own.size, digest, own.fingerprint, changed.fingerprint, likeness(own, changed), likeness(own, other)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to that and to the next document.

    The next document is the one with the next larger doc_id, for the last the first. Rows are range-partitioned and
    sorted by id, so a task meets neighbours in order and texts move once. Only the first and last text of a task's
    range wait for the neighbouring range; they are paired in a second, small job.

    Null text: empty. Null ids come first. Rows that share an id stand in order of a hash of their text. A table of one
    row is its own neighbour. Empty table: empty result. Other columns are ignored.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, powers, last = TaskContext.get().partitionId(), _Powers(), None
        blank = (None,) * 7
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = PrefixHashes(text, powers)
                if last is None:
                    out.append((part, 1, text, *blank))
                else:
                    out.append((part, 0, None, *_compare(*last, text, own, powers)))
                last = doc_id, text, own
            yield arrow_batch(out, _STAGED)
        if last is not None:
            yield arrow_batch([(part, 2, last[1], last[0], *blank[1:])], _STAGED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(scan_tasks(docs), "doc_id", "_tie")
    rows = rows.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    staged = stage(rows.mapInArrow(neighbours, _STAGED), "fingerprints")

    ends = staged.where("edge = 2").select("part")  # one row per task of the first job
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    pairs = stage(ends.select("part", following.alias("next")), "fingerprint-ends")
    firsts = staged.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = staged.where("edge = 2").select("part", "doc_id", "text").join(pairs, "part").join(firsts, "next")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            out = []
            for doc_id, text, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                out.append(_compare(doc_id, text, PrefixHashes(text, powers), other, PrefixHashes(other, powers), powers))
            yield arrow_batch(out, _COLUMNS)

    inner = staged.where("edge = 0").select(*[c.split()[0] for c in _COLUMNS.split(", ")])
    return inner.unionByName(lasts.select("doc_id", "text", "following").mapInArrow(border, _COLUMNS))
