"""Removal of passages that stand in an earlier document, found with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import arrow_batch, whole_text
from rewardloom.session import stage

WINDOW = 50  # words of a passage
GRAM = 12  # words of an anchor
SPREAD = WINDOW - GRAM  # an anchor lies in windows that start up to this many words before it
CHUNK = 4096  # words of a reference shard's part of its document
SHARE = 512  # anchor occurrences that one copy of a reference shard serves
NO_ID = -(1 << 63)  # a null id is smaller than any other

_ANCHORS = "doc_id long, tie long, place int, anchor long"
_SEGMENTS = "owner long, owner_tie long, chunk int, copy int, own boolean, doc_id long, tie long, start int, words binary, anchors binary"
_FOUND = "doc_id long, tie long, start int, stop int, first long, second long"
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_by_hash long"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at the six white space characters alone


class _WordHashes(dict):
    """64-bit values of words, kept for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def gram_hashes(values: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all runs of ``gram`` words."""
    with np.errstate(over="ignore"):
        n = len(values) - gram + 1
        out = np.zeros(n, np.uint64)
        for k in range(gram):
            out = out * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def minimizers(grams: np.ndarray, span: int = SPREAD + 1) -> np.ndarray:
    """For each window of ``span`` grams the place of its smallest gram, the first one of equals.

    The place depends on the words of the window alone, so equal windows have the same anchor at the same distance.
    """
    best, place, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, place = np.where(later, best[step:], best[:n]), np.where(later, place[step:], place[:n])
        width += step
    return place


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors of every text: the places that are the minimizer of some window, one for about twenty words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                grams = gram_hashes(np.array([known[w] for w in words], np.uint64))
                places = np.unique(minimizers(grams))
                for column, values in zip(columns, (np.full(len(places), doc_id), np.full(len(places), tie), places.astype(np.int32), grams[places].view(np.int64))):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], [c.split()[0] for c in _ANCHORS.split(", ")])

    return docs.mapInArrow(find, _ANCHORS)


class SuffixAutomaton:
    """All substrings of the word sequences added; a state holds the length of its longest one."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self._last = [-1], [0], 0

    def add(self, words: list[bytes]) -> None:
        """A sequence of its own: matches never run across two sequences."""
        self._last = 0
        for word in words:
            self._extend(word)

    def _extend(self, word: bytes) -> None:
        following, link, length = self.next, self.link, self.length
        state = self._last
        known = following[state].get(word)
        if known is not None and length[known] == length[state] + 1:
            self._last = known
            return
        if known is not None:
            self._last = self._split(state, word, known)
            return
        new = len(length)
        following.append({})
        length.append(length[state] + 1)
        link.append(0)
        while state >= 0 and word not in following[state]:
            following[state][word] = new
            state = link[state]
        if state >= 0:
            target = following[state][word]
            link[new] = target if length[target] == length[state] + 1 else self._split(state, word, target)
        self._last = new

    def _split(self, state: int, word: bytes, target: int) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(length)
        following.append(following[target].copy())
        length.append(length[state] + 1)
        link.append(link[target])
        link[target] = copy
        while state >= 0 and following[state].get(word) == target:
            following[state][word] = copy
            state = link[state]
        return copy

    def window_ends(self, words: list[bytes], size: int) -> list[int]:
        """Places after which a window of ``size`` words ends that lies in the automaton, by matching statistics."""
        following, link, length = self.next, self.link, self.length
        state, matched, ends = 0, 0, []
        for k, word in enumerate(words, 1):
            target = following[state].get(word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = following[state].get(word)
            if target is None:
                matched = 0
                continue
            state = target
            matched += 1
            if matched >= size:
                ends.append(k)
        return ends


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, stop in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((begin, stop))
    return out


def segments(rows: DataFrame) -> DataFrame:
    """Stretches of words around shared anchors, addressed to the reference shard that owns the anchor.

    ``rows(doc_id, tie, text, shared)``. The owner of an anchor is its first occurrence in the document with the
    smallest id; the words around it go into the reference of that document's shard, once for every copy of the shard.
    All other occurrences become streams to one copy. Neighbouring stretches to one shard are sent once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = words_of(row["text"])
                doc_id, tie = row["doc_id"], row["tie"]
                groups: dict[tuple, list[int]] = defaultdict(list)
                for a in {tuple(a.values()) for a in row["shared"]}:
                    place, owner, owner_tie, owner_place, copies = a
                    own = (owner, owner_tie, owner_place) == (doc_id, tie, place)
                    groups[owner, owner_tie, owner_place // CHUNK, copies, own].append(place)
                for (owner, owner_tie, chunk, copies, own), places in groups.items():
                    target = range(copies) if own else [(doc_id ^ tie) % copies]
                    for begin, stop in _merged([(max(0, p - SPREAD), min(len(words), p + WINDOW)) for p in places]):
                        inside = np.array([p - begin for p in sorted(places) if begin <= p < stop], "<i4")
                        text = b" ".join(words[begin:stop])
                        out += [(owner, owner_tie, chunk, copy, own, doc_id, tie, begin, text, inside.tobytes()) for copy in target]
                if len(out) > 5000:
                    yield arrow_batch(out, _SEGMENTS)
                    out = []
            if out:
                yield arrow_batch(out, _SEGMENTS)

    return rows.select("doc_id", "tie", "text", "shared").mapInArrow(cut, _SEGMENTS)


def match_segments(rows: DataFrame) -> DataFrame:
    """Stream the segments of each shard through the suffix automaton of its reference.

    Gives removed spans (start, stop), and for windows around an anchor that the reference does not hold a 128-bit hash
    in (first, second): two later documents may share such a window without its owner.
    """
    keys = ["owner", "owner_tie", "chunk", "copy"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shard, automaton = None, SuffixAutomaton()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != shard:
                    shard, automaton = key, SuffixAutomaton()
                words = row["words"].split(b" ")
                if row["own"]:
                    automaton.add(words)
                    continue
                doc_id, tie, start = row["doc_id"], row["tie"], row["start"]
                held = {e - WINDOW for e in automaton.window_ends(words, WINDOW)}
                if row["owner"] < doc_id:
                    out += [(doc_id, tie, start + a, start + b, None, None) for a, b in _merged([(s, s + WINDOW) for s in held])]
                last = len(words) - WINDOW
                around = {s for p in np.frombuffer(row["anchors"], "<i4").tolist() for s in range(max(0, p - SPREAD), min(p, last) + 1)}
                around -= held
                if around:
                    values = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    place = minimizers(gram_hashes(values))
                    own = set(np.frombuffer(row["anchors"], "<i4").tolist())
                    raw = memoryview(values.tobytes())
                    for s in around:
                        if int(place[s]) in own:
                            digest = xxhash.xxh3_128_digest(raw[8 * s : 8 * (s + WINDOW)])
                            first, second = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                            out.append((doc_id, tie, start + s, start + s + WINDOW, first, second))
            if out:
                yield arrow_batch(out, _FOUND)

    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("own").desc(), "doc_id", "tie", "start")
    return rows.mapInArrow(stream, _FOUND)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id with null as the smallest number, a checksum that tells rows of one id apart, and the whole text."""
    text = whole_text()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.crc32(text.cast("binary")).alias("tie"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, start, stop, hashed): word spans that windows of an earlier document cover, and whether a window hash
    found them instead of an automaton. ``docs`` as ``_keyed`` gives it.

    Every window of 50 words holds 39 runs of 12 words; the one with the smallest hash is its anchor, so documents that
    share a window share its anchor at the same place in it. (1) Anchors are counted; those of more than one id are
    shared, and the first occurrence in the smallest id owns each. (2) Words around shared anchors go to the shard of
    the owner, a stretch of at most ``CHUNK`` words of one document with a margin; a shard that many occurrences ask
    for is copied once per ``SHARE`` of them. (3) There they run through its suffix automaton; matching statistics of
    50 or more mark spans. (4) Windows whose anchor is shared but which the owner does not hold are compared among
    each other by 128-bit hash, with partial minima of the id.
    """
    found = stage(anchors(docs), "anchors-found")  # 28 bytes an anchor, read twice
    grouped = found.groupBy("anchor").agg(F.min(F.struct("doc_id", "tie", "place")).alias("o"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    shared = grouped.where(F.col("most") > F.col("o.doc_id"))
    shared = stage(shared.select("anchor", F.col("o.doc_id").alias("owner"), F.col("o.tie").alias("owner_tie"), F.col("o.place").alias("owner_place"), "n"), "anchors")
    chunk = F.floor(F.col("owner_place") / CHUNK).cast("int").alias("chunk")
    sizes = shared.groupBy("owner", "owner_tie", chunk).agg((F.floor(F.sum("n") / SHARE) + 1).cast("int").alias("copies"))
    shared = shared.withColumn("chunk", chunk).join(stage(sizes, "shards"), ["owner", "owner_tie", "chunk"]).drop("chunk", "n")
    uses = found.join(stage(shared, "anchors"), "anchor")
    used = F.struct("place", "owner", "owner_tie", "owner_place", "copies")
    uses = uses.groupBy("doc_id", "tie").agg(F.collect_list(used).alias("shared"))
    matched = stage(match_segments(segments(docs.join(uses, ["doc_id", "tie"]))), "matches")
    loose = matched.where(F.col("first").isNotNull())
    several = loose.groupBy("first", "second").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least")
    several = stage(several.select("first", "second", "least"), "windows")
    later = loose.join(several, ["first", "second"]).where("doc_id > least")
    columns = ["doc_id", "tie", "start", "stop"]
    by_automaton = matched.where(F.col("first").isNull()).select(*columns, F.lit(False).alias("hashed"))
    return by_automaton.unionByName(later.select(*columns, F.lit(True).alias("hashed")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_by_hash of every row; the last counts the removed words that no
    automaton of a reference shard marked, but the comparison of window hashes among documents its owner does not share.

    Null or wordless text: no words. Texts under 50 words keep all. A null id counts as the smallest. Rows that share
    an id never remove words of each other. Repeated rows: same values. Empty table: empty result. Other columns are
    ignored.
    """
    rows = _keyed(docs)
    spans = repeated_spans(rows).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "stop", "hashed")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = words_of(row["text"])
                spans = row["spans"] or ()
                gone = _merged([(s["start"], s["stop"]) for s in spans])
                matched = _merged([(s["start"], s["stop"]) for s in spans if not s["hashed"]])
                kept, at = [], 0
                for begin, stop in gone:
                    kept += words[at:begin]
                    at = stop
                kept += words[at:]
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((None if row["doc_id"] == NO_ID else row["doc_id"], len(words), len(words) - len(kept), digest, len(words) - len(kept) - sum(b - a for a, b in matched)))
            yield arrow_batch(out, _KEPT)

    return rows.join(stage(spans, "spans"), ["doc_id", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(keep, _KEPT)
