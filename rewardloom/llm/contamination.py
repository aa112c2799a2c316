"""Benchmark passages in documents, found by an Aho-Corasick automaton over the words of the test items.

Texts are normalised to words. A window of an item is a run of ``WINDOW`` of its words (a shorter item is one window).
The automaton holds every distinct window as a sequence of word numbers and reads a document's word numbers once; words
that no item has are number 0, which no window holds. Each match ends at a word, so hits are runs of words, and the
place of a word in the original text follows from the bytes it was cut from.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.session import stage

WINDOW = 10
#: Words of test items that one automaton holds (some 600 bytes each in a worker). More items are cut into parts, each
#: with an automaton of its own, which reads the documents in a pass of its own.
MOST_WORDS = 250_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are in lower case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
_FOUND = f"doc_id long, row long, n_words long, spans {_SPANS}, items array<string>"
_SPAN_TYPE = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")]))

#: Every byte as itself if it belongs to a word, A-Z as a-z, and a space for the rest: ASCII but letters and digits.
_NORMAL = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters and digits, with A-Z in lower case. Null: none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Windows:
    """The automaton over the windows of ``items``, pairs of an id and a text."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        import ahocorasick

        self.ids = [item_id for item_id, _ in items]
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            coded = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for at in range(max(1, len(coded) - window + 1)) if coded else ():
                owners.setdefault(tuple(coded[at : at + window]), set()).add(k)
        self.lengths = [len(w) for w in owners]
        self.owners = [sorted(o) for o in owners.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, w in enumerate(owners):
            self.automaton.add_word(w, k)
        if owners:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Runs of words (first, last) that windows cover, and the ids of the items these belong to."""
        if not self.lengths:
            return [], []
        coded = tuple(map(self.numbers.get, found, repeat(0)))
        spans: list[list[int]] = []
        windows = set()
        # Matches come in order of their last word; at one word the longest comes first, as the automaton gives them.
        for last, k in self.automaton.iter(coded):
            first = last - self.lengths[k] + 1
            windows.add(k)
            while spans and first <= spans[-1][1] + 1:
                first = min(first, spans.pop()[0])
            spans.append([first, last])
        return spans, sorted({self.ids[o] for k in windows for o in self.owners[k]} - {None})


def placed(text: str, spans: list[list[int]]) -> list[dict[str, int]]:
    """The runs with their code points in the original text: from the start of the first word to the end of the last."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(_NORMAL, np.uint8)[raw] != 32
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before each byte
    return [{"first": a, "last": b, "start": int(points[begins[a]]), "end": int(points[ends[b]])} for a, b in spans]


def _kept(items: Broadcast, window: int) -> Windows:
    """The automaton of this Python worker; another set of items takes its place."""
    kept = sys.modules.setdefault("_rewardloom_windows", ModuleType("_rewardloom_windows")).__dict__
    key = hashlib.sha256(repr((items.value, window)).encode("utf-8", "surrogatepass")).hexdigest()
    if kept.get("key") != key:
        kept.clear()
        kept["key"], kept["windows"] = key, Windows(items.value, window)
    return kept["windows"]


def _scanned(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """One pass of an automaton over ``docs(doc_id, row, text)``; texts lie where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _kept(sent, window)
        for batch in batches:
            counts, spans, ids = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = words(text)
                covered, items = windows.scan(found)
                counts.append(len(found))
                spans.append(placed(text, covered) if covered else [])
                ids.append(items)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64())]
            columns += [pa.array(spans, _SPAN_TYPE), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_words", "spans", "items"])

    return docs.select("doc_id", "row", "text").mapInArrow(scan, _FOUND)


def _parts(benchmark: DataFrame, window: int, most_words: int) -> list[DataFrame]:
    """The items in parts of about ``most_words`` words. Items of one part may share windows with items of another.

    Where there are several parts, items are dealt out in pieces of a few thousand words that overlap by a window less
    one word, so no part hangs on one item.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text.alias("text"))
    lowered = F.translate("text", UPPER, LOWER)
    total = items.agg(F.coalesce(F.sum(F.regexp_count(lowered, F.lit(WORD))), F.lit(0))).first()[0]
    if total <= most_words:
        return [items]
    step = max(window, most_words // 64)
    found = items.select("item_id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(step))
    pieces = F.transform(starts, lambda at: F.array_join(F.slice("words", at, F.lit(step + window - 1)), " "))
    pieces = stage(found.select("item_id", F.explode(pieces).alias("text")), "benchmark-pieces")
    parts = int(total // most_words) + 1
    return [pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, spans (first and last word, start and end in code points) and items of every row of ``docs``.

    Items go to the driver and to the workers only within ``most_words``, a bound that is checked; more are taken part
    by part, a pass over the documents each, and the runs of words that the passes found are united per row.

    Null, empty or wordless text: no words, no hit. Null item text: no window. Null item id: its windows count, it has
    no id to name. Repeated items or rows: as once, or a row each. Empty tables: empty result, or no hit. Other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    parts = _parts(benchmark, window, most_words)
    if len(parts) == 1:
        return _scanned(rows, _collected(parts[0]), window).drop("row")
    rows = stage(rows, "contamination-rows")  # a row keeps its number over all passes
    hits, counts = None, None
    for part in parts:
        found = stage(_scanned(rows, _collected(part), window), "contamination-part")
        counts = counts or found.select("doc_id", "row", "n_words")
        found = found.where(F.size("spans") > 0).select("row", "spans", "items")
        hits = found if hits is None else hits.unionAll(found)
    united = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    joined = counts.join(united.select("row", _united(F.array_sort("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")), "row", "left")
    empty = [F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    return joined.select("doc_id", "n_words", *empty)


def _collected(items: DataFrame) -> list[tuple[str | None, str]]:
    return sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def _united(spans):
    """Sorted runs with those that touch or overlap made one."""

    def add(done, span):
        last = F.element_at(done, -1)
        wider = F.struct(
            last["first"].alias("first"),
            F.greatest(last["last"], span["last"]).alias("last"),
            last["start"].alias("start"),
            F.greatest(last["end"], span["end"]).alias("end"),
        )
        # An if, as element_at of an empty array is an error that only an untaken branch avoids.
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))
        return F.when(F.size(done) == 0, F.array(span)).when(span["first"] <= last["last"] + 1, joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast(_SPANS), add)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; cases as for ``contamination``."""
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    found = found.select("doc_id", "n_words", hit.alias("n_hit"), "items")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
CONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, win)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
