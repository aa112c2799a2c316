"""String helpers that follow Python's text rules on Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python counts as white space, from the rule itself.
PY_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same set as a regex class. The intersection lets a letter fail after two tests instead of nine, which halves the
# time of a split over long texts.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; nested lambdas would otherwise evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_SPACE))


def words(text: Column) -> Column:
    """Split on runs of white space, without empty words."""
    return F.array_remove(F.split(strip(text), SPACE_CLASS + "+"), "")


def word_grams(w: Column, size: int) -> Column:
    """All runs of ``size`` words, joined by one space; ``w`` must hold at least ``size`` words.

    Words hold no white space, so joined runs differ exactly when the runs do, and strings are cheap to compare.
    """
    spaced = [F.lit(" ")] * (2 * size - 1)

    def run(i: Column) -> Column:
        spaced[::2] = [F.get(w, i + F.lit(j)) for j in range(size)]
        return F.concat(*spaced)

    return F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(size)), run)


def _bytes_removed(text: Column, needle: Column) -> Column:
    """Bytes that go when ``needle`` is taken out; byte lengths are known without a scan."""
    return F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))


def exactly_once(text: Column, needle: str) -> Column:
    """True when ``needle`` has one non-overlapping occurrence; texts without it are only searched."""
    mark = F.lit(needle)
    return F.contains(text, mark) & (_bytes_removed(text, mark) == len(needle.encode()))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping count of ``needle`` (not empty)."""
    counted = _bytes_removed(text, needle) / F.octet_length(needle)
    return F.when(F.contains(text, needle), counted.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def before(text: Column, mark: str) -> Column:
    """Text before the first ``mark``, or the whole text without one."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """Text after the first ``mark``, null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + F.lit(len(mark))))


def after_last(text: Column, mark: str) -> Column:
    """Last piece of ``text`` split by ``mark`` from the left (the whole text without one)."""
    return F.element_at(F.split(text, r"\Q" + mark + r"\E"), -1)


def between(text: Column, opening: str, closing: str) -> Column:
    """Text between the first ``opening`` and the next ``closing``, null without such a pair."""
    tail = after(text, opening)
    return F.when(F.instr(tail, closing) > 0, before(tail, closing))


def round6(value: Column) -> Column:
    """Six decimals, with negative zero folded into zero, for stable comparison."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)
