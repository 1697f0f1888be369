"""Periodic runs of words, by the maximal pairs of a bottom-up LCP-interval tree.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and a
length of at least ``max(MIN_WORDS, MIN_TURNS * q)`` that no neighbouring word extends with that period.
Two equal pieces of ``l`` words that start ``q`` apart, have different left neighbours and different right
neighbours (a *maximal pair*) and satisfy ``q + l >= max(MIN_WORDS, MIN_TURNS * q)`` span exactly such a
stretch of ``q + l`` words: neither side can be extended, so nothing has to be.  A stretch is also spanned by
pairs at multiples of its period; the least distance of a stretch is its period.

Per text: word numbers, ranks of the words' blocks of 1, 2, 4, ... words (prefix doubling) until all differ,
the suffix order with its LCP values, and the LCP-interval tree walked bottom-up with a stack.  An interval
carries its places by left word.  Where a part joins an interval, each place of the smaller side looks up the
places of the larger side that are near enough, class by class or place by place, whichever are fewer, and
never one with its own left word.  Intervals too short for any run are not opened.

Defined cases: null or empty text, or fewer than ``MIN_WORDS`` words: no run, the words joined by one blank;
repeated rows and null ids: each row by itself; an empty table gives an empty result; a text of one repeated
word costs n log n; columns of the caller are carried along, and one that has a name of the results is refused.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.llm.common import refuse, ship

#: Least length of a run in words, and in periods.
MIN_WORDS, MIN_TURNS = 6, 4

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUNS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8 (these six are the white space of bytes)."""
    return raw.split()


def _numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 1 on."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.int64, len(words))


def _pairs_of_ranks(first: np.ndarray, width: int) -> np.ndarray:
    """Ranks of blocks of ``2 * width`` words from the ranks of blocks of ``width`` words; the end of the text
    ranks behind every word."""
    n = len(first)
    behind = np.full(n, n + 1, np.int64)
    behind[:max(0, n - width)] = first[width:]
    return np.unique(first * (n + 2) + behind, return_inverse=True)[1] + 1


def _levels(numbers: np.ndarray) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... words from every place until all places differ."""
    out, width = [numbers], 1
    while out[-1].max() < len(numbers):
        out.append(_pairs_of_ranks(out[-1], width))
        width *= 2
    return out


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words from the places ``a`` and ``b`` on."""
    n = len(levels[0])
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        # a block that runs over the end differs from every other, so equal ranks are whole blocks
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (1 << k)
        a, b, total = a + step, b + step, total + step
    return total


class _Interval:
    """Places of an LCP interval, all of them in order and by left word."""

    __slots__ = ("places", "by_left")

    def __init__(self, place: int, left: int):
        self.places, self.by_left = [place], {left: [place]}


def _near(big: _Interval, left: list[int], place: int, reach: int) -> Iterator[int]:
    """Places of ``big`` at most ``reach`` away whose left word differs from that of ``place``."""
    low, high = bisect_left(big.places, place - reach), bisect_left(big.places, place + reach + 1)
    own = left[place]
    if high - low <= len(big.by_left):
        for other in big.places[low:high]:
            if left[other] != own:
                yield other
        return
    for word, places in big.by_left.items():
        if word != own:
            yield from places[bisect_left(places, place - reach):bisect_left(places, place + reach + 1)]


def _merged(into: list[int], more: list[int]) -> None:
    if len(more) < 8:
        for place in more:
            insort(into, place)
    else:
        into += more
        into.sort()  # two ordered parts: one merge


def _joined(a: _Interval, b: _Interval, length: int, left: list[int], least_words: int, least_turns: int,
            found: dict[tuple[int, int], int]) -> _Interval:
    """Both parts as one; their maximal pairs of ``length`` words are noted in ``found``."""
    big, small = (a, b) if len(a.places) >= len(b.places) else (b, a)
    reach = length // (least_turns - 1)
    for place in small.places:
        for other in _near(big, left, place, reach):
            period = abs(other - place)
            if period + length >= least_words:
                start = min(place, other)
                key = start, start + period + length
                if period < found.get(key, period + 1):
                    found[key] = period
    for word, places in small.by_left.items():
        if word in big.by_left:
            _merged(big.by_left[word], places)
        else:
            big.by_left[word] = places
    _merged(big.places, small.places)
    return big


def runs_of(words: list[bytes], least_words: int = MIN_WORDS, least_turns: int = MIN_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < least_words:
        return []
    numbers = _numbered(words)
    # the shortest repeated piece of any run: distance q, length l, q + l >= least_words, l >= (turns - 1) * q
    least = min(max(least_words - q, (least_turns - 1) * q) for q in range(1, least_words + 1))
    levels = _levels(numbers)
    if len(levels) <= 1 or (1 << (len(levels) - 1)) < least:
        return []  # no piece of that length occurs twice
    order = np.argsort(levels[-1])
    common = _common(levels, order[:-1], order[1:])
    near = np.flatnonzero(common >= least)
    if not len(near):
        return []
    left = np.empty(n, np.int64)
    left[0], left[1:] = 0, numbers[:-1]
    left = left.tolist()
    found: dict[tuple[int, int], int] = {}
    # places outside the intervals that are long enough are never looked at
    wanted = np.zeros(n, bool)
    wanted[near], wanted[near + 1] = True, True
    rows = np.flatnonzero(wanted)
    ups = np.where(rows < n - 1, np.append(common, 0)[rows], 0).tolist()
    stack: list[list] = []
    for place, up in zip(order[rows].tolist(), ups):
        part = _Interval(place, left[place])
        while stack and stack[-1][0] > up:
            length, other = stack.pop()
            part = _joined(other, part, length, left, least_words, least_turns, found)
        if up < least:
            continue
        if stack and stack[-1][0] == up:
            stack[-1][1] = _joined(stack[-1][1], part, up, left, least_words, least_turns, found)
        else:
            stack.append([up, part])
    return sorted((start, end - start, period) for (start, end), period in found.items())


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def collapsed(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed",
              min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> DataFrame:
    """``docs`` with the runs of every whole text (array of start, length, period, by start, then period) and
    the text with every run cut to its first period, its words joined by one blank."""
    if min_turns < 2 or min_words < 1:
        raise ValueError("a run needs two periods at least, and a word")
    refuse(docs, runs_col, collapsed_col)
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(runs_col, T.ArrayType(RUN)), T.StructField(collapsed_col, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            runs, cut = [], []
            for text in texts:
                words = words_of(text.as_py() or b"")
                own = runs_of(words, min_words, min_turns)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                cut.append(b" ".join(kept_words(words, own)))
            made = [pa.array(runs, _RUNS_ARROW), pa.array(cut, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, runs_col, collapsed_col])

    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a["start"].isNull() | (y > x), b).otherwise(a)  # runs come by start, then period

    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda acc, r: F.when(acc.isNull(), r).otherwise(better(acc, r)))
