"""Periodic runs of words, by longest common extensions on a difference cover.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST_WORDS, 2q)``
long, that no neighbouring word extends. Word i repeats with period q where words i and i + q
are equal; a run of period q is a stretch of such places, at least q of them, so it holds a
multiple of q. For every q only those multiples are looked at, a harmonic number of places
in all: n/1 + n/2 + n/3 ... From each place the stretch is measured by two longest common
extensions, ahead and, on the reversed words, back.

An extension of (i, j) needs no suffix array of all words. Of every ``PERIOD`` neighbouring
suffixes only those in ``COVER`` are sorted. For any i and j some shift below ``PERIOD`` brings
both into the cover, so at most that many words are compared, and the rest is the
smallest of the common prefixes of neighbours in sorted order, from a sparse table.

Texts are handled in blocks of about ``BLOCK_WORDS`` words, each text closed by a number of
its own, so that extensions end there; a longer text is a block alone, and no text is cut.
Memory follows the block: about 5 numbers a word, besides the places of one turn.

Defined results: a null, empty or blank text has no runs and collapses to the empty text.
Texts do not depend on each other, so repeated rows and ties need no rule; the runs of a text are ordered
by start, then period, and at most one run has a start and a length. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.llm.words import texts_of

LEAST_WORDS = 12
BLOCK_WORDS = 1 << 16
#: Places looked at in one turn.
TURN = 1 << 20
# A perfect difference set; each difference modulo 31 occurs once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


def _shifts() -> np.ndarray:
    """Smallest shift that brings residues i and j into the cover together."""
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    at = np.arange(PERIOD)
    for shift in reversed(range(PERIOD)):
        inside = member[(at + shift) % PERIOD]
        out[np.ix_(inside, inside)] = shift
    return out


_SHIFTS = _shifts()


class Extensions:
    """Longest common extensions of a sequence whose last value occurs once."""

    def __init__(self, words: np.ndarray):
        # Past the end nothing is compared: of two places one meets the last value first.
        self.words = np.concatenate([words, np.full(2 * PERIOD, -1, words.dtype)])
        rounds = -(-words.size // PERIOD)
        self.sampled = (np.arange(rounds)[:, None] * PERIOD + np.array(COVER)).ravel()
        self.place = np.full(rounds * PERIOD, -1, np.int64)
        self.place[self.sampled] = np.arange(self.sampled.size)
        levels = self._sort()
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(order.size, np.int64)
        self.rank[order] = np.arange(order.size)
        self._table(self._neighbours(levels, order))

    def _sort(self) -> list[np.ndarray]:
        """Names of sampled suffixes by their first 31, 62, 124 ... words, until all differ."""
        at = self.sampled[:, None] + np.arange(PERIOD)
        held = np.concatenate([self.words, np.full(PERIOD, -1, self.words.dtype)])
        # Big-endian bytes compare like the numbers; one is added so that none is negative.
        blocks = np.ascontiguousarray((held[at] + 1).astype(">u4")).view(f"V{4 * PERIOD}").ravel()
        names = np.unique(blocks, return_inverse=True)[1].astype(np.int64)
        levels, step = [names], len(COVER)
        while step < names.size and names.max() + 1 < names.size:
            ahead = np.zeros(names.size, np.int64)
            ahead[:-step] = names[step:] + 1
            names = np.unique(names * (names.size + 1) + ahead, return_inverse=True)[1]
            levels.append(names)
            step *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common prefix of each sampled suffix and the next one in sorted order."""
        left, right = order[:-1].copy(), order[1:].copy()
        common = np.zeros(left.size, np.int64)
        for level in reversed(range(len(levels))):
            names, step = levels[level], len(COVER) << level
            inside = (left < names.size) & (right < names.size)
            same = np.zeros(left.size, bool)
            same[inside] = names[left[inside]] == names[right[inside]]
            common[same] += PERIOD << level
            left[same] += step
            right[same] += step
        inside = np.flatnonzero((left < self.sampled.size) & (right < self.sampled.size))
        i, j = self.sampled[left[inside]], self.sampled[right[inside]]
        common[inside] += self._compare(i, j, np.full(i.size, PERIOD))
        return common

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``limit`` of them."""
        out = np.zeros(i.size, np.int64)
        live = np.flatnonzero(limit > 0)
        for k in range(PERIOD):
            live = live[(limit[live] > k) & (self.words[i[live] + k] == self.words[j[live] + k])]
            if not live.size:
                break
            out[live] = k + 1
        return out

    def _table(self, common: np.ndarray) -> None:
        """Smallest value of every window of 1, 2, 4 ... neighbours."""
        self.minima, width = [common], 1
        while 2 * width <= common.size:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair of different places."""
        shift = _SHIFTS[i % PERIOD, j % PERIOD]
        out = self._compare(i, j, shift)
        deep = np.flatnonzero(out == shift)
        x, y = i[deep] + shift[deep], j[deep] + shift[deep]
        inside = (x < self.place.size) & (y < self.place.size)
        deep, x, y = deep[inside], x[inside], y[inside]
        left, right = self.rank[self.place[x]], self.rank[self.place[y]]
        low, high = np.minimum(left, right), np.maximum(left, right)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            now = np.flatnonzero(level == k)
            table = self.minima[k]
            out[deep[now]] += np.minimum(table[low[now]], table[high[now] - (1 << int(k))])
        return out


def _grids(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) for all periods of all texts and all their multiples, in turns."""
    most = sizes // 2
    owner = np.repeat(np.arange(sizes.size), most)
    period = np.arange(owner.size) - np.repeat(np.cumsum(most) - most, most) + 1
    # Places 0, q, 2q ... whose partner, q words on, is still inside.
    count = (sizes[owner] - 1) // period
    ends = np.cumsum(count)
    start = 0
    while start < owner.size:
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + TURN, "right")))
        own = np.repeat(np.arange(start, stop), count[start:stop])
        nth = np.arange(own.size) - np.repeat(ends[start:stop] - count[start:stop] - held, count[start:stop])
        yield owner[own], period[own], nth * period[own]
        start = stop


def block_runs(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of some texts, in this order.

    ``numbers`` are the words of all texts as numbers from 0, one text after another.
    """
    firsts = np.cumsum(sizes) - sizes
    words = np.zeros(numbers.size + sizes.size, np.int64)
    begins = firsts + np.arange(sizes.size)
    ends = begins + sizes
    is_word = np.ones(words.size, bool)
    is_word[ends] = False
    words[is_word] = numbers
    words[ends] = (numbers.max() + 1 if numbers.size else 0) + np.arange(sizes.size)
    ahead = back = None
    found = []
    for text, period, place in _grids(sizes):
        i = begins[text] + place
        same = np.flatnonzero(words[i] == words[i + period])
        if not same.size:
            continue
        if ahead is None:
            ahead = Extensions(words)
            # Reversed, each text ends with the number that closes the text before it.
            back = Extensions(np.append(words[::-1][1:], words[-1]))
        text, period, i = text[same], period[same], i[same]
        more = ahead.of(i, i + period)
        # The word before place i, counted from the end of the reversed words.
        less = back.of(words.size - 1 - i, words.size - 1 - i - period)
        long = np.flatnonzero(more + less >= np.maximum(period, LEAST_WORDS - period))
        found.append(np.stack([
            text[long], (i - less - begins[text])[long], (more + less + period)[long], period[long],
        ], axis=1))
    if not found:
        return np.empty((0, 4), np.int64)
    rows = np.concatenate(found)
    # Several places lie in one run; of periods with the same stretch the smallest is the run's.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _blocks(split: list[list[bytes]]) -> Iterator[slice]:
    start = held = 0
    for k, words in enumerate(split):
        if held and held + len(words) > BLOCK_WORDS:
            yield slice(start, k)
            start, held = k, 0
        held += len(words)
    if start < len(split):
        yield slice(start, len(split))


def find(texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """(start, length, period) of all runs of each text, and the text without repetitions."""
    split = [text.split() for text in texts]
    for part in _blocks(split):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        sizes = np.array([len(words) for words in split[part]], np.int64)
        each = (i for words in split[part] for i in map(number.__getitem__, words))
        numbers = np.fromiter(each, np.int64, int(sizes.sum()))
        rows = block_runs(numbers, sizes)
        cuts = np.searchsorted(rows[:, 0], np.arange(sizes.size + 1))
        for k, words in enumerate(split[part]):
            runs = rows[cuts[k] : cuts[k + 1], 1:]
            yield runs, b" ".join(collapsed(words, runs))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


@F.arrow_udf(RESULT)
def _runs(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        found = list(find(texts_of(column)))
        counts = np.array([len(runs) for runs, _ in found], np.int64)
        rows = np.concatenate([runs for runs, _ in found] or [np.empty((0, 3), np.int64)])
        items = pa.StructArray.from_arrays(
            [pa.array(rows[:, k], pa.int64()) for k in range(3)], names=["start", "length", "period"]
        )
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), items)
        texts = pa.array([text for _, text in found], pa.binary()).cast(pa.string())
        yield pa.StructArray.from_arrays([lists, texts], names=["runs", "collapsed"])


def runs(text: Column) -> Column:
    """Struct of the runs of a text and the text collapsed, see ``RESULT``."""
    return _runs(text)


def rewrite(doc_id: int | None, text: bytes) -> bytes:
    """Make the words of one text in ten periodic from some place on; the rest stays as it is."""
    if doc_id is None:
        return text
    hashed = zlib.crc32(str(doc_id).encode())
    if hashed % 10:
        return text
    words, rest = text.split(), hashed // 10
    if not words:
        return text
    first = rest % len(words)
    period = 1 + (len(words) - first) // (3 + rest % 8)
    head, cycle = words[:first], words[first : first + period]
    return b" ".join(head + [cycle[i % period] for i in range(len(words) - first)])


@F.arrow_udf(T.StringType())
def _rewritten(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ids, texts in columns:
        rows = zip(ids.to_pylist(), texts_of(texts), strict=True)
        yield pa.array([rewrite(i, text) for i, text in rows], pa.binary()).cast(pa.string())


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text with repetitions planted by the id, see ``rewrite``; null texts become empty."""
    return _rewritten(doc_id, text)
