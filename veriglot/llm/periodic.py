"""Runs of periodic repetition among the words of a text, found on a harmonic grid.

For each period p, the longest common extensions of the places jp and (j+1)p are taken forwards and backwards: a run of
period p is at least 2p long, so it holds two neighbouring places of the grid, and the two extensions give its ends.
The grid of n words has about n ln n pairs. Extensions are range minima over the longest common prefixes of neighbours in
a suffix array, for the text and for the reversed text. A pair whose words differ, or whose neighbours differ on both
sides, extends over one word at most: where that is too short for a run, it needs no lookup; texts without any other pair need no suffix array.

A slice of whole documents is handled at a time, with numpy. Suffixes are ordered inside their documents only, so that
copies of a document cost nothing extra. Memory grows with the longest text, by about 300 bytes a word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, text_or_empty, with_id

#: Words of the shortest run; grid pairs looked at together; places of a block of the range minima.
SHORTEST, PAIRS, BLOCK = 12, 1 << 20, 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Minima:
    """Range minima of an array: prefixes and suffixes of blocks, and a sparse table over the blocks' minima."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.grid = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.grid[: len(values)] = values
        self.grid = self.grid.reshape(blocks, BLOCK)
        self.up = np.minimum.accumulate(self.grid, 1).ravel()
        self.down = np.minimum.accumulate(self.grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [self.grid.min(1)]
        while 2 << (len(self.table) - 1) <= blocks:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.down[low], self.up[high])
        same = np.flatnonzero(a == b)
        if len(same):
            places = np.arange(BLOCK)
            outside = (places < (low[same] % BLOCK)[:, None]) | (places > (high[same] % BLOCK)[:, None])
            out[same] = np.where(outside, np.iinfo(np.int32).max, self.grid[a[same]]).min(1)
        far = np.flatnonzero(b - a > 1)
        level = np.frexp((b - a)[far] - 1)[1] - 1
        for k in np.unique(level):
            some = far[level == k]
            out[some] = np.minimum(out[some], np.minimum(self.table[k][a[some] + 1], self.table[k][b[some] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions inside the documents of a slice. values holds each document's words as numbers, followed
    by one place that no other equals; first is the document's number at each place."""

    def __init__(self, values: np.ndarray, document: np.ndarray):
        n = len(values)
        key = document.astype(np.int64) * (int(values.max(initial=0)) + 1) + values
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        sizes = np.diff(starts, append=n)
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(starts, sizes)
        levels, width, active = [rank], 1, order[np.repeat(sizes, sizes) > 1]
        while len(active):
            group, then = rank[active], rank[active + width]
            by = np.lexsort((then, group))
            active, group, then = active[by], group[by], then[by]
            heads = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(then, prepend=-1) != 0))
            outer = np.flatnonzero(np.diff(group, prepend=-1))
            place = np.repeat(heads, np.diff(heads, append=len(active))) - np.repeat(outer, np.diff(outer, append=len(active)))
            rank = rank.copy()
            rank[active] = group + place
            sizes = np.diff(heads, append=len(active))
            active, width = active[np.repeat(sizes, sizes) > 1], 2 * width
            levels.append(rank)
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        x, y = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n, np.int32)  # of each suffix with the one before it
        for k in range(len(levels) - 1, -1, -1):
            step = np.where(levels[k][x] == levels[k][y], 1 << k, 0)
            common[1:] += step.astype(np.int32)
            x += step
            y += step
        self.minima = Minima(common)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on; x and y differ."""
        a, b = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        return self.minima.between(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


@lru_cache(256)
def _grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of n words for periods from low up to high, excluded: left places and periods."""
    periods = np.arange(low, high)
    times = (n - 1) // periods
    period = np.repeat(periods, times)
    ends = np.cumsum(times)
    return (np.arange(len(period)) - np.repeat(ends - times, times)) * period, period


def _candidates(words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Left places and periods of the pairs of a document that may lie in a run."""
    n, found, low = len(words), [], 1
    while low <= n // 2:
        high = min(n // 2 + 1, low + max(1, PAIRS * low // n)) if n > 4_000 else n // 2 + 1
        x, p = _grid(n, low, high) if n <= 4_000 else _grid.__wrapped__(n, low, high)
        y = x + p
        some = np.flatnonzero(words[x] == words[y])
        x, p, y = x[some], p[some], y[some]
        near = (words[np.minimum(x + 1, n - 1)] == words[np.minimum(y + 1, n - 1)]) & (y + 1 < n) | (words[x - 1] == words[y - 1]) & (x > 0)
        near |= np.maximum(shortest - p, p) < 2
        found.append((x[near], p[near]))
        low = high
    return np.concatenate([x for x, _ in found] or [np.empty(0, np.int64)]), np.concatenate([p for _, p in found] or [np.empty(0, np.int64)])


def find_runs(documents: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each document (its words as numbers from 1 on), an array of rows start, length, period by start, then period."""
    places, found = [], {}
    for d, words in enumerate(documents):
        x, p = _candidates(words, shortest) if len(words) >= shortest else (np.empty(0, np.int64),) * 2
        if len(x):
            found[d] = x, p
            places.append(words)
    out = [np.empty((0, 3), np.int64) for _ in documents]
    if not found:
        return out
    values = np.concatenate([np.append(w, 0) for w in places])
    number = np.repeat(np.arange(len(places)), [len(w) + 1 for w in places])
    forward = Extensions(values, number)
    backward = Extensions(np.concatenate([np.append(w[::-1], 0) for w in places]), number)
    at = 0
    for (d, (x, p)), words in zip(found.items(), places, strict=True):
        n, runs = len(words), []
        for i in range(0, len(x), PAIRS):
            left, period = x[i : i + PAIRS], p[i : i + PAIRS]
            right = left + period
            ahead = forward.of(at + left, at + right)
            behind = backward.of(at + n - left, at + n - right)  # the place before x is n - x in the reversed text
            start, end = left - behind, right + ahead
            long = end - start >= np.maximum(shortest, 2 * period)
            runs.append(np.unique(np.stack([start[long], end[long], period[long]], 1), axis=0))
        rows = np.unique(np.concatenate(runs), axis=0)  # by start, end, period: the smallest period is the run's own
        rows = rows[np.any(np.diff(rows[:, :2], axis=0, prepend=-1), axis=1)] if len(rows) else rows
        rows[:, 1] -= rows[:, 0]
        out[d] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        at += n + 1
    return out


def _start(shortest: int) -> Callable[[], Callable[[pa.RecordBatch], list]]:
    def columns(batch: pa.RecordBatch) -> list:
        number = defaultdict(count(1).__next__)
        texts = [WORD.findall(t) for t in batch.column(1).to_pylist()]
        runs = find_runs([np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts], shortest)
        kept = []
        for words, rows in zip(texts, runs, strict=True):
            if len(rows):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            kept.append(" ".join(words))
        each = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        ends = np.cumsum([0, *map(len, runs)])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(each[:, i]) for i in range(3)], ["start", "length", "period"]))
        return [batch.column(0), [len(words) for words in texts], listed, kept]

    return lambda: columns


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row for each row of docs: id, n_words, runs (start, length, period in words, by start, then period) and
    collapsed (the words that no run holds after its first period, joined by one space). A run is a stretch of at least
    `shortest` words and two periods that no neighbouring word extends; its period is the smallest. Null and empty texts
    have no words, no runs and an empty collapsed text; so have texts shorter than `shortest` no runs. Rows that repeat,
    share an id or have none are handled each; other columns stay behind, whatever their names. A text is never cut."""
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(f"`{text_col}`").alias("text"))
    return map_slices(texts, with_id(docs, id_col, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"), 1, _start(shortest))


def greatest(runs: str = "runs") -> list:
    """Columns start, length, period and exponent_milli of the run with the greatest length (ties: smallest start, then
    period); null where there is none."""
    top = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return [(-top["start"]).alias("start"), top["length"].alias("length"), (-top["period"]).alias("period"), F.floor(1000 * top["length"] / -top["period"]).cast("long").alias("exponent_milli")]
