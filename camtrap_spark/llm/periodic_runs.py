"""Periodic runs of words, found online by catching squares with dyadic blocks.

A run is a stretch of words with smallest period q, at least `exponent` times as long as q, that no neighbouring word
extends. Words are appended in portions of any size. At level j every completed block of 2^j words is a catcher: it
waits for its words to come again at a distance of that level, and each appended word advances the comparison of the
last 2^j words with the catcher that their distance selects (there is one at most for exponents from 4 on). A level's
distances are those whose runs are sure to hold one of its blocks together with the block's repetition. Words of the
last 2^j are compared by a hash that the level makes of two hashes of the level below, so a word costs a few steps a
level. A catch is a square's seed. Seeds inside a known stretch whose period divides their distance belong to it; others
of one distance with equal words between them merge and are extended word by word, and a stretch that reaches the last
word goes on with the next ones. So a long run is followed once and not by each multiple of its period.

The documents of a slice are appended one after the other with a word between them that is like no other. Words are
their 64-bit hashes; which words a run holds is decided by comparing words, not by the hashes of blocks.

Defined results: a null text is empty and has no runs; a text of one very long run, or without white space, is like any
other; white space is [\\x20\\x09-\\x0D]. Repeated rows repeat. Memory follows the slice (`SLICE_BYTES`) or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import NOT_SPACE, bound_batches, mix, pieces, running, span_hashes, utf8, words

#: Words that are appended at a time.
PORTION = 1 << 17
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Tail:
    """The last values of a growing array."""

    def __init__(self):
        self.first, self.values = 0, np.zeros(0, np.uint64)

    @property
    def end(self) -> int:
        return self.first + len(self.values)

    def add(self, values: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values])

    def forget(self, before: int) -> None:
        if before > self.first:
            self.values, self.first = self.values[before - self.first :], before

    def __getitem__(self, where: slice) -> np.ndarray:
        return self.values[where.start - self.first : where.stop - self.first]


class Catchers:
    """Catches squares in a growing list of words. append: more words; runs: what they hold so far.

    longest: no run is longer, so that higher levels are left out.
    """

    def __init__(self, exponent: int = 4, least: int = 6, longest: int | None = None):
        if exponent < 2:
            raise ValueError("a run is at least a square")
        self.exponent, self.least, self.longest = exponent, least, longest
        self.words, self.n = np.zeros(1024, np.uint64), 0
        self.levels = [Tail()]  # level j: hashes of 2^j words, by where they begin
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))  # stretches; those that end at n are open

    def distances(self, j: int) -> tuple[int, int]:
        """The smallest and largest distance of level j; a run of distance q holds a block and its repetition if 2^(j+1) - 1 <= (exponent - 1) q."""
        low = lambda level: -(-((2 << level) - 1) // (self.exponent - 1))
        return low(j), low(j + 1) - 1

    def append(self, portion: np.ndarray) -> None:
        """portion: 64-bit hashes of words, in order."""
        if not len(portion):
            return
        before, self.n = self.n, self.n + len(portion)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:before], np.zeros(max(self.n, 2 * before) - before, np.uint64)])
        self.words[before : self.n] = portion
        self.go_on(before)
        self.levels[0].add(portion)
        self.catch(0, before)
        j = 1
        while min(self.n, self.longest or self.n) >= self.exponent * self.distances(j)[0]:
            if len(self.levels) == j:
                self.levels.append(Tail())
            size, below, here = 1 << j, self.levels[j - 1], self.levels[j]
            first, last = here.end, self.n - size + 1
            with np.errstate(over="ignore"):
                hashes = below[slice(first, last)] * (SPREAD + np.uint64(2 * j)) + below[slice(first + size // 2, last + size // 2)]
                hashes ^= hashes >> np.uint64(29)
            here.add(hashes)
            self.catch(j, first)
            j += 1
        for level, tail in enumerate(self.levels[: len(self.levels) - 1]):  # what catchers and the next level still need
            tail.forget(self.n - (4 << level) - self.distances(level)[1])

    def long_enough(self) -> np.ndarray:
        return self.end - self.start >= np.maximum(self.least, self.exponent * self.period)

    def go_on(self, before: int) -> None:
        """Extends the stretches that were open before the last words came; drops those that end too short."""
        open_ = np.flatnonzero(self.end == before)
        q = self.period[open_]
        self.end[open_] = advance(self.words[: self.n], before - q, q, np.full(len(q), self.n), 1) + q
        self.hold((self.end == self.n) | self.long_enough())

    def hold(self, which: np.ndarray) -> None:
        self.start, self.end, self.period = self.start[which], self.end[which], self.period[which]

    def catch(self, j: int, first: int) -> None:
        """Compares the words that begin from `first` on with the catchers of level j."""
        (low, high), tail = self.distances(j), self.levels[j]
        end = np.arange(max(first, low), tail.end)
        if low > high or not len(end):
            return
        block = ((end - low) >> j) << j
        while True:
            fits = end - block <= high
            end, block = end[fits], block[fits]
            if not len(end):
                return
            equal = tail.values[end - tail.first] == tail.values[block - tail.first]
            if equal.any():
                self.merge(block[equal], (end - block)[equal], 1 << j)
            block = block - (1 << j)
            end, block = end[block >= 0], block[block >= 0]

    def merge(self, at: np.ndarray, q: np.ndarray, size: int) -> None:
        """Seeds: blocks of `size` words at `at` that come again q later. Those inside a stretch whose period divides q are a part of it; the others are merged and extended."""
        if len(self.start):
            i = np.searchsorted(self.start, at, side="right") - 1
            new = (i < 0) | (self.end[i] < at + q + size) | (q % self.period[i] != 0)
            at, q = at[new], q[new]
        if not len(at):
            return
        w = self.words[: self.n]
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        same = q[1:] == q[:-1]
        ends = advance(w, at, q, np.append(np.where(same, at[1:], len(w)), len(w)), 1)
        follows = np.append(False, same & (ends[:-1] == at[1:]))  # merged with the seed before
        firsts = np.flatnonzero(~follows)
        lasts = np.append(firsts[1:], len(at)) - 1
        start = advance(w, at[firsts] - 1, q[firsts], np.full(len(firsts), -1), -1) + 1
        self.start, self.end, self.period = np.append(self.start, start), np.append(self.end, ends[lasts] + q[firsts]), np.append(self.period, q[firsts])
        self.hold((self.end == self.n) | self.long_enough())
        self.hold(np.lexsort((-self.period, self.start)))  # of equal starts the smallest period last, where seeds look

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and period of every run, by start, then period."""
        long = self.long_enough()
        start, end, period = self.start[long], self.end[long], self.period[long]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
        start, end, period = start[first], end[first], period[first]  # the smallest period of a stretch
        order = np.lexsort((period, start))
        return start[order], (end - start)[order], period[order]


def advance(w: np.ndarray, at: np.ndarray, q: np.ndarray, until: np.ndarray, step: int) -> np.ndarray:
    """From each position on, in steps of 1 or -1, the first where the word differs from that q later, or `until`."""
    out = until.copy()
    active, x, width = np.arange(len(at)), at.copy(), 8
    while len(active):
        span = x[:, None] + step * np.arange(width)[None, :]
        inside = (span < np.minimum(until[active], len(w) - q[active])[:, None]) if step > 0 else span > until[active][:, None]
        safe = np.where(inside, span, 0)
        stop = ~inside | (w[safe] != w[np.minimum(safe + q[active][:, None], len(w) - 1)])
        hit = stop.any(axis=1)
        place = x[hit] + step * stop[hit].argmax(axis=1)
        out[active[hit]] = np.minimum(place, until[active[hit]]) if step > 0 else np.maximum(place, until[active[hit]])
        active, x = active[~hit], x[~hit] + step * width
        width = min(width * 2, max(8, (1 << 20) // max(1, len(active))), 1 << 14)
    return out


def runs_of(hashes: np.ndarray, sizes: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of the runs of several texts; sizes: their numbers of words."""
    first = np.cumsum(sizes) - sizes
    where = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)  # a word of its own stands after each text
    joined = mix(np.arange(1, len(hashes) + len(sizes) + 1, dtype=np.uint64) * SPREAD)
    joined[where] = hashes
    catchers = Catchers(exponent, least, max(1, int(sizes.max(initial=0))))
    for a in range(0, len(joined), PORTION):
        catchers.append(joined[a : a + PORTION])
    start, length, period = catchers.runs()
    begins = first + np.arange(len(sizes))
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start - begins[text], length, period


def periodic_runs(rows: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """key, runs (start, length and period in words, by start, then period) and collapsed: the words that are left, joined by a space.

    A word is left out if a run holds it after that run's first period.
    """
    bound_batches(rows.sparkSession)
    taken = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one_slice(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(part.column("text"))
        starts, ends, of = words(data, offsets, NOT_SPACE)
        sizes = np.bincount(of, minlength=part.num_rows) if len(of) else np.zeros(part.num_rows, np.int64)
        doc, start, length, period = runs_of(span_hashes(running(data), starts, ends), sizes, exponent, least)
        first = np.cumsum(sizes) - sizes
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, first[doc] + start + period, 1)
        np.add.at(change, first[doc] + start + length, -1)
        left = np.cumsum(change[:-1]) == 0
        raw, collapsed = data.tobytes(), []
        cut = np.zeros(part.num_rows, dtype=bool)
        cut[doc] = True
        for i in range(part.num_rows):
            if cut[i]:
                some = first[i] + np.flatnonzero(left[first[i] : first[i] + sizes[i]])
                collapsed.append(b" ".join([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]))
            else:
                collapsed.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
        counts = np.bincount(doc, minlength=part.num_rows)
        structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(run_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), structs)
        return pa.RecordBatch.from_arrays([part.column("key"), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield one_slice(part)

    one = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    schema = taken.select("key").schema.add("runs", ArrayType(one)).add("collapsed", StringType())
    return taken.mapInArrow(run, schema).withColumnRenamed("key", key)
