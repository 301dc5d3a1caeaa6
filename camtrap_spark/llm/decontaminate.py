"""Benchmark decontamination: pigeonhole edit matching.

A test item of m characters may differ from a passage by k = floor(rate * m) edits. It is split into k + 1
pieces; a passage within k edits holds at least one piece unchanged. One automaton finds all pieces of all items
in each document; the text around a hit is verified with Myers' bit-parallel distance. Texts and items are
lower-cased and runs of white space become one space. Items that the rate allows no edit (of less than 1 / rate
characters) are found where they stand unchanged as whole words.

The items are taken in blocks of a bounded number of characters, each broadcast by itself, so that a benchmark
of any size works with one block on the driver at a time; documents are never collected or shuffled.

Defined results: null and empty texts match nothing; null items, null item ids and items that are empty after
normalisation are left out. Repeated documents give a row each; of items of the same id the one of the smallest
distance counts, of these the one that is found first. Of several places of the same distance the first is reported.
Ids keep their types.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, pieces

RATE = 0.08
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def cut_item(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    n = k + 1
    bounds = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The smallest edit distance of the pattern to any substring of text, and the first end where it is reached."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        up = minus | (~(d0 | plus) & full)
        down = d0 & plus
        if up & high:
            distance += 1
        elif down & high:
            distance -= 1
        up = up << 1 & full  # a match may begin anywhere in the text
        down = down << 1 & full
        plus = down | (~(d0 | up) & full)
        minus = up & d0
        if distance < best:
            best, at = distance, j
    return best, at


class Matcher:
    """The pieces of a block of items; built once in each worker."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        budget = [int(rate * len(text)) for _, text in items]
        self.items = [(key, text, k, masks_of(text), masks_of(text[::-1])) for (key, text), k in zip(items, budget)]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in cut_item(text, budget[i]):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int, int]] = {}

    def verify(self, i: int, window: str) -> tuple[int, int, int]:
        """Distance, start and end of the best passage of the window."""
        if (i, window) in self.seen:
            return self.seen[i, window]
        _, text, _, masks, back = self.items[i]
        exact = window.find(text)
        if exact >= 0:
            out = 0, exact, exact + len(text)
        else:
            distance, end = myers(masks, len(text), window)
            out = distance, max(0, end - myers(back, len(text), window[:end][::-1])[1]), end
        if len(self.seen) > 20_000:
            self.seen.clear()
        self.seen[i, window] = out
        return out

    def match(self, document: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end in the normalised text) of the best place of each item."""
        text = normal(document)
        best: dict[object, tuple[int, int, int]] = {}
        spans: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                key, item, k, _, _ = self.items[i]
                start = end + 1 - length - offset
                if not k:
                    if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                        best[key] = min(best.get(key, (1, 0, 0)), (0, start, end + 1))
                    continue
                low, high = max(0, start - k), min(len(text), start + len(item) + k)
                mine = spans.setdefault(i, [])
                if mine and low <= mine[-1][2]:  # hits of one passage: one window
                    mine[-1][1] = max(mine[-1][1], high)
                    mine[-1][0] = min(mine[-1][0], low)
                    mine[-1][2] = max(mine[-1][2], start + k)
                else:
                    mine.append([low, high, start + k])
        for i, windows in spans.items():
            key, item, k, _, _ = self.items[i]
            for low, high, _ in windows:
                if high - low < len(item) - k:
                    continue
                distance, a, b = self.verify(i, text[low:high])
                if distance <= k:
                    best[key] = min(best.get(key, (k + 1, 0, 0)), (distance, low + a, low + b))
        return [(key, *best[key]) for key in sorted(best)]


def item_blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The normalised items in blocks of `block_chars` characters (more only where one id has more), in the order of their ids; one block is held at a time."""
    block, chars = [], 0
    for k, t in benchmark.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").orderBy("key", "text").toLocalIterator():
        t = normal(t)
        if not t:
            continue
        if block and chars + len(t) > block_chars and block[-1][0] != k:  # items of one id stay together
            yield block
            block, chars = [], 0
        if not block or block[-1] != (k, t):
            block.append((k, t))
            chars += len(t)
    if block:
        yield block


_matchers: dict[int, tuple[list, Matcher]] = {}


def matcher_of(shared, rate: float) -> Matcher:
    """The worker's matcher for this block; the block is kept with it, so that its id stays its own."""
    block = shared.value
    if id(block) not in _matchers:
        _matchers.clear()
        _matchers[id(block)] = block, Matcher(block, rate)
    return _matchers[id(block)][1]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item found in it: key, item_id, distance, start and end in the normalised text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    item_type = benchmark.schema[item_key].dataType
    schema = docs.select(F.col(key)).schema.add("item_id", item_type).add("distance", "long").add("start", "long").add("end", "long")
    out = None
    for block in item_blocks(benchmark, item_key, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher, item_ids = matcher_of(shared, rate), to_arrow_type(item_type)
            for batch in batches:
                for part in pieces(batch, "text"):
                    at, found = [], []
                    for i, t in enumerate(part.column("text").to_pylist()):
                        for match in matcher.match(t):
                            at.append(i)
                            found.append(match)
                    columns = [pa.array([f[j] for f in found], pa.int64()) for j in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(at, pa.int64())), pa.array([f[0] for f in found], item_ids), *columns], names=[key, "item_id", "distance", "start", "end"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows without text stay."""
    bound_batches(docs.sparkSession)
    out = docs
    for block in item_blocks(benchmark, "item_id", "text", block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(shared, rate)
            for batch in batches:
                for part in pieces(batch, text):
                    yield part.filter(pa.array([t is None or not matcher.match(t) for t in part.column(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
