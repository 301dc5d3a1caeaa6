"""LM scoring by logistic context mixing.

A text is read as its lower-cased (A-Z) UTF-8 bytes and one end symbol, cut into units: a word, which may be empty, and
the separator or end after it. Each symbol is a path of binary decisions in a prefix code, and each decision is
predicted by several hashed contexts: the last two bytes, the last four bytes, and the whole word so far; at the first
symbol of a unit these are the last bytes and the word of the unit before, at later symbols they stay inside the unit.
Every context owns a table of bit counts with a fixed number of slots; their predictions, in the logistic domain, are
mixed by a weight vector that a gate chooses (the depth of the decision, the class of the byte before, and how sure
the word is), and the mix is refined by an adaptive probability map over quantised predictions. The weights of each
gate are those of a logistic regression over all its bits, found by Newton's steps; the map then counts how often each
prediction comes true. As a unit's contexts depend on it and on the unit before alone, a task evaluates each distinct
unit, and each distinct pair of a unit and the first symbol after it, once.

What the corpus repeats over words is remembered by passages: units up to one whose word and the word before hash to a
border (`PASSAGE` units on average). All passages of the training texts are counted, in a table that grows with the
corpus. A passage of c occurrences has the probability (c - 1) / N + V / N * (product of its symbols' probabilities), N
all passages and V distinct ones: absolute discounting by one, so that what occurs once teaches nothing by itself.
A text's score is the sum of the log10 probabilities of its passages.

All of it is learned from all training texts, on the executors. One pass over the texts finds the distinct units, pairs
and passages of each task; they are added up over all tasks in buckets of the word's hash and written, once each, with
how often each occurred. The other passes read these: symbol counts give the prefix code, bits are counted (tables of
fixed size for each task, summed by block), `ROUNDS` passes add up gradients and curvatures by gate, and a last one the
hits of the map. What reaches the driver of a pass is a table of fixed size. A learned bit is taken out of the counts
that predict it.

The base score is exact: tokens are counted by a 64-bit hash over all training texts. The tokens with at least
N / `FREQUENT` occurrences - there cannot be more than `FREQUENT` of them - are broadcast; the counts of all
others, and those of the passages, are joined to the documents that hold them.

Defined results: a null text counts as empty: one token, the end. With no training text every token is unknown,
and N and V are 0. Rows are scored one by one, also those of equal or null keys; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import BLOCK_SCHEMA, LOWER, NOT_SPACE, bound_batches, gather_table, keep, mix, narrow, pieces, ragged, running, span_hashes, table_blocks, utf8, widen

END, PAD = 256, 257
#: Slots of each context's table: bytes of two, bytes of four, word.
TABLES = (1 << 18, 1 << 20, 1 << 21)
OFFSETS = (0, TABLES[0], TABLES[0] + TABLES[1])
CONTEXTS = len(TABLES)
#: Newton steps of the weights, each a pass over all training texts; sums travel as multiples of 1 / SUM_STEP.
ROUNDS, SUM_STEP = 1, 1 << 16
FREQUENT = 1 << 20
#: Distinct units of slices that a task holds before it counts them; slices that it holds while it scores.
KINDS_HELD, SLICES_HELD, UNITS_HELD = 400_000, 8, 4_000_000
#: Units of a passage, on average.
PASSAGE = 16
#: int8 tables hold stretch(p) * TABLE_STEP; the map's cells are MAP_STEP to a unit, up to MAP_HALF.
TABLE_STEP, MAP_STEP, MAP_HALF = 12.0, 16.0, 192
CLASSES, DEPTHS, LEVELS = 6, 24, 5
GATES, CELLS = LEVELS * DEPTHS * CLASSES, 2 * MAP_HALF + 1
SLICE = 1 << 20


# -- the prefix code -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Code:
    """For each of the 257 symbols the nodes and bits of its path, all paths in one array."""

    lengths: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    gates: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]  # count, tie, node or symbol
        heapq.heapify(heap)
        children, name = {}, END + 1
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[name] = a, b
            heapq.heappush(heap, (n + m, name, name))
            name += 1
        paths, level, ids = {}, [(heap[0][2], ())], {}
        while level:  # nodes are numbered by depth, so that the frequent ones are neighbours
            below = []
            for node, path in level:
                if node in children:
                    ids[node] = len(ids)
                    below += [(child, (*path, (ids[node], bit))) for bit, child in enumerate(children[node])]
                else:
                    paths[node] = path
            level = below
        lengths = np.array([len(paths[s]) for s in range(END + 1)])
        flat = [x for s in range(END + 1) for x in paths[s]]
        return Code(lengths, np.cumsum(lengths) - lengths, np.array([n for n, _ in flat]), np.array([b for _, b in flat]), np.concatenate([np.minimum(np.arange(k), DEPTHS - 1) * CLASSES for k in lengths]))


# -- contexts ------------------------------------------------------------------------------------------------


def byte_classes() -> np.ndarray:
    out = np.full(PAD + 1, 4, dtype=np.int64)
    out[97:123] = 0
    out[[32, 9, 10, 11, 12, 13]] = 1
    out[33:65] = 2
    out[91:97] = 2
    out[128:256] = 3
    out[END:] = 5
    return out


BYTE_CLASS = byte_classes()
SEPARATOR = np.append(~NOT_SPACE, True)


@dataclass
class Units:
    """Texts cut into units: a word, which may be empty, and the separator or end after it."""

    stream: np.ndarray
    sums: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # of each unit
    text_starts: np.ndarray  # the first symbol of each text


def units_of(data: np.ndarray, offsets: np.ndarray) -> Units:
    lengths = np.diff(offsets)
    text_starts = offsets[:-1] + np.arange(len(lengths))
    stream = np.full(len(data) + len(lengths), END, dtype=np.int64)
    stream[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
    ends = np.flatnonzero(SEPARATOR[stream]) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return Units(stream, running(stream), starts, ends, np.searchsorted(text_starts, starts, side="right") - 1, text_starts)


@dataclass
class Symbols:
    symbol: np.ndarray
    contexts: np.ndarray  # int64 [contexts, symbols]: the first slot of a symbol's decisions in each table
    before: np.ndarray  # the class of the byte before


def contexts_of(last: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        two = (last[0] << 9 | last[1]).astype(np.uint64)
        four = two | (last[2] << 18 | last[3] << 27).astype(np.uint64)
        return np.stack([((x * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(65 - size.bit_length())).astype(np.int64) for k, (x, size) in enumerate(zip((two, four, word), TABLES))])


def first_symbols(u: Units, before: np.ndarray, symbol: np.ndarray) -> Symbols:
    """A unit's first symbol, predicted by the unit of u before it (-1: none, at a text's start)."""
    there = before >= 0
    begin, end = np.where(there, u.starts[before], 0), np.where(there, u.ends[before], 0)
    last = [np.where(end - k >= begin, u.stream[np.maximum(end - k, 0)], PAD) if len(u.stream) else np.full(len(before), PAD) for k in range(1, 5)]
    last = [np.where(there, x, PAD) for x in last]
    word = np.where(there, span_hashes(u.sums, begin, np.maximum(end - 1, begin)), np.uint64(0)) ^ np.uint64(1 << 40)
    return Symbols(symbol, contexts_of(last, word), BYTE_CLASS[last[0]])


def inner_symbols(u: Units, chosen: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """All symbols but the first of the chosen units, and the number of them in each."""
    starts, sizes = u.starts[chosen], u.ends[chosen] - u.starts[chosen] - 1
    ends = np.cumsum(sizes)
    begin = np.repeat(starts, sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts + 1 - (ends - sizes), sizes)
    last = [np.where(at - k >= begin, u.stream[np.maximum(at - k, 0)], PAD) for k in range(1, 5)]
    return Symbols(u.stream[at], contexts_of(last, span_hashes(u.sums, begin, at)), BYTE_CLASS[last[0]]), sizes


@dataclass
class Bits:
    """The binary decisions of a run of symbols."""

    long: np.ndarray  # decisions of each symbol
    node: np.ndarray
    bit: np.ndarray
    gate: np.ndarray


def bits_of(s: Symbols, run: slice, code: Code) -> Bits:
    symbols = s.symbol[run]
    long = code.lengths[symbols]
    path = np.arange(int(long.sum())) + np.repeat(code.starts[symbols] - (np.cumsum(long) - long), long)
    return Bits(long, code.nodes.take(path), code.bits.take(path), code.gates.take(path) + np.repeat(s.before[run], long))


def slots_of(s: Symbols, run: slice, b: Bits, k: int) -> np.ndarray:
    slot = np.repeat(s.contexts[k, run], b.long)
    slot += b.node
    slot &= TABLES[k] - 1
    slot += OFFSETS[k]
    return slot


def level_table() -> np.ndarray:
    """How sure the word's own prediction is, by its int8 value: not seen, then ever surer."""
    return np.digitize(np.abs(np.arange(-128, 128)) / TABLE_STEP, [1e-9, 1.3, 2.6, 4.5]) * (DEPTHS * CLASSES)


LEVEL_GATE = level_table()


def runs(s: Symbols, size: int = 1 << 13) -> Iterator[slice]:
    return (slice(at, min(at + size, len(s.symbol))) for at in range(0, len(s.symbol), size))


# -- the model -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MixModel:
    code: Code
    table: np.ndarray  # int8: stretch(p) of each slot of all tables
    weights: np.ndarray  # float32 [contexts, levels * depths * classes]
    cost: np.ndarray  # float32 [classes * map cells * 2]: log10 probability of the bit


def stretch_table(counts: np.ndarray) -> np.ndarray:
    """counts: [slots, 2] of bits 0 and 1."""
    out = np.empty(len(counts), dtype=np.int8)
    for at in range(0, len(counts), 1 << 18):
        part = counts[at : at + (1 << 18)] + 0.4
        out[at : at + (1 << 18)] = np.clip(np.rint(np.log(part[:, 1] / part[:, 0]) * TABLE_STEP), -127, 127)
    return out


def stretch_without(counts: np.ndarray) -> np.ndarray:
    """For each slot and bit, what the slot predicts once that bit is taken out: int8 [slots * 2]."""
    out = np.empty((len(counts), 2), dtype=np.int8)
    for bit in (0, 1):
        out[:, bit] = stretch_table(np.maximum(counts - (np.arange(2) == bit), 0))
    return out.reshape(-1)


#: Pairs of contexts of a gate's curvature; rows of the sums: gradients, then curvatures.
PAIRS = [(j, k) for j in range(CONTEXTS) for k in range(j, CONTEXTS)]
START_WEIGHT, HOLD = 0.4, 4.0


@dataclass(frozen=True)
class Learner:
    """What a pass of learning reads."""

    code: Code
    without: np.ndarray
    weights: np.ndarray  # float32 [contexts, gates]

    def decisions(self, s: Symbols, times: np.ndarray | None) -> Iterator[tuple]:
        """Of runs of symbols: decisions, gates, int8 predictions of each context, mixed prediction, and how often each occurred."""
        for part in runs(s):
            b, found = bits_of(s, part, self.code), []
            for k in range(CONTEXTS):
                slot = slots_of(s, part, b, k)
                slot *= 2
                slot += b.bit
                found.append(self.without.take(slot))
            gate = b.gate + LEVEL_GATE.take(found[-1].astype(np.int64) + 128)
            mixed = np.zeros(len(b.bit), dtype=np.float32)
            for k in range(CONTEXTS):
                mixed += found[k] * self.weights[k].take(gate)
            yield part, b, gate, found, mixed, None if times is None else np.repeat(times[part], b.long)

    def add_slopes(self, sums: np.ndarray, s: Symbols, times: np.ndarray | None = None) -> None:
        """Adds gradients and curvatures by gate to sums: [contexts + pairs, gates]."""
        for _, b, gate, found, mixed, n in self.decisions(s, times):
            p = 1 / (1 + np.exp(np.clip(mixed * np.float32(-1 / TABLE_STEP), -12, 12)))
            error, curve = b.bit - p, p * (1 - p)
            if n is not None:
                error, curve = error * n, curve * n
            x = [f * np.float32(1 / TABLE_STEP) for f in found]
            for k in range(CONTEXTS):
                sums[k] += np.bincount(gate, weights=error * x[k], minlength=GATES)
            for row, (j, k) in enumerate(PAIRS, CONTEXTS):
                sums[row] += np.bincount(gate, weights=curve * x[j] * x[k], minlength=GATES)

    def add_hits(self, sums: np.ndarray, s: Symbols, times: np.ndarray | None = None) -> None:
        """Adds the bits of each cell of the map to sums: [classes * cells * 2]."""
        for part, b, _, _, mixed, n in self.decisions(s, times):
            sums += np.bincount(map_cells(s, part, b, mixed), weights=n, minlength=len(sums))

    def stepped(self, sums: np.ndarray) -> np.ndarray:
        """The weights after one step of Newton's; gates without bits keep theirs. Rounded, so that the order of adding does not show."""
        slope = sums[:CONTEXTS].T - HOLD * (self.weights.T - START_WEIGHT)
        curve = np.zeros((GATES, CONTEXTS, CONTEXTS))
        for row, (j, k) in enumerate(PAIRS, CONTEXTS):
            curve[:, j, k] = curve[:, k, j] = sums[row]
        curve += HOLD * np.eye(CONTEXTS)
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        return np.ascontiguousarray(np.rint((self.weights + np.clip(step, -1, 1).T) * 1024) / 1024, dtype=np.float32)


def map_cells(s: Symbols, run: slice, b: Bits, mixed: np.ndarray) -> np.ndarray:
    """The place of each decision in the cost table; mixed is overwritten."""
    mixed *= np.float32(MAP_STEP / TABLE_STEP)
    np.clip(mixed, -MAP_HALF, MAP_HALF, out=mixed)
    cell = np.rint(mixed).astype(np.int64)
    cell += np.repeat(s.before[run] * CELLS + MAP_HALF, b.long)
    cell *= 2
    cell += b.bit
    return cell


def map_costs(hits: np.ndarray) -> np.ndarray:
    """hits: [classes * cells * 2]."""
    start = 1 / (1 + np.exp(-np.arange(-MAP_HALF, MAP_HALF + 1) / MAP_STEP))
    hits = hits.reshape(CLASSES, CELLS, 2)
    p = np.clip(0.5 * start + 0.5 * (start * 20 + hits[:, :, 1]) / (20 + hits.sum(axis=2)), 2**-16, 1 - 2**-16)
    return np.log10(np.stack([1 - p, p], axis=-1)).astype(np.float32).reshape(-1)


def symbol_costs(s: Symbols, model: MixModel) -> np.ndarray:
    """log10 probability of each symbol."""
    out = np.zeros(len(s.symbol))
    for part in runs(s):
        b = bits_of(s, part, model.code)
        found = [model.table.take(slots_of(s, part, b, k)) for k in range(CONTEXTS)]
        gate = b.gate + LEVEL_GATE.take(found[-1].astype(np.int64) + 128)
        mixed = np.zeros(len(b.bit), dtype=np.float32)
        for k in range(CONTEXTS):
            mixed += found[k] * model.weights[k].take(gate)
        cell = map_cells(s, part, b, mixed)
        out[part] = np.add.reduceat(model.cost.take(cell), np.cumsum(b.long) - b.long, dtype=np.float64)
    return out


class Kinds:
    """Distinct units gathered from several slices: their hashes and symbols, and how often each occurred."""

    def __init__(self):
        self.hashes, self.symbols, self.lengths, self.times, self.size = [], [], [], [], 0
        self.places, self.begins, self.units = [], [], 0

    @property
    def full(self) -> bool:
        return self.size > KINDS_HELD or self.units > UNITS_HELD

    def add(self, u: Units) -> np.ndarray:
        """The place of each unit of u among the kinds of all slices."""
        self.begins.append(np.concatenate([[True], u.text[1:] != u.text[:-1]]) if len(u.text) else np.zeros(0, bool))
        self.units += len(u.text)
        self.places.append(self.placed(u))
        return self.places[-1]

    def pairs(self, u: Units, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pair_keys of all slices (kinds of the merged u), and how often each occurred."""
        if not self.places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([pair_keys(u, kind[places], begins) for places, begins in zip(self.places, self.begins)])
        return np.unique(keys, return_counts=True)

    def placed(self, u: Units) -> np.ndarray:
        hashes, which, kind, n = np.unique(span_hashes(u.sums, u.starts, u.ends), return_index=True, return_inverse=True, return_counts=True)
        lengths = u.ends[which] - u.starts[which]
        self.hashes.append(hashes)
        self.symbols.append(u.stream[ragged(u.starts[which], lengths)].astype(np.uint16))
        self.lengths.append(lengths.astype(np.int32))
        self.times.append(n)
        self.size += len(which)
        return (kind + (self.size - len(which))).astype(np.int32)

    def merged(self) -> tuple[Units, np.ndarray, np.ndarray]:
        """One unit of each kind of all slices, the kind of each place, and how often it occurred."""
        if not self.size:
            none = np.zeros(0, np.int64)
            return Units(none, running(none), none, none, none, none), none, none
        _, which, kind = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        times = np.bincount(kind, weights=np.concatenate(self.times), minlength=len(which)).astype(np.int64)
        lengths = np.concatenate(self.lengths).astype(np.int64)
        stream = np.concatenate(self.symbols)[ragged((np.cumsum(lengths) - lengths)[which], lengths[which])].astype(np.int64)
        ends = np.cumsum(lengths[which])
        return Units(stream, running(stream), ends - lengths[which], ends, ends, ends), kind, times


def pair_keys(u: Units, of: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For a run of units, given as kinds of u, the unit before (0: none; begins: a text's first) with the first symbol."""
    before = np.concatenate([[0], of[:-1] + 1]) if len(of) else of
    return np.where(begins, 0, before) * (END + 1) + u.stream[u.starts[of]]


def some_pairs(u: Units, keys: np.ndarray, size: int = 1 << 17) -> Iterator[tuple[slice, Symbols]]:
    """The first symbols of distinct pair_keys, in runs that are small enough to lay out."""
    for at in range(0, len(keys), size):
        part = slice(at, min(at + size, len(keys)))
        yield part, first_symbols(u, keys[part] // (END + 1) - 1, keys[part] % (END + 1))


def some_kinds(u: Units, size: int = 1 << 14) -> Iterator[np.ndarray]:
    """The units in runs that are small enough to lay out all their symbols."""
    return (np.arange(at, min(at + size, len(u.starts))) for at in range(0, len(u.starts), size))


def kind_costs(u: Units, model: MixModel) -> np.ndarray:
    """log10 probability of all symbols of each unit but its first."""
    out = np.zeros(len(u.starts))
    for chosen in some_kinds(u):
        s, sizes = inner_symbols(u, chosen)
        inner = np.concatenate([[0.0], np.cumsum(symbol_costs(s, model))])
        ends = np.cumsum(sizes)
        out[chosen] = inner[ends] - inner[ends - sizes]
    return out


def count_bits(table: np.ndarray, s: Symbols, code: Code, times: np.ndarray | None = None) -> None:
    """Adds all decisions of the symbols, each `times` over, to table: [slots * 2]."""
    for part in runs(s):
        b = bits_of(s, part, code)
        more = np.int32(1) if times is None else np.repeat(times[part], b.long).astype(np.int32)  # of the table's type, else adding is slow
        for k in range(CONTEXTS):
            slot = slots_of(s, part, b, k)
            slot *= 2
            slot += b.bit
            np.add.at(table, slot, more)


# -- the jobs ------------------------------------------------------------------------------------------------


def unit_words(u: Units) -> np.ndarray:
    """The hash of the word of each unit; 0 where it is empty."""
    return np.where(u.ends - 1 > u.starts, span_hashes(u.sums, u.starts, u.ends - 1), np.uint64(0))


def passages(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """The first unit and the hash of each passage."""
    if not len(u.starts):
        return u.starts, np.zeros(0, np.uint64)
    words = span_hashes(u.sums, u.starts, np.maximum(u.ends - 1, u.starts))
    ends = np.ones(len(words), dtype=bool)
    same = u.text[1:] == u.text[:-1]
    ends[:-1] = ~same
    with np.errstate(over="ignore"):
        ends[1:] |= same & (mix(words[1:] + words[:-1] * np.uint64(31)) % np.uint64(PASSAGE) == 0)
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    return first, span_hashes(u.sums, u.starts[first], u.ends[last]) ^ PASSAGE_SALT


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, weights=n, minlength=len(distinct)).astype(np.int64)


@dataclass(frozen=True)
class Scorer:
    mix: MixModel
    tokens: int  # N
    kinds: int  # V
    ends: int  # training texts
    frequent: np.ndarray  # sorted hashes
    frequent_counts: np.ndarray
    passages: int  # all of the training texts, and distinct ones
    passage_kinds: int


#: Units travel in buckets of their word's hash, passages in buckets of their own hash; passage bucket b is bucket -1 - b.
BUCKET_BITS = 12
#: Keeps passages of one unit apart from tokens.
PASSAGE_SALT = np.uint64(0x3C6EF372FE94F82B)
#: Stands for END in a byte; no byte of UTF-8.
END_BYTE = 255
PARTS = ("symbols", "lengths", "times", "before", "follow", "pair_times")
BUCKETS = "bucket long, " + ", ".join(f"{n} binary" for n in PARTS)


def packed(n: np.ndarray) -> bytes:
    return narrow(n) if len(n) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    return widen(data, n).astype(np.int64) if n else np.zeros(0, np.int64)


@dataclass
class Counted:
    """Units of one bucket (or of several), and pairs of a unit (from 1; 0: a text's start) and the symbol after it."""

    symbols: np.ndarray  # uint8, END as END_BYTE
    lengths: np.ndarray
    times: np.ndarray
    before: np.ndarray
    follow: np.ndarray  # uint8
    pair_times: np.ndarray

    def cells(self) -> tuple[bytes, ...]:
        return self.symbols.tobytes(), packed(self.lengths), packed(self.times), packed(self.before), self.follow.tobytes(), packed(self.pair_times)

    @staticmethod
    def read(cells) -> Counted:
        symbols, follow = np.frombuffer(cells[0], np.uint8), np.frombuffer(cells[4], np.uint8)
        n = int((symbols == END_BYTE).sum() + np.isin(symbols, SEPARATOR_BYTES).sum())  # a unit ends with each
        return Counted(symbols, unpacked(cells[1], n), unpacked(cells[2], n), unpacked(cells[3], len(follow)), follow, unpacked(cells[5], len(follow)))

    def units(self) -> Units:
        stream = self.symbols.astype(np.int64)
        stream[stream == END_BYTE] = END
        ends = np.cumsum(self.lengths)
        return Units(stream, running(stream), ends - self.lengths, ends, ends, ends)

    def keys(self) -> np.ndarray:
        follow = self.follow.astype(np.int64)
        follow[follow == END_BYTE] = END
        return self.before * (END + 1) + follow


SEPARATOR_BYTES = np.flatnonzero(~NOT_SPACE).astype(np.uint8)


def one_after_other(parts: list[Counted]) -> Counted:
    shift = np.cumsum([0] + [len(p.lengths) for p in parts])
    before = [np.where(p.before > 0, p.before + k, 0) for p, k in zip(parts, shift)]
    return Counted(*(np.concatenate(x) for x in ([p.symbols for p in parts], [p.lengths for p in parts], [p.times for p in parts], before, [p.follow for p in parts], [p.pair_times for p in parts])))


def merged(parts: list[Counted]) -> tuple[Counted, np.ndarray]:
    """Each unit and pair once, with the sums of their times; and the units' word hashes."""
    c = one_after_other(parts)
    u = c.units()
    _, which, kind = np.unique(span_hashes(u.sums, u.starts, u.ends), return_index=True, return_inverse=True)
    times = np.bincount(kind, weights=c.times, minlength=len(which)).astype(np.int64)
    keys, back = np.unique(np.where(c.before > 0, kind[c.before - 1] + 1, 0) * (END_BYTE + 1) + c.follow, return_inverse=True)
    n = np.bincount(back, weights=c.pair_times, minlength=len(keys)).astype(np.int64)
    lengths = c.lengths[which]
    out = Counted(c.symbols[ragged(u.starts[which], lengths)], lengths, times, keys // (END_BYTE + 1), (keys % (END_BYTE + 1)).astype(np.uint8), n)
    return out, np.where(lengths > 1, span_hashes(u.sums, u.starts[which], u.ends[which] - 1), np.uint64(0))


def bucket_rows(kinds: Kinds) -> Iterator[pa.RecordBatch]:
    """The units and pairs of a run of slices, a row for each bucket."""
    u, kind, times = kinds.merged()
    keys, n = kinds.pairs(u, kind)
    bucket = (unit_words(u) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    bucket, lengths = bucket[order], (u.ends - u.starts)[order]
    symbols = u.stream[ragged(u.starts[order], lengths)]
    symbols = np.where(symbols == END, END_BYTE, symbols).astype(np.uint8)
    before, follow = keys // (END + 1), keys % (END + 1)
    place = np.where(before > 0, rank[before - 1], -1) if len(rank) else before - 1
    sort = np.argsort(place, kind="stable")
    place, n, follow = place[sort], n[sort], np.where(follow[sort] == END, END_BYTE, follow[sort]).astype(np.uint8)
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    bounds = np.append(firsts, len(bucket))
    chars = np.concatenate([[0], np.cumsum(lengths)])[bounds]
    pairs = np.searchsorted(place, bounds)
    pairs[:1] = 0  # texts' starts go with the first bucket
    times, rows = times[order], []
    for i in range(len(firsts)):
        a, b, p, q = bounds[i], bounds[i + 1], pairs[i], pairs[i + 1]
        part = Counted(symbols[chars[i] : chars[i + 1]], lengths[a:b], times[a:b], np.maximum(place[p:q] - a + 1, 0), follow[p:q], n[p:q])
        rows.append((int(bucket[a]), *part.cells()))
        if len(rows) == 512 or i == len(firsts) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 7))], names=["bucket", *PARTS])
            rows = []


def passage_rows(hashes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted hashes and their counts, a row for each bucket."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
    lasts = np.append(firsts[1:], len(bucket))
    for at in range(0, len(firsts), 512):
        some = list(zip(firsts[at : at + 512].tolist(), lasts[at : at + 512].tolist()))
        k = len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array(-1 - bucket[firsts[at : at + 512]]), pa.array([hashes[a:b].tobytes() for a, b in some], pa.binary()), pa.nulls(k, pa.binary()), pa.array([narrow(n[a:b]) for a, b in some], pa.binary()), *(pa.nulls(k, pa.binary()) for _ in range(3))],
            names=["bucket", *PARTS],
        )


SUMMED = "hash long, n long, passage boolean, distinct long, " + ", ".join(f"{n} binary" for n in PARTS)


def sum_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of its buckets: merged units and pairs (a row for each bucket), tokens, passages that occur again, and the sums of all passages.

    Holds the distinct units and passages of its share, and never more than as much again of parts that wait to be merged.
    """
    units: dict[int, list] = {}
    hashes: dict[int, list] = {}
    names = ["hash", "n", "passage", "distinct", *PARTS]
    for batch in batches:
        for bucket, *cells in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket < 0:
                keys = np.frombuffer(cells[0], np.uint64)
                mine, part, size = hashes.setdefault(bucket, [[], 0, 1024]), (keys, widen(cells[2], len(keys))), len(keys)
            else:
                part = Counted.read(cells)
                mine, size = units.setdefault(bucket, [[], 0, 1024]), len(part.lengths) + len(part.before)
            mine[0].append(part)
            mine[1] += size
            if mine[1] > mine[2]:
                if bucket < 0:
                    mine[0] = [add_up(np.concatenate([k for k, _ in mine[0]]), np.concatenate([n for _, n in mine[0]]))]
                    mine[1] = len(mine[0][0][0])
                else:
                    mine[0] = [merged(mine[0])[0]]
                    mine[1] = len(mine[0][0].lengths) + len(mine[0][0].before)
                mine[2] = 2 * mine[1] + 1024

    def counted(keys: np.ndarray, n: np.ndarray, passage: bool) -> pa.RecordBatch:
        k = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.full(k, passage)), pa.nulls(k, pa.int64()), *(pa.nulls(k, pa.binary()) for _ in PARTS)], names=names)

    for parts, _, _ in units.values():
        all_of, words = merged(parts)
        keys, n = add_up(words, all_of.times)
        yield counted(keys[keys > 0], n[keys > 0], False)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.binary()) for x in all_of.cells())], names=names)
    every = distinct = 0
    for parts, _, _ in hashes.values():
        keys, n = add_up(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        every, distinct = every + int(n.sum()), distinct + len(n)
        yield counted(keys[n > 1], n[n > 1], True)
    if distinct:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([every]), pa.array([True]), pa.array([distinct]), *(pa.nulls(1, pa.binary()) for _ in PARTS)], names=names)


SUMS = "cell int, total long"


def sum_rows(sums: np.ndarray, step: int = 1) -> Iterator[pa.RecordBatch]:
    whole = np.rint(sums.reshape(-1) * step).astype(np.int64)
    used = np.flatnonzero(whole)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(whole[used])], names=["cell", "total"])


def added(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of all tasks, `size` numbers."""
    found = rows.groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[found.column("cell").to_numpy()] = found.column("total").to_numpy()
    return out


def kinds_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 15) -> Iterator[tuple[Units, np.ndarray, np.ndarray, np.ndarray]]:
    """Units, their times, pair_keys and their times, of several buckets at once."""
    held: list[Counted] = []

    def handed() -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
        c = one_after_other(held)
        held.clear()
        return c.units(), c.times, c.keys(), c.pair_times

    for batch in batches:
        for cells in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(Counted.read(cells))
            if sum(len(c.lengths) for c in held) >= size:
                yield handed()
    if held:
        yield handed()


def symbols_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 14) -> Iterator[tuple[Symbols, np.ndarray]]:
    """All distinct symbols in their contexts, in runs, and how often each occurred."""
    for u, times, keys, n in kinds_of(batches):
        for chosen in some_kinds(u, size):
            inner, sizes = inner_symbols(u, chosen)
            yield inner, np.repeat(times[chosen], sizes)
        for part, firsts in some_pairs(u, keys):
            yield firsts, n[part]


def symbol_counts(kinds: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(END + 1, dtype=np.int64)
        for u, times, _, _ in kinds_of(batches):
            total += np.bincount(u.stream, weights=np.repeat(times, u.ends - u.starts), minlength=END + 1).astype(np.int64)
        yield from sum_rows(total)

    return added(kinds.mapInArrow(count, SUMS), END + 1)


def learned(kinds: DataFrame, shape: tuple[int, ...], add, step: int) -> np.ndarray:
    """What `add`(sums, symbols, times) adds up over all symbols of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for symbols, times in symbols_of(batches):
            add(sums, symbols, times)
        yield from sum_rows(sums, step)

    return added(kinds.mapInArrow(run, SUMS), int(np.prod(shape))).reshape(shape) / step


def fit_mixer(kinds: DataFrame, code: Code, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cost table, learned over all texts; each bit is taken out of the counts that predict it."""
    context = kinds.sparkSession.sparkContext
    fixed = context.broadcast((code, stretch_without(counts)))
    weights = np.full((CONTEXTS, GATES), START_WEIGHT, dtype=np.float32)
    for _ in range(ROUNDS):
        sums = learned(kinds, (CONTEXTS + len(PAIRS), GATES), lambda *a, w=weights: Learner(*fixed.value, w).add_slopes(*a), SUM_STEP)
        weights = Learner(code, np.zeros(0, np.int8), weights).stepped(sums)
    hits = learned(kinds, (CLASSES * CELLS * 2,), lambda *a: Learner(*fixed.value, weights).add_hits(*a), 1)
    fixed.unpersist()
    return weights, map_costs(hits)


def fit(train: DataFrame, text: str) -> tuple[Scorer, DataFrame]:
    """The model; and the counts of all tokens that are not frequent and of all passages that occur again: hash, n, passage."""
    texts = train.select(F.coalesce(F.col(text), F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = Kinds(), []

        def hand_on() -> Iterator[pa.RecordBatch]:
            yield from bucket_rows(kinds)
            yield from passage_rows(*np.unique(np.concatenate(held), return_counts=True))

        for batch in batches:
            for part in pieces(batch, "text", most=SLICE):
                data, offsets = utf8(part.column("text"))
                u = units_of(LOWER[data], offsets)
                kinds.add(u)
                held.append(passages(u)[1])
                if kinds.full:
                    yield from hand_on()
                    kinds = Kinds()
                    held.clear()
        if kinds.units:
            yield from hand_on()

    summed = keep(texts.mapInArrow(gather, BUCKETS).repartition("bucket").mapInArrow(sum_buckets, SUMMED))
    kinds = summed.where("symbols is not null").select(*PARTS)
    n_symbols = symbol_counts(kinds)
    code = Code.of(n_symbols)
    size = 2 * sum(TABLES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.int32)
        for symbols, times in symbols_of(batches, 1 << 15):
            count_bits(table, symbols, code, times)
        yield from table_blocks(table)

    bits = gather_table(kinds.mapInArrow(count, BLOCK_SCHEMA), size).reshape(-1, 2)
    weights, cost = fit_mixer(kinds, code, bits)
    known = summed.where("hash is not null and not passage").select("hash", "n")
    seen = summed.where("distinct is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    again = summed.where("hash is not null and passage").select("hash", "n", F.lit(True).alias("passage"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = int(n_symbols[END])  # the end is a token of its own, one of each text
    tokens, distinct = int(total.n) + ends, int(total.v) + (ends > 0)
    least = max(1, -(-tokens // FREQUENT))
    top = known.where(F.col("n") >= least).toArrow()  # at most FREQUENT rows, as their counts add up to N at most
    hashes = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Scorer(MixModel(code, stretch_table(bits), weights, cost), tokens, distinct, ends, hashes[order], top.column("n").to_numpy()[order].astype(np.uint32 if tokens < 1 << 32 else np.int64), int(seen.n), int(seen.v)), known.where(F.col("n") < least).withColumn("passage", F.lit(False)).unionByName(again)


def lookup(hashes: np.ndarray, scorer: Scorer) -> np.ndarray:
    """The count of each hash that is frequent, else 0."""
    if not len(scorer.frequent):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(scorer.frequent, hashes), len(scorer.frequent) - 1)
    return np.where(scorer.frequent[at] == hashes, scorer.frequent_counts[at].astype(np.int64), 0)


ROWS = (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"), ("n_bytes", "long"))


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row of docs.

    The rows where `held_out` is not true are learned from.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scorer, rare = fit(rows.where("not held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = ["row", "hash", "passage", "key", "held_out", *(n for n, _ in ROWS)]

    def finish(held: list, kinds: Kinds, row: int) -> Iterator[pa.RecordBatch]:
        """The rows of the held slices: one for each text, and one for each place of a token that is not frequent."""
        scorer = shared.value
        u, kind, _ = kinds.merged()
        inner, hashes = kind_costs(u, scorer.mix), unit_words(u)
        keys, _ = kinds.pairs(u, kind)
        firsts = np.zeros(len(keys))
        for part, symbols in some_pairs(u, keys):
            firsts[part] = symbol_costs(symbols, scorer.mix)
        fresh = np.log10(scorer.passage_kinds / scorer.passages) if scorer.passages else 0.0
        c = lookup(hashes, scorer)
        c_end = scorer.ends
        value, is_word, is_rare = np.log10(c + 1.0), hashes > 0, (hashes > 0) & (c == 0)
        for part, places, begins, unit_text, (passage, passage_hash), sizes in held:
            n_texts, of = part.num_rows, kind[places]
            first = firsts[np.searchsorted(keys, pair_keys(u, of, begins))]
            each = np.add.reduceat(inner[of] + first, passage) if len(passage) else np.zeros(0)
            n_words = np.bincount(unit_text, weights=is_word[of], minlength=n_texts)
            known = np.bincount(unit_text, weights=is_word[of] & (c[of] > 0), minlength=n_texts) + (c_end > 0)
            base = np.bincount(unit_text, weights=np.where(is_word[of], value[of], 0.0), minlength=n_texts) + np.log10(c_end + 1.0)
            total = np.bincount(unit_text[passage], weights=each + fresh, minlength=n_texts)
            ids = np.arange(row, row + n_texts)
            row += n_texts
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.nulls(n_texts, pa.int64()), pa.nulls(n_texts, pa.bool_()), part.column("key"), part.column("held_out"), pa.array(n_words.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), pa.array(sizes)],
                names=names,
            )
            at = np.flatnonzero(is_rare[of])
            for rows_of, found, scores in ((unit_text[at], hashes[of[at]], pa.nulls(len(at), pa.float64())), (unit_text[passage], passage_hash, pa.array(each))):
                k = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows_of]), pa.array(found.view(np.int64)), pa.array(np.full(k, found is passage_hash)), pa.nulls(k, part.column("key").type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), scores, pa.nulls(k, pa.int64())],
                    names=names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held, kinds, n = TaskContext.get().partitionId() << 40, [], Kinds(), 0
        for batch in batches:
            for part in pieces(batch, "text", most=SLICE):
                data, offsets = utf8(part.column("text"))
                u = units_of(LOWER[data], offsets)
                held.append((part.select(["key", "held_out"]), kinds.add(u), kinds.begins[-1], u.text.astype(np.int32), passages(u), np.diff(offsets)))
                n += part.num_rows
                if len(held) == SLICES_HELD:
                    yield from finish(held, kinds, row)
                    row, held, kinds, n = row + n, [], Kinds(), 0
        if held:
            yield from finish(held, kinds, row)

    schema = StructType([StructField("row", LongType()), StructField("hash", LongType()), StructField("passage", BooleanType()), StructField("key", rows.schema["key"].dataType), StructField("held_out", BooleanType())])
    for name, kind in ROWS:
        schema = schema.add(name, kind)
    every = keep(rows.mapInArrow(run, schema))
    # What a passage that occurs again adds to the score of its symbols: log10(1 + (c - 1) / V / (product of their probabilities)).
    times_more = F.log10((F.col("n") - F.lit(1.0)) / F.lit(float(max(1, scorer.passage_kinds)))) - F.col("score")
    gain = F.when(times_more > 15, times_more).otherwise(F.log10(F.lit(1.0) + F.pow(F.lit(10.0), times_more)))
    joined = every.where("hash is not null").select("row", "hash", "passage", "score").join(rare, ["hash", "passage"])
    seen = joined.groupBy("row").agg(
        F.sum(F.when(~F.col("passage"), F.log10(F.col("n") + F.lit(1.0)))).alias("more"), F.count_if(~F.col("passage")).alias("more_known"), F.sum(F.when(F.col("passage"), gain)).alias("gained")
    )
    whole = F.lit(float(scorer.tokens + scorer.kinds + 1))
    return (
        every.where("hash is null")
        .join(seen, "row", "left")
        .select(
            F.col("key").alias(key),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(scorer.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(whole)).alias("base_score"),
            (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"),
            "n_bytes",
        )
        .withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1)))
    )
