"""Packing of documents into sequences of one length by non-negative least squares.

Documents are encoded once; the ids are kept in the shared folder with each document's number among those of its
length in its task. Whole windows of a long document are sequences of their own; what is left over of every document,
shorter than the window, is counted by length over the whole corpus. On that histogram (`window` numbers) the driver
enumerates the shallow combinations that fill a window exactly (one or two lengths any number of times, or three
lengths once each), solves for non-negative repeat counts by least squares, and rounds them: whole parts first, then
once more in order of what they lost, then greedily as often as the lengths last. What still remains is packed
greedily in order of length, cut at the window's end; the last, incomplete sequence is cut into powers of two, which
need no padding. A document's place then follows from its number among all of its length, by sums over the tasks:
nothing is sorted, and no length is brought together, whatever share of the documents has it.

Encoding by units: the vocabulary's rules never reach over ASCII white space, so the ids of a text are those of its
white-space separated units one after the other; a plain unit is cut further into its letters, digits and other
characters, as the rules do. Each distinct segment is encoded once by the tokenizer in each worker and remembered
(at most `MEMO_UNITS` and a slice's, then anew).

Defined results: a null text is empty; every row, also one with a null id, has its end id and so at least one piece;
repeated rows are packed each. Longest texts are cut like others. Empty tables give no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, SLICE_BYTES, bound_batches, keep, pieces, ragged, running, span_hashes, utf8, words

WINDOW = 2048
END_ID = 1
MEMO_UNITS = 1 << 20
#: Hashes are looked up by their upper 21 bits first.
NEAR_SHIFT = np.uint64(43)
#: Rows (task, length) of first numbers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
STEPS = 200


# -- encoding ------------------------------------------------------------------------------------------------


def segment_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its class (0 white space, 1 letter, 2 digit, 3 other), and whether its unit is encoded as a whole."""
    kind = np.full(256, 3, np.uint8)
    kind[ord("a") : ord("z") + 1] = kind[ord("A") : ord("Z") + 1] = kind[0x80:] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[~NOT_SPACE] = 0
    whole = np.zeros(256, dtype=bool)
    whole[:0x20] = whole[0x7F] = whole[0xC9:] = whole[0xC0:0xC3] = True
    whole[[ord("'"), ord("<")]] = True  # contractions, special tokens
    return kind, whole & NOT_SPACE


KIND, WHOLE = segment_classes()


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes to encode, and starts, ends, text and wholeness of the segments of all units.

    A unit of ASCII and of Latin letters of two bytes falls into runs of letters, single digits and runs of other
    characters, each a word to the vocabulary's rules, without regard to case. Other units, and those with an
    apostrophe or the begin of a special token, are one segment, as they are.
    """
    starts, ends, of = words(data, offsets, NOT_SPACE)
    odd = WHOLE[data]
    two = np.flatnonzero(data == 0xC3)  # the signs of multiplication and division, and a letter whose lower case is two
    odd[two] = np.isin(data[np.minimum(two + 1, len(data) - 1)], (0x97, 0xB7))
    two = np.flatnonzero(data == 0xC4)
    odd[two] = data[np.minimum(two + 1, len(data) - 1)] == 0xB0
    whole = np.zeros(len(starts), dtype=bool)
    whole[np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1] = True
    kind = KIND[data]
    begin = (kind != 0) & ((kind == 2) | np.append(True, kind[1:] != kind[:-1]))
    begin[starts] = True
    at = np.flatnonzero(begin)
    first = np.zeros(len(data), dtype=bool)
    first[starts] = True
    unit = np.cumsum(first[at]) - 1
    kept = first[at] | ~whole[unit]
    at, unit = at[kept], unit[kept]
    text = LOWER[data]
    raw = ragged(starts[whole], (ends - starts)[whole])
    text[raw] = data[raw]
    return text, at, np.minimum(np.append(at[1:], len(data)), ends[unit]), of[unit], whole[unit]


class UnitEncoder:
    """Ids of texts, each distinct segment of a white-space separated unit encoded once."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # whether an id ends a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        """Slot 0 is of no segment."""
        self.hash, self.first, self.size = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.ids = np.zeros(0, self.type)
        self.known, self.slot = np.zeros(1, np.uint64), np.zeros(1, np.int32)  # hashes in order, and their slots
        self.near = np.zeros(1 << (64 - int(NEAR_SHIFT)), np.int32)  # the first slot of a hash's upper bits

    def one_by_one(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        return np.array([i for x in found for i in x], self.type), np.array([len(x) for x in found], np.int32)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words, encoded together and cut after each id that ends a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(texts).decode(), add_special_tokens=False).ids, self.type)
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0).astype(np.int32)) if len(ends) == len(texts) else self.one_by_one(texts)

    def learn(self, places: np.ndarray, hashes: np.ndarray, texts: list[bytes], whole: np.ndarray) -> np.ndarray:
        """The slots of new segments; places: where their hashes belong among the known ones."""
        size, parts = np.zeros(len(texts), np.int32), []
        order = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])
        simple, at = len(texts) - int(whole.sum()), 0
        while at < len(order):
            some = order[at : min(at + 4096, simple if at < simple else len(order))]
            found = (self.words if at < simple else self.one_by_one)([texts[i] for i in some.tolist()])
            parts.append(found[0])
            size[some] = found[1]
            at += len(some)
        begin, slots = len(self.ids), (len(self.first) + np.argsort(order)).astype(np.int32)
        self.ids = np.concatenate([self.ids, *parts])
        self.known, self.slot = np.insert(self.known, places, hashes), np.insert(self.slot, places, slots)
        self.hash = np.concatenate([self.hash, hashes[order]])
        self.first = np.concatenate([self.first, begin + np.cumsum(size[order]) - size[order]])
        self.size = np.concatenate([self.size, size[order]])
        free = self.near[hashes >> NEAR_SHIFT] == 0
        self.near[hashes[free] >> NEAR_SHIFT] = slots[free]
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's."""
        if not len(data):
            return np.zeros(0, self.type), np.zeros(len(offsets) - 1, np.int64)
        text, starts, ends, of, whole = segments(data, offsets)
        every = span_hashes(running(text), starts, ends)
        if len(self.known) > MEMO_UNITS:
            self.forget()
        slots = self.near[every >> NEAR_SHIFT]
        missed = np.flatnonzero(self.hash[slots] != every)
        at = np.searchsorted(self.known, every[missed])
        found = self.known[np.minimum(at, len(self.known) - 1)] == every[missed]
        slots[missed[found]] = self.slot[at[found]]
        if not found.all():
            unknown = missed[~found]
            hashes, where, inverse = np.unique(every[unknown], return_index=True, return_inverse=True)
            places, where = at[~found][where], unknown[where]
            raw = text.tobytes()
            new = self.learn(places, hashes, [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())], whole[where])
            slots[unknown] = new[inverse]
        sizes = self.size[slots]
        return self.ids[ragged(self.first[slots], sizes)], np.bincount(of, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)


_encoders: dict[int, tuple[str, UnitEncoder]] = {}


def encoder_of(shared) -> UnitEncoder:
    """One in each worker for a definition: with what it remembers."""
    definition = shared.value
    if hash(definition) not in _encoders:
        _encoders.clear()
        _encoders[hash(definition)] = definition, UnitEncoder(definition)
    return _encoders[hash(definition)][1]


def encoded(rows: DataFrame, key: str, text: str, definition: str, window: int, end_id: int) -> DataFrame:
    """key, task, ids, n, whole (windows), rest (ids after them), nth_whole and nth_rest: numbers in the task."""
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(definition)
    taken = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(shared), TaskContext.get().partitionId()
        so_far = np.zeros(window + 1, np.int64)  # of each length; of whole windows at `window`
        for batch in batches:
            for part in pieces(batch, "text", most=SLICE_BYTES // 2):
                ids, n = encoder.encode(*utf8(part.column("text")))
                ends = np.cumsum(n)
                last = np.array([end_id], encoder.type).tobytes()
                cells = [ids[b - m : b].tobytes() + last for b, m in zip(ends.tolist(), n.tolist())]
                n = n + 1
                whole, rest = n // window, n % window
                nth_whole = so_far[window] + np.cumsum(whole) - whole
                so_far[window] += whole.sum()
                order = np.argsort(rest, kind="stable")
                counts = np.bincount(rest, minlength=window)
                nth_rest = np.empty(len(rest), np.int64)
                nth_rest[order] = np.arange(len(rest)) - np.repeat(np.cumsum(counts) - counts, counts)
                nth_rest += so_far[rest]
                so_far[:window] += counts
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.full(len(n), task, np.int32)), pa.array(cells, pa.binary()), *(pa.array(x.astype(np.int64)) for x in (n, whole, rest, nth_whole, nth_rest))],
                    names=["key", "task", "ids", "n", "whole", "rest", "nth_whole", "nth_rest"],
                )

    schema = taken.select("key").schema.add("task", "integer").add("ids", "binary")
    for name in ("n", "whole", "rest", "nth_whole", "nth_rest"):
        schema = schema.add(name, "long")
    return taken.mapInArrow(run, schema)


# -- the plan ------------------------------------------------------------------------------------------------


def combinations(window: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three columns of lengths and of times each (0 times: nothing) that fill the window exactly, out of these lengths."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    found = []
    one = lengths[window % lengths == 0]
    found.append((np.column_stack([one, one, one]), np.column_stack([window // one, 0 * one, 0 * one])))
    often = window // lengths
    a = np.repeat(lengths, often)
    times = np.arange(len(a)) - np.repeat(np.cumsum(often) - often, often) + 1
    left = window - a * times
    a, times, left = a[left > 0], times[left > 0], left[left > 0]
    for m in range(1, window // 2 + 1):
        fits = left % m == 0
        b = left[fits] // m
        fits, b = np.flatnonzero(fits)[there[b] & (b > a[fits])], b[there[b] & (b > a[fits])]
        if len(b):
            found.append((np.column_stack([a[fits], b, b]), np.column_stack([times[fits], np.full(len(b), m), np.zeros(len(b), np.int64)])))
    for x in lengths[lengths * 3 < window].tolist():
        y = lengths[(lengths > x) & (2 * lengths < window - x)]
        y = y[there[window - x - y]]
        if len(y):
            found.append((np.column_stack([np.full(len(y), x), y, window - x - y]), np.ones((len(y), 3), np.int64)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def least_squares(lengths: np.ndarray, times: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with small |W (A x - histogram)|^2 by accelerated projected gradient; W: the root of a length, so that tokens count.

    Columns are scaled to one norm; work and memory follow the number of combinations, which the window bounds.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size, dtype=np.float64))
    scale = np.sqrt((times * weight[lengths] * times * weight[lengths]).sum(axis=1))
    values = times * weight[lengths] / scale[:, None]
    forward = lambda x: sum(np.bincount(lengths[:, j], values[:, j] * x, size) for j in range(3))
    back = lambda r: sum(values[:, j] * r[lengths[:, j]] for j in range(3))
    target = histogram * weight
    v = np.ones(len(lengths))
    for _ in range(12):  # the largest eigenvalue
        v = back(forward(v / np.linalg.norm(v)))
    rate = 1 / (1.1 * np.linalg.norm(v))
    x = ahead = np.zeros(len(lengths))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - rate * back(forward(ahead) - target))
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, x, momentum = new + (momentum - 1) / later * (new - x), new, later
    return x / scale


@dataclass(frozen=True)
class Plan:
    """Where the documents of each length go, by their number: segments of combinations, then the greedy rest."""

    window: int
    #: Segments by length (`begin` tells where a length's start): first number, first sequence, offset, times in a sequence.
    begin: np.ndarray
    number: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    times: np.ndarray
    #: Of each length: documents in segments, and where the first of the others begins in the greedy rest.
    used: np.ndarray
    stream: np.ndarray
    #: Where the rest's sequences begin (its whole windows follow one another), and their numbers.
    tail: np.ndarray
    first_sequence: int

    def places(self, rest: int, nth: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the leftover, length, sequence, offset) of the leftover number `nth` of length `rest`."""
        if nth < self.used[rest]:
            a, b = self.begin[rest], self.begin[rest + 1]
            s = a + int(np.searchsorted(self.number[a:b], nth, side="right")) - 1
            among = nth - int(self.number[s])
            times = int(self.times[s])
            return [(0, rest, int(self.sequence[s]) + among // times, int(self.offset[s]) + among % times * rest)]
        at = int(self.stream[rest]) + (nth - int(self.used[rest])) * rest
        out, done, whole = [], 0, int(self.tail[0])
        while done < rest:
            here = at + done
            if here < whole:
                sequence, offset, room = here // self.window, here % self.window, self.window - here % self.window
            else:
                j = int(np.searchsorted(self.tail, here, side="right")) - 1
                sequence, offset, room = whole // self.window + j, here - int(self.tail[j]), int(self.tail[j + 1]) - here
            length = min(room, rest - done)
            out.append((done, length, self.first_sequence + sequence, offset))
            done += length
        return out


def solve(histogram: np.ndarray, window: int, first_sequence: int) -> Plan:
    """histogram: leftovers of each length below the window."""
    left = histogram.astype(np.int64).copy()
    lengths = np.flatnonzero(left)
    segments: list[tuple[int, int, int, int, int]] = []  # length, first number, sequence, offset, times
    used = np.zeros(window + 1, np.int64)
    sequence = first_sequence
    if len(lengths):
        columns, times = combinations(window, lengths)
        counts = least_squares(columns, times, histogram) if len(columns) else np.zeros(0)
        whole = np.floor(counts).astype(np.int64)
        by_loss, by_count = np.argsort(whole - counts, kind="stable"), np.argsort(-counts, kind="stable")
        for turn, order in (("whole", by_count), ("once", by_loss), ("greedy", by_count)):
            may = (left[columns] >= times).all(axis=1) & ((whole > 0) | (turn != "whole"))
            order = order[may[order]]
            for ls, ms, n in zip(columns[order].tolist(), times[order].tolist(), whole[order].tolist()):
                parts = [(length, m) for length, m in zip(ls, ms) if m]
                most = min(int(left[length]) // m for length, m in parts)
                n = min(most, n if turn == "whole" else 1 if turn == "once" else most)
                if not n:
                    continue
                offset = 0
                for length, m in parts:
                    segments.append((length, int(used[length]), sequence, offset, m))
                    used[length] += n * m
                    left[length] -= n * m
                    offset += length * m
                sequence += n
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 5)
    order = np.arange(window, -1, -1)
    tokens = np.append(left, np.zeros(window + 1 - len(left), np.int64))[order] * order
    stream = np.zeros(window + 1, np.int64)
    stream[order] = np.cumsum(tokens) - tokens  # the longest first
    total = int(tokens.sum())
    tail = [total - total % window]
    for power in range(window.bit_length(), -1, -1):
        if (total - tail[-1]) >> power:
            tail.append(tail[-1] + (1 << power))
    return Plan(window, np.searchsorted(table[:, 0], np.arange(window + 2)), *(table[:, j].copy() for j in (1, 2, 3, 4)), used, stream, np.array(tail), sequence)


# -- the operator --------------------------------------------------------------------------------------------


def pack(rows: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row for each piece.

    tokenizer: the path of a definition file, read on the driver; its size is fixed.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    spark = rows.sparkSession
    kept = keep(encoded(rows, key, text, definition, window, end_id))
    counts = kept.where("rest > 0").groupBy("task", F.col("rest").alias("length")).agg(F.count("*").alias("n"))
    wholes = kept.groupBy("task").agg(F.sum("whole").alias("n")).select("task", F.lit(window).cast("long").alias("length"), "n")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = keep(counts.unionByName(wholes).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    found = {r.length: (r.n, r.entries) for r in bases.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).collect()}  # `window` rows at most
    histogram = np.zeros(window, np.int64)
    for length, (n, _) in found.items():
        if length < window:
            histogram[length] = n
    shared = spark.sparkContext.broadcast((solve(histogram, window, found.get(window, (0, 0))[0]), UnitEncoder(definition).type.str))
    few = sum(entries for _, entries in found.values()) <= BROADCAST_ROWS
    side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    whole_base = side(bases.where(F.col("length") == window).select("task", F.col("base").alias("whole_base")))
    rest_base = side(bases.where(F.col("length") < window).select("task", F.col("length").alias("rest"), F.col("base").alias("rest_base")))
    placed = kept.join(whole_base, "task").join(rest_base, ["task", "rest"], "left")
    numbered = placed.select("key", "ids", "n", "whole", "rest", (F.col("whole_base") + F.col("nth_whole")).alias("window_number"), F.coalesce(F.col("rest_base") + F.col("nth_rest"), F.lit(0)).alias("rest_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, kind = shared.value
        for batch in batches:
            at, out, ids_out = [], [[] for _ in range(5)], []
            values = zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("n", "whole", "rest", "window_number", "rest_number")))
            for i, (cell, n, whole, rest, window_number, rest_number) in enumerate(values):
                ids = np.frombuffer(cell.as_buffer(), kind).astype("<u4")
                of_doc = [(w * window, window, window_number + w, 0) for w in range(whole)]
                if rest:
                    of_doc += [(whole * window + a, length, s, o) for a, length, s, o in plan.places(rest, rest_number)]
                for start, length, sequence, offset in of_doc:
                    at.append(i)
                    ids_out.append(ids[start : start + length].tobytes())
                    for column, value in zip(out, (start, length, n, sequence, offset)):
                        column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), *columns[:2], pa.array(ids_out, pa.binary()), *columns[2:]], names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = numbered.select("key").schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(run, schema).withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids (little-endian unsigned 32-bit) of every sequence, in order; a window's worth each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.reduce(parts, F.lit(b""), lambda whole, part: F.concat(whole, part.ids)).alias("ids"))
