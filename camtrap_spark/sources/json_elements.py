"""The elements of JSON arrays as rows, where one document of any size is dealt over many tasks.

Documents are cut into byte ranges. A first pass tells of each range how it changes what the next one begins in:
whether a string is open, and how deep the brackets are, for both cases of its own begin. Put together in order (a row
for each range, on the driver) that gives every range its begin. A second pass counts the elements that begin in each
range, for each of the three ways in which the range can begin in respect of the wanted array, and tells how it ends;
that gives every range its first element's number. The rows then come from the ranges themselves: an element belongs to
the range that its `[` or comma lies in, and a task reads on over the range's end to finish its last one. So keys may
stand in any order, and names and brackets in strings or in other parts of a document mean nothing.

Defined results: a document without the wanted key, or with another value than an array there, gives no rows; if the key
repeats, its arrays follow one another. Documents are taken by name. Compressed documents are one range each. A
document that ends before its array does loses the element that is not finished.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import file_system

RANGE_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
#: What is read at first beyond a range's end, for its last element.
TAIL_BYTES = 1 << 14
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
QUOTE, BACKSLASH, COMMA, COLON, OPEN_LIST, SPACES = ord('"'), ord("\\"), ord(","), ord(":"), ord("["), b" \t\r\n"
#: Brackets count by their step in depth; commas and colons are structure without a step.
STEP = np.zeros(256, np.int64)
STEP[[OPEN_LIST, ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
STRUCTURE = STEP != 0
STRUCTURE[[COMMA, COLON]] = True
#: How a range can begin: outside of the wanted array, after its key, inside of it.
OUTSIDE, AFTER_KEY, INSIDE = 0, 1, 2
RANGES = "i long, document string, start long, end long, in_string boolean, depth long, state int, first long"
KEY = re.compile(r'"(?:[^"\\]|\\.)*"$', re.DOTALL)


def open_document(document: str):
    there, at = file_system(document)
    if document.endswith(COMPRESSED):
        with there.open_input_stream(at) as stream:
            return io.BytesIO(stream.read())
    return there.open_input_file(at)


def escaped_at(file, place: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n, back = 0, 64
    while n < place:
        file.seek(max(0, place - back))
        before = file.read(min(back, place))
        n = len(before) - len(before.rstrip(b"\\"))
        if n < len(before):
            break
        back *= 2
    return n % 2 == 1


def marks(data: np.ndarray, escaped: bool) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """The number of quotes, places of structure, whether an odd number of quotes stands before each, and whether what follows is escaped."""
    quotes, slashes, next_escaped = np.flatnonzero(data == QUOTE), np.flatnonzero(data == BACKSLASH), False
    if len(slashes):
        first = np.flatnonzero(np.append(True, np.diff(slashes) != 1))
        begins, lengths = slashes[first], np.diff(np.append(first, len(slashes)))
        odd = (lengths + ((begins == 0) & escaped)) % 2 == 1
        after = (begins + lengths)[odd]
        next_escaped = bool(len(after)) and int(after[-1]) == len(data)
        quotes = quotes[~np.isin(quotes, after)]
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    if escaped and not len(data):
        next_escaped = True
    places = np.flatnonzero(STRUCTURE[data])
    return len(quotes), places, np.searchsorted(quotes, places) % 2 == 1, next_escaped


def chunks(file, start: int) -> Iterator[np.ndarray]:
    file.seek(start)
    while chunk := file.read(CHUNK_BYTES):
        yield np.frombuffer(chunk, np.uint8)


def change(document: str, start: int, end: int) -> tuple[bool, int, int]:
    """Whether the range opens or closes a string, and its change in depth if it begins outside and inside of one."""
    parity, steps = 0, [0, 0]
    with open_document(document) as file:
        escaped = escaped_at(file, start)
        for data in chunks(file, start):
            data = data[: end - start]
            start += len(data)
            quotes, places, odd, escaped = marks(data, escaped)
            step, odd = STEP[data[places]], odd ^ bool(parity)
            steps[0] += int(step[~odd].sum())
            steps[1] += int(step[odd].sum())
            parity ^= quotes & 1
            if start >= end:
                break
    return bool(parity), steps[0], steps[1]


class Walk:
    """The structure around the array from a range's begin on: chunks with the marks that matter."""

    def __init__(self, file, start: int, end: int, in_string: bool, depth: int, key: str | None):
        self.file, self.at, self.end, self.in_string, self.depth, self.key = file, start, end, in_string, depth, key
        self.level = 1 if key is None else 2  # how deep the elements are

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Place of the chunk, its bytes, places of marks in it, and their characters."""
        escaped, beyond = escaped_at(self.file, self.at), TAIL_BYTES
        while True:
            size = min(CHUNK_BYTES, self.end - self.at)
            if size <= 0:
                size, beyond = min(CHUNK_BYTES, beyond), 2 * beyond
            self.file.seek(self.at)  # a look at a key moves the file
            data = np.frombuffer(self.file.read(size), np.uint8)
            if not len(data):
                return
            quotes, places, odd, escaped = marks(data, escaped)
            places = places[odd == self.in_string]
            chars = data[places]
            step = STEP[chars]
            depth = self.depth + np.cumsum(step)
            wanted = (chars == COMMA) & (depth == self.level) | (step == 1) & (depth == self.level) | (step == -1) & (depth == self.level - 1)
            if self.key is not None:
                wanted |= (chars == COLON) & (depth == 1)
            if len(depth):
                self.depth = int(depth[-1])
            self.in_string ^= bool(quotes & 1)
            at, self.at = self.at, self.at + len(data)
            yield at, data, places[wanted], chars[wanted]

    def is_key(self, colon: int) -> bool:
        """Whether the string before a colon is the wanted key."""
        back = 4096
        while True:
            self.file.seek(max(0, colon - back))
            text = self.file.read(min(back, colon)).rstrip(SPACES)
            if text or back > colon:
                found = KEY.search(text.decode("utf-8", "replace"))
                return bool(found) and json.loads(found.group(), strict=False) == self.key
            back *= 2

    def is_empty(self, bracket: int) -> bool:
        """Whether only white space stands between a bracket and the array's end."""
        at = bracket + 1
        while True:
            self.file.seek(at)
            text = self.file.read(4096)
            rest = text.lstrip(SPACES)
            if rest or not text:
                return rest[:1] in (b"]", b"")
            at += len(text)


def count(document: str, start: int, end: int, in_string: bool, depth: int, key: str | None) -> tuple[list[int], list[int]]:
    """Elements that begin in the range, and how it ends, for each way in which it can begin."""
    found, states = [0, 0, 0], [OUTSIDE, AFTER_KEY, INSIDE]
    with open_document(document) as file:
        if start == 0 and key is None and file.read(1 << 16).lstrip(b"\xef\xbb\xbf" + SPACES)[:1] != b"[":
            raise ValueError(f"a JSON array is expected: {document}")
        walk = Walk(file, start, end, in_string, depth, key)
        for at, _, places, chars in walk:
            inside = places + at < end
            places, chars = places[inside], chars[inside]
            commas = places[chars == COMMA]
            turns = np.flatnonzero(chars != COMMA)
            before = 0
            for turn in [*turns.tolist(), None]:
                until = len(commas) if turn is None else int(np.searchsorted(commas, places[turn]))
                for i in range(3):
                    found[i] += until - before if states[i] == INSIDE else 0
                before = until
                if turn is None:
                    break
                char, place = int(chars[turn]), at + int(places[turn])
                if char == COLON:
                    states = [AFTER_KEY if walk.is_key(place) else OUTSIDE] * 3
                elif STEP[char] == 1:
                    states = [INSIDE if s == AFTER_KEY and char == OPEN_LIST else OUTSIDE for s in states]
                    if INSIDE in states and not walk.is_empty(place):
                        found = [n + (s == INSIDE) for n, s in zip(found, states)]
                else:
                    states = [OUTSIDE] * 3
            if walk.at >= end:
                break
    return found, states


def elements(document: str, start: int, end: int, in_string: bool, depth: int, state: int, key: str | None) -> Iterator[bytes]:
    """The elements that begin in the range, each to its end."""
    with open_document(document) as file:
        walk, begun = Walk(file, start, end, in_string, depth, key), None
        for at, data, places, chars in walk:
            raw, last = data.tobytes(), 0
            for place, char in zip(places.tolist(), chars.tolist()):
                if begun is not None and (char == COMMA or STEP[char] == -1):
                    element = b"".join([*begun, raw[last:place]])
                    begun = None
                    if element.strip(SPACES):
                        yield element
                if at + place >= end:
                    return
                if char == COLON:
                    state = AFTER_KEY if walk.is_key(at + place) else OUTSIDE
                elif STEP[char] == 1:
                    state = INSIDE if state == AFTER_KEY and char == OPEN_LIST else OUTSIDE
                elif char != COMMA:
                    state = OUTSIDE
                if state == INSIDE:
                    begun, last = [], place + 1
            if begun is not None:
                begun.append(raw[last:])
            elif walk.at >= end:
                return


def with_depths(rows: list[tuple], changed: dict[int, tuple[bool, int, int]]) -> list[tuple]:
    """The ranges, in order, with what the changes of those before make of their begins."""
    out, in_string, depth = [], False, 0
    for i, document, a, b, _, _, state, first in rows:
        if a == 0:
            in_string, depth = False, 0
        out.append((i, document, a, b, in_string, depth, state, first))
        parity, outside, inside = changed[i]
        depth += inside if in_string else outside
        in_string ^= parity
    return out


def with_numbers(rows: list[tuple], counted: dict[int, tuple[list[int], list[int]]]) -> list[tuple]:
    """The ranges with the way in which each begins, and the number of its first element."""
    out, first, state = [], 0, OUTSIDE
    for i, document, a, b, in_string, depth, begin, _ in rows:
        state = begin if a == 0 else state
        out.append((i, document, a, b, in_string, depth, state, first))
        found, states = counted[i]
        first, state = first + found[state], states[state]
    return out


def _over_ranges(spark: SparkSession, rows: list[tuple], tasks: int, run, schema: str) -> DataFrame:
    ranges = spark.createDataFrame(rows, RANGES)
    return (ranges.repartitionByRange(tasks, "i") if len(rows) > 1 else ranges).mapInArrow(run, schema)


def read_elements(spark: SparkSession, path: str, key: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """document, ord and element (its text): the array under `key` of each document, or the document itself if it is the array.

    ord goes on over the documents. Two passes over the ranges run at once, to place them; rows are read when they are asked for.
    """
    files = sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())  # a row for each document
    cut = []
    for document, length in files:
        steps = [0] if document.endswith(COMPRESSED) else range(0, max(1, length), range_bytes)
        cut += [(document, a, 1 << 62 if document.endswith(COMPRESSED) else min(a + range_bytes, length)) for a in steps]
    if not cut:
        return spark.createDataFrame([], "document string, ord long, element string")
    begin = OUTSIDE if key is not None else AFTER_KEY
    # Four tasks a core, and enough for the bytes; small ranges, or those of many small documents, share one.
    tasks = min(len(cut), max(4 * spark.sparkContext.defaultParallelism, -(-sum(length for _, length in files) // max(range_bytes, RANGE_BYTES))))

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parity, outside, inside = change(r["document"], r["start"], r["end"])
                yield pa.RecordBatch.from_pylist([{"i": r["i"], "parity": parity, "outside": outside, "inside": inside}])

    rows = [(i, d, a, b, False, 0, begin, 0) for i, (d, a, b) in enumerate(cut)]
    changed = {r.i: (r.parity, r.outside, r.inside) for r in _over_ranges(spark, rows, tasks, changes, "i long, parity boolean, outside long, inside long").collect()}  # a row for each range
    placed = with_depths(rows, changed)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found, states = count(r["document"], r["start"], r["end"], r["in_string"], r["depth"], key)
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]], pa.int64()), pa.array([found], pa.list_(pa.int64())), pa.array([states], pa.list_(pa.int64()))], names=["i", "found", "states"])

    counted = {r.i: (r.found, r.states) for r in _over_ranges(spark, placed, tasks, counts, "i long, found array<long>, states array<long>").collect()}
    numbered = with_numbers(placed, counted)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, held, size = r["first"], [], 0
                for element in elements(r["document"], r["start"], r["end"], r["in_string"], r["depth"], r["state"], key):
                    held.append(element.decode("utf-8", "replace").strip())
                    size += len(element)
                    if size >= CHUNK_BYTES:
                        yield _batch(r["document"], n, held)
                        n, held, size = n + len(held), [], 0
                if held:
                    yield _batch(r["document"], n, held)

    return _over_ranges(spark, numbered, tasks, rows_of, "document string, ord long, element string")


def _batch(document: str, first: int, held: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([document] * len(held)), pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.string())], names=["document", "ord", "element"])


