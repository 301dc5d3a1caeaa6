"""SentencePiece encoding and decoding by streaming Viterbi.

A text becomes `\\u2581` + text with each space as `\\u2581`; its encoding is the sequence of vocabulary pieces of
the largest total score, characters outside the vocabulary counting as their UTF-8 byte pieces at a penalty. Of
equal totals the one with the longer last piece wins. The vocabulary and its scores are read from a model file on
the driver and broadcast (its size is fixed by the file); nothing is trained.

All streams of an Arrow slice advance together, one character a step, in numpy. Of each, `Lanes` retains the scores of
as many positions as the longest piece has characters, and for each of these the boundaries on its best path. When
the best paths of all of them - those that a later piece can still continue - share a boundary, they agree on
everything before it: the pieces up to there are committed. What is not committed at a stream's end is committed then.

No piece has a `\\u2581` behind another character (checked when the vocabulary is loaded; else nothing is cut), so
all paths share the boundary before each such `\\u2581`, whatever came before. So they do wherever no piece of the
text reaches over. A text therefore enters as several streams of `STREAM_CHARS` characters or more that begin there:
before words and, where words are longer (base64, scripts without spaces), inside them; which is all that makes long
texts advance in parallel. Texts of over `WINDOW_CHARS` characters are encoded window by window, each ending at such a
boundary, so that the arrays of a task are bounded but where pieces overlap throughout a whole window.

Defined results: a null text has null ids; an empty one has no ids. A literal `\\u2581` in a text is encoded in
bytes, so that decoding gives back every text exactly. Rows are independent; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import INVERSE, bound_batches, pieces, powers, ragged, running

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
META = 0x2581
#: Stands for a literal META inside texts; no code point.
LITERAL = 0x110000
#: Characters of a stream before the next boundary that all paths share ends it.
STREAM_CHARS = 256
#: Characters encoded together, but where no boundary is shared for longer.
WINDOW_CHARS = 1 << 20
SLICE = 1 << 19


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown_score: float
    #: Of every id the bytes it decodes to.
    decoded: list[bytes]
    longest: int
    #: Whether META stands inside pieces only at the start, so that texts can be cut before it.
    cut_before_meta: bool
    by_codes: dict[tuple[int, ...], tuple[int, float]] = field(default_factory=dict)

    @staticmethod
    def load(model_file: str = MODEL_FILE) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids, decoded, found = [0] * 256, [b""] * n, {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                decoded[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                found[name] = (i, float(model.get_score(i)))
                decoded[i] = name.replace("▁", " ").encode()
        cut_ok = not any("▁" in p.lstrip("▁") for p in found)
        lowest = min((s for _, s in found.values()), default=0.0)
        return Vocabulary(found, byte_ids, lowest - 10.0, decoded, max(map(len, found), default=1), cut_ok, {tuple(map(ord, p)): v for p, v in found.items()})


def to_codes(text: str) -> list[int]:
    return [META, *(META if c == " " else LITERAL if c == "▁" else ord(c) for c in text)] if text else []


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    return b"".join(vocabulary.decoded[i] for i in ids).decode("utf-8", "surrogatepass")[1:]


class Pieces:
    """The vocabulary as a hash table for whole arrays; one for each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        entries = dict(vocabulary.by_codes)
        codes = np.concatenate([np.array(c, dtype=np.uint64) for c in entries])
        lengths = np.array([len(c) for c in entries])
        ends = np.cumsum(lengths)
        values = span_values(running(codes), powers(INVERSE, len(codes)), ends - lengths, lengths)
        self.bits = 19
        slot = self.slots(values)
        order = np.argsort(slot, kind="stable")
        nth = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        self.depth = int(nth.max()) + 1
        self.keys = np.zeros((self.depth, 1 << self.bits), dtype=np.uint64)
        self.ids = np.full((self.depth, 1 << self.bits), -1, dtype=np.int32)
        self.keys[nth, slot[order]] = values[order]
        self.ids[nth, slot[order]] = np.array([v[0] for v in entries.values()], dtype=np.int32)[order]
        self.taken = (self.ids[0] >= 0).astype(np.uint8)  # small enough to stay near
        self.score_of = np.zeros(len(vocabulary.decoded) + 1)
        for i, score in entries.values():
            self.score_of[i] = score
        self.score_of[-1] = vocabulary.unknown_score
        self.inside = np.zeros(LITERAL + 1, dtype=bool)  # characters of pieces of several characters
        for c in entries:
            if len(c) > 1:
                self.inside[list(c)] = True
        self.decoded_lengths = np.array([len(d) for d in vocabulary.decoded])
        self.decoded_starts = np.cumsum(self.decoded_lengths) - self.decoded_lengths
        self.decoded = np.frombuffer(b"".join(vocabulary.decoded), dtype=np.uint8)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)

    def slots(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).view(np.int64)

    def lookup(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the values that are pieces, and the pieces."""
        slot = self.slots(values)
        at = np.flatnonzero(self.taken.take(slot))
        slot, values = slot.take(at), values.take(at)
        out = np.full(len(at), -1, dtype=np.int32)
        for d in range(self.depth):
            hit = np.flatnonzero(self.keys[d].take(slot) == values)
            out[hit] = self.ids[d].take(slot.take(hit))
        found = np.flatnonzero(out >= 0)
        return at.take(found), out.take(found)


def span_values(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A 64-bit value of each span by its characters and length, not scrambled."""
    with np.errstate(over="ignore"):
        return (sums.take(starts + length) - sums.take(starts)) * inverse.take(starts) + np.uint64(0x9E6C63D0876A9A75) * np.asarray(length, dtype=np.uint64)


class Lanes:
    """Streams of one slice that advance together; n: all characters, streams sorted by falling length."""

    def __init__(self, table: Pieces, n: int, starts: np.ndarray, lengths: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]):
        self.table, self.starts, self.lengths = table, starts, lengths
        self.longest = table.vocabulary.longest
        lanes, top = len(starts), int(lengths[0]) if len(lengths) else 0
        # The window: scores and paths of the last positions, the newest in row `position % (longest + 1)`.
        self.scores = np.full((self.longest + 1, lanes), -np.inf)
        self.paths = np.zeros((self.longest + 1, lanes), dtype=np.uint64)  # bit i: a boundary i positions back
        self.scores[0], self.paths[0] = 0.0, 1
        self.base = np.zeros(lanes, dtype=np.int64)  # committed up to here
        self.piece = np.full(n, -1, dtype=np.int32)  # the best last piece at each position, until it is committed
        self.size = np.zeros(n, dtype=np.uint8)
        self.ends = np.zeros(n, dtype=bool)  # committed: a piece ends behind this character
        self.converged = self.at_end = 0
        #: Of each step the number of streams that are still running, and of all steps before it together.
        self.running = np.searchsorted(-lengths, -np.arange(1, top + 1), side="right")
        self.before = np.concatenate([[0], np.cumsum(self.running)])
        self.arrange(n, found)

    def arrange(self, chars: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The pieces that end at each character, in the order of the steps, of one character the longest first."""
        lane = np.empty(chars, dtype=np.int32)
        where = ragged(self.starts, self.lengths)
        lane[where] = np.repeat(np.arange(len(self.starts), dtype=np.int32), self.lengths)
        step = np.arange(chars) - self.starts[lane]  # from 0
        place = self.before[step] + lane
        n = np.ones(chars, dtype=np.int32)
        for at, _ in found[1:]:
            n[at] += 1
        by_place = np.empty(chars, dtype=np.int64)
        by_place[place] = n
        self.first = np.concatenate([[0], np.cumsum(by_place)])
        total = int(self.first[-1])
        self.m_piece, self.m_size, self.m_lane = np.empty(total, np.int32), np.empty(total, np.uint8), np.empty(total, np.int32)
        free = self.first[place]
        for k in range(self.longest, 0, -1):
            at, piece = found[k - 1]
            slot = free[at]
            self.m_piece[slot], self.m_size[slot], self.m_lane[slot] = piece, k, lane[at]
            free[at] = slot + 1

    def advance(self, j: int, m: int) -> None:
        """The j-th character of the first m streams."""
        rows, lanes = self.longest + 1, len(self.starts)
        first = self.first[self.before[j - 1] : self.before[j]]
        part = slice(int(first[0]), int(self.first[self.before[j]]))
        lane, size, piece = self.m_lane[part], self.m_size[part], self.m_piece[part]
        from_row = (j - np.arange(rows)) % rows * lanes  # of each size, where the position before the piece lies
        value = self.scores.reshape(-1).take(from_row.take(size) + lane)
        value += self.table.score_of.take(piece)
        best = np.maximum.reduceat(value, first - first[0])
        at = np.flatnonzero(value == best.take(lane))
        chosen = lane.take(at)
        at = at[np.concatenate([[True], chosen[1:] != chosen[:-1]])]  # the longest of those with the best total
        size = size.take(at)
        here = self.starts[:m] + (j - 1)
        self.piece[here], self.size[here] = piece.take(at), size
        path = self.paths.reshape(-1).take(from_row.take(size) + np.arange(m))
        self.scores[j % rows, :m] = best
        self.paths[j % rows, :m] = (path << size.astype(np.uint64)) | np.uint64(1)

    def common(self, j: int, m: int) -> np.ndarray:
        """How far back the newest boundary lies that the best paths of all positions in the window share; -1: none."""
        rows, shared = self.longest + 1, np.full(m, ~np.uint64(0))
        for back in range(min(self.longest, j + 1)):
            path = self.paths[(j - back) % rows, :m]
            dead = np.isneginf(self.scores[(j - back) % rows, :m])
            shared &= np.where(dead, ~np.uint64(0), path << np.uint64(back))
        newest = shared & (~shared + np.uint64(1))
        return np.where(shared > 0, np.log2(np.maximum(newest, 1).astype(np.float64)).astype(np.int64), -1)

    def commit(self, lanes: np.ndarray, until: np.ndarray) -> int:
        """Follows the path back from `until` to what is committed already; returns the number of pieces."""
        n, position, lanes_left = 0, until.copy(), lanes
        while len(lanes_left):
            at = self.starts[lanes_left] + position - 1
            self.ends[at] = True
            n += len(at)
            position = position - self.size[at]
            left = position > self.base[lanes_left]
            lanes_left, position = lanes_left[left], position[left]
        self.base[lanes] = until
        return n

    def run(self) -> None:
        for j, m in enumerate(self.running.tolist(), 1):
            self.advance(j, m)
            ended = np.arange(int(self.running[j]) if j < len(self.running) else 0, m)
            if len(ended):
                self.at_end += self.commit(ended, np.full(len(ended), j))
            if j % self.longest == 0:
                back = self.common(j, m)
                until = j - back
                lanes = np.flatnonzero((back >= 0) & (until > self.base[:m]))
                self.converged += self.commit(lanes, until[lanes])


class BatchEncoder:
    """Encodes and decodes whole slices; counts the pieces committed by convergence and at a stream's end."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.table = vocabulary, Pieces(vocabulary)
        self.converged = self.at_end = 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        joined = "".join("▁" + t for t in texts if t)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        n_ids = np.zeros(len(texts), np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), n_ids
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        codes[codes == META] = LITERAL
        codes[codes == 32] = META
        codes[firsts] = META
        out, counts, low, width = [], np.zeros(len(firsts), np.int64), 0, WINDOW_CHARS
        while low < len(codes):
            high = min(len(codes), low + width)
            part = codes[low:high]
            mine = firsts[(firsts >= low) & (firsts < high)] - low
            begins, reach = self.reaches(part, mine)
            found = self.spell(part, reach)
            shared = self.shared(begins, found)
            if high < len(codes):  # pieces may reach over the window's end: only boundaries well before it are known
                shared = shared[shared <= len(part) - self.vocabulary.longest]
                if not len(shared) or not shared[-1]:
                    width *= 2
                    continue
                high = low + int(shared[-1])
                part, mine, shared = part[: high - low], mine[mine < high - low], shared[:-1]
                found = [(at[at < high - low], piece[at < high - low]) for at, piece in found]
            ids, ends, n = self.encode_window(part, mine, shared, found)
            out.append(ids)
            counts += np.bincount(np.searchsorted(firsts, ends + low, side="right") - 1, weights=n, minlength=len(firsts)).astype(np.int64)
            low, width = high, WINDOW_CHARS
        n_ids[sizes > 0] = counts
        return np.concatenate(out), n_ids

    def encode_window(self, codes: np.ndarray, firsts: np.ndarray, shared: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, the last character of each piece, and its number of ids."""
        lanes = Lanes(self.table, len(codes), *self.streams(len(codes), firsts, shared), found)
        lanes.run()
        self.converged += lanes.converged
        self.at_end += lanes.at_end
        ends = np.flatnonzero(lanes.ends)
        piece = lanes.piece[ends]
        unknown = np.flatnonzero(piece < 0)  # characters on their own: as bytes
        chars = codes[ends[unknown]]
        chars = np.where(chars == LITERAL, META, chars)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        n = np.ones(len(ends), dtype=np.int64)
        n[unknown] = width
        after = np.cumsum(n)
        out = np.zeros(int(after[-1]), dtype=np.int32)
        known = piece >= 0
        out[after[known] - 1] = piece[known]
        raw = np.frombuffer(chars.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        out[ragged(after[unknown] - width, width)] = self.table.byte_ids[raw]
        return out, ends, n

    def reaches(self, codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and for each character how long a piece that ends there can be."""
        at = np.arange(len(codes))
        begins = np.zeros(len(codes), dtype=bool)
        if self.vocabulary.cut_before_meta:
            begins[1:] = (codes[1:] == META) & (codes[:-1] != META)
        begins[0] = True
        begins[firsts] = True
        stretch = np.zeros(len(codes), dtype=bool)  # no piece of several characters reaches over these
        stretch[1:] = ~(self.table.inside[codes[1:]] & self.table.inside[codes[:-1]])
        stretch[begins] = True
        since = np.maximum.accumulate(np.where(stretch, at, 0))
        return begins, np.minimum(at - since + 1, self.vocabulary.longest).astype(np.int8)

    def spell(self, codes: np.ndarray, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each length the last characters of all pieces of the text, and the pieces; of length 1 all characters, known (else -1) or not."""
        sums, inverse, here = running(codes), powers(INVERSE, len(codes)), np.arange(len(codes))
        found = []
        for k in range(1, self.vocabulary.longest + 1):
            if k > 1:
                here = here.take(np.flatnonzero(reach.take(here) >= k))
            some, piece = self.table.lookup(span_values(sums, inverse, here + (1 - k), k))
            if k == 1:
                alone = np.full(len(codes), -1, dtype=np.int32)
                alone[some] = piece
                found.append((here, alone))
            else:
                found.append((here.take(some), piece))
        return found

    def shared(self, begins: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Boundaries that all paths share: where words begin and, if some words are long, where no piece reaches over."""
        may = np.flatnonzero(begins)
        if np.diff(np.append(may, len(begins))).max() <= 2 * STREAM_CHARS:
            return may
        over = np.zeros(len(begins) + 1, dtype=np.int64)
        for k, (at, _) in enumerate(found[1:], 2):
            over += np.bincount(at + (2 - k), minlength=len(over)) - np.bincount(at + 1, minlength=len(over))
        return np.flatnonzero(begins | (np.cumsum(over)[:-1] == 0))

    def streams(self, chars: int, firsts: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the streams, the longest first."""
        origins = np.union1d(firsts, [0])
        text = np.searchsorted(origins, shared, side="right") - 1
        block = (shared - origins[text]) // STREAM_CHARS
        starts = shared[np.concatenate([[True], (text[1:] != text[:-1]) | (block[1:] != block[:-1])])]
        lengths = np.diff(np.append(starts, chars))
        order = np.argsort(-lengths, kind="stable")
        return starts[order], lengths[order]

    def decode(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all decoded texts one after the other, each with its leading space, and their lengths."""
        lengths = self.table.decoded_lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        until = np.cumsum(n_ids)
        return self.table.decoded[ragged(self.table.decoded_starts[ids], lengths)], ends[until] - ends[until - n_ids]


_encoders: dict[int, tuple[Vocabulary, BatchEncoder]] = {}


def encoder_of(shared) -> BatchEncoder:
    vocabulary = shared.value
    if id(vocabulary) not in _encoders:
        _encoders.clear()
        _encoders[id(vocabulary)] = vocabulary, BatchEncoder(vocabulary)
    return _encoders[id(vocabulary)][1]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """key, ids, n_ids and round_trip (whether decoding the ids gave the text again) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = docs.select(F.col(key)).schema.add("n_ids", "long").add("round_trip", "boolean").add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for part in pieces(batch, "text", most=SLICE):
                texts = part.column("text").to_pylist()
                ids, n_ids = encoder.encode(texts)
                data, sizes = encoder.decode(ids, n_ids)
                ends = np.cumsum(sizes)
                raw = data.tobytes()
                same = [(t is None or (raw[b - n : b][1:] == t.encode())) for t, b, n in zip(texts, ends.tolist(), sizes.tolist())]
                none = np.array([t is None for t in texts], dtype=bool)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int32), mask=np.append(none, False))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n_ids, mask=none), pa.array(same, mask=none), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    names=[key, "n_ids", "round_trip", "ids"],
                )

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """key and text of rows of ids; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = [None if x is None else decode(x, vocabulary) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, encoded.select(F.col(key)).schema.add("text", "string"))
