"""Token counts by field and section, from one encoding of each whole document.

The fields of a row are joined by a separator, the whole is encoded once, and each token's character span is joined
to the spans of the sections: a section is a field, or a line of a field. A token that crosses a boundary goes to
the section that holds most of its characters, of equal shares to the earliest; characters of separators belong to
the section before them. A token that holds only a part of a character's bytes spans that character.

The vocabulary is read from a rank file on the driver and broadcast (its size is fixed by the file).

Defined results: null fields count as empty; a section that has no characters (an empty field, an empty text) gives
a row with 0 tokens, so every row of the input has at least one section. Repeated rows repeat.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = RANK_FILE) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character starts and ends of the tokens of a text."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        ends = np.cumsum(self.bytes_of[ids])
        starts = ends - self.bytes_of[ids]
        if text.isascii():
            return starts, ends
        begins = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        char_of = np.cumsum(begins) - 1  # of each byte
        return char_of[starts], char_of[ends - 1] + 1


def section_starts(fields: list[str], separator: str, by_line: bool) -> tuple[str, np.ndarray, list[int]]:
    """The joined text, the start of each section, and its field."""
    starts, of, at = [], [], 0
    for f, value in enumerate(fields):
        starts.append(at)
        of.append(f)
        if by_line:
            found = value.find("\n")
            while 0 <= found < len(value) - 1:
                starts.append(at + found + 1)
                of.append(f)
                found = value.find("\n", found + 1)
        at += len(value) + len(separator) * (f + 1 < len(fields))
    return separator.join(fields), np.array(starts, dtype=np.int64), of


def allot(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each section its tokens, and those among them that cross a boundary.

    An interval join on sorted bounds: a token meets the sections from that of its first to that of its last
    character; only tokens that meet several are looked at one by one.
    """
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    chosen, cross = first.copy(), np.flatnonzero(first != last)
    bounds = np.append(sections, length)
    for t in cross.tolist():
        met = np.arange(first[t], last[t] + 1)
        shares = np.minimum(bounds[met + 1], ends[t]) - np.maximum(bounds[met], starts[t])
        chosen[t] = met[int(np.argmax(shares))]
    return np.bincount(chosen, minlength=len(sections)), np.bincount(chosen[cross], minlength=len(sections))


_encoders: dict[int, tuple[dict, Encoder]] = {}


def encoder_of(shared) -> Encoder:
    ranks = shared.value
    if id(ranks) not in _encoders:
        _encoders.clear()
        _encoders[id(ranks)] = ranks, Encoder(ranks)
    return _encoders[id(ranks)][1]


def section_tokens(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",), fields: tuple[str, ...] = ("text",), by_line: bool = True, separator: str = "\n", rank_file: str = RANK_FILE) -> DataFrame:
    """keys, section (from 0), field, start and end in the joined text, n_tokens, n_crossing; a row for each section."""
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    taken = rows.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"field{i}") for i, f in enumerate(fields)))
    schema = rows.select(*keys).schema
    for column in ("section integer", "field string", "start long", "end long", "n_tokens long", "n_crossing long"):
        schema = schema.add(*column.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for part in pieces(batch, *(f"field{j}" for j in range(len(fields)))):
                at, section, field, start, end, n, crossing = [], [], [], [], [], [], []
                for i, values in enumerate(zip(*(part.column(f"field{j}").to_pylist() for j in range(len(fields))))):
                    text, bounds, of = section_starts(list(values), separator, by_line)
                    tokens, crossed = allot(*encoder.spans(text), bounds, len(text))
                    at.append(np.full(len(bounds), i))
                    section.append(np.arange(len(bounds), dtype=np.int32))
                    field += [fields[f] for f in of]
                    start.append(bounds)
                    end.append(np.append(bounds[1:], len(text)))
                    n.append(tokens)
                    crossing.append(crossed)
                where = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f"key{j}").take(where) for j in range(len(keys))), pa.array(np.concatenate(section)), pa.array(field, pa.string()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (start, end, n, crossing))],
                    names=[*keys, "section", "field", "start", "end", "n_tokens", "n_crossing"],
                )

    return taken.mapInArrow(run, schema)
