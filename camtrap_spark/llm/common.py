"""What several operators share: shared storage for cut lineage, and vectorised text handling inside tasks.

Texts reach Python as Arrow batches. `pieces` cuts each batch into slices of a bounded number of bytes (or one
row, if a single text is longer), so that a task's memory follows `SLICE_BYTES` and its longest text, and not
the number of rows that Spark puts into a batch.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Bytes of text that one vectorised step takes at a time.
SLICE_BYTES = 1 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir."""
    return shared_dir(spark)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Lets Spark hand rows to Python in batches of `most` bytes, unless the session asks for less already.

    A task holds a batch several times over (in the JVM, in the pipe, in Python), beside its slices.
    """
    unit = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = lambda text: int(text.rstrip("bkmg")) * unit[text[-1] if text[-1] in "bkmg" else ""]
    now = size(spark.conf.get(BATCH_BYTES).lower())
    if now <= 0 or now > size(most):
        spark.conf.set(BATCH_BYTES, most)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later steps read it and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared checkpoint folder, and read again; for rows that several jobs read."""
    at = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    kept = df.sparkSession.read.schema(df.schema).parquet(at)
    kept._kept_at = at
    return kept


def discard(*kept: DataFrame) -> None:
    """Removes tables that `keep` wrote and that nothing will read again."""
    for df in kept:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor, on the JVM; a null id counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def crc_of(value, divisor: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % divisor


def pieces(batch: pa.RecordBatch, *columns: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts in these columns hold `most` bytes at most together, or of one row."""
    if not batch.num_rows:
        return
    lengths = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, first = np.cumsum(lengths), 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of the column one after the other, and the offsets of each (nulls: empty)."""
    values = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: An odd multiplier; its inverse modulo 2**64 lets every word's hash be read off one running sum.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Powers are made of two small tables: of the last POWER_BITS bits of an exponent, and of the bits above.
POWER_BITS = 12
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base below 2^POWER_BITS, and those of its 2^POWER_BITS-th power that exponents below n need."""
    many = (n >> POWER_BITS) + 1
    if int(base) not in _powers or len(_powers[int(base)][1]) < many:
        made = []
        with np.errstate(over="ignore"):
            for step, size in ((base, 1 << POWER_BITS), (np.uint64(pow(int(base), 1 << POWER_BITS, 1 << 64)), max(many, 512))):
                run = np.full(size, step, dtype=np.uint64)
                run[0] = 1
                made.append(np.cumprod(run, dtype=np.uint64))
        _powers[int(base)] = made[0], made[1]
    return _powers[int(base)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base."""
    low, high = power_tables(base, n)
    with np.errstate(over="ignore"):
        return (high[: (n >> POWER_BITS) + 1, None] * low[None, :]).reshape(-1)[:n]


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the values, one longer than data."""
    n = len(data)
    out = np.zeros(n + 1, dtype=np.uint64)
    up = powers(BASE, n)
    with np.errstate(over="ignore"):
        up *= data.astype(np.uint64) + np.uint64(1)
        np.cumsum(up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans have equal hashes wherever they stand."""
    low, high = power_tables(INVERSE, len(sums))
    with np.errstate(over="ignore"):
        down = low.take(starts & ((1 << POWER_BITS) - 1)) * high.take(starts >> POWER_BITS)
        return mix((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes b with inside[b], never over a text's end: starts, ends, and the text of each."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mask = np.zeros(len(data) + 1, dtype=bool)
    mask[:-1] = inside[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = mask[cuts]
    starts = np.flatnonzero(begins)
    finish = mask[:-1] & ~mask[1:]
    finish[cuts - 1] = mask[cuts - 1]
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def hash_words(text: str) -> np.ndarray:
    """The hashes of the white-space separated words of a (short, fixed) text, as `span_hashes` gives them."""
    data, offsets = utf8(pa.array([text]))
    starts, ends, _ = words(data, offsets, NOT_SPACE)
    return span_hashes(running(data), starts, ends)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
WORD = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


# -- dense tables gathered over all rows ---------------------------------------------------------------------

BLOCK = 1 << 12
BLOCK_SCHEMA = "block long, slots binary, counts binary"


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the smallest of one, two or four bytes each."""
    most = int(counts.max())
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def widen(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(counts) // n])


def table_blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-zero entries of a count table of fixed size, a row for each block of 4096 slots that has any."""
    used = np.flatnonzero(table)
    blocks, firsts = np.unique(used // BLOCK, return_index=True)
    parts = np.split(used, firsts[1:]) if len(used) else []
    for at in range(0, len(blocks), 256):
        some = range(at, min(at + 256, len(blocks)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks[at : at + 256], pa.int64()),
                pa.array([(parts[i] % BLOCK).astype(np.uint16).tobytes() for i in some], pa.binary()),
                pa.array([narrow(table[parts[i]]) for i in some], pa.binary()),
            ],
            names=["block", "slots", "counts"],
        )


def sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over the rows of its blocks; holds one array of BLOCK counts for each block of its share."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
            total = totals.get(block)
            if total is None:
                total = totals[block] = np.zeros(BLOCK, dtype=np.int64)
            at = np.frombuffer(slots, np.uint16)
            total[at] += widen(counts, len(at))
    for block, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "total"]
        )


def gather_table(blocks: DataFrame, size: int) -> np.ndarray:
    """The sum of all partial tables: summed by block on the executors, then `size` numbers (a fixed bound) come here."""
    summed = blocks.repartition(F.col("block")).mapInArrow(sum_blocks, "block long, total binary")
    return placed_blocks(summed, size)


def placed_blocks(summed: DataFrame, size: int) -> np.ndarray:
    """The table of `size` numbers from rows of block and total; what comes to the driver is as large as the table."""
    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype=np.int64)
    found = summed.toArrow()
    for block, total in zip(found.column(0).to_pylist(), found.column(1)):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(total.as_buffer(), np.int64)
    return out[:size]
