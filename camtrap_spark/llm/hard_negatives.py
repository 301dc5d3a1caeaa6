"""Hard negatives by Fagin's threshold algorithm.

For an anchor and each of its positives (the best rows of its own label) the best rows of other labels are wanted whose
score lies in a window below the positive's score. The index is a table of blocks, a row each: the vectors of at most
`BLOCK_ROWS` rows and, for each dimension, the order of the rows by that component. Anchors go to the tasks in rounds
of about `ROUND_ANCHORS` (broadcast, of bounded size); each task takes them through its blocks and carries what it has
found from block to block, so that later blocks stop earlier; the tasks' best rows, k for each window at most, are
then reduced by Spark. Positives are a pass of the same search with one open window.

In a block the lists of all dimensions are read in step, from the end where the component's product with the anchor
is large (sorted access by the anchor's sign). Each row that comes up first is scored by its whole vector (random
access, whole numbers). The products of the list heads add up to the threshold, which no unread row exceeds. Reading
ends when, for every window, the threshold is below the window or strictly below its k-th score: an equal score with a
smaller id could still be unread.

Components are floor(256 * x), scores exact whole numbers; a score in the result that does not fit into a long is an
error. Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take
no part. Vectors of another length than the anchor's are no rows for it. Rows with the anchor's own id are never its
positives; otherwise repeated rows count each, repeated anchors have their results each. Equal scores are ranked by
smaller id. A negative positive score has no negatives, as its window is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, keep
from .topk_mtree import best, inner, integers

BLOCK_ROWS = 8192
ROUND_ANCHORS = 4096
#: Rows that are read from each list at first; then twice as many, and so on.
FIRST_DEPTH = 32
BLOCKS = "n long, ids binary, labels binary, vectors binary, width long, orders binary"
WIDTHS = {2: np.int16, 4: np.int32, 8: np.float64}
FOUND = "anchor long, slot long, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def taking_part(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    v = F.col("v")
    fine = F.col("key").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(fine)


# -- the index -----------------------------------------------------------------------------------------------


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows; holds the rows of one block and one batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        ids, labels, x = (np.concatenate([h[j] for h in held]) for j in range(3))
        most = np.abs(x).max(initial=0)
        width = 2 if most < 2**15 else 4 if most < 2**31 else 8
        orders = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)  # a list for each dimension
        cells = (ids.tobytes(), labels.tobytes(), x.astype(WIDTHS[width]).tobytes())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int64()), *(pa.array([c], pa.binary()) for c in cells), pa.array([width], pa.int64()), pa.array([np.ascontiguousarray(orders).tobytes()], pa.binary())],
            names=["n", "ids", "labels", "vectors", "width", "orders"],
        )

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK_ROWS - sum(len(h[0]) for h in held))
            held.append((part.column("key").to_numpy(), part.column("label").to_numpy(), integers(part.column("v").to_pylist())))
            at += part.num_rows
            if sum(len(h[0]) for h in held) == BLOCK_ROWS:
                yield block()
    if held:
        yield block()


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    orders: np.ndarray
    most: float

    @classmethod
    def of(cls, cell: dict) -> Block:
        n = cell["n"]
        vectors = np.frombuffer(cell["vectors"], WIDTHS[cell["width"]]).reshape(n, -1).astype(np.float64)
        orders = np.frombuffer(cell["orders"], np.uint16).reshape(-1, n)
        return cls(np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["labels"], np.int64), vectors, orders, float(np.abs(vectors).max(initial=0)))


# -- the search ----------------------------------------------------------------------------------------------


@dataclass
class Wanted:
    """The k best scores from low to high (None: open) that have been found so far."""

    k: int
    low: int | None = None
    high: int | None = None
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def closed(self, threshold: float) -> bool:
        """Whether no row of this score or less is wanted any more."""
        if self.low is not None and (threshold < self.low or self.high < self.low):
            return True
        return len(self.scores) == self.k and threshold < self.scores[-1]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.ones(len(scores), dtype=bool)
        if self.high is not None:
            fits &= (scores <= self.high) & (scores >= self.low)
        if len(self.scores) == self.k:
            fits &= scores >= self.scores[-1]
        some = np.flatnonzero(fits)
        if len(some):
            s, x = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
            top = best(s, x, self.k)
            self.scores, self.ids = s[top], x[top]


class Lists:
    """Sorted access to a block's lists by the signs of an anchor's components."""

    def __init__(self, block: Block, q: np.ndarray):
        self.block, self.q = block, q
        self.up, self.down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        self.dims = np.concatenate([self.up, self.down])

    def read(self, first: int, last: int) -> np.ndarray:
        """The rows at the depths from first to last of all lists."""
        n = len(self.block.ids)
        return np.concatenate([self.block.orders[self.up, n - last : n - first].ravel(), self.block.orders[self.down, first:last].ravel()])

    def threshold(self, depth: int) -> float:
        """The most that a row can score that no list has shown above this depth."""
        if not len(self.dims):
            return 0.0
        terms = self.q[self.dims] * self.block.vectors[self.read(depth, depth + 1), self.dims]
        size = float(np.abs(terms).sum())
        return float(terms.sum()) + (size * 1e-9 if size >= 2**53 else 0.0)  # whole numbers below 2^53 add up exactly


def threshold_search(block: Block, q: np.ndarray, allowed: np.ndarray, wanted: list[Wanted]) -> int:
    """Adds the block's rows to what is wanted of an anchor; gives the number of rows that were scored.

    allowed: whether a row may be a result.
    """
    n, lists = len(block.ids), Lists(block, q)
    seen = np.zeros(n, dtype=bool)
    exact = block.most * float(np.abs(q).max(initial=0)) * len(q) < 2**53
    depth, step, scored = 0, FIRST_DEPTH, 0
    while depth < n:
        threshold = lists.threshold(depth)
        if all(w.closed(threshold) for w in wanted):
            break
        last = min(depth + step, n) if len(lists.dims) else n
        fresh = np.zeros(n, dtype=bool)
        if last < n:
            fresh[lists.read(depth, last)] = True
            fresh &= ~seen
        else:
            fresh = ~seen
        seen |= fresh
        new = np.flatnonzero(fresh)
        scored += len(new)
        new = new[allowed[new]]
        if len(new):
            scores = np.rint(block.vectors[new] @ q).astype(np.int64) if exact else inner(block.vectors[new], q[None, :])[:, 0]
            for w in wanted:
                w.add(scores, block.ids[new])
        depth, step = last, step * 2
    return scored


@dataclass(frozen=True)
class Anchors:
    """A round of anchors; slots: of each anchor the windows (low, high), None for the search of positives."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    slots: list[list[tuple[int, int]]] | None


def searcher(shared, k: int):
    """A task's part of a round: its blocks one after the other, every anchor through each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        n = len(anchors.ids)
        wanted = [[Wanted(k)] if anchors.slots is None else [Wanted(k, low, high) for low, high in anchors.slots[i]] for i in range(n)]
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.of({name: batch.column(name)[row].as_py() for name in batch.schema.names})
                for i in range(n):
                    same = block.labels == anchors.labels[i]
                    allowed = same & (block.ids != anchors.ids[i]) if anchors.slots is None else ~same
                    threshold_search(block, anchors.vectors[i], allowed, wanted[i])
        for i, found in enumerate(wanted):
            for slot, w in enumerate(found):
                if len(w.scores):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(w.ids), pa.int64()), pa.array([slot] * len(w.ids), pa.int64()), pa.array(w.scores.tolist(), pa.int64()), pa.array(w.ids)], names=["anchor", "slot", "score", "id"]
                    )

    return run


def reduced(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on the column `key`. A negative's score lies between low and high percent of its positive's.
    """
    spark = rows.sparkSession
    fine = keep(taking_part(rows, key, vector, label))
    at = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"  # a folder for each round
    spark.createDataFrame([], RESULT).write.parquet(f"{at}/length=0/round=0")
    for length in sorted(r.length for r in fine.select(F.size("v").alias("length")).distinct().collect()):
        one = fine.where(F.size("v") == length)
        chosen = keep(one.withColumnRenamed("key", key).where(is_anchor).withColumnRenamed(key, "key").withColumn("anchor", F.monotonically_increasing_id()))
        rounds = -(-chosen.count() // ROUND_ANCHORS)
        index = keep(one.mapInArrow(pack, BLOCKS)) if rounds else None
        for r in range(rounds):
            some = chosen.where(F.pmod(F.xxhash64("anchor"), F.lit(rounds)) == r).collect()  # ROUND_ANCHORS, more or less
            if some:
                search_round(index, some, positives, negatives, low, high).write.mode("overwrite").parquet(f"{at}/length={length}/round={r}")
    return spark.read.schema(RESULT).option("recursiveFileLookup", True).parquet(at)


def search_round(index: DataFrame, some: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = index.sparkSession
    ids, labels, q = np.array([a.key for a in some], np.int64), np.array([a.label for a in some], np.int64), integers([a.v for a in some])
    shared = spark.sparkContext.broadcast(Anchors(ids, labels, q, None))
    own = reduced(index.mapInArrow(searcher(shared, positives), FOUND), positives).orderBy("anchor", "rank").collect()  # `positives` for each anchor of the round
    slots: list[list[tuple[int, int]]] = [[] for _ in some]
    for r in own:
        slots[r.anchor].append((-(-low * r.score // 100), high * r.score // 100))
    windows = spark.sparkContext.broadcast(Anchors(ids, labels, q, slots))
    found = reduced(index.mapInArrow(searcher(windows, negatives), FOUND), negatives)
    pairs = spark.createDataFrame([(r.anchor, r["rank"] - 1, int(ids[r.anchor]), r.id, r.score) for r in own], "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
    out = found.join(F.broadcast(pairs), ["anchor", "slot"])  # pairs: as many as were collected
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
