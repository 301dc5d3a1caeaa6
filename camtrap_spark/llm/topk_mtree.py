"""Exact top-k search by inner product over an M-tree.

The tree is a table. Routing objects are vectors of a bounded sample; every vector goes to its nearest one, and the
vectors of one routing object, nearest first, are its pages, each with a covering radius and every vector's
distance to the routing object (its parent). Pages of neighbouring routing objects are packed into subtrees of at
most about `SUBTREE_ROWS` vectors, a row each. A routing object with more is split by distance into rings, a subtree
each (`BINS` counts of distances for each routing object tell where); only vectors of one distance, such as copies, are
dealt over several subtrees. Queries are broadcast in rounds of bounded size, and each task takes them through those of
its subtrees that can still hold a result, with the k-th scores found so far: from d(q, parent) and the ring, q.x <= (|q|^2 + |x|^2 - d(q, ring)^2) / 2 and q.x <= q.parent + |q| radius. Inside a
subtree each query takes its pages best bound first, stops when the best bound is below its k-th score, and skips
vectors by the same two bounds with their stored parent distances. The first k-th score of a query comes from the
sample. Bounds are widened by more than all rounding, so the result is exact.

Components are floor(256 * x) and scores are exact whole numbers of any size; a score that is in the result and does
not fit into a long is an error, as for any sum in Spark. Defined results: vectors that are null, empty, or hold null
or non-finite components take no part, nor do rows without an id; vectors of another length than the query's are no
candidates of it. Rows with the query's own id are no candidates; other repeated rows are candidates each. Equal
scores are ranked by smaller id. A query with fewer candidates than k gets them all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, keep

SCALE = 256.0
SAMPLE_ROWS = 4096
MOST_ROUTING = 1024
ROUTING_ROWS = 512
PAGE_ROWS = 128
SUBTREE_ROWS = 4096
QUERY_BLOCK = 256
ROUND_QUERIES = 4096
#: Distances to a routing object are counted in this many bins, to cut a large one into rings.
BINS = 256
#: How far a bound is widened, as a share of |q|^2 + |x|^2; float64 rounds by less than 1e-15 of it, distances by 1e-8.
MARGIN = 1e-7
FOUND = "query_id long, vec_id long, score long"
PACKED = "subtree long, ids binary, vectors binary, norms binary, distances binary, routing binary, sizes binary"


def integers(vectors: list) -> np.ndarray:
    """floor(256 * x) of equally long vectors, as float64 (exact whole numbers: a float's product by 256 is exact)."""
    return np.floor(SCALE * np.array(vectors, dtype=np.float64))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b: int64, or Python's whole numbers where they may be too large for it."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def distances(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> np.ndarray:
    squares = a_norms[:, None] + b_norms[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(np.where(np.isnan(squares), np.inf, squares), 0))


def upper(q_norm, d, product, low, high, x_norm):
    """The most q.x can be for |x|^2 <= x_norm and low <= d(x, c) <= high; d = d(q, c), product = q.c."""
    apart = np.maximum(np.maximum(d - high, low - d), 0)
    by_distance = (q_norm + x_norm - apart**2) / 2
    by_angle = product + np.sqrt(q_norm) * high
    out = np.minimum(by_distance, by_angle) + MARGIN * (q_norm + x_norm) + 1.0
    return np.where(np.isnan(out), np.inf, out)  # beyond float64 nothing is known


@dataclass(frozen=True)
class Routing:
    """What every task knows of the tree's upper levels: routing objects and sample of bounded size, and a few numbers for each subtree's rings."""

    vectors: np.ndarray
    norms: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    #: Of each ring: its routing object, its subtree and the number of subtrees that it is dealt over, distances, largest norm.
    owner: np.ndarray | None = None
    subtree: np.ndarray | None = None
    shares: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    most: np.ndarray | None = None
    #: The ring of each routing object and bin.
    ring_of: np.ndarray | None = None


def vectors_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (array<double>), size of the rows that take part."""
    v = F.col("v")
    fine = F.col("key").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(fine)


def neighbours(routing: Routing) -> list[int]:
    """The routing objects as a chain of nearest neighbours."""
    n = len(routing.vectors)
    near = distances(routing.vectors, routing.norms, routing.vectors, routing.norms)
    order, at, left = [], 0, np.ones(n, dtype=bool)
    for _ in range(n):
        order.append(at)
        left[at] = False
        at = int(np.argmin(np.where(left, near[at], np.inf)))
    return order


def plan_rings(routing: Routing, found: list) -> Routing:
    """Cuts each routing object's bins into rings of SUBTREE_ROWS at most, and packs small ones of neighbours together.

    found: rows of routing, bin, n, low, high, most; as many as routing objects times BINS at most.
    """
    bins: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.routing, r.bin)):
        bins.setdefault(r.routing, []).append(r)
    rings, ring_of = [], np.full((len(routing.vectors), BINS), -1)
    subtree, filled = 0, 0
    for p in neighbours(routing) if len(routing.vectors) else []:
        groups, size = [], 0
        for r in bins.get(p, []):
            if not groups or size + r.n > SUBTREE_ROWS:
                groups.append([])
                size = 0
            groups[-1].append(r)
            size += r.n
        for group in groups:
            n = sum(r.n for r in group)
            shares = -(-n // SUBTREE_ROWS)  # several only where one bin has too many
            if filled and filled + n > SUBTREE_ROWS:
                subtree, filled = subtree + 1, 0
            for r in group:
                ring_of[p, r.bin] = len(rings)
            rings.append((p, subtree, shares, min(r.low for r in group), max(r.high for r in group), max(r.most for r in group)))
            subtree, filled = (subtree + shares, 0) if shares > 1 else (subtree, filled + n)
    columns = [np.array([r[j] for r in rings], dtype=t) for j, t in enumerate((np.int64, np.int64, np.int64, float, float, float))]
    return Routing(routing.vectors, routing.norms, routing.sample, routing.sample_ids, *columns, ring_of)


def share_of(ids: np.ndarray, shares: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shares


def build(vectors: DataFrame, n: int) -> tuple[DataFrame, Routing, DataFrame]:
    """The packed subtrees, the upper levels, and every vector (key, v)."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).collect()  # bounded
    s = integers([r.v for r in sample])
    _, distinct = np.unique(s, axis=0, return_index=True)
    chosen = s[np.sort(distinct)[: max(1, min(MOST_ROUTING, -(-n // ROUTING_ROWS)))]]
    routing = Routing(chosen, (chosen**2).sum(axis=1), s, np.array([r.key for r in sample], dtype=np.int64))
    upper_levels = spark.sparkContext.broadcast(routing)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = upper_levels.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = integers(part.column("v").to_pylist())
                d = distances(x, (x**2).sum(axis=1), r.vectors, r.norms)
                p = d.argmin(axis=1)
                exact = np.minimum(np.sqrt(((x - r.vectors[p]) ** 2).sum(axis=1)), np.finfo(float).max)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(p), pa.array(exact), pa.array((x**2).sum(axis=1)), pa.array([row.tobytes() for row in x], pa.binary())],
                    names=["key", "routing", "distance", "norm", "vector"],
                )

    assigned = keep(vectors.mapInArrow(assign, "key long, routing long, distance double, norm double, vector binary"))
    radii = {r.routing: r.radius for r in assigned.groupBy("routing").agg(F.max("distance").alias("radius")).collect()}  # routing objects at most
    width = np.array([max(radii.get(p, 0.0), 1e-300) / BINS for p in range(len(chosen))])
    widths = spark.sparkContext.broadcast(width)

    def bins_of(p: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return np.minimum(distance / widths.value[p], BINS - 1).astype(np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, distance = batch.column("routing").to_numpy(), batch.column("distance").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("routing"), pa.array(bins_of(p, distance)), batch.column("distance"), batch.column("norm")], names=["routing", "bin", "distance", "norm"])

    measured = assigned.mapInArrow(measure, "routing long, bin long, distance double, norm double")
    found = measured.groupBy("routing", "bin").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("most")).collect()  # routing objects times BINS at most
    routing = plan_rings(routing, found)
    plan = spark.sparkContext.broadcast((routing.ring_of, routing.subtree, routing.shares))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring_of, first, shares = plan.value
        for batch in batches:
            p = batch.column("routing").to_numpy()
            ring = ring_of[p, bins_of(p, batch.column("distance").to_numpy())]
            subtree = first[ring] + share_of(batch.column("key").to_numpy(), shares[ring])
            yield pa.RecordBatch.from_arrays([pa.array(subtree), *batch.columns], names=["subtree", *batch.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each subtree of rows sorted by subtree, routing object, distance; holds one subtree."""
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            p = t.column("routing").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            sizes = np.diff(np.append(starts, len(p)))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([t.column("subtree")[0].as_py()], pa.int64()),
                    *(pa.array([x], pa.binary()) for x in (t.column("key").to_numpy().astype(np.int64).tobytes(), b"".join(t.column("vector").to_pylist()), t.column("norm").to_numpy().tobytes(), t.column("distance").to_numpy().tobytes(), p[starts].astype(np.int64).tobytes(), sizes.astype(np.int64).tobytes())),
                ],
                names=["subtree", "ids", "vectors", "norms", "distances", "routing", "sizes"],
            )

        for batch in batches:
            subtree = batch.column("subtree").to_numpy()
            cuts = [0, *(np.flatnonzero(subtree[1:] != subtree[:-1]) + 1).tolist(), len(subtree)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[-1].column("subtree")[0].as_py() != subtree[a]:
                    yield row()
                    held.clear()
                held.append(batch.slice(a, b - a))
        if held:
            yield row()

    placed = assigned.mapInArrow(place, "subtree long, key long, routing long, distance double, norm double, vector binary")
    return keep(placed.repartition("subtree").sortWithinPartitions("subtree", "routing", "distance").mapInArrow(pack, PACKED)), routing, assigned


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher score, then smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(subtree: dict, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, routing: Routing, k: int) -> list[tuple[int, int, int]]:
    """Best-first search of one subtree for a block of queries: (number of the query, id, score), at most k for each."""
    ids, norms, away = (np.frombuffer(subtree[n], t) for n, t in (("ids", np.int64), ("norms", np.float64), ("distances", np.float64)))
    vectors = np.frombuffer(subtree["vectors"], np.float64).reshape(len(ids), -1)
    owner, sizes = (np.frombuffer(subtree[n], np.int64) for n in ("routing", "sizes"))
    pages = []  # first, last, routing object; pages of one routing object lie in rings around it
    at = 0
    for c, size in zip(owner.tolist(), sizes.tolist()):
        pages += [(a, min(a + PAGE_ROWS, at + size), c) for a in range(at, at + size, PAGE_ROWS)]
        at += size
    q_norms = (q**2).sum(axis=1)
    centre = np.array([p[2] for p in pages])
    d = distances(q, q_norms, routing.vectors[centre], routing.norms[centre])
    product = q @ routing.vectors[centre].T
    radius = np.array([away[b - 1] for _, b, _ in pages])
    least = np.array([away[a] for a, _, _ in pages])
    most = np.array([norms[a:b].max() for a, b, _ in pages])
    bound = upper(q_norms[:, None], d, product, least[None, :], radius[None, :], most[None, :])
    order = np.argsort(-bound, axis=1)
    limit = floor.astype(np.float64).copy()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    for turn in range(len(pages)):
        nth = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(q)), nth] >= limit)
        if not len(active):
            break
        for page in np.unique(nth[active]).tolist():
            who = active[nth[active] == page]
            a, b, _ = pages[page]
            may = upper(q_norms[who][:, None], d[who, page][:, None], product[who, page][:, None], away[None, a:b], away[None, a:b], norms[None, a:b]) >= limit[who][:, None]
            columns = np.flatnonzero(may.any(axis=0))
            if not len(columns):
                continue
            scores = inner(q[who], vectors[a:b][columns])
            some = ids[a:b][columns]
            good = may[:, columns] & (scores >= limit[who][:, None] * 1.0).astype(bool) & (some[None, :] != q_ids[who][:, None])
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                w = who[i]
                s, x = np.concatenate([found[w][0], scores[i, good[i]]]), np.concatenate([found[w][1], some[good[i]]])
                top = best(s, x, k)
                found[w] = s[top], x[top]
                if len(top) == k:
                    limit[w] = max(limit[w], np.nextafter(float(min(s[top].tolist())), -np.inf))  # not above the exact score
    return [(i, int(x), int(s)) for i, (ss, xs) in enumerate(found) for s, x in zip(ss, xs)]


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest inner product for every query.

    is_query: a condition on the column `key` (the id).
    """
    spark, vectors = rows.sparkSession, vectors_of(rows, key, vector)
    at = f"{checkpoint_dir(spark)}/top-{uuid.uuid4().hex}"  # a folder for each round
    spark.createDataFrame([], FOUND).write.parquet(f"{at}/length=0/round=0")
    for length, n in sorted((r.length, r.n) for r in vectors.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).collect()):
        one = vectors.where(F.size("v") == length)
        for r, found in enumerate(rounds(one, n, is_query, k)):
            found.write.mode("overwrite").parquet(f"{at}/length={length}/round={r}")
    found = spark.read.schema(FOUND).option("recursiveFileLookup", True).parquet(at)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def with_floors(queries: DataFrame, shared, k: int) -> DataFrame:
    """vec_id, vector and floor: the k-th best score among the sample, or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                ids = part.column("vec_id").to_numpy()
                q = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
                scores = q @ r.sample.T
                scores = scores - MARGIN * ((q**2).sum(axis=1)[:, None] + (r.sample**2).sum(axis=1)[None, :])  # never above the exact score
                scores[np.isnan(scores) | (ids[:, None] == r.sample_ids[None, :])] = -np.inf
                floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(floor, pa.float64())], names=["vec_id", "vector", "floor"])

    return queries.mapInArrow(run, "vec_id long, vector binary, floor double")


def reach(r: Routing, q: np.ndarray) -> np.ndarray:
    """The most that a row of each subtree can score, by query and subtree."""
    q_norms = (q**2).sum(axis=1)
    d, product = distances(q, q_norms, r.vectors, r.norms), q @ r.vectors.T
    by_ring = upper(q_norms[:, None], d[:, r.owner], product[:, r.owner], r.low[None, :], r.high[None, :], r.most[None, :])
    many = int((r.subtree + r.shares).max(initial=0))
    out = np.full((len(q), many), -np.inf)
    for ring in range(len(r.owner)):
        some = slice(int(r.subtree[ring]), int(r.subtree[ring] + r.shares[ring]))
        out[:, some] = np.maximum(out[:, some], by_ring[:, ring : ring + 1])
    return out


def rounds(vectors: DataFrame, n: int, is_query: Column, k: int) -> Iterator[DataFrame]:
    """query_id, vec_id, score of what the tasks find, k rows for a query and task at most; a round of queries at a time.

    Queries go to the subtrees, not the other way: ROUND_QUERIES of them are broadcast, and each task takes them through
    its subtrees and carries every query's k-th score from one to the next.
    """
    spark = vectors.sparkSession
    subtrees, routing, assigned = build(vectors, n)
    shared = spark.sparkContext.broadcast(routing)
    chosen = assigned.withColumnRenamed("key", "vec_id").where(is_query).select("vec_id", "vector")
    queries = keep(with_floors(chosen, shared, k).withColumn("nth", F.monotonically_increasing_id()))
    many = -(-queries.count() // ROUND_QUERIES)

    for r in range(many):
        some = queries.where(F.pmod(F.xxhash64("nth"), F.lit(many)) == r).collect()  # ROUND_QUERIES, more or less
        if not some:
            continue
        ids = np.array([s.vec_id for s in some], np.int64)
        block = spark.sparkContext.broadcast((ids, np.frombuffer(b"".join(bytes(s.vector) for s in some), np.float64).reshape(len(some), -1), np.array([s.floor for s in some])))

        def look(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            (q_ids, q, floor), tree = block.value, shared.value
            floor, top = floor.copy(), {}
            most = None
            for batch in batches:
                for row in range(batch.num_rows):
                    if most is None:
                        most = reach(tree, q)
                    cell = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                    who = np.flatnonzero(most[:, cell["subtree"]] >= floor)
                    for at in range(0, len(who), QUERY_BLOCK):
                        part = who[at : at + QUERY_BLOCK]
                        for i, x, score in search(cell, q_ids[part], q[part], floor[part], tree, k):
                            top.setdefault(int(part[i]), []).append((-score, x))
                    for i in who.tolist():
                        if len(top.get(i, ())) >= k:
                            top[i] = sorted(top[i])[:k]
                            floor[i] = max(floor[i], np.nextafter(float(-top[i][-1][0]), -np.inf))  # not above the exact score
            rows = [(int(q_ids[i]), x, -s) for i, found in top.items() for s, x in found]
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in part], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        yield subtrees.mapInArrow(look, FOUND)
