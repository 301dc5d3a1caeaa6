"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Every document's set of word 5-grams (words: runs without white space, A-Z lowered; fewer than five words: all of
them as one n-gram) is sketched by `TREES` trees. In each, its label is `DEEPEST` MinHash values of one byte. A tree is
the prefix trie of all labels; it is held as the sorted sequence of labels, in which every prefix is a run. Documents
of the same n-gram set form a node, so copies are never paired.

Two nodes meet in a tree if their labels share a prefix that is long enough. How long is decided for each node: from
its size follows the smallest similarity that another set at the threshold or above can have (a set of four n-grams
has partners at exactly 0.8, one of six at 0.83 only, one of three none at all), and its prefix is shortened from
`DEEPEST` until a pair of that similarity meets in some tree with the probability `TARGET_RECALL`. Nodes without a
possible partner never enter the forest. The sorted labels are dealt out by range, so that a run of any length is
spread over tasks; a task links each node to the first one of its run in the batch, and what runs over the border of
two tasks is linked by their first and last runs (a few rows of each task).

The first `FIRST_TREES` trees are joined into components before the others are sorted; in these, a node counts as its
component, and a link inside a component is none. So the links that are looked at are about as many as the nodes.

Each candidate component is dealt into blocks of about `BLOCK_NGRAMS` n-grams and `BLOCK_NODES` nodes; a task takes two
blocks, counts the common n-grams of all their pairs at once, and keeps the pairs of Jaccard similarity `threshold`
or more: exact, by 64-bit n-gram hashes. It emits for each node the number of its links and one link of a spanning
forest, never the pairs. The classes are the connected components of the links.

Defined results: a document without words has no n-gram, links nothing and is a class of its own; so is one with
null text. Rows without an id take no part and give no row. Rows of the same id and text are copies of each other;
rows of the same id and different texts are separate rows. Ties: a class is named by its smallest id. Ids are whole
numbers; other types are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from .common import LOWER, NOT_SPACE, bound_batches, checkpoint_dir, discard, keep, mix, pieces, running, span_hashes, utf8, words

WORDS = 5
THRESHOLD = 0.8
TREES, DEEPEST, FIRST_TREES = 32, 8, 2
TARGET_RECALL = 0.9995
#: Sets of more n-grams than this have partners of about the threshold itself.
SIZED = 256
BLOCK_NGRAMS, BLOCK_NODES = 1 << 19, 2048
#: Slots of the filter on ids; a fixed size that is broadcast. Ids that share a slot are told apart by the join behind it.
FILTER_SLOTS = 1 << 22
SLICE = 1 << 20
NODE_ROWS = "doc_id long, node long, n_ngrams long, labels array<long>"


def least_similarity(size: int, threshold: float) -> float:
    """The smallest Jaccard similarity, of those at the threshold or above, of a set of `size` with a different set; 2.0 if there is none."""
    found = 2.0
    for common in range(1, size + 1):
        other = int(common / threshold + 1e-9) - size + common  # the largest set that still reaches it
        while other >= common and common / (size + other - common) < threshold - 1e-12:
            other -= 1
        if other >= common and not other == common == size:
            found = min(found, common / (size + other - common))
    return found


def forest_depths(trees: int, threshold: float, target: float) -> np.ndarray:
    """For each set size up to SIZED, the longest prefix with which its pairs meet in some tree with the target probability; 0: no pair is possible."""
    out = np.zeros(SIZED + 1, dtype=np.int64)
    for size in range(1, SIZED + 1):
        similarity = least_similarity(size, threshold) if size < SIZED else threshold
        if similarity <= 1:
            out[size] = next((d for d in range(DEEPEST, 1, -1) if 1 - (1 - similarity**d) ** trees >= target), 1)
    return out


def ngram_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of all texts, one text after the other, and their number in each."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, row = words(data, offsets, NOT_SPACE)
    hashes = span_hashes(running(data), starts, ends)
    n_words = np.bincount(row, minlength=len(column))
    n_grams = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    first = np.cumsum(n_words) - n_words
    ends_g = np.cumsum(n_grams)
    at = np.arange(ends_g[-1] if len(ends_g) else 0) + np.repeat(first - (ends_g - n_grams), n_grams)
    until = np.repeat(first + n_words, n_grams)
    grams = np.zeros(len(at), dtype=np.uint64)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    with np.errstate(over="ignore"):
        for k in range(size):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < until, padded[at + k], np.uint64(k + 1)))
    for a, b in zip((ends_g - n_grams).tolist(), ends_g.tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    new[(ends_g - n_grams)[n_grams > 0]] = True
    text = np.repeat(np.arange(len(column)), n_grams)
    return grams[new], np.bincount(text[new], minlength=len(column))


def per_text(values: np.ndarray, sizes: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    """reduce over the values of each text that has any."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return reduce.reduceat(values, starts) if len(starts) else values[:0]


def node_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram set; 0 for the empty set."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[sizes > 0] = mix(per_text(mix(grams), sizes, np.add) + sizes[sizes > 0].astype(np.uint64)) | np.uint64(1)
    return out


def labels_of(grams: np.ndarray, sizes: np.ndarray, trees: int) -> np.ndarray:
    """For each text with n-grams its label in each tree: DEEPEST MinHash values of a byte each, the first one on top."""
    n = int((sizes > 0).sum())
    out = np.zeros((n, trees), dtype=np.uint64)
    state = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for tree in range(trees):
            for _ in range(DEEPEST):
                state = mix(np.array([state + np.uint64(0x9E3779B97F4A7C15)]))[0]
                least = per_text(((grams * (state | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), sizes, np.minimum)
                out[:, tree] = out[:, tree] << np.uint64(8) | mix(least.astype(np.uint64)) & np.uint64(255)
    return out


LINKS = "a long, b long, task int, at_end int, depth int, prefix long, tree int"


def linked_runs(batches: Iterator[pa.RecordBatch], shortest: int, task: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by tree and label, and the first and last run of each depth in this task.

    Rows: tree, label, node, depth (the prefix length that the node needs). A run is a prefix's rows; its head is the
    first of them that is content with this length. Holds a batch and the heads of the run that is open.
    """
    depths = list(range(shortest, DEEPEST + 1))
    heads = {d: None for d in depths}  # of the open run: (tree, prefix, node or None)
    opened = {d: None for d in depths}  # the task's first run
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, label, node, need = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("tree", "label", "node", "depth"))
        label = label.view(np.uint64)
        left, right = [], []
        for d in depths:
            prefix = (label >> np.uint64(8 * (DEEPEST - d))).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])]))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
            content, newly = need <= d, need == d
            place = np.where(content, np.arange(len(node)), len(node))
            head = np.minimum.reduceat(place, starts)
            earlier = np.minimum.reduceat(np.where(need < d, np.arange(len(node)), len(node)), starts)
            # Nodes that need less are linked at a shorter prefix already: the first of them stands for all.
            joined = newly.copy()
            joined[earlier[earlier < len(node)]] = True
            at = np.flatnonzero(joined & (head[run] < np.arange(len(node))))
            left.append(node[head[run[at]]])
            right.append(node[at])
            first = (int(tree[0]), int(prefix[0]), int(node[head[0]]) if head[0] < len(node) else None)
            before = heads[d]
            if before is not None and before[:2] == first[:2]:
                if before[2] is not None and first[2] is not None:
                    left.append(np.array([before[2]]))
                    right.append(np.array([first[2]]))
                first = (*first[:2], before[2] if before[2] is not None else first[2])
            if opened[d] is None or before is not None and opened[d][:2] == first[:2]:
                opened[d] = first
            last = head[-1]
            heads[d] = first if len(starts) == 1 else (int(tree[-1]), int(prefix[-1]), int(node[last]) if last < len(node) else None)
        a, b = np.concatenate(left), np.concatenate(right)
        some = np.flatnonzero(a != b)  # members of one component are linked already
        pairs = np.unique(np.stack([np.minimum(a[some], b[some]), np.maximum(a[some], b[some])], axis=1), axis=0)
        k = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names=["a", "b", "task", "at_end", "depth", "prefix", "tree"])
    for at_end, found in enumerate((opened, heads)):
        rows = [(d, *found[d]) for d in depths if found[d] is not None]
        k = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[3] for r in rows], pa.int64()), pa.nulls(k, pa.int64()), pa.array([task] * k, pa.int32()), pa.array([at_end] * k, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())],
            names=["a", "b", "task", "at_end", "depth", "prefix", "tree"],
        )


def border_links(rows: list) -> list[tuple[int, int]]:
    """Links between the last run of each task and the first one of the next; rows: two of each depth and task."""
    out = []
    for depth in {r.depth for r in rows}:
        carried = None
        for r in sorted((r for r in rows if r.depth == depth), key=lambda r: (r.task, r.at_end)):
            here = (r.tree, r.prefix, r.a)
            if carried is not None and carried[:2] == here[:2]:
                if carried[2] is not None and here[2] is not None and carried[2] != here[2]:
                    out.append((carried[2], here[2]))
                here = (*here[:2], carried[2] if carried[2] is not None else here[2])
            carried = here
    return out


def forest_links(rows: DataFrame, shortest: int) -> DataFrame:
    """a, b: the links of the sorted tries of rows (tree, label, node, depth)."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = keep(ordered.mapInArrow(lambda batches: linked_runs(batches, shortest, TaskContext.get().partitionId()), LINKS))
    border = border_links(found.where("b is null").collect())  # a few rows of each task
    return found.where("b is not null").select("a", "b").unionByName(spark.createDataFrame(border, "a long, b long"))


def forest_components(nodes: DataFrame, trees: int, threshold: float, target: float) -> DataFrame:
    """node, n_ngrams, component of every node that enters the forest: those that meet in it, directly or over others, have one component. nodes: node, n_ngrams, labels."""
    depths = forest_depths(trees, threshold, target)
    shortest = int(depths[depths > 0].min()) if (depths > 0).any() else DEEPEST
    size = F.least("n_ngrams", F.lit(SIZED)).cast("int")
    entered = nodes.withColumn("depth", F.get(F.array(*(F.lit(int(d)) for d in depths)), size)).where("depth > 0")

    def planted(frame: DataFrame, first: int, many: int, name: str) -> DataFrame:
        return frame.select(F.posexplode(F.slice("labels", first + 1, many)).alias("tree", "label"), F.col(name).alias("node"), "depth").select("tree", "label", "node", "depth")

    first = min(FIRST_TREES, trees)
    near = components(forest_links(planted(entered, 0, first, "node"), shortest))
    labelled = keep(entered.join(near, "node", "left").select("node", "n_ngrams", "depth", "labels", F.coalesce("component", "node").alias("component")))
    if first == trees:
        return labelled.select("node", "n_ngrams", "component")
    wide = components(forest_links(planted(labelled, first, trees - first, "component"), shortest))
    grown = labelled.select("node", "n_ngrams", "component").join(wide.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    return keep(grown.select("node", "n_ngrams", F.coalesce("further", "component").alias("component")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that a chain of edges leads to.

    Each round, one job, a node takes the smallest label next to it, and what that label's own node was called in the
    round before; until no label changes.
    """
    both = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).where("a <> b").distinct())
    held = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        labels = held.select("node", "component")
        spread = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        near = labels.join(spread, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        seen = Observation()
        moved = near.join(far, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        moved = keep(moved.observe(seen, F.count_if(F.col("component") != F.col("was")).alias("changed")))
        discard(held)
        held = moved
        if not seen.get["changed"]:
            discard(both)
            return held.select("node", "component")


def id_slots(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(FILTER_SLOTS - 1)).astype(np.int64)


def id_filter(ids: DataFrame, key: str):
    """A function that tells for each id of an Arrow column whether it may be among `ids` (never wrongly no).

    A bit for each of FILTER_SLOTS slots, put together by block on the executors; half a megabyte comes to the driver.
    """
    block = 1 << 15

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_SLOTS, dtype=bool)
        for batch in batches:
            table[id_slots(batch.column(0))] = True
        used = np.flatnonzero(table.reshape(-1, block).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([np.packbits(table[k * block : (k + 1) * block]).tobytes() for k in used.tolist()], pa.binary())], names=["block", "bits"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(k, np.zeros(block // 8, dtype=np.uint8))
                held[k] |= np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "bits"])

    schema = "block long, bits binary"
    found = ids.select(F.col(key).cast("long")).mapInArrow(mark, schema).repartition("block").mapInArrow(united, schema).toArrow()
    packed = np.zeros(FILTER_SLOTS // 8, dtype=np.uint8)
    for k, bits in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        packed[k * (block // 8) : (k + 1) * (block // 8)] = np.frombuffer(bits, np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(packed)

    def maybe(column: pa.Array) -> np.ndarray:
        slots = id_slots(column)
        return (shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)

    return maybe


def pair_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of common n-grams of every set of left with every set of right (flat values and sizes)."""
    values = np.concatenate([left[0], right[0]])
    distinct, ids = np.unique(values, return_inverse=True)
    in_left = np.bincount(ids[: len(left[0])], minlength=len(distinct)) > 0
    in_right = np.bincount(ids[len(left[0]) :], minlength=len(distinct)) > 0
    shared = np.flatnonzero(in_left & in_right)
    place = np.full(len(distinct), -1)
    place[shared] = np.arange(len(shared))
    rows = [np.repeat(np.arange(len(s)), s) for _, s in (left, right)]
    columns = [place[ids[: len(left[0])]], place[ids[len(left[0]) :]]]
    out = np.zeros((len(left[1]), len(right[1])), dtype=np.float32)
    step = 1 << 11
    sorted_by = [np.argsort(c, kind="stable") for c in columns]
    for first in range(0, len(shared), step):
        dense = []
        for row, column, order, sizes in zip(rows, columns, sorted_by, (left[1], right[1])):
            low, high = np.searchsorted(column, [first, first + step], sorter=order)
            at = order[low:high]
            matrix = np.zeros((len(sizes), step), dtype=np.float32)
            matrix[row[at], column[at] - first] = 1
            dense.append(matrix)
        out += dense[0] @ dense[1].T
    return out


def verify(left: tuple, right: tuple | None, threshold: float) -> list[tuple[int, int, int, int]]:
    """(node, links to texts, links to documents, a linked node that leads to the group's root) of two blocks.

    A block: node ids, copies, flat n-grams, sizes. right None: the pairs inside one block.
    """
    other = left if right is None else right
    common = pair_counts((left[2], left[3]), (other[2], other[3]))
    linked = common >= threshold * (left[3][:, None] + other[3][None, :] - common) - 1e-4
    if right is None:
        np.fill_diagonal(linked, False)
    nodes = np.concatenate([left[0], other[0]]) if right is not None else left[0]
    a, b = np.nonzero(linked)
    b = b + (len(left[0]) if right is not None else 0)
    root = np.arange(len(nodes))
    while len(a):  # hooks to the smallest neighbour, halves the paths
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    texts = [linked.sum(axis=1)]
    documents = [linked @ other[1]]
    if right is not None:
        texts.append(linked.sum(axis=0))
        documents.append(left[1] @ linked)
    texts, documents = np.concatenate(texts), np.concatenate(documents)
    return [(int(nodes[i]), int(texts[i]), int(documents[i]), int(nodes[root[i]])) for i in np.flatnonzero(texts)]


def block_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Verifies group after group of rows sorted by component, i, j; holds one group (two blocks) at a time."""
    key, group = None, {}

    def done() -> Iterator[pa.RecordBatch]:
        sides = []
        for side in (0, 1):
            rows = [v for v in group.values() if v[0] == side]
            if rows:
                sets = [np.frombuffer(v[3], np.uint64) for v in rows]
                sides.append((np.array([v[1] for v in rows]), np.array([v[2] for v in rows]), np.concatenate(sets), np.array([len(s) for s in sets])))
        if key[1] == key[2]:
            found = verify(sides[0], None, threshold)
        else:
            found = verify(sides[0], sides[1], threshold) if len(sides) == 2 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names=["node", "texts", "documents", "root"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("component", "i", "j", "block", "node", "copies", "grams")]
        for component, i, j, block, node, copies, grams in zip(*columns):
            if (component, i, j) != key:
                if group:
                    yield from done()
                key, group = (component, i, j), {}
            group[node] = (int(block != i), node, copies, grams)
    if group:
        yield from done()


def links(nodes: DataFrame, docs: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    """node, component, texts, documents: every node that has a link, with its class and numbers of links.

    nodes: node, first_id, copies, n_ngrams, labels; docs: doc_id, text.
    """
    placed = forest_components(nodes, trees, threshold, target)
    many = F.greatest(F.ceil(F.sum("n_ngrams") / F.lit(BLOCK_NGRAMS)), F.ceil(F.count("*") / F.lit(BLOCK_NODES)))
    blocks = placed.groupBy("component").agg(F.count("*").alias("n"), many.cast("int").alias("blocks")).where("n > 1").drop("n")
    dealt = keep(
        placed.join(blocks, "component")
        .join(nodes.select("node", "first_id", "copies"), "node")
        .select("node", "component", "first_id", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    )
    maybe = id_filter(dealt, "first_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-gram sets of documents that may be in a component; most others stop here."""
        for batch in batches:
            batch = batch.filter(pa.array(maybe(batch.column("doc_id"))))
            for part in pieces(batch, "text", most=SLICE):
                grams, sizes = ngram_sets(part.column("text"))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(node_ids(grams, sizes).view(np.int64)), pa.array([grams[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist())], pa.binary())],
                    names=["doc_id", "node", "grams"],
                )

    loaded = docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, node long, grams binary").join(dealt.withColumnRenamed("first_id", "doc_id"), ["doc_id", "node"])
    pairs = loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "grams"
    )
    found = keep(
        pairs.repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(lambda batches: block_links(batches, threshold), "node long, texts long, documents long, root long")
    )
    classes = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    return found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents")).join(classes, "node", "left")


def classed_nodes(docs: DataFrame, key: str, text: str, threshold: float, trees: int, target: float) -> DataFrame:
    """What join_classes gives, with the node of each row (0 without words) and the node that stands for its class."""
    bound_batches(docs.sparkSession)
    checkpoint_dir(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is not a whole number: {docs.schema[key].dataType.simpleString()}")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", most=SLICE):
                grams, sizes = ngram_sets(part.column("text"))
                flat = labels_of(grams, sizes, trees)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, trees, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(node_ids(grams, sizes).view(np.int64)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1).view(np.int64)))],
                    names=["doc_id", "node", "n_ngrams", "labels"],
                )

    sketched = keep(rows.mapInArrow(sketch, NODE_ROWS))
    nodes = keep(sketched.where("n_ngrams > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n_ngrams").alias("n_ngrams"), F.any_value("labels").alias("labels")))
    linked = keep(nodes.select("node", "first_id", "copies").join(links(nodes, rows, threshold, trees, target), "node"))
    named = linked.groupBy("component").agg(F.min(F.struct("first_id", "node")).alias("lead")).select("component", F.col("lead.first_id").alias("class_id"), F.col("lead.node").alias("class_node"))
    # A table of its own, so that the last join is of two plain shuffles, whose large keys (copies) Spark can split.
    known = keep(nodes.select("node", "first_id", "copies").join(linked.join(named, "component").select("node", "texts", "documents", "class_id", "class_node"), "node", "left"))
    return sketched.select("doc_id", "node", "n_ngrams").join(known, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "first_id", "doc_id").alias("class_id"),
        F.coalesce("first_id", "doc_id").alias("copy_id"),
        (F.coalesce("documents", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        "node",
        F.coalesce("class_node", "node").alias("class_node"),
    )


def join_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, n_text_links of every row of docs that has an id.

    class_id: the smallest id of the class; copy_id: the smallest id with the same n-gram set; n_links: other
    documents at the threshold or above, copies included; n_text_links: other n-gram sets.
    """
    return classed_nodes(docs, key, text, threshold, trees, target).drop("node", "class_node")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all rows of a class but one of the smallest id; all columns stay.

    It is decided by row, told by id and n-gram set: of the sets that have a class's smallest id one stays, the one
    of the smallest hash. Rows without an id stay. Of rows that agree in id and n-gram set, or without words in id
    and text, one stays, that of the smallest text.
    """
    found = classed_nodes(docs, key, text, threshold, TREES, TARGET_RECALL)
    dropped = keep(found.where("doc_id <> class_id or node <> class_node").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct())
    again = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).count().where("count > 1").select("_id")
    looked_at = keep(dropped.select("_id").unionByName(again))
    maybe = id_filter(looked_at, "_id")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~maybe(batch.column(key))))

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.filter(pa.array(maybe(batch.column(key)))), text, most=SLICE):
                filled = part.column(text).fill_null("")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node_ids(*ngram_sets(filled)).view(np.int64))], names=[*part.schema.names, "_node"])

    rows = docs.mapInArrow(with_node, StructType([*docs.schema.fields, StructField("_node", LongType())])).withColumn("_id", F.col(key).cast("long"))
    left = rows.join(dropped, ["_id", "_node"], "left_anti")
    whole = docs.mapInArrow(untouched, docs.schema)
    if again.isEmpty():
        return whole.unionByName(left.select(docs.columns))
    once = left.join(again, "_id", "left_anti")
    several = left.join(again, "_id", "left_semi").groupBy("_id", "_node", F.when(F.col("_node") == 0, F.col(text)).alias("_text")).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text), F.lit(""))).alias("row"))
    return whole.unionByName(once.select(docs.columns)).unionByName(several.select("row.*"))
