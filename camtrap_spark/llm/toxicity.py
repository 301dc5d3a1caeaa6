"""Toxicity by a classifier chain.

Features are the hashed words of a text and the hashed byte 5-grams inside them, present or not. On the labelled
documents (at most `MAX_LABELLED`, the ids of smallest hash, one text each) the executors count, fold by fold, in how
many toxic and clean texts each feature occurs; the features most associated with toxic texts are kept. The chain then
predicts its categories one after the other by regularised linear models: `toxic` (the label), `toxic_junk` (toxic and
of low quality), `toxic_prose` (toxic and of good quality). Every later model also sees the log-odds of the earlier
categories: in training these are out-of-fold predictions, by models whose features, too, were chosen without the
fold, so that it learns from errors of the size it will meet. The threshold of the decision is the one of the best F1
on the out-of-fold predictions.

The bounded fit (`MAX_LABELLED` rows of `MAX_FEATURES` features for each fold at most) runs on the driver; every text
is scored.

Defined results: null and empty texts have no feature; their probabilities are those of a text without evidence.
A category without positive rows has probability 0. Without labels nothing is toxic. Labels that disagree about a
document count as toxic; null labels and labels without a document are left out; of several texts of a labelled id the
first in order counts. Of features with the same association the one of the smaller hash is kept; of thresholds with
the same F1 the lowest. Repeated rows are scored row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK, BLOCK_SCHEMA, LOWER, WORD, bound_batches, cut, pieces, running, span_hashes, sum_blocks, table_blocks, utf8, words

MAX_LABELLED = 20_000
MAX_FEATURES = 2048
SLOT_BITS = 20
GRAM = 5
LEAST_RATIO = 10.0
CATEGORIES = ("toxic", "toxic_junk", "toxic_prose")
FOLDS = 5
#: Places of a feature's counts in the table, by fold and class; a power of two, so that a block holds whole features.
KINDS = 16


def feature_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot and row of every word and every in-word 5-gram of the texts."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, row = words(data, offsets, WORD)
    sums = running(data)
    grams = ends - starts - GRAM + 1
    many = np.maximum(grams, 0)
    last = np.cumsum(many)
    at = np.arange(last[-1] if len(last) else 0) + np.repeat(starts - (last - many), many)
    hashes = np.concatenate([span_hashes(sums, starts, ends), span_hashes(sums, at, at + GRAM) ^ np.uint64(0x5A5A << 40)])
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate([row, np.repeat(row, many)])


@dataclass(frozen=True)
class ToxicityChain:
    #: Of each slot its feature, or -1.
    feature_of: np.ndarray
    #: For each category: feature weights, weights of earlier log-odds, bias; None: never.
    models: tuple[tuple[np.ndarray, np.ndarray, float] | None, ...]
    threshold: float


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, width: int, more: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 300):
    """Logistic regression over present features and some dense columns, by accelerated gradient descent."""
    if not y.any():
        return None
    weights, dense, bias = np.zeros(width), np.zeros(more.shape[1]), float(log_odds(np.array([y.mean()]))[0])
    vw, vd, vb = weights.copy(), dense.copy(), bias
    scale = more.std(axis=0) + 1e-9 if more.shape[1] else np.ones(0)
    seen = np.bincount(columns, minlength=width)
    step_w = 4.0 / (np.maximum(seen, 1) * max(1.0, len(columns) / max(1, n)) ** 0.5 + 4 * ridge)
    for turn in range(rounds):
        z = vb + more @ (vd / scale) + np.bincount(rows, weights=vw[columns], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new_w = vw - step_w * (np.bincount(columns, weights=error[rows], minlength=width) + ridge * vw)
        new_d = vd - 1.0 / n * ((more / scale).T @ error + ridge * vd)
        new_b = vb - 2.0 / n * error.sum()
        pull = turn / (turn + 3)
        vw, vd, vb = new_w + pull * (new_w - weights), new_d + pull * (new_d - dense), new_b + pull * (new_b - bias)
        weights, dense, bias = new_w, new_d, new_b
    return weights, dense / scale, bias


def predict_linear(model, rows: np.ndarray, columns: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(n)
    z = model[2] + more @ model[1] + np.bincount(rows, weights=model[0][columns], minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(rows: np.ndarray, columns: np.ndarray, n: int, chosen: np.ndarray, targets: list[np.ndarray], fold: np.ndarray):
    """The chain's models and the out-of-fold predictions of each category.

    chosen: of each fold the columns that may be used without it, last those of the whole; bool [FOLDS + 1, columns].
    """
    more, models, out_of_fold = np.zeros((n, 0)), [], []
    width = chosen.shape[1]
    for y in targets:
        held = np.zeros(n)
        for f in range(FOLDS):
            train, test, may = fold != f, fold == f, chosen[f][columns]
            new_id = np.cumsum(train) - 1
            use = train[rows] & may
            model = fit_linear(new_id[rows[use]], columns[use], int(train.sum()), width, more[train], y[train])
            new_id = np.cumsum(test) - 1
            use = test[rows] & may
            held[test] = predict_linear(model, new_id[rows[use]], columns[use], int(test.sum()), more[test])
        use = chosen[FOLDS][columns]
        models.append(fit_linear(rows[use], columns[use], n, width, more, y))
        out_of_fold.append(held)
        more = np.column_stack([more, log_odds(held)])
    return tuple(models), out_of_fold


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """At most `most` labelled documents, a row for each id: text, toxic, junk, fold."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(most)
    )
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FOLDS)).cast("int")
    one = rows.join(F.broadcast(known), "key").groupBy("key").agg(F.min("text").alias("text"), F.any_value("toxic").alias("toxic"), F.any_value("quality").alias("quality"))
    return one.select("key", "text", (F.col("toxic") > 0).alias("toxic"), (F.col("quality") == 0).alias("junk"), fold.alias("fold"))


def association(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, least_ratio: float = LEAST_RATIO) -> np.ndarray:
    """G-squared of each feature with the label; 0 unless it is `least_ratio` times as frequent in toxic texts."""
    a, b = toxic.astype(float), clean.astype(float)
    n, c, d = n_toxic + n_clean, n_toxic - a, n_clean - b

    def part(x, row, column):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) * max(n, 1) / np.maximum(row * column, 1e-9)), 0.0)

    g = 2 * (part(a, a + b, n_toxic) + part(b, a + b, n_clean) + part(c, c + d, n_toxic) + part(d, c + d, n_clean))
    ratio = (a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))
    return np.where(ratio >= least_ratio, g, 0.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, least_docs: int = 3) -> ToxicityChain:
    bound_batches(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, key, text, max_labelled))
    slots = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots * KINDS, dtype=np.uint16 if max_labelled < 1 << 16 else np.uint32)  # of each feature, by fold and class, the texts
        for batch in batches:
            for part in pieces(batch, "text"):
                slot, row = feature_slots(part.column("text"))
                pairs = np.unique(row * slots + slot)
                kind = np.asarray(part.column("fold").to_pylist(), dtype=np.int64) * 2 + np.asarray(part.column("toxic").to_pylist(), dtype=np.int64)
                np.add.at(table, pairs % slots * KINDS + kind[pairs // slots], table.dtype.type(1))
        yield from table_blocks(table)

    texts = np.zeros(KINDS, dtype=np.int64)
    for r in sample.groupBy("fold", "toxic").count().collect():  # ten rows at most
        texts[r.fold * 2 + int(r.toxic)] = r["count"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the tables of its blocks and gives the features that are associated, without each fold and over all."""
        for batch in sum_blocks(batches):
            for block, total in zip(batch.column("block").to_pylist(), batch.column("total").to_pylist()):
                counts = np.frombuffer(total, np.int64).reshape(-1, KINDS)
                for fold in range(FOLDS + 1):
                    use = [k for k in range(2 * FOLDS) if k // 2 != fold]
                    toxic, clean = (counts[:, [k for k in use if k % 2 == c]].sum(axis=1) for c in (1, 0))
                    n_toxic, n_clean = (int(texts[[k for k in use if k % 2 == c]].sum()) for c in (1, 0))
                    g = association(toxic, clean, n_toxic, n_clean)
                    g[toxic < min(least_docs, max(1, n_toxic))] = 0.0
                    at = np.flatnonzero(g > 10.83)  # the 0.1 % point of chi-squared
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), fold, np.int32)), pa.array(at + block * (BLOCK // KINDS)), pa.array(g[at])], names=["fold", "slot", "g"])

    candidates = sample.select("text", "toxic", "fold").mapInArrow(count, BLOCK_SCHEMA).repartition("block").mapInArrow(choose, "fold int, slot long, g double")
    best = Window.partitionBy("fold").orderBy(F.desc("g"), "slot")
    found = candidates.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= max_features).collect()  # max_features for each fold at most
    parts = [np.array([r.slot for r in found if r.fold == f], dtype=np.int64) for f in range(FOLDS + 1)]
    union = np.unique(np.concatenate(parts))
    feature_of = np.full(slots, -1, dtype=np.int32)
    feature_of[union] = np.arange(len(union))
    if not texts[1::2].sum() or not len(parts[FOLDS]):
        return ToxicityChain(feature_of, (None,) * len(CATEGORIES), 1.0)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, feature, _ = present(part.column("text"), feature_of)
                cuts = np.searchsorted(row, np.arange(1, part.num_rows))
                packed = [x.astype(np.int32).tobytes() for x in np.split(feature, cuts)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("toxic"), part.column("junk"), part.column("fold"), pa.array(packed, pa.binary())], names=["key", "toxic", "junk", "fold", "features"])

    found = sample.mapInArrow(evidence, sample.drop("text").schema.add("features", "binary")).toArrow().sort_by("key")  # max_labelled rows at most
    packed = [np.frombuffer(x, dtype=np.int32) for x in found.column("features").to_pylist()]
    rows, columns = np.repeat(np.arange(len(packed)), [len(x) for x in packed]), np.concatenate(packed)
    toxic, junk, fold = (np.asarray(found.column(c).to_pylist()) for c in ("toxic", "junk", "fold"))
    chosen = np.stack([np.isin(union, part) for part in parts])
    models, held = fit_chain(rows, columns, len(packed), chosen, [x.astype(float) for x in (toxic, toxic & junk, toxic & ~junk)], fold)
    return ToxicityChain(feature_of, models, best_threshold(held[0], toxic))


def best_threshold(p: np.ndarray, truth: np.ndarray) -> float:
    grid = np.arange(0.5, 1.0, 0.02)
    hit = np.array([(p >= t)[truth].sum() for t in grid], dtype=float)
    f1 = 2 * hit / (np.array([(p >= t).sum() for t in grid]) + truth.sum())
    return float(grid[np.argmax(f1)])


def present(column: pa.Array, feature_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of each feature that a row has, in order; and the number of places with one, for each row."""
    slot, row = feature_slots(column)
    feature = feature_of[slot]
    at = np.flatnonzero(feature >= 0)
    pairs = np.unique(row[at] << 32 | feature[at])
    return pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(row[at], minlength=len(column))


def chain_probabilities(column: pa.Array, chain: ToxicityChain) -> tuple[list[np.ndarray], np.ndarray]:
    row, feature, hits = present(column, chain.feature_of)
    n, out = len(column), []
    more = np.zeros((n, 0))
    for model in chain.models:
        p = predict_linear(model, row, feature, n, more)
        out.append(p)
        more = np.column_stack([more, log_odds(p)])
    return out, hits


def predict(docs: DataFrame, chain: ToxicityChain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, toxic (the decision), the probability of each category and the number of hits of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = docs.select(F.col(key)).schema.add("toxic", "boolean")
    for c in CATEGORIES:
        schema = schema.add(f"p_{c}", "double")
    schema = schema.add("hits", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                p, hits = chain_probabilities(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(p[0] >= shared.value.threshold), *(pa.array(x) for x in p), pa.array(hits)], names=[key, "toxic", *(f"p_{c}" for c in CATEGORIES), "hits"])

    return rows.mapInArrow(run, schema)


def remove(docs: DataFrame, chain: ToxicityChain, text: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield part.filter(pa.array(chain_probabilities(part.column(text), shared.value)[0][0] < shared.value.threshold))

    return docs.mapInArrow(run, docs.schema)
