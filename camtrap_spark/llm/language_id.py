"""Language identification: multinomial naive Bayes over hashed character n-grams.

`fit` counts n-grams of every training text on the executors (one table of fixed size for each task, summed by
block), a pass for each `LANGUAGES_A_PASS` languages; `predict` broadcasts the log-probability matrix and scores Arrow
batches in numpy, gathering only the rows of the n-grams that a text has. The matrix holds orders x buckets x languages
floats: it grows with the set of languages (393 KB each), not with the data.

With `familiar`, `fit` also notes how probable the n-grams of each language's own texts are on average, so that
`remove` can tell texts of languages and scripts that were never learned: by their posterior alone these are as sure
as any other.

Defined results: a null text, or one without a letter, is `und` with score 0.0, as is any text if nothing was
learned. Rows with null text or language teach nothing. Ties go to the language first in alphabetical order.
Repeated rows are predicted row by row; other columns of the input are never read by `predict`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_SCHEMA, bound_batches, gather_table, pieces, table_blocks

UND = "und"
#: Languages whose n-grams a task counts at a time: its table grows with them.
LANGUAGES_A_PASS = 64
#: Cells of the matrix that are gathered at a time.
GATHERED = 1 << 24


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: log P(bucket | language) of each order, one row for each bucket: float32 [orders * buckets, langs].
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]
    buckets: int
    #: Of each language the mean log-probability of an n-gram that its texts reach, if fitted so.
    least: np.ndarray | None = None


#: Bins of mean log-probabilities, to a unit and in all; the share of a language's own texts below, and how far below these a text is unfamiliar.
BINS, ALL_BINS, LOW_SHARE, MARGIN = 32, 1024, 0.001, 1.0
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(texts: list[str], orders: tuple[int, ...], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, the slots of all n-grams and the row of each; and whether a row has a letter.

    Lower-cased; every character that is not a letter counts as one space. n-grams stay inside a text and those
    that end in two spaces are left out.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = letter_table()[codes]
    has_letter = np.bincount(row[letter], minlength=len(texts)) > 0
    symbols = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    out, run = [], np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(orders) + 1):
            if n == 1:
                run, whole = symbols + np.uint64(1), keep
            else:
                run = np.concatenate([np.zeros(1, np.uint64), run[:-1]]) * np.uint64(0x100000001B3) + symbols + np.uint64(1)
                whole = keep.copy()
                whole[: n - 1] = False
                whole[n - 1 :] &= row[n - 1 :] == row[: len(row) - n + 1]
            if n in orders:
                at = np.flatnonzero(whole)
                slot = ((run[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
                out.append((slot + orders.index(n) * buckets, row[at]))
    return out, has_letter


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, alpha: float = 0.1, familiar: bool = False) -> LanguageModel:
    """Learns from every row that has a text and a language; familiar: in a second pass, what texts of each are like."""
    bound_batches(docs.sparkSession)
    train = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    by_lang = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(by_lang))
    if not langs:
        return LanguageModel((), np.zeros((len(orders) * buckets, 0), np.float32), np.zeros(0), orders, buckets)
    log_prob = np.empty((len(orders) * buckets, len(langs)), dtype=np.float32)
    for a in range(0, len(langs), LANGUAGES_A_PASS):
        some = langs[a : a + LANGUAGES_A_PASS]
        part = train if len(some) == len(langs) else train.where(F.col("lang").isin(*some))
        counts = ngram_counts(part, some, orders, buckets).reshape(len(orders), buckets, len(some)).astype(np.float64)
        log_prob[:, a : a + len(some)] = (np.log(counts + alpha) - np.log(counts.sum(axis=1, keepdims=True) + alpha * buckets)).reshape(-1, len(some))
    n = np.array([by_lang[x] for x in langs], dtype=np.float64)
    model = LanguageModel(langs, log_prob, np.log(n / n.sum()), orders, buckets)
    return replace(model, least=least_familiar(train, model)) if familiar else model


def ngram_counts(train: DataFrame, langs: tuple[str, ...], orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """How often the n-grams of each slot stand in the texts of each of these languages."""
    size = len(orders) * buckets * len(langs)
    code = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                labels = np.array([code[x] for x in part.column("lang").to_pylist()])
                for slots, rows in ngrams(part.column("text").to_pylist(), orders, buckets)[0]:
                    np.add.at(table, slots * len(langs) + labels[rows], 1) if len(slots) < 4096 else table.__iadd__(np.bincount(slots * len(langs) + labels[rows], minlength=size))
        yield from table_blocks(table)

    return gather_table(train.mapInArrow(count, BLOCK_SCHEMA), size)


def least_familiar(train: DataFrame, model: LanguageModel) -> np.ndarray:
    """Of each language the mean log-probability that all but LOW_SHARE of its texts reach, less MARGIN."""
    shared, size = train.sparkSession.sparkContext.broadcast(model), ALL_BINS * len(model.langs)
    code = {x: i for i, x in enumerate(model.langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                label = np.array([code[x] for x in part.column("lang").to_pylist()])
                total, n, has_letter = totals(part.column("text").to_pylist(), shared.value)
                mean = (total - shared.value.log_prior)[np.arange(len(label)), label] / np.maximum(n, 1)
                bins = np.clip(-mean * BINS, 0, ALL_BINS - 1).astype(np.int64)
                table += np.bincount((label * ALL_BINS + bins)[has_letter], minlength=size)
        yield from table_blocks(table)

    counts = gather_table(train.mapInArrow(count, BLOCK_SCHEMA), size).reshape(-1, ALL_BINS)
    beyond = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # texts in this bin or a less probable one
    last = np.array([int(np.flatnonzero(b > LOW_SHARE * max(1, b[0]))[-1]) if b[0] else ALL_BINS for b in beyond])
    return -(last + 1) / BINS - MARGIN


def totals(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the log-probability with each language, its n-grams, and whether it has a letter."""
    grams, has_letter = ngrams(texts, model.orders, model.buckets)
    total, n = np.tile(model.log_prior, (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
    step = max(1, GATHERED // len(model.langs))
    for slots, rows in grams:
        for a in range(0, len(rows), step):
            here = rows[a : a + step]
            firsts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            total[here[firsts]] += np.add.reduceat(model.log_prob[slots[a : a + step]], firsts, axis=0, dtype=np.float64)
        n += np.bincount(rows, minlength=len(texts))
    return total, n, has_letter


def judged(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability and familiarity (whether the text is like those of the language) of each text."""
    given = ["" if t is None else t for t in texts]
    if not model.langs:
        return [UND] * len(given), np.zeros(len(given)), np.ones(len(given), dtype=bool)
    total, n, has_letter = totals(given, model)
    best = total.argmax(axis=1)
    top = total[np.arange(len(given)), best]
    score = np.where(has_letter, 1.0 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
    familiar = np.ones(len(given), dtype=bool)
    if model.least is not None:
        familiar = (top - model.log_prior[best]) / np.maximum(n, 1) >= model.least[best]
    return [model.langs[b] if ok else UND for b, ok in zip(best, has_letter)], score, familiar


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    return judged(texts, model)[:2]


def predictor(model: LanguageModel, docs: DataFrame):
    """A function from a list of texts to what `judged` says of them, that takes the broadcast model to the executors."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: judged(texts, shared.value)


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """key, the columns of `extra`, lang_pred and score (0 to 1) of every row."""
    scorer, names = predictor(model, docs), [key, *(extra or {}), "lang_pred", "score"]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(c.alias(n) for n, c in (extra or {}).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lang, score, _ = scorer(part.column("text").to_pylist())
                kept = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    schema = rows.drop("text").withColumnRenamed("key", key).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def remove(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a probability of `least` or more, with all their columns.

    Rows that are `und` go, and rows that are unlike the texts of their language, if the model knows that (`familiar`).
    If nothing was learned, only rows without a letter go.
    """
    scorer, learned = predictor(model, docs), bool(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(text).to_pylist()
                if learned:
                    lang, score, familiar = scorer(texts)
                    fine = [x != UND and s >= least and f for x, s, f in zip(lang, score, familiar)]
                else:
                    fine = [t is not None and any(c.isalpha() for c in t) for t in texts]
                yield part.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
