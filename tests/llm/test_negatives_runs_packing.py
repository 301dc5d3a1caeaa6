"""Hard negatives, periodic runs and packing against brute force, by unit and as whole queries."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from camtrap_spark.llm import hard_negatives, packing, periodic_runs, queries

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# -- hard negatives ------------------------------------------------------------------------------------------


def mined(rows, anchor, k=5):
    """Every pair, in plain Python. rows: id, label, whole components."""
    fine = [r for r in rows if None not in r[:2] and r[2] and all(x is not None and np.isfinite(x) for x in r[2])]
    fine = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in fine]
    out = []
    for i, label, v in fine:
        if not anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        others = [(-score(w), j, other) for j, other, w in fine if len(w) == len(v)]
        own = sorted((s, j) for s, j, other in others if other == label and j != i)[:k]
        for p, pid in own:
            below = sorted((s, j) for s, j, other in others if other != label and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(i, pid, rank + 1, j, -p, -s) for rank, (s, j) in enumerate(below)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, key string, v int, anchor long")


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "ROUND_ANCHORS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(300)]
    rows += rows[:40] + [(i, 1, rows[3][2]) for i in range(300, 330)]  # repeated rows, ties
    rows += [(400, None, [0.5] * 6), (None, 1, [0.5] * 6), (401, 1, None), (402, 1, []), (403, 1, [0.5, None, 0.0, 0.0, 0.0, 0.0]), (404, 1, [float("nan")] * 6), (405, 2, [float("inf")] * 6)]
    rows += [(500 + i, i % 2, [float(i % 5), 1.0]) for i in range(20)] + [(600, 0, [0.0] * 6), (610, 1, [0.0] * 6)]
    got = hard_negatives.mine(vectors(spark, [(*r, "k", 1, 2) for r in rows]).repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_components_and_few_rows(spark):
    big = [(10, 0, [1e6, 3.0]), (11, 0, [1e6, 2.0]), (12, 1, [0.9e6, 1.0]), (13, 1, [1e5, 1.0])]
    got = hard_negatives.mine(vectors(spark, [(*r, "k", 1, 2) for r in big]), F.col("vec_id") == 10)
    assert sorted(map(tuple, got.collect())) == mined(big, lambda i: i == 10)
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") == 10).collect() == []
    assert hard_negatives.mine(vectors(spark, [(10, 0, [1.0], "k", 1, 2)]), F.col("vec_id") == 10).collect() == []


def block_of(x, labels):
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(len(x)), pa.int64()), "label": pa.array(labels, pa.int64()), "v": pa.array((x / 256).tolist(), pa.list_(pa.float64()))})
    cell = next(iter(hard_negatives.pack(iter([batch]))))
    return hard_negatives.Block.of({n: cell.column(n)[0].as_py() for n in cell.schema.names})


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 90), st.integers(1, 5), st.integers(1, 4))
def test_threshold_search_finds_the_best(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-4, 5, (n, dims)).astype(float), rng.integers(-3, 4, dims).astype(float)
    allowed, scores = rng.random(n) < 0.7, (x @ q).astype(int)
    high = int(rng.integers(-5, 20))
    wanted = [hard_negatives.Wanted(k), hard_negatives.Wanted(k, high - 6, high)]
    hard_negatives.threshold_search(block_of(x, [0] * n), q, allowed, wanted)
    order = sorted((-int(scores[i]), i) for i in np.flatnonzero(allowed))
    assert list(zip((-wanted[0].scores).tolist(), wanted[0].ids.tolist())) == order[:k]
    assert list(zip((-wanted[1].scores).tolist(), wanted[1].ids.tolist())) == [o for o in order if high - 6 <= -o[0] <= high][:k]


def test_threshold_search_stops_early():
    rng = np.random.default_rng(1)
    x = np.floor(np.outer(rng.random(4000) ** 4, [200.0, 100.0, 50.0]))  # lists that agree
    scored = hard_negatives.threshold_search(block_of(x, [0] * 4000), np.array([3.0, 2.0, 1.0]), np.ones(4000, bool), [hard_negatives.Wanted(5)])
    assert scored < 200


def test_negatives_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = c.execute(queries.oracle_sql()["op11_hard_negatives"]).fetchall()
    assert want and sorted(map(tuple, queries.op11_hard_negatives(spark, SMALL).collect())) == sorted(want)


# -- periodic runs -------------------------------------------------------------------------------------------


def plain_runs(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b > a and b + q - a >= max(least, exponent * q):
                found.setdefault((a, b + q - a), q)
            a = b + 1
    return sorted((a, length, q) for (a, length), q in found.items())


WORDS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(2, 6), st.integers(1, 40))
def test_catchers_find_all_runs_whatever_the_portions(parts, exponent, portion):
    words = [w for unit, times in parts for w in unit * times]
    hashes = np.array([(w + 1) * 0x1234567 for w in words], np.uint64)
    for size in (1, portion, max(1, len(words))):
        catchers = periodic_runs.Catchers(exponent, 6)
        for a in range(0, len(words), size):
            catchers.append(hashes[a : a + size])
        assert list(zip(*(x.tolist() for x in catchers.runs()))) == plain_runs(words, exponent)


def test_long_runs_in_few_steps():
    unit = np.arange(1, 1001, dtype=np.uint64)
    catchers = periodic_runs.Catchers()
    catchers.append(np.concatenate([np.tile(unit, 300), np.full(300_000, 7, np.uint64), np.arange(5000, 300_000, dtype=np.uint64)]))
    assert list(zip(*(x.tolist() for x in catchers.runs()))) == [(0, 300_000, 1000), (300_000, 300_000, 1)]


def collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return [w for i, w in enumerate(words) if i not in gone]


TEXTS = [None, "", "   \n", "a", "a a a a a", "a a a a a a", " x\ty x\x0by x y\r\nx y  z", "é é é é é é b", "a b " * 3000, "w" * 100_000, "p q r s " * 3 + "p q r s", "           ", "a b c a b c a b c a b c d d d d d d d"]


def test_runs_of_texts(spark):
    rows = [(i, t, "n", [1], "c") for i, t in enumerate(TEXTS + TEXTS)] + [(None, "a a a a a a a", "n", [1], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, runs array<int>, collapsed string")
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id): r for r in got}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, 6000, 2)]
        assert [tuple(r) for r in by_text[i].runs] == runs
        assert by_text[i].collapsed == " ".join(collapsed(words, runs))
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_runs_query_on_the_whole_table(spark):
    def one(doc_id, text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        numbers = {x: i for i, x in enumerate(dict.fromkeys(w))}
        x, found = np.array([numbers[v] for v in w]), {}
        for q in range(1, len(w) // 4 + 1):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b + q - a >= max(6, 4 * q):
                    found.setdefault((a, b + q - a), q)
        runs = sorted((a, length, q) for (a, length), q in found.items())
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        return doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()

    docs = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    want = [one(*r) for r in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist())]
    got = queries.op12_periodic_runs(spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] for r in want) > 10


# -- packing -------------------------------------------------------------------------------------------------


def check_packing(pieces, ids_of, window):
    """pieces: row (of the document), start, length, ids, doc_tokens, sequence_id, offset. Gives tokens and padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(ids_of)
    for row, parts in by_doc.items():
        whole = np.array(ids_of[row], "<u4")
        at = 0
        for _, start, length, ids, n, *_ in sorted(parts, key=lambda p: p[1]):
            assert (start, n) == (at, len(whole)) and ids == whole[start : start + length].tobytes() and length > 0
            at += length
        assert at == len(whole)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p[6])
        ends = np.cumsum([p[2] for p in parts])
        assert [p[6] for p in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= window
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else window - int(ends[-1])
    return padding


NASTY = [None, "", " ", "Hello, WORLD's  naïve café", "café é", "́start ́ x", "it's 12345 <|endoftext|> a<|startoftext|>b", " x y　z", "日本語 のテキスト", "İstanbul ΣΑΣ ΑΣ", "a\u0000b \x1c\x1d", "🙂🙂 🙂", "w" * 5000, "힣가", "x y\x85z"]


def test_units_encode_as_whole_texts():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    encoder = packing.UnitEncoder(open(VOCABULARY, encoding="utf-8").read())
    texts = NASTY + pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist()
    from camtrap_spark.llm.common import utf8

    for _ in range(2):
        ids, n = encoder.encode(*utf8(pa.array(texts, pa.string())))
        parts = np.split(ids, np.cumsum(n)[:-1])
        for text, part in zip(texts, parts):
            assert part.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing_of_repeated_null_and_long_rows(spark):
    texts = NASTY + NASTY + ["same words here"] * 500 + ["a b c d e f g h " * 2000, "x"]
    rows = [(i if i % 7 else None, t, i, "t", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, task string, rest int").repartition(5)
    for window in (16, 100):
        got = packing.pack(docs, VOCABULARY, key="row", window=window)
        assert got.columns == ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        tokenizer = Tokenizer.from_file(VOCABULARY)
        ids_of = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
        assert check_packing([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.collect()], ids_of, window) == 0
    assert packing.pack(docs, VOCABULARY, window=16).where("doc_id is null").select("doc_id", "start").distinct().count() >= 1
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []


def test_packing_without_broadcast_and_sequences(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4)
    want = {r[:2] + r[2:] for r in map(tuple, packing.pack(docs, VOCABULARY).drop("ids", "sequence_id", "offset").collect())}
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    packed = packing.pack(docs, VOCABULARY)
    rows = packed.collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(r[0], r[3]) for r in want}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for sequence in whole:
        parts = sorted((r.offset, bytes(r.ids)) for r in rows if r.sequence_id == sequence)
        assert b"".join(p[1] for p in parts) == whole[sequence] and len(whole[sequence]) <= 4 * 2048


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=24, max_size=24))
def test_plan_places_every_id_once(counts):
    window = 24
    histogram = np.array(counts)
    histogram[0] = 0
    plan = packing.solve(histogram, window, 3)
    taken = {}
    for length in range(1, window):
        for nth in range(int(histogram[length])):
            done = 0
            for start, size, sequence, offset in plan.places(length, nth):
                assert start == done and sequence >= 3
                done += size
                for i in range(offset, offset + size):
                    assert (sequence, i) not in taken
                    taken[sequence, i] = True
            assert done == length
    sizes = np.bincount([s for s, _ in taken]) if taken else np.zeros(0, int)
    assert all(n in (0, 24) or n & (n - 1) == 0 for n in sizes.tolist())


def test_least_squares_reach_a_histogram_that_combinations_made():
    window = 64
    lengths, times = packing.combinations(window, np.arange(1, window))
    assert ((lengths * times).sum(axis=1) == window).all()
    rng = np.random.default_rng(2)
    x = np.where(rng.random(len(lengths)) < 0.1, rng.integers(1, 1000, len(lengths)), 0)
    histogram = np.zeros(window, np.int64)
    np.add.at(histogram, lengths.ravel(), (times * x[:, None]).ravel())
    found = packing.least_squares(lengths, times, histogram)
    made = np.zeros(window)
    np.add.at(made, lengths.ravel(), (times * found[:, None]).ravel())
    assert (found >= 0).all() and np.abs(made - histogram).sum() < 0.01 * histogram.sum()


def test_packing_query_fills_sequences(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids_of = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist())}
    got = queries.op13_packing(spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = []
    for doc_id, start, length, crc, n, sequence, offset in got.collect():
        ids = np.array(ids_of[doc_id][start : start + length], "<u4").tobytes()
        assert crc == zlib.crc32(ids)
        pieces.append((doc_id, start, length, ids, n, sequence, offset))
    assert check_packing(pieces, ids_of, 2048) == 0


if __name__ == "__main__":
    raise SystemExit(pytest.main([__file__]))
