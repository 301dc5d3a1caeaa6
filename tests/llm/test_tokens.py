"""SentencePiece coding, token counts, LM scores."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from camtrap_spark.llm import lm_scoring, token_counts
from camtrap_spark.llm import sentencepiece_viterbi as sp
from camtrap_spark.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load()


def brute_viterbi(codes, v):
    n = len(codes)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for j in range(1, n + 1):
        for k in range(min(j, v.longest), 0, -1):
            piece = v.by_codes.get(tuple(codes[j - k : j]))
            ids = (piece[0],) if piece else None
            if piece is None and k == 1:
                text = "▁" if codes[j - 1] == sp.LITERAL else chr(codes[j - 1])
                piece, ids = (0, v.unknown_score), tuple(v.byte_ids[b] for b in text.encode())
            if piece and best[j - k] + piece[1] > best[j]:
                best[j], back[j] = best[j - k] + piece[1], (j - k, ids)
    out, j = [], n
    while j:
        j, ids = back[j]
        out.append(ids)
    return [i for run in reversed(out) for i in run]


def odd_texts():
    rng = random.Random(3)
    fixed = ["", "a", "  two  spaces ", "\n\n", "x▁y ▁", "日本語 漢字😀😀 é", "a" * 300, "\t tab", "Ünïcödé ñandú", "https://example.com/" + "q1" * 60, "á​"]
    return fixed + ["".join(rng.choice("ab e th \n▁😀éñ") for _ in range(rng.randint(0, 80))) for _ in range(100)]


def test_viterbi_equals_brute_force_and_round_trips(vocabulary):
    texts = odd_texts()
    ids, n = sp.BatchEncoder(vocabulary).encode(texts)
    ends = np.cumsum(n)
    for text, end, k in zip(texts, ends, n):
        got = ids[end - k : end].tolist()
        assert got == brute_viterbi(sp.to_codes(text), vocabulary)
        assert sp.decode(got, vocabulary) == text


def test_every_id_is_committed_by_convergence_or_at_the_end(vocabulary, monkeypatch):
    monkeypatch.setattr(sp, "STREAM_CHARS", 1 << 30)  # a text is one stream
    text = "the cat sat on the mat " * 50 + "unbroken" * 40
    encoder = sp.BatchEncoder(vocabulary)
    ids, _ = encoder.encode([text])
    assert ids.tolist() == brute_viterbi(sp.to_codes(text), vocabulary)
    assert encoder.converged + encoder.at_end == len(ids) and encoder.at_end <= 3 * vocabulary.longest < encoder.converged


def test_paths_that_do_not_converge(vocabulary):
    # Phases of one repeated character never agree inside the horizon; they are committed at the end.
    texts = ["a" * 1000, "=" * 999, "ab" * 300 + "é" * 200, "\u4e00" * 500]
    encoder = sp.BatchEncoder(vocabulary)
    ids, n = encoder.encode(texts)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [brute_viterbi(sp.to_codes(t), vocabulary) for t in texts]


def unspaced_texts(n):
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    words = "".join(rng.choice(["the", "station", "ing", "work", "house", "and"]) for _ in range(n // 4))
    return [letters, words, letters[: n // 2].upper() + "+/9" * (n // 6), "\u65e5\u672c\u8a9e\u6f22" * (n // 8), "a" * (n // 4), "thecat" * (n // 20)]


def test_texts_without_spaces_are_cut_where_no_piece_reaches_over(vocabulary):
    encoder = sp.BatchEncoder(vocabulary)
    for text in unspaced_texts(6000):
        assert encoder.encode([text])[0].tolist() == brute_viterbi(sp.to_codes(text), vocabulary)
    letters = unspaced_texts(1_000_000)[0]
    codes = np.array(sp.to_codes(letters), dtype=np.uint32)
    begins, reach = encoder.reaches(codes, np.array([0]))
    _, lengths = encoder.streams(len(codes), np.array([0]), encoder.shared(begins, encoder.spell(codes, reach)))
    assert len(lengths) > 1000 and lengths.sum() == len(codes) and lengths[0] < 4 * sp.STREAM_CHARS


@pytest.mark.parametrize("window", [64, 300, 2000])
def test_windows_do_not_change_ids(vocabulary, monkeypatch, window):
    monkeypatch.setattr(sp, "WINDOW_CHARS", window)
    texts = [*odd_texts(), *unspaced_texts(2400), None, "ab " * 500]
    ids, n = sp.BatchEncoder(vocabulary).encode(texts)
    for text, end, k in zip(texts, np.cumsum(n), n):
        assert ids[end - k : end].tolist() == brute_viterbi(sp.to_codes(text or ""), vocabulary)


def test_encode_query_equals_brute_force_and_round_trips(spark, vocabulary):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    encoded = queries()["op8_sentencepiece"](spark, SMALL)
    assert encoded.count() == docs.count() and encoded.where("not round_trip").count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encoded.collect():
        assert r.ids == brute_viterbi(sp.to_codes(texts[r.doc_id]), vocabulary) and r.n_ids == len(r.ids)
    again = sp.decode_documents(encoded)
    assert again.join(docs, ["doc_id", "text"]).count() == docs.count()


def test_encode_very_long_text_through_the_operator(spark, vocabulary):
    words = ["alpha", "beta\n", "gämma", "x" * 50]
    text = " ".join(words[i * i % 4] for i in range(60_000))
    rows = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = sp.encode_documents(rows).collect()
    assert got[0].ids == got[1].ids == brute_viterbi(sp.to_codes(text), vocabulary) and all(r.round_trip for r in got)


def test_encode_edges(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "same", 9), (2, "same", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.n_ids, r.round_trip, r.ids is None) for r in sp.encode_documents(rows).collect()), key=str)
    assert (1, None, None, True) in got and (2, 0, True, False) in got and len(got) == 5
    assert sp.encode_documents(rows.limit(0)).count() == 0
    assert {r.text for r in sp.decode_documents(sp.encode_documents(rows)).collect()} == {None, "", "same", "x"}


# -- token counts --------------------------------------------------------------------------------------------


def brute_sections(text, ranks):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
    counts, crossing = [0] * len(starts), [0] * len(starts)
    char_of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for token in e.encode_ordinary(text):
        size = len(e.decode_single_token_bytes(token))
        chars = range(char_of_byte[at], char_of_byte[at + size - 1] + 1)
        at += size
        held = Counter(max(s for s in range(len(starts)) if starts[s] <= c) for c in chars)
        most = max(held.values())
        section = min(s for s, k in held.items() if k == most)
        counts[section] += 1
        crossing[section] += len(held) > 1
    return counts, crossing


def test_token_counts_equal_brute_force(spark):
    texts = ["", "one\ntwo\n\n\nthree", "\n\n\n\n", "日本語\n漢字😀\n\n😀é", "a" * 3000 + "\n" + "b", "no lines", "end\n"] + odd_texts()[:40]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key0 string")
    got = {}
    for r in token_counts.section_tokens(rows).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_crossing))
    ranks = token_counts.read_ranks()
    for i, t in enumerate(texts):
        assert got[i] == list(zip(*brute_sections(t, ranks))), repr(t)


def test_fields_and_edges(spark):
    rows = spark.createDataFrame([(1, "user", "hello there"), (2, None, "x"), (3, "user", None), (3, None, None)], "id long, role string, text string")
    got = token_counts.section_tokens(rows, ("id",), ("role", "text"), by_line=False).collect()
    assert len(got) == 8
    first = [(r.field, r.start, r.end, r.n_tokens) for r in got if r.id == 1]
    assert first == [("role", 0, 5, 2), ("text", 5, 16, 2)]
    assert token_counts.section_tokens(rows.limit(0), ("id",), ("role", "text")).count() == 0


def test_long_fields_in_any_place(spark):
    long = "word " * 500_000
    rows = spark.createDataFrame([(i, long if i % 2 else "x", "y" if i % 2 else long) for i in range(4)], "id long, role string, text string")
    got = token_counts.section_tokens(rows, ("id",), ("role", "text"), by_line=False).groupBy("id").agg(F.sum("n_tokens").alias("n")).collect()
    assert len({r.n for r in got}) == 1 and got[0].n > 500_000


# -- LM scores -----------------------------------------------------------------------------------------------


def tokens_of(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [None]


def check_base(docs, rows, divisor, rest):
    counts = Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % divisor == rest for i, _ in docs}
    for i, t in docs:
        if not held[i]:
            counts.update(tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held[i], len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t)), 6)) for i, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want


def test_lm_query_has_the_exact_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries()["op1_lm_scoring"](spark, SMALL).collect()
    check_base(docs, rows, 7, 2)
    assert all(r.score < 0 and r.bits_per_byte < 8 for r in rows if r.n_bytes > 50)


@pytest.mark.parametrize("name", ["lm_scoring_base", "license_scan_base"])
def test_base_queries_equal_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert {tuple(r) for r in queries()[name](spark, SMALL).select(*columns).collect()} == set(found.fetchall())


@pytest.mark.parametrize("frequent", [1, 4, 1 << 20])
def test_lm_base_with_few_frequent_tokens(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    docs = [(1, "a b a b c"), (2, "A\tB  a"), (2, "A\tB  a"), (3, None), (4, ""), (None, "z z"), (5, "é é " * 200), (6, "unseen words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("row", F.lit(2))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    check_base(docs, lm_scoring.score(df, held).collect(), 3, 1)


def test_lm_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert lm_scoring.score(df.limit(0), F.lit(False)).count() == 0
    r = lm_scoring.score(df, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)


def test_bit_probabilities_add_up():
    """Over all 257 symbols, the probabilities of the next symbol sum to one."""
    rng = np.random.default_rng(0)
    counts = np.append(rng.integers(0, 1000, 256), 10)
    code = lm_scoring.Code.of(counts)
    assert abs(sum(2.0 ** -int(k) for k in code.lengths) - 1) < 1e-12
    table = rng.integers(-100, 100, sum(lm_scoring.TABLES)).astype(np.int8)
    gates = lm_scoring.LEVELS * lm_scoring.DEPTHS * lm_scoring.CLASSES
    p = rng.uniform(0.05, 0.95, (lm_scoring.CLASSES, 2 * lm_scoring.MAP_HALF + 1))
    cost = np.log10(np.stack([1 - p, p], axis=-1)).astype(np.float32).reshape(-1)
    model = lm_scoring.MixModel(code, table, rng.normal(0, 0.5, (3, gates)).astype(np.float32), cost)
    context = rng.integers(0, 1 << 18, (3, 1))
    s = lm_scoring.Symbols(np.arange(257), np.repeat(context, 257, axis=1), np.zeros(257, np.int64))
    assert (10 ** lm_scoring.symbol_costs(s, model)).sum() == pytest.approx(1, abs=1e-4)


def unit_hash(symbols):
    stream = np.array(symbols, dtype=np.int64)
    return int(lm_scoring.span_hashes(lm_scoring.running(stream), np.array([0]), np.array([len(stream)]))[0])


def brute_score(text, mix, again, passages, kinds):
    """The score of one text, symbol by symbol and bit by bit; again: the counts of repeated passages by their hash."""
    data = [c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()] + [lm_scoring.END]
    units, unit = [], []
    for c in data:
        unit.append(c)
        if c in (9, 10, 11, 12, 13, 32, lm_scoring.END):
            units.append(unit)
            unit = []

    def symbol_cost(symbol, last, word):
        last = (last + [lm_scoring.PAD] * 4)[:4]
        two = last[0] << 9 | last[1]
        four = two | last[2] << 18 | last[3] << 27
        slots = [(x * (0x9E3779B97F4A7C15 + 2 * k) % 2**64) >> (65 - size.bit_length()) for k, (x, size) in enumerate(zip((two, four, word), lm_scoring.TABLES))]
        cost, start = 0.0, int(mix.code.starts[symbol])
        for at in range(start, start + int(mix.code.lengths[symbol])):
            node, bit = int(mix.code.nodes[at]), int(mix.code.bits[at])
            found = [int(mix.table[lm_scoring.OFFSETS[k] + ((slots[k] + node) & (lm_scoring.TABLES[k] - 1))]) for k in range(3)]
            before = int(lm_scoring.BYTE_CLASS[last[0]])
            gate = min(at - start, lm_scoring.DEPTHS - 1) * lm_scoring.CLASSES + before + int(lm_scoring.LEVEL_GATE[found[2] + 128])
            mixed = np.float32(0)
            for k in range(3):
                mixed += np.float32(found[k]) * mix.weights[k][gate]
            cell = int(np.rint(np.clip(mixed * np.float32(lm_scoring.MAP_STEP / lm_scoring.TABLE_STEP), -lm_scoring.MAP_HALF, lm_scoring.MAP_HALF)))
            cost += float(mix.cost[(before * lm_scoring.CELLS + lm_scoring.MAP_HALF + cell) * 2 + bit])
        return cost

    costs = []
    for i, u in enumerate(units):
        before = units[i - 1] if i else []
        word = (unit_hash(before[:-1]) if i else 0) ^ 1 << 40
        cost = symbol_cost(u[0], before[::-1], word)
        for j in range(1, len(u)):
            cost += symbol_cost(u[j], u[:j][::-1], unit_hash(u[:j]))
        costs.append(cost)
    words = [unit_hash(u[:-1]) for u in units]
    total, first = 0.0, 0
    for i in range(len(units)):
        border = i and int(lm_scoring.mix(np.array([(words[i] + words[i - 1] * 31) % 2**64], dtype=np.uint64))[0]) % lm_scoring.PASSAGE == 0
        if i == len(units) - 1 or border:
            symbols = [c for u in units[first : i + 1] for c in u]
            c = again.get(unit_hash(symbols) ^ int(lm_scoring.PASSAGE_SALT), 1)
            own = 10 ** sum(costs[first : i + 1])
            total += math.log10((c - 1) / passages + kinds / passages * own) if own > 0 else math.log10((c - 1) / passages) if c > 1 else sum(costs[first : i + 1]) + math.log10(kinds / passages)
            first = i + 1
    return total


def test_lm_score_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(80)]
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += texts[:10] + [None, "", " ", "É 漢字 ABC\tabc", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 7 == 3
    scorer, counts = lm_scoring.fit(df.where(~held), "text")
    again = {r.hash % 2**64: r.n for r in counts.where("passage").collect()}
    assert len(again) > 10 and scorer.passage_kinds < scorer.passages
    for r in lm_scoring.score(df, held).collect():
        assert r.score == pytest.approx(brute_score(texts[r.doc_id], scorer.mix, again, scorer.passages, scorer.passage_kinds), rel=1e-5, abs=1e-3), r.doc_id
    # A text that occurs twice among those learned from is more probable than one of the same kind that does not.
    bits = {r.doc_id: r.bits_per_byte for r in lm_scoring.score(df, held).collect()}
    assert np.mean([bits[i] for i in range(10) if i % 7 != 3 and (60 + i) % 7 != 3]) < 0.6 * np.mean([bits[i] for i in range(10, 60)])


def test_lm_long_text_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 2000)
    monkeypatch.setattr(lm_scoring, "KINDS_HELD", 50)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcd", k=3)) for _ in range(n)) for n in (5000, 3, 900, 700, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in lm_scoring.score(df, F.lit(False)).collect()}
    monkeypatch.undo()
    want = {r.doc_id: r.score for r in lm_scoring.score(df, F.lit(False)).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_lm_mixer_learns_from_all_texts(spark):
    # Texts of any length, and more of them than any sample: each changes code, weights and map.
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(300)]
    long = [" ".join(rng.choices(words, k=6000)) for _ in range(3)]
    assert min(map(len, long)) > 20_000
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    scorer, _ = lm_scoring.fit(df, "text")
    counts = np.bincount(np.frombuffer("".join(long).encode(), np.uint8), minlength=257)
    counts[256] = len(long)
    assert (scorer.mix.code.lengths == lm_scoring.Code.of(counts).lengths).all()
    assert (scorer.mix.weights != np.float32(lm_scoring.START_WEIGHT)).sum() > 50
    assert (scorer.mix.cost != lm_scoring.map_costs(np.zeros(len(scorer.mix.cost)))).sum() > 500
    other, _ = lm_scoring.fit(df.repartition(3), "text")
    assert (other.mix.weights == scorer.mix.weights).all() and (other.mix.cost == scorer.mix.cost).all()
