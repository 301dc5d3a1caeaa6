"""Exact top-k search, the n-gram join, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from camtrap_spark.llm import ngram_join, topk_mtree
from camtrap_spark.llm.queries import TOP_K_SQL, queries

SMALL = "/root/testdata/sf0.001"


# -- top-k ---------------------------------------------------------------------------------------------------


def brute_top(vectors, k, divisor):
    fine = [(i, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if q % divisor == 0:
            scored = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("shape", ["random", "clusters", "copies"])
def test_top_k_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(topk_mtree, "SUBTREE_ROWS", 200)
    monkeypatch.setattr(topk_mtree, "ROUTING_ROWS", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8))
    if shape == "clusters":
        x = x * 0.05 + rng.normal(size=(6, 8))[rng.integers(0, 6, 1500)]
    if shape == "copies":
        x[::3] = x[0]
    vectors = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk_mtree.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == brute_top(vectors, 5, 50)


@pytest.mark.parametrize("size", [1e5, 1e6, 1.5e6])
def test_top_k_is_exact_for_large_components(spark, monkeypatch, size):
    monkeypatch.setattr(topk_mtree, "SUBTREE_ROWS", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) * size
    x[::7] = rng.normal(size=4)  # small ones and copies between them
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, [size, 1.0, 0.0, 0.0]), (1001, [size, 0.0, 0.0, 0.0]), (1002, [2 * size, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk_mtree.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    duck = duckdb.connect()
    table = df.toPandas()
    duck.register("embeddings", table)
    assert got == set(duck.execute(TOP_K_SQL).fetchall())


def test_top_k_refuses_scores_beyond_a_long(spark):
    rows = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 1.0]), (2, [-1e200, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError|too big|too large"):
        topk_mtree.top_k(rows, F.col("vec_id") % 50 == 0, 5).collect()


def test_large_routing_objects_are_cut_by_distance(spark, monkeypatch):
    monkeypatch.setattr(topk_mtree, "SUBTREE_ROWS", 50)
    monkeypatch.setattr(topk_mtree, "MOST_ROUTING", 2)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 6)), np.tile(rng.normal(size=6), (300, 1))])
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    subtrees, routing, _ = topk_mtree.build(topk_mtree.vectors_of(df, "vec_id", "embedding"), len(vectors))
    sizes = [len(r.ids) // 8 for r in subtrees.collect()]
    assert sum(sizes) == len(vectors) and max(sizes) < 150 and len(routing.owner) > 8
    rings = sorted((o, a, b) for o, a, b in zip(routing.owner, routing.low, routing.high))
    assert all(b <= c for (o, _, b), (p, c, _) in zip(rings, rings[1:]) if o == p)  # they do not overlap
    assert {tuple(r) for r in topk_mtree.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()} == brute_top(vectors, 5, 50)


def test_top_k_edges(spark):
    vectors = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0, 1.0]), (6, [3.0, 1.0]), (None, [9.0, 9.0]), (7, [1.0, 1.0, 1.0]), (50, [-1.0, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("v", F.lit(2)).withColumn("rank", F.lit(3))
    got = [tuple(r) for r in topk_mtree.top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    a, b, c = [np.floor(256 * np.array(v)).astype(int) for v in ([1.0, 2.0], [3.0, 1.0], [-1.0, 0.5])]
    assert got == [(0, 1, 6, a @ b), (0, 2, 6, a @ b), (0, 3, 50, a @ c), (50, 1, 0, a @ c), (50, 2, 6, b @ c), (50, 3, 6, b @ c)]
    assert topk_mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert {tuple(r) for r in queries()["op5_topk_mtree"](spark, SMALL).collect()} == set(duck.execute(TOP_K_SQL).fetchall())


# -- join ----------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(docs, threshold=0.8):
    """Links to other documents and class of each id, by all pairs that share an n-gram."""
    sets, holders = [shingles(t) for _, t in docs], defaultdict(list)
    n, root = Counter(), {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, k in common.items():
            if k >= threshold * (len(s) + len(sets[j]) - k):
                a, b = docs[i][0], docs[j][0]
                n[a] += 1
                n[b] += 1
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: (find(i), n[i]) for i, _ in docs}


def near_copies(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    docs, i = [], 0
    for group in range(25):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            docs.append((i, " ".join(text)))
            i += rng.choice([1, 1, 7])
    rng.shuffle(docs)
    return docs


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 400)  # several blocks in a group
    docs = near_copies()
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_join(docs)


def test_join_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries()["op10_ngram_join"](spark, SMALL).collect()}
    assert got == brute_join(docs)


def test_join_edges(spark):
    rows = [(5, None), (6, ""), (7, "one two"), (3, "One  TWO"), (8, " \n"), (None, "one two"), (9, "a b c d e f"), (9, "a b c d e f"), (2, "long " * 30_000), (10, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("count", F.lit(1)).withColumn("prefix", F.lit(2))
    got = sorted(tuple(r) for r in ngram_join.join_classes(df).collect())
    assert got == [(2, 2, 2, 1, 0), (3, 3, 3, 1, 0), (5, 5, 5, 0, 0), (6, 6, 6, 0, 0), (7, 3, 3, 1, 0), (8, 8, 8, 0, 0), (9, 9, 9, 1, 0), (9, 9, 9, 1, 0), (10, 2, 2, 1, 0)]
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "6", "8", "9", "None"]
    assert ngram_join.join_classes(df.limit(0)).count() == 0 and ngram_join.keep_one(df.limit(0)).count() == 0


def test_least_similarity_equals_enumeration():
    for size in range(1, 40):
        all_of = [c / (size + m - c) for m in range(1, 60) for c in range(1, min(size, m) + 1) if not c == m == size]
        want = min((s for s in all_of if s >= 0.8 - 1e-12), default=2.0)
        assert ngram_join.least_similarity(size, 0.8) == pytest.approx(want)


def test_forest_depths_reach_the_recall():
    depths = ngram_join.forest_depths(ngram_join.TREES, 0.8, ngram_join.TARGET_RECALL)
    assert (depths[:4] == 0).all() and set(depths[4:]) <= {6, 7, 8}
    for size in range(4, len(depths)):
        d, s = int(depths[size]), min(ngram_join.least_similarity(size, 0.8), 0.8 if size == len(depths) - 1 else 1)
        meets = lambda d: 1 - (1 - s**d) ** ngram_join.TREES
        assert meets(d) >= ngram_join.TARGET_RECALL and (d == ngram_join.DEEPEST or meets(d + 1) < ngram_join.TARGET_RECALL)


def runs_by_hand(rows, shortest):
    """Components of all pairs that share a prefix that is long enough for both, tree by tree."""
    root = {n: n for _, _, n, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for t, x, n, d in rows:
        for u, y, m, e in rows:
            if t == u and n != m and x >> (8 * (8 - max(d, e))) == y >> (8 * (8 - max(d, e))):
                a, b = find(n), find(m)
                root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("seed", range(3))
def test_forest_links_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    heads = [rng.randrange(1, 2**62) for _ in range(6)]
    rows = []
    for node in range(300):
        for tree in range(2):
            label = rng.choice(heads)
            for level in range(rng.choice([0, 1, 2, 3, 8])):
                label ^= rng.choice([0, 1, 1]) << (8 * level)
            rows.append((tree, label, node, [6, 6, 7, 8][node % 4]))
    df = spark.createDataFrame(rows, "tree int, label long, node long, depth int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # runs that go over batches and tasks
    try:
        found = {r.node: r.component for r in ngram_join.components(ngram_join.forest_links(df.repartition(5), 6)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = runs_by_hand(rows, 6)
    assert {n: found.get(n, n) for n in want} == want


def test_short_texts_that_share_one_ngram(spark):
    # 10,000 texts of six words, all with the same first five, and some of eight words with partners at exactly 0.8.
    rows = [(i, f"a b c d e w{i}") for i in range(10_000)]
    rows += [(20_000 + i, " ".join(f"{c}{i // 2}" for c in "pqrstuvw") + (" x" if i % 2 else "")) for i in range(400)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i, 0) for i in range(10_000))
    assert all(got[20_000 + i] == (20_000 + i // 2 * 2, 1) for i in range(400))


def test_join_of_many_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 16)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = f"x{i}"
        docs.append((i, " ".join(text)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_join(docs)


def test_join_refuses_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError):
        ngram_join.join_classes(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 200: 150, 150: 150}


# -- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.keep(stage(spark, before, "/root/testdata/sf0.01"))
        assert kept.columns == docs.columns
        assert kept.join(before, docs.columns, "left_anti").count() == 0
        seen.append(before.count() - kept.count())
        if name == "ngram_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            classes = brute_join(rows)
            assert {r.doc_id for r in kept.collect()} == {i for i, (c, _) in classes.items() if i == c}
        if name == "decontamination":
            bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
            assert not any(b in " ".join(r.text.lower().split()) for r in kept.collect() for b in bench)
    assert seen[0] > 0 and seen[1] <= 5 and seen[2] > 0 and seen[3] > 0
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()} and out.where("not round_trip").count() == 0


def test_pipeline_equals_brute_force(spark):
    from test_text_operators import brute_chain, brute_items
    from test_tokens import brute_viterbi

    from camtrap_spark.llm import decontaminate, language_id, toxicity
    from camtrap_spark.llm import sentencepiece_viterbi as sp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(i, t) for i, t in kept if brute_chain(t, chain)[0] < chain.threshold]
    model = language_id.fit(docs.where(F.col("doc_id").isin([i for i, _ in kept])), familiar=True)
    one = {i: [x[0] for x in language_id.judged([t], model)] for i, t in kept}
    kept = [(i, t) for i, t in kept if one[i][0] != "und" and one[i][1] >= 0.5 and one[i][2]]
    classes = brute_join(kept)
    kept = [(i, t) for i, t in kept if classes[i][0] == i]
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not brute_items(t, items)]
    vocabulary = sp.Vocabulary.load()
    want = {i: brute_viterbi(sp.to_codes(t), vocabulary) for i, t in kept}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SMALL).collect()} == want and len(want) > 100


def test_pipeline_on_long_texts_and_ties(spark, tmp_path):
    long = " ".join(f"word{i % 977} text{i % 53}" for i in range(60_000))
    rows = [(4, long, "en"), (2, long, "en"), (9, long + " more words", "en"), (7, "a short text of some words in a row", "en"), (7, "a short text of some words in a row", "en"), (3, "a short text of some words in a row", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such item in any of these texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.keep(stage(spark, kept, str(tmp_path)))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert {r.doc_id: r.round_trip for r in corpus_pipeline.encode(spark, kept, str(tmp_path)).collect()} == {2: True, 3: True}


def test_pipeline_stages_on_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "words in a row " * 9, "en", None, 1), (3, "words in a row " * 9, "en", None, 1), (None, "other words here", "en", "s", 2)], schema)
    docs = docs.withColumns({"toxic": F.lit(1), "key": F.lit("k"), "label": F.lit(None).cast("string")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        rows = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.keep(stage(spark, rows, str(tmp_path)))
            assert rows.columns == docs.columns
        assert corpus_pipeline.encode(spark, rows, str(tmp_path)).count() == (2 if table is docs else 0)


def test_keep_one_decides_by_row(spark):
    # One id with two texts: each row goes or stays with its own class.
    a, b, c = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, c + " c60", "x"), (8, "", "x"), (8, None, "x"), (8, "", "x"), (None, a, "x"), (9, b.upper(), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=str)
    sevens = [r for r in kept if r[0] == 7]
    assert len(sevens) == 1 and sevens[0][1] in (c, c + " c60")
    assert [r for r in kept if r[0] != 7] == sorted([(1, a), (5, b), (8, ""), (8, None), (None, a)], key=str)
