"""Language identification, toxicity, licences, decontamination, HTML: small cases and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from camtrap_spark.llm import decontaminate, html_extract, language_id, license_scan, toxicity
from camtrap_spark.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def documents(spark, *texts, lang="en"):
    """With extra columns of the names that the operators use inside."""
    df = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({"key": F.lit("x"), "row": F.lit(1), "score": F.lit(2.0), "hash": F.lit(3), "n_words": F.lit(4)})


# -- language ------------------------------------------------------------------------------------------------


def two_languages(spark):
    en = ["the quick brown fox jumps over the lazy dog", "she sells sea shells on the shore", "this is the house that was built"] * 5
    de = ["der schnelle braune fuchs springt über den faulen hund", "das ist nicht mein haus", "wir gehen heute nicht in die schule"] * 5
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(100 + i, t, "de") for i, t in enumerate(de)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_are_told_apart(spark):
    model = language_id.fit(two_languages(spark))
    assert model.langs == ("de", "en")
    texts = documents(spark, "the dog that was lazy", "nicht der hund", None, "", "123 ... !!", "THE HOUSE")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(texts, model).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[2][1] == 0.0


def test_language_matches_brute_force(spark):
    model = language_id.fit(two_languages(spark), orders=(1, 2), buckets=64)
    texts = ["a Bc", "über  x", "q"]
    _, got = language_id.score_texts(texts, model)
    for text, score in zip(texts, got):
        total = dict(zip(model.langs, model.log_prior))
        symbols = [c if c.isalpha() else " " for c in text.lower()]
        for n in (1, 2):
            for i in range(len(symbols) - n + 1):
                gram = "".join(symbols[i : i + n])
                if gram[-1] == " " and (i + n < 2 or symbols[i + n - 2] == " "):
                    continue
                slot = language_id.ngrams([gram if n == 1 or gram[-1] != " " else gram], (1, 2), 64)[0][n - 1][0]
                for k, lang in enumerate(model.langs):
                    total[lang] += model.log_prob[slot[-1] if len(slot) else brute_slot(gram, n), k]
        values = np.array(list(total.values()))
        assert score == pytest.approx(1 / np.exp(values - values.max()).sum(), rel=1e-6)


def brute_slot(gram, n, buckets=64):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % buckets + (n - 1) * buckets


def test_nothing_learned_and_empty_table(spark):
    empty = documents(spark, "x").limit(0)
    model = language_id.fit(empty)
    assert [r.lang_pred for r in language_id.predict(documents(spark, "some text"), model).collect()] == ["und"]
    assert language_id.predict(empty, model).count() == 0
    assert {r.doc_id for r in language_id.remove(documents(spark, "text", "12", None), model).collect()} == {0}


def test_unlearned_languages_and_junk_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, familiar=True)
    strange = documents(spark, "これは学んでいない言語の文章です。" * 5, "Это предложение на другом языке, которого не было. " * 5, "xqzjk vvkqx zzxqj wqkzx jjqxv " * 8, None, "123")
    assert language_id.remove(strange, model).count() == 0
    n = docs.where("text is not null").count()
    assert language_id.remove(docs, model).count() >= 0.995 * n
    for lang in model.langs:  # clean texts of each language stay
        mine = docs.where(F.col("lang") == lang).where("n_chars > 200")
        assert language_id.remove(mine, model).count() >= 0.998 * mine.count()


def test_language_ties_repeats_and_long_texts(spark):
    same = spark.createDataFrame([(1, "abc abc", "x"), (2, "abc abc", "w")], DOCS)
    assert [r.lang_pred for r in language_id.predict(documents(spark, "abc", "abc"), language_id.fit(same)).collect()] == ["w", "w"]
    model = language_id.fit(two_languages(spark))
    got = language_id.predict(documents(spark, "the house that was built " * 40_000, "nicht der hund " * 40_000), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de"] and all(r.score > 0.99 for r in got)


def test_many_languages(spark, monkeypatch):
    rng = random.Random(5)
    words = {f"l{i:03}": ["".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(5)) for _ in range(4)] for i in range(300)}
    rows = spark.createDataFrame([(k, " ".join(rng.choices(words[lang], k=6)), lang) for k, lang in enumerate(sorted(words) * 2)], DOCS)
    model = language_id.fit(rows, buckets=1 << 12)
    assert len(model.langs) == 300 and model.log_prob.shape == (3 << 12, 300)
    got = language_id.predict(rows, model).join(rows, "doc_id")
    assert got.where("lang_pred = lang").count() == got.count() == 600
    monkeypatch.setattr(language_id, "LANGUAGES_A_PASS", 7)
    few = rows.where("lang < 'l030'")
    small = language_id.fit(few, buckets=64)
    monkeypatch.setattr(language_id, "LANGUAGES_A_PASS", 64)
    monkeypatch.setattr(language_id, "GATHERED", 30 * 4)
    assert np.array_equal(small.log_prob, language_id.fit(few, buckets=64).log_prob)
    texts = [r.text for r in few.collect()]
    pieces = language_id.totals(texts, small)[0]
    monkeypatch.setattr(language_id, "GATHERED", 1 << 24)
    assert pieces == pytest.approx(language_id.totals(texts, small)[0], rel=1e-9)


def test_language_query_is_accurate_on_held_out_documents(spark):
    got = queries()["op2_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id")
    right = held.where("lang = lang_pred").count()
    assert held.count() > 100 and right / held.count() > 0.97


# -- toxicity ------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeiklmnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilejerk", "vilejerks", "gruffwad"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, i % 2, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    chain = toxicity.fit(docs, labels.where("doc_id < 300"))
    got = {r.doc_id: r.toxic for r in toxicity.predict(docs, chain).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(300, 400))
    assert len(chain.models) == 3 and len(chain.models[1][1]) == 1 and len(chain.models[2][1]) == 2
    kept = {r.doc_id for r in toxicity.remove(docs.withColumn("hits", F.lit("x")), chain).collect()}
    assert kept == {i for i in range(400) if not got[i]}


def test_toxicity_edges(spark):
    docs, labels = labelled(spark)
    odd = documents(spark, None, "", "VileJerk!", "fine " * 30_000, "fine")
    chain = toxicity.fit(docs.unionByName(docs), labels.unionByName(spark.createDataFrame([(5, None, 1), (None, 1, 1), (9999, 1, 1), (1, 1, None)], labels.schema)))
    got = {r.doc_id: r.toxic for r in toxicity.predict(odd, chain).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False}
    never = toxicity.fit(docs, labels.limit(0))
    assert toxicity.predict(odd, never).where("toxic").count() == 0
    assert toxicity.predict(odd.limit(0), chain).count() == 0


def brute_chain(text, chain):
    """The probabilities of all categories, feature by feature."""
    import math

    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    grams = {w[i : i + 5] for w in words for i in range(len(w) - 4)}
    slots = set()
    for found, which in ((set(words), 0), (grams, 1)):
        for word in found:
            data = np.frombuffer(word, np.uint8)
            h = int(toxicity.span_hashes(toxicity.running(data), np.array([0]), np.array([len(data)]))[0])
            slots.add((h ^ (0x5A5A << 40 if which else 0)) >> (64 - toxicity.SLOT_BITS))
    features, odds, out = {int(f) for f in chain.feature_of[sorted(slots)] if f >= 0}, [], []
    for model in chain.models:
        z = -math.inf if model is None else model[2] + sum(model[0][f] for f in features) + sum(w * o for w, o in zip(model[1], odds))
        p = 0.0 if model is None else 1 / (1 + math.exp(-z))
        out.append(p)
        p = min(max(p, 1e-6), 1 - 1e-6)
        odds.append(math.log(p / (1 - p)))
    return out


def test_toxicity_probabilities_equal_brute_force(spark):
    docs, labels = labelled(spark)
    chain = toxicity.fit(docs, labels.where("doc_id < 300"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.predict(docs.where("doc_id >= 300"), chain).collect():
        assert brute_chain(texts[r.doc_id], chain) == pytest.approx([r.p_toxic, r.p_toxic_junk, r.p_toxic_prose], rel=1e-6, abs=1e-9)


def test_toxicity_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries()["op3_toxicity"](spark, SMALL).collect():
        want = brute_chain(texts[r.doc_id], chain)
        assert want == pytest.approx([r.p_toxic, r.p_toxic_junk, r.p_toxic_prose], rel=1e-6, abs=1e-9) and r.toxic == (want[0] >= chain.threshold)


def test_toxicity_ties_and_repeats(spark):
    docs, labels = labelled(spark)
    twice = docs.where("doc_id < 5").unionByName(docs.where("doc_id < 5"))
    chain = toxicity.fit(docs, labels)
    rows = toxicity.predict(twice, chain).collect()
    assert len(rows) == 10 and len({tuple(r) for r in rows}) == 5
    assert toxicity.best_threshold(np.array([0.9, 0.9, 0.1]), np.array([True, True, False])) == 0.5


def test_out_of_fold_predictions_do_not_see_their_fold():
    rng = np.random.default_rng(0)
    n, width = 200, 30
    present = rng.random((n, width)) < 0.2
    rows, columns = np.nonzero(present)
    y, fold = present[:, 0].astype(float), rng.integers(0, toxicity.FOLDS, n)
    chosen = rng.random((toxicity.FOLDS + 1, width)) < 0.7
    _, held = toxicity.fit_chain(rows, columns, n, chosen, [y], fold)
    other = np.where(fold == 2, 1 - y, y)  # the labels of one fold turned round
    _, again = toxicity.fit_chain(rows, columns, n, chosen, [other], fold)
    assert np.allclose(held[0][fold == 2], again[0][fold == 2]) and not np.allclose(held[0], again[0])


def test_toxicity_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    many = docs.where("doc_id = 5").join(spark.range(50), how="cross").select(docs.columns)
    assert toxicity.labelled_sample(many, labels.where("doc_id = 5"), "doc_id", "text", 1).count() == 1
    assert toxicity.labelled_sample(docs, labels, "doc_id", "text", 7).count() == 7


# -- licences ------------------------------------------------------------------------------------------------


def brute_base(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENCES = [
    "Released under the MIT License.", "x UNDER  the-MIT\nlicense, apache license; Version 2 cc-by-nc cc by nc", None, "", "no licence here " * 5, "under the mit licenses",
    "under the mit", "license under the mit license under the mit license", "ñandú under the mit license é", "word " * 20_000 + "apache license version 2", "CC BY NC",
    "This work is licensed under the GNU General Public License, version 3.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "general public version 3 of nothing", "the license of the public",
]


def test_license_base_equals_brute_force(spark):
    docs = documents(spark, *LICENCES)
    for r in license_scan.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(LICENCES[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_templates(spark):
    got = {r.doc_id: r.labels for r in license_scan.scan(documents(spark, *LICENCES)).collect()}
    assert got[11] == "gpl-3" and got[12] == "bsd" and got[13] == "" and got[14] == "" and got[4] == ""
    assert license_scan.scan(documents(spark, "x").limit(0)).count() == 0


def test_several_notices_in_one_text(spark):
    # Every template word votes: a text of all templates has all labels, however common some of its words are.
    labels = {label for label, _, _ in license_scan.TEMPLATES}
    common = [t for label, t, _ in license_scan.TEMPLATES if label in ("gpl-3", "lgpl-3", "cc-by", "mpl-2")]
    texts = [" and then ".join(t for _, t, _ in license_scan.TEMPLATES), *common * 3, *["other text of no licence"] * 1000]
    got = license_scan.scan(documents(spark, *texts)).orderBy("doc_id").first()
    assert set(got.labels.split(",")) == labels and got.score == 1.0


def brute_labels(text, rare):
    """The labels of one text by trying every template at every start."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    words, labels = words_of(text or ""), set()
    for label, template, keys in license_scan.TEMPLATES:
        body = words_of(template)
        slack = max(2, len(body) // 20)
        needed = min(2, len(set(body) & rare))
        for start in range(-len(body), len(words)):
            here = {i: {words[start + i + d] for d in range(-slack, slack + 1) if 0 <= start + i + d < len(words)} for i in range(len(body))}
            if not any(0 <= start + i < len(words) and words[start + i] == w and w in rare for i, w in enumerate(body)):
                continue
            if len({w for i, w in enumerate(body) if w in rare and w in here[i]}) < needed:
                continue
            low, high = max(0, start - slack), max(0, start + len(body) + slack)
            part = words[low:high]
            plain = lambda j: len(body) > license_scan.NOTICE_WORDS or not set(words[max(0, low + j - license_scan.NEGATED) : low + j]) & set(license_scan.NEGATIONS)
            if all(any(part[j : j + len(k)] == k and plain(j) for j in range(len(part))) for k in map(words_of, keys)) and sum(w in here[i] for i, w in enumerate(body)) >= 0.6 * len(body):
                labels.add(label)
    return labels


def test_license_labels_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for i in range(60):
        words = " ".join(t for _, t, _ in rng.sample(license_scan.TEMPLATES, rng.randint(1, 3))).split()
        for _ in range(rng.choice([0, 1, 3, 10, 40])):  # words lost, added and changed
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["software"], ["word"], ["not"], ["the", "license"]])
            words = words or ["word"]
        texts.append("some words before " * rng.randint(0, 3) + " ".join(words))
    texts += ["", None, "the license of the software", "word " * 30_000 + texts[0]]
    index = license_scan.LicenseIndex.build()
    docs = documents(spark, *texts, *["plain filler"] * 900)
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan.scan(docs).collect()}
    frequency, n = license_scan.document_frequency(docs, index)
    is_rare = lambda w: frequency[np.searchsorted(index.vocabulary, license_scan.word_hashes(w)[0])] <= 0.1 * n
    every = set(license_scan.NEGATIONS) | {w.lower() for _, t, _ in license_scan.TEMPLATES for w in re.findall(r"[A-Za-z0-9]+", t)}
    rare = {w for w in every if is_rare(w)}
    assert len(rare) == len(every)  # so that the words of phrases need no rule of their own
    for i, t in enumerate(texts[:-1]):
        assert got[i] == brute_labels(t, rare) | set(filter(None, brute_base(t)[4].split(","))), i
    assert got[len(texts) - 1] == got[0] and sum(map(bool, got.values())) > 30


def test_license_headings_identifiers_and_negations(spark):
    texts = {
        "# SPDX-License-Identifier: Apache-2.0\nimport os": "apache-2",
        "// spdx-license-identifier: GPL-3.0-or-later": "gpl-3",
        "SPDX-License-Identifier: CC-BY-NC-4.0": "cc-by-nc",
        "The MIT License (MIT)\n\nCopyright (c) someone": "mit",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies": "gpl-3",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "lgpl-2.1",
        "this work is not licensed under the GNU General Public License, version 3": "",
        "This isn't licensed under the GNU General Public License, version 2": "",
        "This isn't released under the MIT License.": "mit",  # a base label stays
        "never licensed under the Apache License, Version 2.0": "apache-2",  # so it does here
        "This is not lost. This work is licensed under the GNU General Public License, version 3": "gpl-3",
        "not licensed under the GNU General Public License, version 3, as was said of an earlier release, but licensed under the GNU General Public License, version 2": "gpl-2",
        "SPDX-License-Identifier: none of these": "",
    }
    got = license_scan.scan(documents(spark, *texts, *["other text of no licence"] * 200)).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        assert row.labels.replace("cc-by,cc-by-nc", "cc-by-nc") == texts[text], text


def test_license_repeated_rows(spark):
    docs = documents(spark, LICENCES[11])
    assert [r.labels for r in license_scan.scan(docs.unionByName(docs)).collect()] == ["gpl-3"] * 2


def test_license_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries()["op4_license_scan"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(docs[r.doc_id])


# -- decontamination -----------------------------------------------------------------------------------------


def brute_distance(pattern, text):
    previous = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, c in enumerate(text, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (p != c)))
        previous = row
    return min(previous)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        assert decontaminate.myers(decontaminate.masks_of(pattern), len(pattern), text)[0] == brute_distance(pattern, text)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("xyz")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, rng.choice("xyz"))
    return "".join(text)


def test_matches_are_those_within_the_budget(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(20)) for _ in range(6)]
    texts = []
    for i in range(60):
        noise = " ".join(word() for _ in range(30))
        item = items[i % 6]
        texts.append(f"{noise}\n{edited(rng, item, rng.randint(0, 20))}  {noise}".title() if i % 3 else noise)
    docs = documents(spark, *texts, None, "", "short")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(6, None), (None, items[0]), (7, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench, block_chars=300).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            distance = brute_distance(decontaminate.normal(item), decontaminate.normal(t))
            if distance <= int(decontaminate.RATE * len(item)):
                want[d, i] = distance
    assert got == want and len(want) > 5
    kept = {r.doc_id for r in decontaminate.remove(docs, bench, block_chars=300).collect()}
    assert kept == set(range(63)) - {d for d, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove(docs.limit(0), bench).count() == 0


def test_short_equal_and_repeated_items(spark):
    t = "one item of enough characters for edits"
    docs = documents(spark, f"x {t} y", f"x {t.replace('enough', 'enouhg')} y", "a tiny thing", "destiny", "Tiny\nThing", t + " " + t, "long " * 20_000 + t)
    docs = docs.unionByName(docs.where("doc_id = 0"))
    items = [("b", t), ("b", t), ("b", t.replace("enough", "enouhg")), ("a", "tiny"), ("c", " Tiny  thing "), ("d", " \n"), (None, "thing"), ("e", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block_chars in (1, 50, 10_000):
        got = sorted((r.doc_id, r.item_id, r.distance, r.start) for r in decontaminate.contaminated(docs, bench, block_chars=block_chars).collect())
        assert got == [(0, "b", 0, 2), (0, "b", 0, 2), (1, "b", 0, 2), (2, "a", 0, 2), (2, "c", 0, 2), (4, "a", 0, 0), (4, "c", 0, 0), (5, "b", 0, 0), (6, "b", 0, 100_000)]
        assert sorted(r.doc_id for r in decontaminate.remove(docs, bench, block_chars=block_chars).collect()) == [3]


def test_the_rate_alone_gives_the_budget(spark):
    item = "what is a mole?!"  # 16 characters: one edit
    docs = documents(spark, "so: what is a mule?! yes", "what is a mule!", "xx What  is a\nmole?! xx", "what is a")
    bench = spark.createDataFrame([(1, item), (2, "what is a mo")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, 1, 1), (2, 1, 0)]


def brute_items(text, items):
    """Id and distance of every item within its budget: the whole table of edit distances, a row at a time."""
    t, found = decontaminate.normal(text or ""), {}
    codes, steps = np.array([ord(c) for c in t], dtype=np.int64), np.arange(len(t) + 1)
    for k, item in items:
        # Only pairs that share eight characters in a row can be near; others are far beyond the budget.
        if any(item[a : a + 8] in t for a in range(0, len(item) - 8)):
            row = np.zeros(len(t) + 1, dtype=np.int64)
            for n, c in enumerate(item, 1):
                new = np.empty_like(row)
                new[0] = n
                new[1:] = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
                row = np.minimum.accumulate(new - steps) + steps
            if row.min() <= int(decontaminate.RATE * len(item)):
                found[k] = int(row.min())
    return found


def test_decontamination_query_equals_brute_force(spark):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {(r.doc_id, k): d for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for k, d in brute_items(r.text, items).items()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries()["op6_decontaminate"](spark, SMALL).collect()}
    assert got == want and len(got) >= 3


# -- HTML ----------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; T</h1><p>One <b>bo</b>ld<br>two\n\n three.<p>Four.</article><footer>f</footer>", "T & T One bold two three. Four."),
    (
        '<body><div id="top-menu"><a>Home</a></div><div class="content"><h2>Title</h2><p>Hello world one two three, plenty of words here.<p>Second paragraph with text, also plenty of it.</div>'
        '<div class="comments"><p>Nice post, really a nice post, so great!</div><div class=footer>c</div>',
        "Title Hello world one two three, plenty of words here. Second paragraph with text, also plenty of it.",
    ),
    ("<article><section><p>Long text one two three.</section><aside>side</aside><ul><li>i1<li>i2</ul><div class='ad'>buy</div><form>f</form><section class=comments><article><p>c</article></section></article>", "Long text one two three. i1 i2"),
    ("<script>var t='</p>';</script><style>p{}</style><p>only</p><!-- no --><noscript>x</noscript>", "only"),
    ("plain &lt;text&gt; &#228;", "plain <text> ä"),
    ("", ""),
    (None, ""),
    ("<nav>menu</nav>", ""),
    ('<p title="a > b">x</p><p title="it\'s>y</p><p>z</p>', None),
    ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("</p></div><p>after stray ends", "after stray ends"),
]


def test_html_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for r in html_extract.main_text(pages).collect():
        if PAGES[r.page_id][1] is not None:
            assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text) and r.url == f"u{r.page_id}"
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_html_query_finds_the_articles(spark):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries()["op7_html_text"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        article = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r.text == " ".join(h.unescape(article).split())


def brute_core(page):
    """The composite text density by its definition, on well-formed pages: the node of the largest density sum."""
    import math
    from html.parser import HTMLParser

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = {"tag": "#", "up": None, "kids": [], "n": 0}
            self.at = self.root

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "up": self.at, "kids": []}
            self.at["kids"].append(node)
            if tag not in html_extract.VOID:
                self.at = node

        def handle_endtag(self, tag):
            self.at = self.at["up"]

        def handle_data(self, data):
            self.at["kids"].append(data)

    builder = Builder()
    builder.feed(page)

    def counts(node, link=False):
        if isinstance(node, str):
            n = len("".join(node.split()))
            return n, 0, n * link, 0
        if node["tag"] in html_extract.DROPPED:
            return 0, -1, 0, 0
        link = link or node["tag"] == "a"
        got = [counts(k, link) for k in node["kids"]]
        inner = sum(not isinstance(k, str) and k["tag"] not in html_extract.DROPPED for k in node["kids"])
        links = sum(not isinstance(k, str) and k["tag"] == "a" for k in node["kids"])
        return sum(g[0] for g in got), inner + sum(max(g[1], 0) for g in got), sum(g[2] for g in got), links + sum(g[3] for g in got)

    body = next(k for k in builder.root["kids"][0]["kids"] if k["tag"] == "body")
    whole = counts(body)

    def density(node):
        c, t, lc, lt = counts(node)
        if not c:
            return 0.0
        t, lt = max(t, 1), max(lt, 1)
        return c / t * max(math.log(c / max(lc, 1) * t / lt) / math.log(math.e) / math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e), 0.0)

    best = (-1.0, None)
    nodes = [body]
    while nodes:
        node = nodes.pop(0)
        kids = [k for k in node["kids"] if not isinstance(k, str)]
        total = sum(density(k) for k in kids if k["tag"] not in html_extract.INLINE)
        if total > best[0] and node["tag"] not in html_extract.DROPPED:
            best = total, node
        nodes += kids
    return best[1]["tag"], best[0]


def test_html_core_equals_brute_force(spark):
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    for page in pages:
        page = re.sub(r"<(script|style)>.*?</\1>|<!--.*?-->|<!DOCTYPE html>|<div class=\"ad\">.*?</div>", "", page, flags=re.S)
        page = re.sub(r"</?b>|<br>", "", page).replace("<p><p>", "<p>")
        page = re.sub(r"(<p>[^<]*)(?=<p>)", r"\1</p>", page)
        tree = html_extract.Tree(page)
        _, _, _, total = html_extract.densities(tree)
        core = max(range(len(total)), key=lambda i: (total[i], -i))
        assert (tree.tag[core], round(total[core], 6)) == (brute_core(page)[0], round(brute_core(page)[1], 6))


def test_html_does_not_need_the_article_element(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        renamed = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_extract.extract(renamed) == html_extract.extract(r.html)


def test_html_names_do_not_decide_alone():
    long = " ".join(f"word{i}" for i in range(60))
    kept = [f'<div class="related-work"><p>A {long}</p></div>', f'<p class="side">B {long}</p>', f'<section id="search"><p>C {long}</p></section>']
    gone = ['<div class="ad">buy</div>', f'<div class="comments"><p>D {long}</p><p>D {long}</p></div>', '<ul class="related-posts"><li>E one</li></ul>']
    got = html_extract.extract(f"<body><article><h1>T</h1><p>{long}</p>{''.join(kept + gone)}</article></body>")
    assert all(f"{x} word0" in got for x in "ABC") and not any(x in got for x in ("buy", "D word0", "E one"))


def test_html_two_articles_and_text_beside_them():
    long = " ".join(f"word{i}" for i in range(60))
    got = html_extract.extract(f"<body><nav>m</nav><article><p>A {long}</p><p>{long}</p></article><article><p>B {long}</p><p>{long}</p></article><p>C {long}</p><footer>f</footer></body>")
    assert [got.find(f"{x} word0") >= 0 for x in "ABC"] == [True] * 3 and "m " not in got[:2]


def test_html_long_deep_and_repeated_pages(spark):
    import time

    deep = ["<div>word" * n for n in (2000, 16000)]
    took = []
    for page in deep:
        began = time.process_time()
        assert html_extract.extract(page).split() == ["word"] * page.count("word")
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 1  # linear: 8 times the depth
    long = "<body><article>" + "<p>some running text of a long page</p>" * 20_000 + "</article></body>"
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (1, "u", None)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_extract.main_text(pages).collect()) == [0] + [33 * 20_000 - 1] * 2


def test_html_keeps_text_outside_the_marked_element():
    # The body-path threshold runs on pages with <article>, too.
    p = "<p>" + "Some running text of an article. " * 8 + "</p>"
    links = "<div>" + '<a href="/x">a link</a> ' * 9 + "</div>"
    page = f"<body><article>{p}<p>{'The first one ends here. ' * 8}</p></article><article>{p * 9}</article><section><p>{'Text outside of them. ' * 20}</p></section>{links}</body>"
    got = html_extract.extract(page)
    assert "The first one ends" in got and "Text outside of them" in got and "a link" not in got


LONG = "<p>" + "The long text of an article goes on here, with commas, and with words. " * 3 + "</p>"


@pytest.mark.parametrize("page", [
    f'<body><article class="banner-story">{LONG}{LONG}</article></body>',
    f'<body><article class="subscription-story">{LONG}{LONG}</article><p>One unnamed sentence of forty letters.</p></body>',
    f'<body><form id="page-form">{LONG}{LONG}<input name="x"><button>Send</button></form></body>',
    f'<body><div class="comments">{LONG}{LONG}</div></body>',
    f'<body><div class="a">{LONG}{LONG}<p class="ad">Buy now, really buy.</p></div><section class="discussion"><p>I think that all this is wrong, and more.</p></section></body>',
    f'<body><div class="a">{LONG}{LONG}</div><div id="responses"><p>No, it is right, dear friend of the text.</p></div><form><p>Write to us, please, about the text.</p></form></body>',
    f'<body><div class="a">{LONG}{LONG}</div><section class="user-reviews"><p>Five stars, I read it all, and twice.</p></section><div class="read-next"><p>Another story, which is longer than this.</p></div></body>',
    f'<body><div class="a">{LONG}<p style="display: none">Hidden words are here.</p>{LONG}</div><div class="privacy"><p>We use cookies, and more cookies, for you.</p></div></body>',
])
def test_html_keeps_articles_and_drops_what_stands_beside_them(page):
    from camtrap_spark.llm.html_extract import extract

    wanted = " ".join("The long text of an article goes on here, with commas, and with words." for _ in range(6))
    found = extract(page)
    assert found.replace("One unnamed sentence of forty letters.", "").strip() == wanted
