import math

import pytest
from pyspark.sql import functions as F

from camtrap_spark.functions import features as ft
from camtrap_spark.functions import names
from camtrap_spark.functions.strata import PRESETS, assign_categories, preset, quality_score
from camtrap_spark.operators import rarity
from camtrap_spark.schemas import IMAGES


def det(conf=0.9, box=(0.4, 0.4, 0.2, 0.2), category="1", cls=()):
    return {"category": category, "conf": conf, "bbox": [float(x) for x in box], "classifications": None if cls is None else [{"species_id": s, "conf": c} for s, c in cls]}


def images(spark, *detections):
    return spark.createDataFrame([(f"d/{i}.jpg", i, d) for i, d in enumerate(detections)], IMAGES)


def test_images_without_animals_are_dropped_and_thresholds_include(spark):
    df = images(spark, None, [], [det(category="2")], [det(conf=0.29)], [det(conf=0.30)])
    assert [r.image_ord for r in ft.image_features(df).collect()] == [4]


def test_features_of_one_image(spark):
    df = images(spark, [det(0.5, (0, 0, 0.1, 0.1)), det(0.9, (0.2, 0.2, 0.4, 0.5)), det(0.7, (0.0, 0.0, 0.5, 0.4)), det(0.99, category="3")])
    r = ft.image_features(df).first()
    assert r.num_animals == 3
    assert r.max_size == pytest.approx(0.2)
    assert r.avg_size == pytest.approx((0.01 + 0.2 + 0.2) / 3)
    assert r.max_confidence == 0.9
    # two boxes of the largest size: the first one gives the centrality
    assert r.centrality == pytest.approx(1 - math.hypot(0.4 - 0.5, 0.45 - 0.5))


def test_species_are_distinct_and_confident(spark):
    df = images(spark, [det(cls=[("a", 0.5), ("b", 0.49)]), det(cls=[("a", 0.9), ("c", 0.7)]), det(0.1, cls=[("z", 0.9)]), det(cls=None)])
    r = ft.image_features(df).first()
    assert r.species_list == ["a", "c"]
    assert r.num_species == 2


def test_rarity_counts_all_animals_and_ties_are_rare(spark):
    df = images(spark, [det(0.05, cls=[("a", 0.9)])], [det(cls=[("b", 0.9), ("b", 0.6)])], [det(category="2", cls=[("q", 0.9)])], [det(cls=[("c", 0.9)])], None)
    counts = rarity.species_counts(df)
    assert {r.species: r.n for r in counts.collect()} == {"a": 1, "b": 2, "c": 1}
    assert {r.species for r in rarity.rare_species(counts).collect()} == {"a", "c"}
    assert rarity.rare_species(rarity.species_counts(images(spark, None))).collect() == []


def test_many_species_are_joined_with_the_same_result(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("image_ord"), F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: F.concat(F.lit("s"), (F.col("id") * (i + 1) % 7001).cast("string"))).alias("species_list"))
    rows = rows.unionByName(spark.createDataFrame([(50_000, [])], "image_ord long, species_list array<string>"))
    counts = rows.select(F.explode("species_list").alias("species")).groupBy("species").agg(F.count("*").alias("n"))
    found = []
    for few in (50_000, 10):
        monkeypatch.setattr(rarity, "FEW_SPECIES", few)
        rare = rarity.rare_species(counts)
        marked = rarity.with_rarity(rarity.mark_rare(rows, rare), counts)
        assert ("_shares" in marked._jdf.queryExecution().optimizedPlan().toString()) == (few > 10)
        found.append((sorted(map(tuple, rare.collect())), sorted(map(tuple, marked.select("image_ord", "has_rare_species", "rarity").collect()))))
    assert found[0] == found[1] and len(found[0][1]) == 20_001
    assert {r[1] for r in found[0][1]} == {True, False} and found[0][1][-1] == (50_000, False, 0.0)


def test_threshold_is_number_n_div_5(spark):
    counts = spark.createDataFrame([(f"s{i}", i) for i in range(1, 12)], "species string, n long")  # 11 kinds: place 2
    assert {r.species for r in rarity.rare_species(counts).collect()} == {"s1", "s2", "s3"}


BOUNDARIES = [
    ("training", 1, 0.80, "single_huge"), ("training", 1, 0.79, "single_optimal"), ("training", 1, 0.10, "single_optimal"), ("training", 1, 0.099, "single_medium"),
    ("training", 1, 0.005, "single_medium"), ("training", 1, 0.0049, "single_tiny"), ("v1", 1, 0.15, "single_large"), ("v1", 1, 0.02, "single_medium"), ("v1", 1, 0.01, "single_medium"),
    ("improved", 1, 0.05, "single_large"), ("improved", 1, 0.001, "single_medium"), ("improved", 1, 0.0005, "single_medium"),
]


@pytest.mark.parametrize("rules, n, size, category", BOUNDARIES)
def test_category_boundaries(spark, rules, n, size, category):
    row = spark.createDataFrame([(n, size, 0.5, 0.5, 1)], "num_animals long, max_size double, max_confidence double, centrality double, num_species long")
    assert row.select(assign_categories(PRESETS[rules], F.lit(False))).first()[0] == [category]


def test_overlapping_labels(spark):
    schema = "num_animals long, max_size double, max_confidence double, centrality double, num_species long"
    rows = spark.createDataFrame([(2, 0.05, 0.85, 0.7, 2), (2, 0.5, 0.85, 0.7, 1), (2, 0.51, 0.85, 0.7, 1), (2, 0.2, 0.849, 0.7, 1)], schema)
    got = [r[0] for r in rows.select(assign_categories(PRESETS["sequence"], F.col("max_size") > 0.5)).collect()]
    assert got == [["multi_different_species", "high_action"], ["multi_same_species", "high_action"], ["multi_same_species", "rare_species"], ["multi_same_species"]]
    bare = spark.createDataFrame([(1, 0.01, 0.9, 0.2, 0)], schema)
    assert bare.select(assign_categories(PRESETS["v1"], F.lit(True))).first()[0] == ["rare_species"]


def test_quality_scores_by_hand(spark):
    row = spark.createDataFrame([(4, 0.2, 0.8, 0.6, 0.5, 2)], "num_animals long, max_size double, max_confidence double, avg_confidence double, centrality double, num_species long")
    z = 0.3 + 0.7 * math.exp(-((0.2 - 0.25) ** 2) / (2 * 0.15**2))
    want = {
        "single_tiny": 0.5 * 0.8 + 0.3 * 0.5 + 0.2 * z, "single_optimal": 0.5 * z + 0.3 * 0.5 + 0.2 * 0.8, "single_medium": 0.3 * z + 0.4 * 0.5 + 0.3 * 0.8,
        "multi_same_species": 0.3 * z + 0.3 * 0.8 + 0.2 * 0.5 + 0.2 * 0.8, "multi_different_species": 0.25 * z + 0.25 * 0.8 + 0.2 * 0.5 + 0.3 * 0.5,
        "rare_species": 0.4 * 0.8 + 0.4 * z + 0.2 * 0.5, "high_action": 0.3 * 0.8 + 0.3 * 0.5 + 0.3 * z + 0.1 * 0.6, "else": (z + 0.8 + 0.5) / 3,
    }
    for category, value in want.items():
        assert row.select(quality_score(preset("sequence"), F.lit(category))).first()[0] == pytest.approx(value)


def test_quota_truncates():
    assert preset("sequence", shares={"a": 0.29}).quotas(100) == {"a": 28}


def test_heuristic_uses_the_best_of_any_detection(spark):
    df = images(spark, [det(0.5, (0.45, 0.45, 0.1, 0.1), cls=[("a", 0.9)]), det(0.9, (0, 0, 0.5, 0.5), cls=[("b", 0.6)])])
    got = df.select(ft.heuristic_score(ft.animal_detections(F.col("detections")), F.lit(0.75))).first()[0]
    want = 3 * (math.log10(0.2501) + 4) + 2 * 1.0 + 0.9 + 1.5 * 1.0 + 2 * 1.0 + 0.75
    assert got == pytest.approx(want)


def test_names(spark):
    row = spark.createDataFrame([("a\\b/c:d.JPG", "models/x:1/y", 7.96)], "p string, m string, s double")
    got = row.select(
        names.flattened_name(F.col("p")), names.basename(F.col("p")), names.sanitize_model(F.col("m")), names.sanitize_model(F.col("m"), False), names.score_bucket(F.col("s")),
        names.score_display(F.col("s"), F.lit(True), F.lit(None)), names.score_display(F.col("s"), F.lit(False), F.lit("e")), names.score_display(F.col("s"), F.lit(False), F.lit(None)),
    ).first()
    assert tuple(got) == ("a#b#c:d.JPG", "c:d.JPG", "x-1-y", "models-x-1-y", 7, "8.0", "Unavailable", "FAILED")


@pytest.mark.parametrize("w, h, want", [(1000, 500, (768, 384)), (500, 1000, (384, 768)), (300, 300, (768, 768)), (100, 50, (768, 384))])
def test_resize(spark, w, h, want):
    assert tuple(spark.range(1).select(*names.resize_plan(F.lit(w), F.lit(h))).first()) == want


def test_costs(spark):
    row = spark.range(1).select(names.image_cost(F.lit("models/gemini-2.5-flash"), "batch"), names.image_cost(F.lit("gemini-2-5-pro"), "sync"), names.image_cost(F.lit("x"), "sync"), names.image_tokens(F.lit(769), F.lit(768))).first()
    assert tuple(row) == (0.0003337, 0.0026975, None, 516)
