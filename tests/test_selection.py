import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from camtrap_spark import fixtures as fx
from camtrap_spark import queries
from camtrap_spark.functions.strata import preset
from camtrap_spark.operators import profile, selection
from camtrap_spark.operators.order_stats import values_at
from camtrap_spark.plans import selectors

SMALL = "/root/testdata/sf0.001"
GROUP = "category string, seq_id string, file string, image_ord long, quality_score double"


def test_golden_selection(spark):
    rows = selectors.select_sequence_aware(fx.images(spark, SMALL), fx.metadata(spark, SMALL), 100, preset("sequence", score_scale=6)).collect()
    assert len(rows) == 100
    assert sum(r.phase for r in rows) == 2
    assert len({r.seq_id for r in rows}) == 70
    assert sum(r.quality_score for r in rows) == pytest.approx(83.7842, abs=1e-4)
    assert hashlib.md5("|".join(sorted(f"{r.category},{r.file}" for r in rows)).encode()).hexdigest() == "1e1441070027e862d3cd2040b63ec034"


def test_selection_does_not_depend_on_partitions(spark):
    pick = lambda images: {(r.category, r.file, r.rank) for r in selectors.select_sequence_aware(images, fx.metadata(spark, SMALL), 60).collect()}
    images = fx.images(spark, SMALL)
    assert pick(images) == pick(images.repartition(7, F.xxhash64("file")))


def test_best_per_sequence_takes_the_first_of_equals(spark):
    rows = [("a", "s", "1", 5, 0.5), ("a", "s", "2", 3, 0.9), ("a", "s", "3", 1, 0.9), ("b", "s", "3", 1, 0.1), ("a", None, "4", 7, 0.2)]
    got = {(r.category, r.seq_id): (r.file, r.sequence_size, r.group_ord) for r in selection.best_per_sequence(spark.createDataFrame(rows, GROUP)).collect()}
    assert got == {("a", "s"): ("3", 3, 1), ("b", "s"): ("3", 1, 1), ("a", None): ("4", 1, 7)}


def test_quota_and_fill(spark):
    rows = [("multi_same_species", f"s{i}", f"f{i}", i, 1 - i / 100) for i in range(10)] + [("high_action", "s0", "f0", 0, 0.5), ("high_action", "s20", "f20", 20, 0.4)]
    groups = selection.best_per_sequence(spark.createDataFrame(rows, GROUP))
    config = preset("sequence", shares={"multi_same_species": 0.3, "high_action": 0.2})
    got = [(r.phase, r.category, r.seq_id, r.rank) for r in selection.select(groups, config, 10).orderBy("phase", "category_ord", "rank").collect()]
    assert got[:3] == [(0, "multi_same_species", f"s{i}", i + 1) for i in range(3)]
    assert got[3:5] == [(0, "high_action", "s0", 1), (0, "high_action", "s20", 2)]
    assert got[5:] == [(1, "multi_same_species", f"s{i}", i - 2) for i in range(3, 8)]
    once = selection.select(groups, preset("sequence", shares=config.shares, strict_unique_sequences=True), 10).collect()
    assert len({r.seq_id for r in once}) == len(once)


def test_strict_fill_reaches_the_total_where_bursts_are_enough(spark):
    rows = [(c, f"s{i}", f"f{i}{c}", 2 * i + j, 1 - i / 100 - j / 1000) for i in range(20) for j, c in enumerate(("multi_same_species", "high_action"))]
    rows += [("rare_species", None, "n", 90, 0.99)]
    groups = selection.best_per_sequence(spark.createDataFrame(rows, GROUP))
    config = preset("sequence", shares={"multi_same_species": 0.2, "high_action": 0.2}, strict_unique_sequences=True)
    got = selection.select(groups, config, 15).collect()
    assert len(got) == 15 == len({r.seq_id for r in got})
    assert len(selection.select(groups, config, 40).collect()) == 21
    fill = sorted((r for r in got if r.phase == 1), key=lambda r: r.rank)
    assert [r.rank for r in fill] == list(range(1, len(fill) + 1)) and fill[0].file == "n"


def test_large_quotas_use_ordered_limits(spark):
    rows = [("multi_same_species", f"s{i}", f"f{i}", i, (i * 7919 % 3000) / 3000) for i in range(3000)]
    groups = selection.best_per_sequence(spark.createDataFrame(rows, GROUP))
    got = selection.category_top_k(groups, {"multi_same_species": 1500}).collect()
    best = sorted(rows, key=lambda r: (-r[4], r[3]))[:1500]
    assert [r.file for r in sorted(got, key=lambda r: r.rank)] == [r[2] for r in best]


def test_order_statistics_are_exact(spark):
    values = [((i * 7919) % 1000) / 7 for i in range(5000)] + [3.0] * 700
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 1.0), ("y", None), ("z", None)], "measure string, v double").repartition(5)
    places = {"q25": (1, 4), "median": (1, 2), "q75": (3, 4), "p10": (1, 10)}
    got = {(r.measure, r.place): (r.v, r.n) for r in values_at(df, places).collect()}
    s, n = sorted(values), len(values)
    assert got == {**{("x", p): (s[a * n // b], n) for p, (a, b) in places.items()}, **{("y", p): (1.0, 1) for p in places}}
    assert values_at(df.limit(0), {"m": (1, 2)}).count() == 0


def test_negatives_take_halves(spark):
    import hashlib

    rows = [("single_tiny", f"f{i}", i, (i * 37 % 10) / 10) for i in range(41)] + [("single_huge", "g", 99, 0.5), ("other", "h", 3, 0.5)]
    groups = spark.createDataFrame(rows, "category string, file string, group_ord long, quality_score double")
    got = [(r.category, r.rank, r.file) for r in selection.negatives_mix(groups, {"single_tiny": 9, "single_huge": 5}, ("single_tiny", "single_huge"), 3).collect()]
    order = sorted([r for r in rows if r[0] == "single_tiny"], key=lambda r: (-r[3], r[2]))
    rest = sorted(order[20:], key=lambda r: (hashlib.md5(f"3:{r[1]}".encode()).hexdigest(), r[2]))
    want = [("single_tiny", i + 1, r[1]) for i, r in enumerate(order[:4] + rest[:5])] + [("single_huge", 1, "g")]
    assert sorted(got) == sorted(want)


def test_selectors_by_name(spark):
    images = fx.images(spark, SMALL)
    selectors.register_selector("Smallest", lambda rows, n: rows.where("detections is not null").orderBy("image_ord").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("image_ord"))))
    try:
        assert selectors.select_by("Smallest", images, 5).count() == 5
        got = selectors.select_hybrid({"Smallest": 1, "improved": 2, "HeuristicSelector": 1}, images, 20).collect()
        assert len(got) <= 20 and {r.source_selector for r in got} == {"Smallest", "improved", "HeuristicSelector"} and len({r.file for r in got}) == len(got)
    finally:
        del selectors.SELECTORS["Smallest"]
    with pytest.raises(ValueError, match="RandomSelector"):
        selectors.select_by("none", images, 5)


def test_hybrid_keeps_the_first_source(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "file string, r int")
    b = spark.createDataFrame([("y", 1), ("w", 2)], "file string, r int")
    got = [(r.file, r.source_selector) for r in selection.hybrid_candidates([("A", a, "r", 1.0), ("B", b, "r", 1.0)], 4).orderBy("position").collect()]
    assert got == [("x", "A"), ("y", "A"), ("w", "B")]


@pytest.mark.parametrize("name", ["v1", "improved", "training"])
def test_stratified_takes_at_most_the_quotas(spark, name):
    config = preset(name)
    rows = selectors.select_stratified(fx.images(spark, SMALL), 80, config).collect()
    assert len(rows) == 80
    for category, quota in config.quotas(80).items():
        assert sum(r.phase == 0 and r.category == category for r in rows) <= quota


def test_detections_travel_once(spark):
    """The view's rows are dealt out once, by image; a second time only the images that they are joined to."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx.images(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("run", [lambda images: selectors.features_with_rarity(images, preset("v1")), lambda images: selectors.heuristic_scores(images)])
def test_images_are_computed_once(spark, run):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    images = fx.images(spark, SMALL).repartition(2)
    rows = images.count()
    run(images.mapInArrow(count, images.schema)).collect()
    assert seen.value == rows


@pytest.mark.parametrize("name", ["unselected_sequences", "unselected_images", "fill_remaining", "selector_comparison", "rarity_lookup"])
def test_queries_that_read_twice_keep(spark, name):
    """What a query reads more than once is written before: no window over line items is left in its plan."""
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_many_line_items_are_dealt_over_more_tasks(spark, monkeypatch):
    """The rows that a task sorts are bounded by number, not by the session's shuffle partitions."""
    monkeypatch.setattr(fx, "ROWS_A_TASK", 500, raising=False)
    few = fx.detections(spark, SMALL)
    sizes = [r["count"] for r in few.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == fx.table(spark, SMALL, "lineitem").count() and max(sizes) < 1000
    nested = lambda: {r.image_ord: r for r in fx.images(spark, SMALL).collect()}
    found = nested()
    monkeypatch.setattr(fx, "ROWS_A_TASK", 10**9, raising=False)
    assert found == nested()


@pytest.fixture
def no_small_tables(spark):
    """Nothing is broadcast for its size alone, as where all tables are large."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("strict", [False, True])
def test_groups_stay_where_they_are_for_what_is_selected(spark, no_small_tables, strict):
    """The selected rows travel to the groups, which are many more."""
    rows = [("high_action", f"s{i}", f"f{i}", i, 1 - i / 100) for i in range(20)] + [("high_action", None, "n", 90, 0.5)]
    groups = selection.best_per_sequence(spark.createDataFrame(rows, GROUP))
    for found in (selection.unselected_sequences(groups, groups.limit(3)), selection.unselected_images(groups, groups.limit(3)), selection.fill_remaining(groups, groups.limit(3), 10, True, strict)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_no_species_travel_to_the_metadata(spark, no_small_tables):
    """Rare species are marked below the join, which gets the mark alone."""
    config = preset("sequence", score_scale=6)
    rows = selectors.candidates(selectors.features_with_rarity(fx.images(spark, SMALL), config, fx.metadata(spark, SMALL)), config)
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line and "file_name" in line)
    assert not any("arrays_overlap" in line or "species_list" in line for line in lines[:join])
    assert any("arrays_overlap" in line for line in lines[join:])


def exchanged(df):
    """The columns that each shuffle of a plan moves."""
    todo, found = [df._jdf.queryExecution().executedPlan().initialPlan()], []
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_selection_moves_no_features(spark, no_small_tables, monkeypatch):
    """Neither the join with the metadata nor the best of each burst moves features; the picks get them from the images."""
    seen = []
    monkeypatch.setattr(selection, "best_per_sequence", lambda rows, best=selection.best_per_sequence: (seen.append(best(rows)), seen[-1])[1])
    picked = selectors.select_sequence_aware(fx.images(spark, SMALL), fx.metadata(spark, SMALL), 100, preset("sequence", score_scale=6))
    assert seen[0].columns[-2:] == ["sequence_size", "group_ord"] and not {"max_size", "centrality", "num_species"} & set(seen[0].columns)
    moved = exchanged(seen[0])
    assert len(moved) >= 3 and not any("max_size" in columns for columns in moved)
    features = {r.file: r for r in selectors.features_with_rarity(fx.images(spark, SMALL), preset("sequence")).collect()}
    rows = picked.collect()
    assert len(rows) == 100
    for r in rows:
        f = features[r.file]
        assert all(r[c] == f[c] for c in ("image_ord", "num_animals", "max_size", "avg_size", "max_confidence", "avg_confidence", "centrality", "num_species", "has_rare_species"))


def test_features_are_those_of_the_picked_row(spark):
    """Images of one number in two documents are told apart by their paths; other columns of the images stay."""
    box = lambda w: [("1", 0.9, [0.0, 0.0, w, 0.5], [])]
    schema = "file string, image_ord long, detections array<struct<category:string,conf:double,bbox:array<double>,classifications:array<struct<species_id:string,conf:double>>>>, note string"
    images = spark.createDataFrame([("a", 0, box(0.5), "x"), ("b", 0, box(0.6), "y"), ("c", None, box(0.7), "z"), ("d", 1, None, "w")], schema)
    metadata = spark.createDataFrame([(f, f"s{f}", 0) for f in "abcd"], "file_name string, seq_id string, frame_num int")
    rows = selectors.select_sequence_aware(images, metadata, 10, preset("sequence")).collect()
    assert {(r.file, r.image_ord, r.seq_id, r.note, round(r.max_size, 6)) for r in rows} == {("a", 0, "sa", "x", 0.25), ("b", 0, "sb", "y", 0.3), ("c", None, "sc", "z", 0.35)}


def test_metadata_deals_out_no_names(spark, no_small_tables):
    """The view's windows get the table's own columns; names are computed after they are dealt out."""
    moved = exchanged(fx.metadata(spark, SMALL))
    assert moved == [{"o_orderkey", "o_custkey"}]


def test_category_distribution_reads_the_selection_once(spark, tmp_path):
    """The total comes from the counts; the selection is not computed for it again."""
    spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "category string").write.parquet(str(tmp_path / "rows"))
    found = profile.category_distribution(spark.read.parquet(str(tmp_path / "rows")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {(r.category, r.n, r.percent) for r in found.collect()} == {("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)}
    assert profile.category_distribution(spark.read.parquet(str(tmp_path / "rows")).limit(0)).count() == 0


def test_metadata_are_not_sent_through_the_driver(spark):
    """They are as many as the images, however small their file is estimated to be: a selection deals both out at every size."""
    config = preset("sequence", score_scale=6)
    for rows in (
        selection.join_sequences(fx.image_list(spark, SMALL), fx.metadata(spark, SMALL)),
        selectors.burst_candidates(fx.images(spark, SMALL), fx.metadata(spark, SMALL), config),
    ):
        plan = rows._jdf.queryExecution().executedPlan().initialPlan().toString()
        assert "SortMergeJoin [file" in plan and not any("BroadcastHashJoin [file" in line for line in plan.splitlines())
    files = {r.file for r in fx.image_list(spark, SMALL).collect()}
    found = selection.join_sequences(fx.image_list(spark, SMALL), fx.metadata(spark, SMALL)).select("file").collect()
    assert len(found) == fx.metadata(spark, SMALL).count() < len(files) and {r.file for r in found} < files
