import json

import pytest
from pyspark.sql import functions as F

from camtrap_spark.functions.replies import build_requests, parse_responses
from camtrap_spark.operators import comparison, labelling

# reply -> (batch, sync, local): score if successful, else the kind of failure
CASES = [
    ('{"score": 7, "reasoning": "r", "image_filename": "a.jpg"}', 7.0, 7.0, 7.0),
    (' ```json\n{"score": 7.5, "reasoning": "r", "image_filename": "a.jpg"}\n```\n', 7.5, 7.5, 7.5),
    ('```\n{"score": 7}\n```', "bad_json", "bad_json", "bad_json"),
    ("  \n\t ", "empty", "empty", "empty"),
    (None, "empty", "empty", "empty"),
    ('{"score": ', "bad_json", "bad_json", "bad_json"),
    ('[{"score": 7}]', "bad_json", "bad_json", "bad_json"),
    ('{"reasoning": "r", "image_filename": "a.jpg"}', "missing_score", "missing_score", 0.0),
    ('{"score": null, "reasoning": "r", "image_filename": "a.jpg"}', "bad_score", "bad_score", "bad_score"),
    ('{"score": "good", "reasoning": "r", "image_filename": "a.jpg"}', "bad_score", "bad_score", "bad_score"),
    ('{"score": "7.5", "reasoning": "r", "image_filename": "a.jpg"}', 7.5, 7.5, 7.5),
    ('{"score": true, "reasoning": "r", "image_filename": "a.jpg"}', 1.0, 1.0, 1.0),
    ('{"score": "NaN", "reasoning": "r", "image_filename": "a.jpg"}', "bad_score", "bad_score", "bad_score"),
    ('{"score": 12, "reasoning": "r", "image_filename": "a.jpg"}', 12.0, "out_of_range", 12.0),
    ('{"score": -1, "reasoning": "r", "image_filename": "a.jpg"}', -1.0, "out_of_range", -1.0),
    ('{"score": 0, "reasoning": "r", "image_filename": "a.jpg"}', 0.0, 0.0, 0.0),
    ('{"score": 10, "reasoning": "r", "image_filename": "a.jpg"}', 10.0, 10.0, 10.0),
    ('{"score": 5, "image_filename": "a.jpg"}', "missing_reasoning", "missing_reasoning", 5.0),
    ('{"score": 5, "reasoning": "r"}', "missing_filename", 5.0, 5.0),
]


@pytest.mark.parametrize("mode, column", [("batch", 1), ("sync", 2), ("local", 3)])
def test_reply_table(spark, mode, column):
    rows = spark.createDataFrame([(i, c[0], "a.jpg") for i, c in enumerate(CASES)], "i int, reply string, image_filename string")
    got = {r.i: r.score if r.success else r.failure_kind for r in parse_responses(rows, mode).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[column] for c in CASES]


def test_sync_failures_score_zero_and_local_has_standard_reasoning(spark):
    rows = spark.createDataFrame([('{"score": 5}', "a.jpg")], "reply string, image_filename string")
    assert parse_responses(rows, "sync").first().score == 0.0
    r = parse_responses(rows, "local").first()
    assert (r.reasoning, r.returned_filename) == ("No reasoning provided", "a.jpg")


@pytest.mark.parametrize("kind", ["batch", "generate", "chat"])
def test_requests_are_json_and_skip_images_without_bytes(spark, kind):
    rows = spark.createDataFrame([("a.jpg", bytearray(b"xyz")), ("b.jpg", None)], "image_filename string, content binary")
    got = build_requests(rows, 'Rate "this"', kind).collect()
    assert len(got) == 1
    assert "eHl6" in json.dumps(json.loads(got[0].request))


def test_resume_treats_failures_as_done(spark):
    images = spark.createDataFrame([("d/a.jpg",), ("d/b.jpg",), ("e/c.jpg",)], "path string")
    results = spark.createDataFrame([("a.jpg", True), ("b.jpg", False), (None, True)], "image_filename string, success boolean")
    pending = labelling.resume_pending(images, results)
    assert [r.path for r in pending.collect()] == ["e/c.jpg"]


def test_reconcile(spark):
    expected = spark.createDataFrame([("a.jpg", "d/a.jpg"), ("b.jpg", "d/b.jpg")], "image_filename string, path string")
    reply = lambda name: f'{{"score": 1, "reasoning": "r", "image_filename": "{name}"}}'
    parse = lambda *names: parse_responses(spark.createDataFrame([(reply(n),) for n in names], "reply string"), "batch")
    assert [r.path for r in labelling.reconcile_responses(parse("b.jpg", "x.jpg"), expected).collect()] == ["d/b.jpg"]
    with pytest.raises(ValueError):
        labelling.reconcile_responses(parse("x.jpg", "x.jpg"), expected)
    with pytest.raises(ValueError):
        labelling.reconcile_responses(parse("a.jpg"), expected)


def test_names_count_whatever_else_is_wrong(spark):
    expected = spark.createDataFrame([("a.jpg", "d/a.jpg"), ("b.jpg", "d/b.jpg")], "image_filename string, path string")
    parse = lambda *replies: parse_responses(spark.createDataFrame([(r,) for r in replies], "reply string"), "batch")
    empty = '{"score": 1, "reasoning": "r", "image_filename": ""}'
    rows = parse(empty, empty)
    assert [(r.returned_filename, r.success, r.failure_kind) for r in rows.collect()] == [(None, False, "missing_filename")] * 2
    assert labelling.reconcile_responses(rows, expected).count() == 0  # no duplicate, two replies of two
    good, bad = '{"score": 1, "reasoning": "r", "image_filename": "a.jpg"}', '{"score": null, "reasoning": "r", "image_filename": "a.jpg"}'
    with pytest.raises(ValueError, match="duplicate"):
        labelling.reconcile_responses(parse(good, bad), expected)
    assert [r.score for r in labelling.reconcile_responses(parse(good, bad), expected, check=False).collect()] == [1.0]


def test_each_reply_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"score": 1, "reasoning": "r", "image_filename": "a.jpg"}',)], "reply string")
    expected = spark.createDataFrame([("a.jpg", "d/a.jpg")], "image_filename string, path string")
    joined = labelling.reconcile_responses(parse_responses(rows, "batch"), expected, check=False)
    plan = joined._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1


def test_statistics_without_successes_are_zero(spark):
    rows = spark.createDataFrame([("m", None, False), ("m", None, False), ("n", 4.0, True), ("n", 9.0, True), ("n", 0.0, False)], "model string, score double, success boolean")
    got = {r.model: tuple(r)[1:] for r in labelling.label_stats(rows).collect()}
    assert got == {"m": (2, 0, 2, 0.0, 0.0, 0.0, 0.0), "n": (3, 2, 1, 66.666667, 6.5, 4.0, 9.0)}
    assert labelling.label_stats(rows.limit(0)).collect() == []


def test_sample_join_marks_what_is_missing(spark):
    sample = spark.createDataFrame([("a",), ("b",)], "image_filename string")
    results = spark.createDataFrame([("a", "d/a", 1, 3.0, "r", True, None), ("a", "d/a", 2, 4.0, "s", True, None)], "image_filename string, image_path string, pos int, score double, reasoning string, success boolean, error string")
    got = {r.image_filename: tuple(r)[1:] for r in comparison.sample_join(sample, results, "x_labels_m.json", "m").collect()}
    assert got == {
        "a": ("d/a", 4.0, "s", True, None, False),
        "b": ("", 0.0, "Image not found in m results", False, "No results available for this image in x_labels_m.json", True),
    }


def test_display_orders(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("b", 9.0, False), ("c", 5.0, True), ("d", 5.0, True)], "image_filename string, score double, success boolean")
    assert [r.image_filename for r in comparison.displayed(rows).collect()] == ["c", "d", "a", "b"]
    assert [r.image_filename for r in comparison.displayed(rows, top_only=True).collect()] == ["c", "d", "a"]
    assert [r.image_filename for r in comparison.displayed(rows, "filename").collect()] == ["a", "b", "c", "d"]


def test_sample_is_seeded_and_sorted(spark):
    rows = spark.createDataFrame([(f"f{i:03}",) for i in range(100)], "image_filename string")
    one = [r[0] for r in comparison.sample_filenames(rows, 10, 1).collect()]
    assert one == sorted(one) and len(one) == 10
    assert one == [r[0] for r in comparison.sample_filenames(rows.repartition(7), 10, 1).collect()]
    assert one != [r[0] for r in comparison.sample_filenames(rows, 10, 2).collect()]
    assert comparison.sample_filenames(rows, 0).count() == 100


def test_dashboard_defaults(spark):
    schema = "file_name string, info struct<processing_method:string,model_used:string,total_images:int,success_rate:double,statistics:struct<avg_score:double>,timestamp:string>"
    rows = spark.createDataFrame([("b", None), ("a", ("local_vllm", "q", 3, 50.0, (4.0,), "t"))], schema)
    got = [tuple(r) for r in comparison.dashboard(rows).collect()]
    assert got == [("a", "vLLM: q", 3, 50.0, 4.0, "t"), ("b", "Unknown: Unknown", 0, 0.0, 0.0, "Unknown")]
    assert rows.where(F.col("info").isNull()).count() == 1
