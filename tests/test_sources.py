import gzip
import json
import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from camtrap_spark.functions.names import basename
from camtrap_spark.operators.labelling import label_stats
from camtrap_spark.sources import detections, images, json_elements, labels, sinks
from camtrap_spark.streaming import labelling
from camtrap_spark.streaming.calls import CallPolicy, Calls
from camtrap_spark.streaming.labelling import score_images, stream_label, stream_label_stats

DOCUMENT = {
    "info": {"v": 1},
    "detection_categories": {"1": "animal"},
    "images": [
        {"file": "a/1.jpg", "detections": [{"category": "1", "conf": 0.93, "bbox": [0.1, 0.2, 0.3, 0.4], "classifications": [["12", 0.87], ["3", 0.02]]}]},
        {"file": "a/2.jpg", "detections": None},
        {"file": "a/3.jpg"},
        {"file": 'q"]}\\.jpg', "detections": []},
    ],
}


def test_detection_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOCUMENT))
    rows = detections.read_detections(spark, str(tmp_path / "d.json")).orderBy("image_ord").collect()
    assert [r.file for r in rows] == ["a/1.jpg", "a/2.jpg", "a/3.jpg", 'q"]}\\.jpg']
    assert [(c.species_id, c.conf) for c in rows[0].detections[0].classifications] == [("12", 0.87), ("3", 0.02)]
    assert rows[1].detections is None and rows[2].detections is None and rows[3].detections == []


@pytest.mark.parametrize("layout", ["compact", "indented", "other order", "several", "other files"])
def test_documents_are_cut_into_ranges(spark, tmp_path, layout):
    images_of = [{"file": f"a/{i}.jpg", "detections": [{"category": "1", "conf": i / 7, "bbox": [0.1, 0.2, 0.3, 0.4], "classifications": [["file", 0.5]] if i % 3 else None}] * (i % 4)} for i in range(2000)]
    if layout == "other order":
        images_of = [{k: image[k] for k in ("detections", "file")} for image in images_of]
    document = {"info": {"v": 1}, "images": images_of, "detection_categories": {"1": "animal"}}
    if layout == "other files":
        document = {"info": {"file": "model.pt", "images": [{"file": "no"}]}, **document, "rest": [{"file": 'x"[\\'}]}
    target = tmp_path / "d.json"
    if layout == "several":
        target.mkdir()
        for k in range(3):
            (target / f"p{k}.json").write_text(json.dumps({**document, "images": images_of[k * 700 : (k + 1) * 700]}))
    else:
        target.write_text(json.dumps(document, indent=1 if layout == "indented" else None))
    found = detections.read_detections(spark, str(target), 20_000)
    assert found.rdd.getNumPartitions() >= 8
    rows = found.orderBy("image_ord").collect()
    assert [(r.image_ord, r.file) for r in rows] == [(i, f"a/{i}.jpg") for i in range(2000)]
    assert [len(r.detections) for r in rows] == [i % 4 for i in range(2000)]
    assert [d.conf for r in rows for d in r.detections] == [i / 7 for i in range(2000) for _ in range(i % 4)]
    if layout != "several":
        assert rows == detections.read_whole_documents(spark, str(target)).orderBy("image_ord").collect()


TEXT = st.text(st.sampled_from('ab"\\[]{},: é\n'), max_size=6)
VALUE = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 99), TEXT), lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(TEXT, inner, max_size=3)), max_leaves=6)


def elements_by_range(path, size, key, length):
    begin = json_elements.AFTER_KEY if key is None else json_elements.OUTSIDE
    rows = [(i, path, a, min(a + size, length), False, 0, begin, 0) for i, a in enumerate(range(0, max(1, length), size))]
    placed = json_elements.with_depths(rows, {r[0]: json_elements.change(*r[1:4]) for r in rows})
    rows = json_elements.with_numbers(placed, {r[0]: json_elements.count(*r[1:6], key) for r in placed})
    found = {}
    for _, document, a, b, in_string, depth, state, first in rows:
        for n, element in enumerate(json_elements.elements(document, a, b, in_string, depth, state, key)):
            assert first + n not in found
            found[first + n] = json.loads(element)
    assert sorted(found) == list(range(len(found)))
    return [found[i] for i in range(len(found))]


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUE, max_size=5), st.dictionaries(TEXT, VALUE, max_size=3), st.dictionaries(TEXT, VALUE, max_size=2), st.integers(1, 40), st.sampled_from([None, 1]), st.sampled_from([(", ", ": "), (",", ":"), (" ,\n", " :  ")]), st.integers(1, 30), st.booleans())
def test_ranges_of_any_size_give_the_elements(tmp_path_factory, array, before, after, size, indent, separators, chunk, ascii_only):
    path = tmp_path_factory.getbasetemp() / "ranges.json"
    document = {**before, "images": array, **{k: v for k, v in after.items() if k not in before and k != "images"}}
    for content, key, want in ((document, "images", document["images"]), (array, None, array), ({"images": {"a": array}, "x": array}, "images", []), ({"a": {"images": array}}, "images", [])):
        text = json.dumps(content, indent=indent, separators=separators, ensure_ascii=ascii_only).encode()
        path.write_bytes(text)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(json_elements, "CHUNK_BYTES", chunk)
            assert elements_by_range(str(path), size, key, len(text)) == want


def test_arrays_in_unusual_documents(spark, tmp_path):
    read = lambda text, key="images": (tmp_path / "u.json").write_bytes(text) and [r.element for r in json_elements.read_elements(spark, str(tmp_path / "u.json"), key, 7).orderBy("ord").collect()]
    assert read(b'\xef\xbb\xbf {"im\\u0061ges" : [ 1, "a\\"]" ,{"b":[2]}] , "x": 3}') == ["1", '"a\\"]"', '{"b":[2]}']
    assert read(b'{"images": []}') == read(b'{"images": null, "a": [1]}') == read(b"{}") == read(b'{"images": [  ]}') == []
    assert read(b'\xef\xbb\xbf["a", "b"]', None) == ['"a"', '"b"']
    (tmp_path / "z.json.gz").write_bytes(gzip.compress(b'{"images": [1, 2]}'))
    assert json_elements.read_elements(spark, str(tmp_path / "z.json.gz"), "images", 3).count() == 2


def test_last_metadata_entry_counts(spark, tmp_path):
    entry = lambda f, s: {"file_name": f, "seq_id": s, "frame_num": 0, "seq_num_frames": 1, "location": "l"}
    (tmp_path / "m.json").write_text(json.dumps({"images": [entry("a", "1"), entry("b", "2"), entry("a", "3")]}))
    got = {r.file_name: r.seq_id for r in detections.read_sequence_metadata(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a": "3", "b": "2"}


def test_image_lists(spark, tmp_path):
    (tmp_path / "i/sub").mkdir(parents=True)
    for name in ("a.jpg", "B.JPG", "c.jpeg", "d.PNG", "e.txt", "sub/f.png"):
        (tmp_path / "i" / name).write_bytes(b"x")
    flat = {p.path.rsplit("/", 1)[1] for p in images.list_images(spark, str(tmp_path / "i")).collect()}
    assert flat == {"a.jpg", "B.JPG", "c.jpeg", "d.PNG"}
    assert images.list_images(spark, str(tmp_path / "i"), True).count() == 5
    (tmp_path / "l.txt").write_text("\n x.jpg \n# no\n\t\ny.png\n")
    assert [r.path for r in images.list_from_text(spark, str(tmp_path / "l.txt")).collect()] == ["x.jpg", "y.png"]
    assert images.list_from_text(spark, str(tmp_path / "l.txt"), False).count() == 3
    (tmp_path / "l.json").write_text('["x.jpg", 3, "y.JPG", null, {"a": "b"}]')
    assert [r.path for r in images.list_from_json(spark, str(tmp_path / "l.json")).orderBy("pos").collect()] == ["x.jpg", "y.JPG"]
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="array"):
        images.list_from_json(spark, str(tmp_path / "o.json")).collect()


def test_label_files(spark, tmp_path):
    info = {"model_used": "m", "total_images": 2}
    results = [{"image_filename": "a.jpg", "aesthetic_score": 4.0, "success": True}, {"image_filename": "b.jpg", "success": False, "error_message": "no"}]
    (tmp_path / "gemini_sync_labels_m_1.json").write_text(json.dumps({"labeling_info": info, "results": results}))
    (tmp_path / "local_vllm_labels_m_2.tmp.json").write_text(json.dumps({"checkpoint_info": info, "results": []}))
    (tmp_path / "other.json").write_text("{}")
    files = labels.read_label_files(spark, str(tmp_path))
    assert {r.file_name: r.info.model_used for r in files.collect()} == {"gemini_sync_labels_m_1.json": "m", "local_vllm_labels_m_2.tmp.json": "m"}
    assert [(r.image_filename, r.success, r.error) for r in labels.label_results(files).orderBy("pos").collect()] == [("a.jpg", True, None), ("b.jpg", False, "no")]


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"batch_info": {"job_name": "j"}, "image_list": [{"index": 0, "path": "d/a.jpg", "filename": "a.jpg"}]}))
    assert [tuple(r) for r in labels.read_batch_manifest(spark, str(tmp_path / "b.json")).collect()] == [("j", 0, 0, "d/a.jpg", "a.jpg")]
    plan = sinks.copy_plan(spark.createDataFrame([("d/a.jpg",), ("d/b.jpg",)], "file string"), spark.createDataFrame([("d/a.jpg",)], "path string"), "t")
    assert {tuple(r) for r in plan.collect()} == {("d/a.jpg", "t/d#a.jpg", True), ("d/b.jpg", "t/d#b.jpg", False)}
    assert tuple(sinks.copy_counts(plan).first()) == (1, 1)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.jpg").write_bytes(b"abc")
    plan = plan.withColumn("target", F.concat(F.lit(f"{tmp_path}/"), "target"))
    done = sinks.copy_files(plan, f"{tmp_path}/")
    assert {(r.source, r.copied) for r in done.collect()} == {("d/a.jpg", True), ("d/b.jpg", False)}
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["d#a.jpg"] and (tmp_path / "t/d#a.jpg").read_bytes() == b"abc"
    assert sinks.copy_files(plan.withColumn("exists", F.lit(True)), f"{tmp_path}/").where("copied").count() == 1
    results = spark.createDataFrame([("m", "a.jpg", 4.0, True)], "model string, image_filename string, score double, success boolean")
    sinks.write_labels(results, str(tmp_path / "labels"))
    sinks.append_checkpoint(results, str(tmp_path / "check"))
    sinks.append_checkpoint(results, str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "labels/results")).count() == 1
    assert tuple(spark.read.parquet(str(tmp_path / "labels/labeling_info")).first())[:5] == ("m", 1, 1, 0, 100.0)
    assert spark.read.parquet(str(tmp_path / "check")).count() == 2


def clients():
    """A maker of clients that travels to the workers by value."""

    def make_client():
        def client(path):
            if "bad" in path:
                raise OSError("unreadable")
            return '{"score": 6, "reasoning": "r"}'

        return client

    return make_client


def test_one_failure_does_not_stop_the_others(spark):
    rows = spark.createDataFrame([("d/a.jpg",), ("d/bad.jpg",), ("d/c.jpg",)], "path string")
    got = {r.image_filename: r.failure_kind for r in score_images(rows, clients(), 2).collect()}
    assert got == {"a.jpg": None, "bad.jpg": "OSError: unreadable", "c.jpg": None}
    assert rows.select(basename(rows.path)).count() == 3


def test_streaming_labels_each_image_once(spark, tmp_path):
    source, results = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.txt").write_text("d/a.jpg\nd/bad.jpg\nd/a.jpg\n")
    run = lambda: stream_label(spark, str(source), str(results), str(tmp_path / "c"), clients(), "m", files_per_trigger=1).awaitTermination()
    run()
    (source / "2.txt").write_text("d/b.jpg\nd/a.jpg\n")
    run()
    run()
    got = {(r.image_filename, r.success, r.score) for r in spark.read.parquet(str(results)).collect()}
    assert got == {("a.jpg", True, 6.0), ("bad.jpg", False, None), ("b.jpg", True, 6.0)}
    assert spark.read.parquet(str(results)).count() == 3
    existing = spark.createDataFrame([("b.jpg",)], "image_filename string")
    stream_label(spark, str(source), str(tmp_path / "o2"), str(tmp_path / "c2"), clients(), "m", existing=existing).awaitTermination()
    assert {r.image_filename for r in spark.read.parquet(str(tmp_path / "o2")).collect()} == {"a.jpg", "bad.jpg"}


def test_tables_appear_together_or_not_at_all(spark, tmp_path, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        runs.add(1)
        return x

    fields = "file string, category string, quality_score double, seq_id string, frame_num int, seq_num_frames int, max_size double, max_confidence double, num_animals int, num_species int, sequence_size long"
    rows = spark.createDataFrame([(f"d/{i}.jpg", "c", 0.5, f"s{i}", 0, 1, 0.1 * i, 0.9, 1, 1, i) for i in range(1, 7)], fields)
    selected = rows.withColumn("file", counted("file"))
    assert sinks.write_candidates(selected, str(tmp_path / "a")) == {"total_candidates": 6, "max_sequence_size": 6}
    assert runs.value == 6
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["candidates", "categories", "sizes", "summary"]
    with pytest.raises(FileExistsError):
        sinks.write_candidates(selected, str(tmp_path / "a"))
    monkeypatch.setattr(sinks, "size_distribution", lambda df: df.select(F.raise_error(F.lit("no summary"))))
    with pytest.raises(Exception, match="no summary"):
        sinks.write_candidates(selected, str(tmp_path / "b"))
    results = spark.createDataFrame([("m", "a.jpg", 4.0, True), ("n", "a.jpg", None, False)], "model string, image_filename string, score double, success boolean")
    assert sinks.write_labels(results, str(tmp_path / "l")) == {"total_images": 2, "successful_labels": 1}
    monkeypatch.setattr(sinks, "label_stats", lambda df, time: df.select(F.raise_error(F.lit("no totals"))))
    with pytest.raises(Exception, match="no totals"):
        sinks.write_labels(results, str(tmp_path / "k"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "l"]


def test_uneven_files_are_dealt_by_bytes_and_copied_once(spark, tmp_path, monkeypatch):
    sizes = [4_000_000, 2_500_000] + [10_000 + i for i in range(200)]
    (tmp_path / "i").mkdir()
    for i, n in enumerate(sizes):
        (tmp_path / f"i/{i}.jpg").write_bytes(bytes([i % 251]) * n)
    at = f"file:{tmp_path}/i/"
    listing = images.list_images(spark, str(tmp_path / "i")).select(F.replace("path", F.lit(at), F.lit("")).alias("path"), "length")
    plan = sinks.copy_plan(listing.withColumnRenamed("path", "file"), listing, f"{tmp_path}/o")
    loads = sinks.dealt_by_bytes(plan, 4).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in loads) == len(sizes) and len(loads) == 4
    others = sorted(r.b for r in loads)
    assert others[-1] < 4_100_000 and others[0] > 400_000
    monkeypatch.setattr(sinks, "CHUNK_BYTES", 1000)
    (tmp_path / "o").mkdir()
    (tmp_path / "o/7.jpg").write_bytes(b"x" * sizes[7])  # finished, by its size
    (tmp_path / "o/8.jpg").write_bytes(b"x")
    done = sinks.copy_files(plan, at, tasks=4).collect()
    assert all(r.copied for r in done) and sum(r.moved for r in done) == sum(sizes) - sizes[7]
    assert all((tmp_path / f"o/{i}.jpg").read_bytes() == (tmp_path / f"i/{i}.jpg").read_bytes() for i in range(len(sizes)) if i != 7)
    assert sum(r.moved for r in sinks.copy_files(plan, at, tasks=4).collect()) == 0
    assert len(list((tmp_path / "o").iterdir())) == len(sizes)


def test_directories_are_walked_by_levels(spark, tmp_path):
    for name in ("a.jpg", "x/b.png", "x/y/z/c.JPEG", ".hidden/d.jpg", "x/_e.jpg", "w/f.txt", "n o/é #%.jpg"):
        path = tmp_path / "i" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"xy")
    (tmp_path / "i/empty").mkdir()
    (tmp_path / "i/loop").symlink_to(tmp_path / "i")
    (tmp_path / "i/link.jpg").symlink_to(tmp_path / "i/a.jpg")
    got = {(r.path.split("/i/", 1)[1], r.length) for r in images.list_images(spark, str(tmp_path / "i"), True).collect()}
    assert got == {(n, 2) for n in ("a.jpg", "link.jpg", "x/b.png", "x/y/z/c.JPEG", "n o/é #%.jpg")}
    assert {r.path for r in images.list_images(spark, str(tmp_path / "i")).collect()} == {f"file:{tmp_path}/i/a.jpg", f"file:{tmp_path}/i/link.jpg"}
    assert images.image_bytes(spark, str(tmp_path / "i/x")).count() == 1


def test_a_batch_repeated_after_a_crash_counts_once(spark, tmp_path, monkeypatch):
    source, results, statistics = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "stats")
    source.mkdir()
    run = lambda: stream_label(spark, str(source), results, str(tmp_path / "c"), clients(), "m", statistics=statistics).awaitTermination()
    (source / "1.txt").write_text("d/a.jpg\nd/bad.jpg\n")
    run()
    whole = labelling.label_batch

    def crash(*batch):
        whole(*batch)
        raise RuntimeError("between write and commit")

    (source / "2.txt").write_text("d/b.jpg\nd/a.jpg\nd/c.jpg\n")
    monkeypatch.setattr(labelling, "label_batch", crash)
    with pytest.raises(Exception, match="between write and commit"):
        run()
    assert spark.read.parquet(results).count() == 4  # written, not committed
    monkeypatch.setattr(labelling, "label_batch", whole)
    run()
    run()
    found = spark.read.parquet(results)
    assert sorted(r.path for r in found.collect()) == ["d/a.jpg", "d/b.jpg", "d/bad.jpg", "d/c.jpg"]
    want = [tuple(r) for r in label_stats(found).collect()]
    assert [tuple(r) for r in stream_label_stats(spark, statistics).collect()] == want == [("m", 4, 3, 1, 75.0, 6.0, 6.0, 6.0)]


def test_state_is_on_disk_and_does_not_grow_in_memory(spark, tmp_path):
    source = str(tmp_path / "in")
    held = []
    for n in (2_000, 100_000):
        spark.range(n).selectExpr("concat('d/', id, '.jpg') AS value").coalesce(2).write.mode("append").text(source)
        with labelling.disk_state(spark):
            stream = spark.readStream.schema("value string").text(source).dropDuplicates(["value"])
            run = stream.writeStream.foreachBatch(lambda batch, number: batch.write.format("noop").mode("overwrite").save()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        held.append(run.lastProgress["stateOperators"][0])
    assert held[1]["numRowsTotal"] == 100_000
    assert held[1]["customMetrics"]["rocksdbSstFileSize"] is not None
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != labelling.DISK_STATE["spark.sql.streaming.stateStore.providerClass"]


def test_calls_keep_order_deadlines_and_retries():
    made, tried, lock = [], {}, threading.Lock()

    def make():
        made.append(1)
        busy = threading.Lock()

        def client(path):
            assert busy.acquire(blocking=False)  # one call at a time
            try:
                with lock:
                    tried[path] = tried.get(path, 0) + 1
                if path == "hang":
                    time.sleep(5)
                time.sleep(0.02)
                if path.startswith("twice") and tried[path] < 2 or path == "never":
                    raise OSError("busy")
                return path.upper()
            finally:
                busy.release()

        return client

    paths = [f"p{i}" for i in range(100)]
    paths[10], paths[20], paths[30], paths[31] = "hang", "never", "twice1", "twice2"
    began = time.monotonic()
    got = list(Calls(make, CallPolicy(window=10, deadline=0.4, retries=1, backoff=0.05)).run(iter(paths)))
    took = time.monotonic() - began
    assert [r for r, _ in got] == [None if p in ("hang", "never") else p.upper() for p in paths]
    assert got[10][1].startswith("TimeoutError") and got[20][1] == "OSError: busy"
    assert tried["hang"] == 2 and tried["never"] == 2 and tried["twice1"] == 2 and tried["p1"] == 1
    assert took < 2.0 and len(made) <= 13  # one by one it would be over 2 seconds without the hanging ones
    began = time.monotonic()
    assert len(list(Calls(make, CallPolicy(window=4, interval=0.05)).run(iter(paths[:9])))) == 9
    assert time.monotonic() - began >= 8 * 0.05
    assert list(Calls(make, CallPolicy()).run(iter([]))) == []


def test_hanging_calls_leave_the_others_results(spark):
    def make_client():
        def client(path):
            if path.endswith("7.jpg"):
                time.sleep(20)
            return '{"score": 6, "reasoning": "r"}'

        return client

    rows = spark.createDataFrame([(f"d/{i:03}.jpg",) for i in range(60)], "path string")
    got = score_images(rows, make_client, 2, CallPolicy(window=4, deadline=0.5)).collect()
    assert sorted(r.path for r in got) == [f"d/{i:03}.jpg" for i in range(60)]
    assert {r.path for r in got if r.failure_kind} == {f"d/{i:03}.jpg" for i in range(7, 60, 10)}
    assert all(r.reply for r in got if not r.failure_kind)
    with pytest.raises(ValueError, match="concurrency"):
        score_images(rows, make_client, rate=5.0)


def test_no_call_waits_for_another_ones_result():
    paths = ["hang"] + [f"p{i}" for i in range(5000)]

    def make():
        def client(path):
            if path == "hang":
                time.sleep(5)
            return path.upper()

        return client

    began, ends = time.monotonic(), {}
    for place, reply, failure in Calls(make, CallPolicy(window=4, deadline=1.0)).as_they_end(iter(paths)):
        ends[place] = time.monotonic() - began
        assert failure.startswith("TimeoutError") if place == 0 else reply == paths[place].upper()
    assert sorted(ends) == list(range(len(paths)))
    assert max(end for place, end in ends.items() if place) < 0.9 and 1.0 <= ends[0] < 2.0


@pytest.mark.parametrize("window", [1, 4])
def test_a_call_of_no_time_makes_no_thread(window):
    threads = set()

    def make():
        def client(path):
            threads.add(threading.get_ident())
            if path == "p5":
                raise OSError("no")
            return path

        return client

    got = list(Calls(make, CallPolicy(window=window)).run(f"p{i}" for i in range(3000)))
    assert [r for r, _ in got] == [None if i == 5 else f"p{i}" for i in range(3000)] and got[5][1] == "OSError: no"
    assert len(threads) <= window


def test_late_replies_and_failing_makers():
    def make():
        def client(path):
            time.sleep(0.3)
            return path

        return client

    late = Calls(make, CallPolicy(window=1, deadline=0.1)).as_they_end(iter(["a", "b"]))
    first = next(late)
    time.sleep(0.5)  # the reader is away while the second call overruns its deadline
    assert [first[0], *(r[0] for r in late)] == [0, 1] and first[2].startswith("TimeoutError")
    assert [f for _, f in Calls(make, CallPolicy(window=1, deadline=0.1)).run(iter(["a", "b"]))] == ["TimeoutError: no reply within 0.1 seconds"] * 2

    def broken():
        raise OSError("no server")

    for policy in (CallPolicy(window=1), CallPolicy(window=3, retries=1, backoff=0.01)):
        assert list(Calls(broken, policy).run(iter("ab"))) == [(None, "OSError: no server")] * 2


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"images": [{"a": "x" * 40, "b": i} for i in range(500)]}))
    read = json_elements.read_elements(spark, str(tmp_path / "s.json"), "images", 50)
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism  # of some 600 ranges
    assert [json.loads(r.element)["b"] for r in read.orderBy("ord").collect()] == list(range(500))


def test_little_is_read_beyond_a_range(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"images": [{"a": "x" * 40, "b": i} for i in range(50_000)]}))
    with json_elements.open_document(str(path)) as file:
        seen = list(json_elements.Walk(file, 0, 1000, False, 0, "images"))
        assert len(seen[0][1]) == 1000 and len(seen[1][1]) == json_elements.TAIL_BYTES
