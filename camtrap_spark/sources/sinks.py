"""Candidates, labels, documents and copies as written tables and files."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.names import basename, flattened_name, sanitize_model
from ..operators.labelling import label_stats
from ..operators.profile import category_distribution, selection_summary, size_distribution
from ..storage import keep
from .files import file_system

CANDIDATE_FIELDS = ("original_path", "flattened_filename", "category", "quality_score", "seq_id", "frame_num", "seq_num_frames", "max_size", "max_confidence", "num_animals", "num_species")


def candidate_rows(selected: DataFrame) -> DataFrame:
    """The eleven fields of the candidate file."""
    return selected.withColumn("original_path", F.col("file")).withColumn("flattened_filename", flattened_name(F.col("file"))).select(*CANDIDATE_FIELDS)


def committed(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets `write` fill a folder beside path and moves it there at the end: all its tables are there, or none. path must be new."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at, staged = hadoop(path), hadoop(f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if there.exists(at):
        raise FileExistsError(path)
    try:
        write(staged.toString())
        if not there.rename(staged, at):
            raise OSError(f"{staged.toString()} cannot be moved to {path}")
    except BaseException:
        there.delete(staged, True)
        raise


def write_candidates(selected: DataFrame, path: str, form: str = "parquet") -> dict[str, int]:
    """The candidates and, beside them, their summaries: `candidates`, `summary`, `categories` and `sizes` below path.

    The selection runs once, and the four tables appear together or not at all. Gives the number of candidates and the
    largest burst, as that run observed them.
    """
    spark, seen = selected.sparkSession, Observation()
    rows = keep(selected.observe(seen, F.count("*").alias("total_candidates"), F.max("sequence_size").alias("max_sequence_size")), "selected")

    def write(at: str) -> None:
        candidate_rows(rows).write.format(form).save(f"{at}/candidates")
        for name, table in (("summary", selection_summary(rows)), ("categories", category_distribution(rows)), ("sizes", size_distribution(rows))):
            table.coalesce(1).write.format(form).save(f"{at}/{name}")

    committed(spark, path, write)
    return seen.get


def write_labels(results: DataFrame, path: str, time: str | None = None) -> dict[str, int]:
    """Results by model, one folder each, and `labeling_info` with the totals of each model; together or not at all.

    The results are computed once; the totals are those of what was written. Gives their numbers as the write observed them.
    """
    spark, seen = results.sparkSession, Observation()

    def write(at: str) -> None:
        results.observe(seen, F.count("*").alias("total_images"), F.count_if("success").alias("successful_labels")).write.partitionBy("model").parquet(f"{at}/results")
        written = spark.read.schema(results.schema).parquet(f"{at}/results")
        label_stats(written, time=time).coalesce(1).write.parquet(f"{at}/labeling_info")

    committed(spark, path, write)
    return seen.get


def append_checkpoint(results: DataFrame, path: str) -> None:
    """Adds results; the commit protocol makes the addition whole or nothing."""
    results.write.mode("append").parquet(path)


def label_document(results: DataFrame, info: Column, by: list[str], position: str = "pos") -> DataFrame:
    """A label file a row, as JSON text: `labeling_info` and the results in order. A group of `by` must fit into a file."""
    fields = F.struct("image_path", "image_filename", F.col("score").alias("aesthetic_score"), "reasoning", "success", "error")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), fields.alias("r")))), lambda x: x.r)
    return results.groupBy(*by).agg(ordered.alias("results")).select(*by, F.to_json(F.struct(info.alias("labeling_info"), "results")).alias("content"))


def write_documents(rows: DataFrame, path: str, head: str, tail: str, element: str = "value") -> None:
    """One text document a partition: head, the partition's elements with commas between them, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = batch.column(0)
            if len(lines):
                heads = pa.array([head if first else ",", *[","] * (len(lines) - 1)], pa.string())
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(heads, lines.cast(pa.string()), "")], names=["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_pydict({"value": [tail]})

    rows.select(element).mapInArrow(run, "value string").write.text(path)


def write_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A file for each row, whole or not at all: written beside its place and moved there. Gives path and bytes when it is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [put(p, data) for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")


def put(path: str, data: bytes) -> int:
    with placed(path) as out:
        out.write(data)
    return len(data)


@contextmanager
def placed(path: str) -> Iterator:
    """A stream to a file beside path, which is moved there when all is written."""
    there, at = file_system(path)
    beside = f"{at}.{uuid.uuid4().hex}.part"
    there.create_dir(at.rsplit("/", 1)[0], recursive=True)
    try:
        with there.open_output_stream(beside) as out:
            yield out
        there.move(beside, at)
    except BaseException:
        if there.get_file_info(beside).type != fs.FileType.NotFound:
            there.delete_file(beside)
        raise


def copy_plan(candidates: DataFrame, listing: DataFrame, target: str, file: str = "file") -> DataFrame:
    """source, target and whether the source is there, for each candidate; and its bytes, if the listing (path) has a length."""
    sized = "length" in listing.columns
    there = listing.groupBy(F.col("path").alias("there")).agg(*([F.max("length").alias("bytes")] if sized else []), F.lit(True).alias("_is"))
    plan = candidates.select(F.col(file).alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), flattened_name(F.col(file))).alias("target"))
    return plan.join(there, F.col("source") == F.col("there"), "left").select("source", "target", F.col("there").isNotNull().alias("exists"), *(["bytes"] if sized else []))


def dealt_by_bytes(plan: DataFrame, tasks: int) -> DataFrame:
    """The plan in as many partitions as tasks, of about equal bytes.

    Files of more than a quarter of a task's share, four for each task at most, are packed greedily, the largest first
    to the emptiest task; all others are spread by hash in proportion to the room that is left.
    """
    size = F.coalesce(F.col("bytes"), F.lit(0))
    total = plan.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    share = max(1.0, total / tasks)
    large = plan.where(size > share / 4).select("source", "target", "bytes").distinct().collect()
    loads, fixed = [(0, i) for i in range(tasks)], []
    for r in sorted(large, key=lambda r: (-r.bytes, r.source, r.target)):
        load, i = heapq.heappop(loads)
        fixed.append((r.source, r.target, i))
        heapq.heappush(loads, (load + r.bytes, i))
    room = [max(share / 100, share - load) for load, _ in sorted(loads, key=lambda x: x[1])]
    ends = [sum(room[: i + 1]) / sum(room) for i in range(tasks)]
    at = F.pmod(F.xxhash64("source", "target"), F.lit(1 << 20)) / float(1 << 20)
    spread = F.size(F.filter(F.array(*(F.lit(e) for e in ends[:-1])), lambda e: e <= at)) if tasks > 1 else F.lit(0)
    given = plan.sparkSession.createDataFrame(fixed, "source string, target string, _fixed int")
    placed_ = plan.join(F.broadcast(given), ["source", "target"], "left").withColumn("_task", F.coalesce("_fixed", spread))
    return placed_.repartitionById(tasks, F.col("_task").cast("int")).drop("_task", "_fixed")


CHUNK_BYTES = 4 << 20


def copy_one(source: str, target: str) -> tuple[bool, int]:
    """Copies a file in chunks; whether it is at its target, and the bytes that were moved: none if it was there with its size."""
    try:
        there, at = file_system(source)
        to, to_at = file_system(target)
        found, done = there.get_file_info(at), to.get_file_info(to_at)
        if found.is_file and done.is_file and found.size == done.size:
            return True, 0
        with there.open_input_stream(at) as data, placed(target) as out:
            moved = 0
            while chunk := data.read(CHUNK_BYTES):
                out.write(chunk)
                moved += len(chunk)
        return True, moved
    except OSError:
        return False, 0


def copy_files(plan: DataFrame, root: str = "", tasks: int | None = None) -> DataFrame:
    """Copies what is there, file by file in the tasks; gives source, target, copied (false: absent or unreadable) and moved bytes when it is run.

    A copy that is there with its source's size is finished: a second run goes on where the first stopped. tasks: deals
    the files by their bytes, if the plan has them.
    """
    if tasks and "bytes" in plan.columns:
        plan = dealt_by_bytes(plan, tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("source", "target", "exists")))
            done = [copy_one(f"{root}{source}", target) if exists else (False, 0) for source, target, exists in rows]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("target"), pa.array([d[0] for d in done], pa.bool_()), pa.array([d[1] for d in done], pa.int64())], names=["source", "target", "copied", "moved"])

    return plan.select("source", "target", "exists").mapInArrow(run, "source string, target string, copied boolean, moved long")


def copy_counts(done: DataFrame, copied: str = "exists") -> DataFrame:
    return done.agg(F.count_if(copied).alias("copied"), F.count_if(~F.col(copied)).alias("failed"))


def run_name(method, model, stamp, checkpoint: bool = False):
    """`{method}_labels_{model}_{stamp}.json`; checkpoints end in .tmp.json."""
    return F.concat(method, F.lit("_labels_"), sanitize_model(model), F.lit("_"), stamp, F.lit(".tmp.json" if checkpoint else ".json"))


def missing_and_found(files: DataFrame, listing: DataFrame, file: str = "file") -> DataFrame:
    """Whether each path is in the listing (`verify_paths`)."""
    there = listing.select(F.col("path").alias("there")).distinct()
    return files.join(there, F.col(file) == F.col("there"), "left").select(F.col(file).alias("path"), basename(F.col(file)).alias("filename"), F.col("there").isNotNull().alias("found"))
