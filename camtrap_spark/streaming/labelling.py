"""Incremental labelling: new images are labelled once, results are appended, a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import basename
from ..functions.replies import parse_responses
from ..operators.labelling import PARTIALS, label_partials, merged_stats, resume_pending
from ..sources.images import strip
from .calls import CallPolicy, Calls

SCORED = "path string, image_filename string, reply string, failure_kind string"
COLUMNS = ["path", "image_filename", "reply", "failure_kind"]
#: Rows that a task hands on at a time.
HELD_ROWS = 500
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
#: Builds a client, once for each call at a time in a task; the client takes a path and returns the reply's text.
MakeClient = Callable[[], Callable[[str], str]]


def score_images(images: DataFrame, make_client: MakeClient, concurrency: int | None = None, policy: CallPolicy = CallPolicy(window=1), rate: float | None = None) -> DataFrame:
    """A reply for each path, as the calls end; a failing image becomes a row with its error and never stops the others.

    concurrency: tasks. policy: calls at a time in each, their deadline and retries (a client serves one call at a time).
    rate: calls a second of all tasks together, shared out evenly; it needs concurrency.
    """
    if rate:
        if not concurrency:
            raise ValueError("a rate is shared out over a number of tasks: concurrency")
        policy = replace(policy, interval=concurrency / rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple[str, str]] = {}

        def paths() -> Iterator[str]:
            pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for place, pair in enumerate(pairs):
                rows[place] = pair
                yield pair[0]

        held: list[tuple] = []
        for place, reply, failure in Calls(make_client, policy).as_they_end(paths()):
            held.append((*rows.pop(place), reply, failure))
            if len(held) == HELD_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    rows = images.select("path", basename(F.col("path")).alias("image_filename"))
    return (rows.repartition(concurrency) if concurrency else rows).mapInArrow(run, SCORED)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=COLUMNS)


def to_results(scored: DataFrame, model: str, mode: str = "local") -> DataFrame:
    parsed = parse_responses(scored.withColumnRenamed("failure_kind", "call_error"), mode)
    return parsed.select(
        F.lit(model).alias("model"), "path", "image_filename", "score", "reasoning", (F.col("success") & F.col("call_error").isNull()).alias("success"), F.coalesce("call_error", "failure_kind").alias("error")
    )


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state on disk and log its changes; a cache of fixed size is in memory."""
    before = {k: spark.conf.get(k, None) for k in DISK_STATE}
    for k, v in DISK_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def label_batch(batch: DataFrame, number: int, results: str, label: Callable[[DataFrame], DataFrame], statistics: str | None) -> None:
    """Writes a micro-batch's results to its own folder, and its partial statistics to another; a repeated batch replaces both."""
    at = f"{results}/batch={number}"
    rows = label(batch)
    rows.write.mode("overwrite").parquet(at)
    if statistics:
        label_partials(batch.sparkSession.read.schema(rows.schema).parquet(at)).coalesce(1).write.mode("overwrite").parquet(f"{statistics}/batch={number}")


def stream_label(
    spark: SparkSession, source: str, results: str, checkpoint: str, make_client: MakeClient, model: str, mode: str = "local", files_per_trigger: int = 1000, concurrency: int | None = None,
    existing: DataFrame | None = None, policy: CallPolicy = CallPolicy(window=1), statistics: str | None = None,
):
    """Labels the paths in the text files that arrive in `source`; runs over what is there, then ends.

    A path is labelled once: the stream's state, which is kept on disk, remembers it over restarts. Each micro-batch
    writes its own folder (`batch=<number>`) and overwrites it if it is repeated after a crash, so nothing is added
    twice and no earlier result is read. existing: results of other runs (image_filename), whose images are left out.
    statistics: a folder for each batch's partial statistics, which `stream_label_stats` merges.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(source)
    paths = lines.select(strip(F.col("value")).alias("path")).where("path <> ''").dropDuplicates(["path"])

    def label(batch: DataFrame) -> DataFrame:
        pending = batch if existing is None else resume_pending(batch, existing)
        return to_results(score_images(pending, make_client, concurrency, policy), model, mode)

    def add(batch: DataFrame, number: int) -> None:
        label_batch(batch, number, results, label, statistics)

    with disk_state(spark):
        return paths.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_label_stats(spark: SparkSession, statistics: str) -> DataFrame:
    """Statistics by model of all that `stream_label` has labelled so far, from the partial ones of its batches: each batch counts once."""
    return merged_stats(spark.read.schema(PARTIALS).parquet(statistics))
