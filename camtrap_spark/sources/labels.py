"""Label files of earlier runs, and manifests of submitted batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BATCH_MANIFEST, LABEL_FILE


def read_label_files(spark: SparkSession, directory: str) -> DataFrame:
    """file_name, info and results of every `*_labels_*.json` of the directory; info of a checkpoint where it is one."""
    files = spark.read.schema(LABEL_FILE).option("multiLine", True).json(f"{directory}/*_labels_*.json")
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.coalesce("labeling_info", "checkpoint_info").alias("info"), "results")


def label_results(files: DataFrame) -> DataFrame:
    """A row for each result, in one schema: the error's two names become one."""
    rows = files.select("file_name", F.posexplode("results").alias("pos", "r"))
    return rows.select(
        "file_name", "pos", "r.image_path", "r.image_filename", "r.aesthetic_score", "r.reasoning", "r.processing_time", F.coalesce("r.success", F.lit(False)).alias("success"), F.coalesce("r.error", "r.error_message").alias("error")
    )


def read_batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path and filename of a submitted batch, in order."""
    document = spark.read.schema(BATCH_MANIFEST).option("multiLine", True).json(path)
    return document.select("batch_info.job_name", F.posexplode("image_list").alias("pos", "i")).select("job_name", "pos", "i.index", "i.path", "i.filename")
