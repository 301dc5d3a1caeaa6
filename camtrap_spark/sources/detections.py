"""Detection documents and sequence metadata as DataFrames of one row per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schemas import DETECTION_DOCUMENT, IMAGES, RAW_IMAGE, SEQUENCE
from .json_elements import RANGE_BYTES, read_elements


def typed_detections(raw: Column) -> Column:
    """Detections with their [species, confidence] pairs as structs."""
    return F.transform(
        raw,
        lambda d: F.struct(
            d.category.alias("category"),
            d.conf.alias("conf"),
            d.bbox.alias("bbox"),
            F.transform(d.classifications, lambda c: F.struct(F.get(c, F.lit(0)).alias("species_id"), F.get(c, F.lit(1)).try_cast("double").alias("conf"))).alias("classifications"),
        ),
    )


def read_detections(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """JSON documents with an `images` array; image_ord keeps the order of the array, and of the documents by name.

    Each document is dealt over tasks by byte ranges, whatever the order of its keys and whatever stands beside the array.
    """
    rows = read_elements(spark, path, "images", range_bytes).select(F.col("ord").alias("image_ord"), F.from_json("element", RAW_IMAGE).alias("image"))
    return rows.select("image.file", "image_ord", typed_detections(F.col("image.detections")).alias("detections"))


def read_whole_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's own reader, a document a row: for documents that fit into a task, in any store that Spark reads."""
    document = spark.read.schema(DETECTION_DOCUMENT).option("multiLine", True).json(path)
    rows = document.select(F.col("_metadata.file_path").alias("document"), F.posexplode("images").alias("pos", "image"))
    sizes = rows.groupBy("document").agg(F.count("*").alias("n"))
    before = sizes.select("document", (F.sum("n").over(Window.orderBy("document")) - F.col("n")).alias("before"))  # a row for each document
    placed = rows.join(F.broadcast(before), "document")
    return placed.select("image.file", (F.col("before") + F.col("pos")).alias("image_ord"), typed_detections(F.col("image.detections")).alias("detections"))


def read_image_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of one image each, with image_ord; splittable."""
    rows = spark.read.schema(StructType([*RAW_IMAGE.fields, StructField("image_ord", LongType())])).json(path)
    return rows.select("file", "image_ord", typed_detections(F.col("detections")).alias("detections"))


def read_sequence_metadata(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file_name with its sequence fields; of several entries for a file the last one counts."""
    entries = read_elements(spark, path, "images", range_bytes).select(F.col("ord").alias("pos"), F.from_json("element", SEQUENCE).alias("entry"))
    return last_per_file(entries.select("pos", "entry.*"))


def last_per_file(entries: DataFrame, position: str = "pos") -> DataFrame:
    fields = ["seq_id", "frame_num", "seq_num_frames", "location"]
    return entries.groupBy("file_name").agg(F.max_by(F.struct(*fields), position).alias("entry")).select("file_name", *(f"entry.{f}" for f in fields))


def head_subset(images: DataFrame, n: int) -> DataFrame:
    """The first n images of the input order."""
    return images.where(F.col("image_ord") < n)


def with_chunk(images: DataFrame, size: int = 100_000) -> DataFrame:
    return images.withColumn("chunk_id", F.floor(F.col("image_ord") / size))


__all__ = ["IMAGES", "head_subset", "last_per_file", "read_detections", "read_image_rows", "read_sequence_metadata", "read_whole_documents", "typed_detections", "with_chunk"]
