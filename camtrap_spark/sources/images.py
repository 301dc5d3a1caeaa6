"""Image lists: directories, text files, JSON arrays."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import keep
from .files import file_system
from .json_elements import RANGE_BYTES, read_elements

EXTENSIONS = (".jpg", ".jpeg", ".png")


# The white space that Unicode names, and the four separators of ASCII.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def is_image(path: Column) -> Column:
    ends = F.lit(False)
    for e in EXTENSIONS:
        ends = ends | F.lower(path).endswith(e)
    return ends


def _entries(directory: str) -> Iterator[tuple[str, int | None]]:
    """What is in a directory: full paths, and the length of files (None: a directory). Names that begin with . or _ are hidden."""
    there, at = file_system(directory)
    if isinstance(there, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    entry = None
                elif e.is_file():
                    entry = e.stat().st_size
                else:
                    continue  # links to directories are not followed
                if e.name[0] not in "._":
                    yield f"{directory.rstrip('/')}/{e.name}", entry
        return
    for e in there.get_file_info(fs.FileSelector(at)):
        if e.base_name[0] not in "._" and e.type in (fs.FileType.File, fs.FileType.Directory):
            yield f"{directory.rstrip('/')}/{e.base_name}", e.size if e.is_file else None


def walk(spark: SparkSession, directory: str, recursive: bool) -> DataFrame:
    """path and length of all files below a directory.

    Level by level: the directories of a level are dealt over the tasks, which list them; what they find is kept in the
    shared folder, and its directories are the next level. No list of files is held in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = list(_entries(path))
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["path", "length"])

    there = spark._jvm.org.apache.hadoop.fs.Path(directory)
    whole = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
    level, files = spark.createDataFrame([(whole,)], "path string"), None
    while True:
        found = keep(level.mapInArrow(run, "path string, length long"), "listing")
        here = found.where("length is not null")
        files = here if files is None else files.unionByName(here)
        level = found.where("length is null").select("path")
        if not recursive or level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism)


def list_images(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """path and length of the images of a directory; file contents are not read.

    Hidden files and folders (names that begin with . or _) are left out; links to files count as files, links to
    directories are not followed.
    """
    return walk(spark, directory, recursive).where(is_image(F.col("path")))


def list_from_text(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """A path a line; blank lines, and lines starting with # if they are comments, are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("path")).where("path <> ''")
    return lines.where(~F.col("path").startswith("#")) if comments else lines


def list_from_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The strings of a JSON array, in order; other elements are dropped, another document is an error."""
    elements = read_elements(spark, path, range_bytes=range_bytes).select(F.col("ord").alias("pos"), F.parse_json("element").alias("element"))
    return elements.where(F.schema_of_variant("element") == "STRING").select("pos", F.col("element").cast("string").alias("path"))


def limit_images(paths: DataFrame, most: int | None) -> DataFrame:
    """The first `most` paths in sorted order; all without a limit."""
    return paths.orderBy("path").limit(most) if most else paths


def image_bytes(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """path and content of the images of a directory, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).where(is_image(F.col("path")))
    if not recursive:
        there = spark._jvm.org.apache.hadoop.fs.Path(directory)
        whole = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
        files = files.where(F.instr(F.substring("path", len(whole) + 2, 2**31 - 1), "/") == 0)
    return files.select("path", "content")
