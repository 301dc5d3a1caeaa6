"""Several models on one sample of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import link_text
from .selection import dedupe_last, hash_order


def sample_filenames(names: DataFrame, sample: int, seed: int = 0, name: str = "image_filename") -> DataFrame:
    """All names in order; with 0 < sample, at most that many in hash order of the seed. Repeats are kept."""
    rows = names.select(F.col(name))
    if sample > 0:
        rows = rows.orderBy(hash_order(seed, F.col(name)), name).limit(sample)
    return rows.orderBy(name)


def sample_join(sample: DataFrame, results: DataFrame, source: str, model: str = "this model", position: str = "pos", name: str = "image_filename") -> DataFrame:
    """For each sampled name the model's last result, or a row that says it is missing in the label file `source`.

    The sample reduces the results before they are deduplicated (and, if they are parsed replies, before parsing).
    """
    picked = sample.select(F.col(name).alias("_sampled"))
    last = dedupe_last(results.join(picked.distinct(), F.col(name) == F.col("_sampled"), "left_semi"), name, position)
    return _with_missing(picked, last, F.col("_sampled") == F.col(name), name, F.lit(source), F.lit(model))


def _with_missing(left: DataFrame, right: DataFrame, on, name: str, source: Column, model: Column) -> DataFrame:
    rows = left.join(right, on, "left")
    there = F.col(name).isNotNull()
    return rows.select(
        F.col("_sampled").alias(name),
        *([F.col("_model").alias("model")] if "_model" in left.columns else []),
        F.when(there, F.col("image_path")).otherwise(F.lit("")).alias("image_path"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(there, F.col("reasoning")).otherwise(F.concat(F.lit("Image not found in "), model, F.lit(" results"))).alias("reasoning"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.when(there, F.col("error")).otherwise(F.concat(F.lit("No results available for this image in "), source)).alias("error"),
        (~there).alias("missing"),
    )


def model_grid(sample: DataFrame, results: DataFrame, files: DataFrame, position: str = "pos", name: str = "image_filename") -> DataFrame:
    """`sample_join` for every model; files: model and the file_name of its labels. The grid is models (few) times the sample (limited)."""
    picked = sample.select(F.col(name).alias("_sampled"))
    fields = ("image_path", "score", "reasoning", "success", "error")
    last = results.join(picked.distinct(), F.col(name) == F.col("_sampled"), "left_semi").groupBy("model", name).agg(F.max_by(F.struct(*fields), position).alias("r")).select("model", name, "r.*")
    grid = picked.crossJoin(files.select(F.col("model").alias("_model"), F.col("file_name").alias("_source")))
    return _with_missing(grid, last, (F.col("_sampled") == F.col(name)) & (F.col("_model") == F.col("model")), name, F.col("_source"), F.col("_model"))


def display_order(results: DataFrame, by: str = "score", top_only: bool = False, name: str = "image_filename") -> list:
    """Order columns for a display: by score successes come first, best first, then failures by name; or by name."""
    if by == "filename":
        return [F.asc(name)]
    order = [F.desc("success"), F.desc(F.when(F.col("success"), F.col("score"))), F.asc(name)]
    return order[1:] if top_only else order


def displayed(results: DataFrame, by: str = "score", top_only: bool = False, sample: int = 0, seed: int = 0, name: str = "image_filename") -> DataFrame:
    rows = results.where("success") if top_only else results
    if sample > 0:
        rows = rows.orderBy(hash_order(seed, F.col(name)), name).limit(sample)
    return rows.orderBy(*display_order(rows, by, top_only, name))


def dashboard(files: DataFrame) -> DataFrame:
    """A row for each label file: link text, totals, success rate, average score, time; standard values where missing."""
    i = "info."
    method, model = F.coalesce(F.col(f"{i}processing_method"), F.lit("Unknown")), F.coalesce(F.col(f"{i}model_used"), F.lit("Unknown"))
    return files.select(
        "file_name",
        link_text(method, model).alias("link_text"),
        F.coalesce(F.col(f"{i}total_images"), F.lit(0)).cast("long").alias("total_images"),
        F.coalesce(F.col(f"{i}success_rate"), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.col(f"{i}statistics.avg_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.col(f"{i}timestamp"), F.lit("Unknown")).alias("timestamp"),
    ).orderBy("file_name")
