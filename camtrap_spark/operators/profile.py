"""Summaries of a collection and of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import all_animals, animal_detections, size_of, species_in_image
from .order_stats import values_at

QUARTILES = {"q25": (1, 4), "median": (1, 2), "q75": (3, 4)}


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def dataset_summary(images: DataFrame) -> DataFrame:
    """Totals in one pass; shares of images, of several animals and species of the images with animals."""
    animals = all_animals(F.col("detections"))
    rows = images.select(
        F.size(animals).alias("n"),
        F.size(F.filter(animals, lambda d: d.conf >= 0.3)).alias("sure"),
        F.exists(animals, lambda d: F.size(F.coalesce(d.classifications, F.array())) > 0).alias("classified"),
        F.size(species_in_image(animals)).alias("species"),
    )
    totals = rows.agg(
        F.count("*").alias("total_images"),
        F.count_if(F.col("n") > 0).alias("with_animals"),
        F.count_if(F.col("sure") > 0).alias("with_high_conf"),
        F.count_if("classified").alias("with_classifications"),
        F.count_if(F.col("n") > 1).alias("multi_animal"),
        F.count_if(F.col("species") > 1).alias("multi_species"),
    )
    return totals.select(
        "*",
        F.round(percent(F.col("with_animals"), F.col("total_images")), 6).alias("with_animals_pct"),
        F.round(percent(F.col("with_high_conf"), F.col("total_images")), 6).alias("with_high_conf_pct"),
        F.round(percent(F.col("with_classifications"), F.col("total_images")), 6).alias("with_classifications_pct"),
        F.round(percent(F.col("multi_animal"), F.col("with_animals")), 6).alias("multi_animal_pct"),
        F.round(percent(F.col("multi_species"), F.col("with_animals")), 6).alias("multi_species_pct"),
    )


def top_species(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("n"), "species").limit(n)


def value_quantiles(images: DataFrame) -> DataFrame:
    """min, q25, median, q75, max by index of box sizes, detection and classification confidences; a row each, from one pass."""
    animals = all_animals(F.col("detections"))
    of = lambda measure, v: F.struct(F.lit(measure).alias("measure"), v.alias("v"))
    every = F.flatten(
        F.transform(
            animals,
            lambda d: F.concat(F.array(of("bbox_size", size_of(d)), of("detection_conf", d.conf)), F.transform(F.coalesce(d.classifications, F.array()), lambda c: of("classification_conf", c.conf))),
        )
    )
    found = values_at(images.select(F.inline(every)), QUARTILES)
    return found.groupBy("measure").agg(F.max("low").alias("min"), *(F.max(F.when(F.col("place") == q, F.col("v"))).alias(q) for q in QUARTILES), F.max("high").alias("max"))


def threshold_counts(images: DataFrame, size: float = 0.1, confidence: float = 0.8) -> DataFrame:
    dets = images.select(F.explode(all_animals(F.col("detections"))).alias("d"))
    return dets.agg(F.count("*").alias("detections"), F.count_if(size_of(F.col("d")) > size).alias("large"), F.count_if(F.col("d.conf") > confidence).alias("confident"))


def category_stats(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("category").agg(F.count("*").alias("images"), F.count_distinct("seq_id").alias("sequences"))


def funnel(images: DataFrame, metadata: DataFrame) -> DataFrame:
    known = metadata.select(F.col("file_name"))
    rows = images.select("file", (F.size(animal_detections(F.col("detections"))) > 0).alias("animals")).join(known, F.col("file") == F.col("file_name"), "left")
    there = F.col("file_name").isNotNull()
    return rows.agg(F.count("*").alias("images"), F.count_if(there).alias("with_metadata"), F.count_if(there & F.col("animals")).alias("with_animals"))


def high_conf_with_classifications(images: DataFrame) -> DataFrame:
    first = F.get(animal_detections(F.col("detections")), F.lit(0))
    rows = images.select(first.alias("d")).where("d is not null")
    return rows.agg(F.count("*").alias("images"), F.count_if(F.size(F.coalesce("d.classifications", F.array())) > 0).alias("first_with_classifications"))


def selection_summary(selected: DataFrame) -> DataFrame:
    return selected.agg(
        F.count("*").alias("total_candidates"),
        F.count_distinct("seq_id").alias("unique_sequences"),
        F.round(percent(F.count_distinct("seq_id"), F.count("*")), 6).alias("sequence_diversity_percent"),
        F.round(F.avg("sequence_size"), 6).alias("avg_sequence_size"),
        F.min("sequence_size").alias("min_sequence_size"),
        F.max("sequence_size").alias("max_sequence_size"),
        (F.count("*") - F.count_distinct("seq_id")).alias("duplicates"),
    )


def category_distribution(selected: DataFrame) -> DataFrame:
    """The selection is computed once; the total is the sum over its categories, a row for each."""
    counts = selected.groupBy("category").agg(F.count("*").alias("n"))
    return counts.select("category", "n", F.round(percent(F.col("n"), F.sum("n").over(Window.partitionBy())), 6).alias("percent"))


def size_distribution(selected: DataFrame) -> DataFrame:
    """By index over the selected rows, which are few."""
    s = selected.agg(F.sort_array(F.collect_list("max_size")).alias("s"), F.avg("max_size").alias("mean"))
    at = lambda a, b: F.get("s", F.floor(F.size("s") * a / b).cast("int"))
    return s.select(
        F.array_min("s").alias("min"), F.array_max("s").alias("max"), F.round("mean", 6).alias("mean"),
        at(1, 10).alias("p10"), at(1, 4).alias("p25"), at(1, 2).alias("median"), at(3, 4).alias("p75"), at(9, 10).alias("p90"),
    )


def category_sizes(selected: DataFrame) -> DataFrame:
    return selected.groupBy("category").agg(
        F.min("max_size").alias("min_size"), F.max("max_size").alias("max_size"), F.round(F.avg("max_size"), 6).alias("mean_size"), F.round(F.avg("sequence_size"), 6).alias("avg_sequence_size")
    )


def selector_comparison(rows: DataFrame) -> DataFrame:
    """rows: method and the features of what it picked."""
    return rows.groupBy("method").agg(
        F.count("*").alias("n"),
        F.round(F.avg("max_size"), 6).alias("avg_max_size"),
        F.round(F.avg("max_confidence"), 6).alias("avg_max_confidence"),
        F.round(F.avg("num_animals"), 6).alias("avg_animals"),
        F.round(F.avg("num_species"), 6).alias("avg_species"),
        F.count_if(F.col("num_animals") > 1).alias("multi_animal"),
        F.count_if(F.col("num_species") > 1).alias("multi_species"),
    )
