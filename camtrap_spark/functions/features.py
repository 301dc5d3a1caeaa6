"""Per-image features by higher-order functions: one row per image, no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANIMAL = "1"
DETECTION_THRESHOLD, SPECIES_THRESHOLD = 0.3, 0.5


def all_animals(detections: Column) -> Column:
    """Animals of any confidence; absent detections count as none."""
    return F.filter(F.coalesce(detections, F.array()), lambda d: d.category == ANIMAL)


def animal_detections(detections: Column, threshold: float = DETECTION_THRESHOLD) -> Column:
    return F.filter(F.coalesce(detections, F.array()), lambda d: (d.category == ANIMAL) & (d.conf >= threshold))


def size_of(d: Column) -> Column:
    return d.bbox[2] * d.bbox[3]


def centre_distance(d: Column) -> Column:
    return F.sqrt(F.pow(d.bbox[0] + d.bbox[2] / 2 - 0.5, F.lit(2)) + F.pow(d.bbox[1] + d.bbox[3] / 2 - 0.5, F.lit(2)))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def classified(detections: Column, threshold: float = SPECIES_THRESHOLD) -> Column:
    """All species ids of confident classifications, in order, with repeats."""
    return F.flatten(F.transform(detections, lambda d: F.transform(F.filter(F.coalesce(d.classifications, F.array()), lambda c: c.conf >= threshold), lambda c: c.species_id)))


def species_in_image(detections: Column, threshold: float = SPECIES_THRESHOLD) -> Column:
    return F.array_distinct(classified(detections, threshold))


def centrality(kept: Column, sizes: Column) -> Column:
    """1 minus the centre distance of the largest detection, the first one of equals."""
    return 1 - centre_distance(F.element_at(kept, F.array_position(sizes, F.array_max(sizes)).cast("int")))


def gaussian_size_score(size: Column, base: float = 0.3, centre: float = 0.25, spread: float = 0.15) -> Column:
    return base + (1 - base) * F.exp(-F.pow(size - centre, F.lit(2)) / (2 * spread * spread))


def log_size_score(size: Column) -> Column:
    return F.least(F.log10(size + 0.0001) + 4, F.lit(10.0)) / 10


def image_features(images: DataFrame, threshold: float = DETECTION_THRESHOLD, species_threshold: float = SPECIES_THRESHOLD) -> DataFrame:
    """Features of the images that have an animal; detections are dropped, other columns stay."""
    return kept_features(images.withColumn("kept", animal_detections(F.col("detections"), threshold)).where(F.size("kept") > 0), species_threshold)


def kept_features(kept: DataFrame, species_threshold: float = SPECIES_THRESHOLD) -> DataFrame:
    """Features of the detections in `kept`, one at least; it and detections are dropped, other columns stay."""
    sized = kept.withColumn("sizes", F.transform("kept", size_of)).withColumn("confidences", F.transform("kept", lambda d: d.conf))
    return sized.select(
        *(c for c in kept.columns if c not in ("detections", "kept")),
        F.size("kept").cast("long").alias("num_animals"),
        F.array_max("sizes").alias("max_size"),
        mean(F.col("sizes")).alias("avg_size"),
        F.array_max("confidences").alias("max_confidence"),
        mean(F.col("confidences")).alias("avg_confidence"),
        centrality(F.col("kept"), F.col("sizes")).alias("centrality"),
        species_in_image(F.col("kept"), species_threshold).alias("species_list"),
        F.size(species_in_image(F.col("kept"), species_threshold)).cast("long").alias("num_species"),
        "sizes",
        "confidences",
    )


def selection_criteria() -> Column:
    return F.struct(
        "num_animals",
        F.col("max_size").alias("max_animal_size"),
        F.col("avg_size").alias("avg_animal_size"),
        "max_confidence",
        "avg_confidence",
        F.col("num_species").alias("species_count"),
        "species_list",
    )


def heuristic_score(kept: Column, rarity: Column) -> Column:
    """The composite score of an image; rarity: of its rarest species, from 0 to 1."""
    best_size = F.greatest(F.lit(0.0), F.array_max(F.transform(kept, lambda d: F.log10(size_of(d) + 0.0001) + 4)))
    best_centre = F.greatest(F.lit(0.0), F.array_max(F.transform(kept, lambda d: 1 - centre_distance(d))))
    confidence = F.greatest(F.lit(0.0), F.array_max(F.transform(kept, lambda d: d.conf)))
    n, species = F.size(kept), species_in_image(kept)
    several = F.when(n > 1, F.least(F.log2(n.cast("double")), F.lit(2.0))).otherwise(0.0)
    kinds = F.when(F.size(species) > 1, F.least(F.size(species) * 0.5, F.lit(2.0))).otherwise(0.0)
    return best_size * 3 + best_centre * 2 + confidence + several * 1.5 + kinds * 2 + rarity
