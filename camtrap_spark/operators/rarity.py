"""Species counts over the whole collection, and what is rare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import SPECIES_THRESHOLD, all_animals, classified
from ..storage import keep
from .order_stats import values_at

#: Species up to this number travel as one row; more are joined.
FEW_SPECIES = 50_000


def species_counts(images: DataFrame, threshold: float = SPECIES_THRESHOLD) -> DataFrame:
    """Confident classifications of each species over all animals, whatever the detection's confidence."""
    found = images.select(F.explode(classified(all_animals(F.col("detections")), threshold)).alias("species"))
    return found.groupBy("species").agg(F.count("*").alias("n"))


def fits(table: DataFrame, column: str = "species", rows: int | None = None) -> bool:
    """Whether a table is measured to be small enough to travel as one row: by its rows and by the bytes of a column."""
    rows = FEW_SPECIES if rows is None else rows
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    return found.n <= rows and found.bytes <= rows * 64


def rare_species(counts: DataFrame) -> DataFrame:
    """Species as frequent as number n // 5 of the n species, counted from the rarest (0-based), or less; ties are in.

    The place is an exact order statistic: of one sorted row of numbers where they are measured to be few, else of ranges.
    """
    counts = keep(counts, "species")
    if fits(counts):
        cut = counts.agg(F.sort_array(F.collect_list("n")).alias("ns")).select(F.get("ns", F.floor(F.size("ns") / 5).cast("int")).alias("threshold"))  # FEW_SPECIES numbers at most
    else:
        cut = values_at(counts.withColumn("all", F.lit(1)), {"rare": (1, 5)}, "all", "n").select(F.col("v").alias("threshold"))
    return counts.join(F.broadcast(cut), F.col("n") <= F.col("threshold")).select("species", "n", "threshold")  # cut: one row


def mark_rare(features: DataFrame, rare: DataFrame, species: str = "species_list", key: str = "image_ord") -> DataFrame:
    """Adds has_rare_species: by the rare set as one row where it is measured to be small, else by a join on the species. key: unique."""
    rare = keep(rare, "rare")
    if fits(rare):
        one = rare.agg(F.collect_set("species").alias("_rare"))
        return features.crossJoin(F.broadcast(one)).withColumn("has_rare_species", F.arrays_overlap(species, "_rare")).drop("_rare")
    found = features.select(F.col(key).alias("_key"), F.explode(species).alias("species")).join(rare.select("species"), "species", "left_semi").select("_key").distinct()
    return features.join(found, F.col(key) == F.col("_key"), "left").withColumn("has_rare_species", F.col("_key").isNotNull()).drop("_key")


def with_rarity(rows: DataFrame, counts: DataFrame, species: str = "species_list", key: str = "image_ord") -> DataFrame:
    """Adds rarity: 1 less the share of the row's rarest species among all confident classifications, 0 without one. key: unique.

    The shares are one map where the species are measured to be few, else a join on the species.
    """
    counts = keep(counts, "species")
    total = counts.agg(F.sum("n").alias("_total"))
    if fits(counts):
        shares = counts.agg(F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("species", "n"))).alias("_ns"))
        shares = shares.select(F.transform_values("_ns", lambda _, n: n / F.col("_total")).alias("_shares"))
        bonus = F.array_max(F.transform(species, lambda s: 1 - F.col("_shares")[s]))
        return rows.crossJoin(F.broadcast(shares)).withColumn("rarity", F.greatest(F.lit(0.0), F.coalesce(bonus, F.lit(0.0)))).drop("_shares")
    least = rows.select(F.col(key).alias("_key"), F.explode(species).alias("species")).join(counts, "species").groupBy("_key").agg(F.min("n").alias("_n"))
    joined = rows.join(least, F.col(key) == F.col("_key"), "left").crossJoin(F.broadcast(total))  # total: one row
    return joined.withColumn("rarity", F.greatest(F.lit(0.0), F.coalesce(1 - F.col("_n") / F.col("_total"), F.lit(0.0)))).drop("_key", "_n", "_total")
