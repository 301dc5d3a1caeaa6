"""Exact order statistics of any number of values, without sorting them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep


def values_at(rows: DataFrame, places: dict[str, tuple[int, int]], group: str = "measure", value: str = "v") -> DataFrame:
    """group, place, v, n, low, high: in each group of n non-null values from low to high the one at the 0-based place floor(a * n / b) of their order.

    Equal values are counted first. The counts are dealt out by range and written with the number of their range, so
    that every later step sees the same ranges; sums by range tell which range holds a place, and only those few are
    looked into. The rows of a value, or the values of a group, are never brought together.
    """
    # Written, as dealing out by range reads it twice: for the bounds and for the rows.
    counts = keep(rows.select(F.col(group).alias("_group"), F.col(value).alias("v")).where("v is not null").groupBy("_group", "v").agg(F.count("*").alias("n")))
    ranged = keep(counts.repartitionByRange("_group", "v").withColumn("p", F.spark_partition_id()))
    by_range = ranged.groupBy("_group", "p").agg(F.sum("n").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))  # as many rows as ranges
    whole = Window.partitionBy("_group")
    sizes = by_range.withColumns({"total": F.sum("size").over(whole), "last": F.sum("size").over(whole.orderBy("p")), "low": F.min("low").over(whole), "high": F.max("high").over(whole)})
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("place"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, (a, b) in places.items())))
    at = sizes.withColumn("w", wanted).select("_group", "p", "total", "low", "high", (F.col("last") - F.col("size")).alias("before"), "last", "w.place", F.floor(F.col("total") * F.col("w.a") / F.col("w.b")).alias("at"))
    there = at.where("at >= before and at < last").select("_group", "p", "total", "low", "high", "before", "place", "at")
    upto = ranged.join(there, ["_group", "p"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("_group", "place").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return upto.where("upto > at and upto - n <= at").select(F.col("_group").alias(group), "place", "v", F.col("total").alias("n"), "low", "high")
