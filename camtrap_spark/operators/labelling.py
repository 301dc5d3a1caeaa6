"""Replies against requests: resume, reconciliation, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import basename


def resume_pending(images: DataFrame, results: DataFrame, path: str = "path") -> DataFrame:
    """Images whose base name has no result yet; failed results count as done."""
    done = results.select(F.col("image_filename").alias("_done")).where("_done is not null").distinct()
    return images.withColumn("_name", basename(F.col(path))).join(done, F.col("_name") == F.col("_done"), "left_anti").drop("_name")


def violations(replies: DataFrame, expected: DataFrame, returned: str = "returned_filename", by: tuple[str, ...] = ()) -> DataFrame:
    """What makes a batch invalid: names returned more than once, another number of replies than of requests."""
    repeated = replies.where(F.col(returned).isNotNull()).groupBy(*by, returned).agg(F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select(*by, F.lit("duplicate_filename").alias("violation"), F.col(returned).alias("subject"), "n")
    counts = replies.groupBy(*by).agg(F.count("*").alias("_got"))
    wanted = expected.groupBy(*by).agg(F.count("*").alias("_want"))
    both = counts.join(wanted, list(by), "full") if by else counts.crossJoin(wanted)
    other = both.where(F.coalesce("_got", F.lit(0)) != F.coalesce("_want", F.lit(0)))
    other = other.select(*by, F.lit("reply_count").alias("violation"), F.lit(None).cast("string").alias("subject"), F.coalesce("_got", F.lit(0)).alias("n"))
    return repeated.unionByName(other)


def reconcile_responses(parsed: DataFrame, expected: DataFrame, returned: str = "returned_filename", name: str = "image_filename", by: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """Replies by the name they return, joined to the expected images; unexpected and failed replies are dropped.

    With check, an invalid batch (`violations`) raises; names count there even if the rest of the reply is no good.
    """
    if check:
        bad = violations(parsed, expected, returned, by).take(5)
        if bad:
            raise ValueError(f"the batch is not valid: {bad}")
    good = parsed.where("success")
    wanted = expected.select(*by, F.col(name).alias("_name"), *(c for c in expected.columns if c not in (*by, name)))
    keep = [c for c in good.columns if c not in wanted.columns or c in by]
    return good.select(*keep).join(wanted, [*(good[b] == wanted[b] for b in by), F.col(returned) == F.col("_name")]).select(*(good[c] for c in keep), *(c for c in wanted.columns if c not in (*by, "_name")))


def label_stats(results: DataFrame, by: tuple[str, ...] = ("model",), time: str | None = None) -> DataFrame:
    """Totals, success rate in percent, and score statistics of the successes, 0.0 without one."""
    score = F.when(F.col("success"), F.col("score"))
    out = [
        F.count("*").alias("total_images"),
        F.count_if("success").alias("successful_labels"),
        F.count_if(~F.col("success")).alias("failed_labels"),
        F.round(F.coalesce(F.try_divide(F.count_if("success") * 100.0, F.count("*")), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("avg_score"),
        F.coalesce(F.min(score), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"),
    ]
    if time:
        out.append(F.round(F.coalesce(F.avg(F.when(F.col("success"), F.col(time))), F.lit(0.0)), 6).alias("avg_processing_time"))
    return results.groupBy(*by).agg(*out)


PARTIALS = "model string, total long, successful long, scored long, sum_score double, min_score double, max_score double"


def label_partials(results: DataFrame) -> DataFrame:
    """What `merged_stats` needs of a part of the results: counts, sum and bounds by model."""
    score = F.when(F.col("success"), F.col("score"))
    return results.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count(score).alias("scored"), F.sum(score).alias("sum_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score")
    )


def merged_stats(partials: DataFrame) -> DataFrame:
    """The statistics of `label_stats` from partial ones."""
    total, good = F.sum("total"), F.sum("successful")
    zero = F.lit(0.0)
    return partials.groupBy("model").agg(
        total.alias("total_images"),
        good.alias("successful_labels"),
        (total - good).alias("failed_labels"),
        F.round(F.coalesce(F.try_divide(good * 100.0, total), zero), 6).alias("success_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("sum_score"), F.sum("scored")), zero), 6).alias("avg_score"),
        F.coalesce(F.min("min_score"), zero).alias("min_score"),
        F.coalesce(F.max("max_score"), zero).alias("max_score"),
    )


def response_audit(parsed: DataFrame, reply: str = "reply", by: tuple[str, ...] = ("model",)) -> DataFrame:
    """What came back: replies, with text, readable, by kind of failure; names returned, once and more often."""
    names = parsed.where("returned_filename is not null").groupBy(*by, "returned_filename").agg(F.count("*").alias("times"))
    names = names.groupBy(*by).agg(F.count("*").alias("unique_filenames"), F.count_if(F.col("times") > 1).alias("duplicate_filenames"))
    kind = lambda k: F.count_if(F.col("failure_kind") == k)
    counts = parsed.groupBy(*by).agg(
        F.count("*").alias("replies"),
        F.count_if(F.col(reply).isNotNull()).alias("has_response"),
        F.count("*").cast("long").alias("_all"),
        F.count_if(F.coalesce(F.col("failure_kind") != "empty", F.lit(True))).alias("has_text"),
        F.count_if(F.coalesce(~F.col("failure_kind").isin("empty", "bad_json"), F.lit(True))).alias("parse_ok"),
        *(kind(k).alias(k) for k in ("empty", "bad_json", "missing_score", "bad_score", "out_of_range", "missing_reasoning", "missing_filename")),
    )
    return counts.drop("_all").join(names, list(by), "left").fillna(0, ["unique_filenames", "duplicate_filenames"])
