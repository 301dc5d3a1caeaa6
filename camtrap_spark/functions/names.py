"""Names and texts for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flattened_name(path: Column) -> Column:
    """A path as one file name."""
    return F.translate(path, "/\\", "##")


def display_safe(name: Column) -> Column:
    return F.translate(name, "#:", "__")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sanitize_model(model: Column, drop_prefix: bool = True) -> Column:
    """A model's name as part of a file name."""
    name = F.replace(model, F.lit("models/"), F.lit("")) if drop_prefix else model
    return F.translate(name, ":/", "--")


def with_prefix(model: Column) -> Column:
    return F.when(model.startswith("models/"), model).otherwise(F.concat(F.lit("models/"), model))


def without_prefix(model: Column) -> Column:
    return F.regexp_replace(model, "^models/", "")


def score_bucket(score: Column) -> Column:
    return F.when(~F.isnan(score), score).try_cast("int")


def score_display(score: Column, success: Column, error: Column) -> Column:
    """One decimal; `Unavailable` where an error is known, else `FAILED`."""
    return F.when(success, F.format_string("%.1f", score)).when(error.isNotNull(), F.lit("Unavailable")).otherwise(F.lit("FAILED"))


#: Method and its label.
METHOD_LABELS = {"local_ollama": "Ollama", "local_vllm": "vLLM", "gemini_batch": "Gemini Batch", "gemini_sync": "Gemini"}


def link_text(method: Column, model: Column) -> Column:
    label = F.coalesce(*(F.when(method == k, F.lit(v)) for k, v in METHOD_LABELS.items()), method)
    return F.concat(label, F.lit(": "), model)


def resize_plan(width: Column, height: Column, side: int = 768, upscale: bool = True) -> tuple[Column, Column]:
    """Width and height with the longer side at `side`; without upscaling at most there."""
    long = F.lit(side) if upscale else F.least(F.greatest(width, height), F.lit(side))
    wide = width > height
    return (
        F.when(wide, long).otherwise(F.floor(width * long / height)).cast("long"),
        F.when(wide, F.floor(height * long / width)).otherwise(long).cast("long"),
    )


#: Dollars an image, by model and mode.
IMAGE_COSTS = {("flash", "batch"): 0.0003337, ("flash", "sync"): 0.0006674, ("pro", "batch"): 0.00134875, ("pro", "sync"): 0.0026975}
TOKENS_A_TILE = 258


def image_tokens(width: Column, height: Column, tile: int = 768) -> Column:
    return (F.floor((width + tile - 1) / tile) * F.floor((height + tile - 1) / tile) * TOKENS_A_TILE).cast("long")


def image_cost(model: Column, mode: str) -> Column:
    """Dollars for one image; null for models without a price."""
    return F.coalesce(*(F.when(F.lower(model).rlike(f"gemini-2[.-]5-{kind}"), F.lit(cost)) for (kind, m), cost in IMAGE_COSTS.items() if m == mode))
