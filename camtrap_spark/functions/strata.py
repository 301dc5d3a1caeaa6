"""Category rules and quality scores of the selector presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import gaussian_size_score, log_size_score

# Categories and their default shares, in order.
SIZE_SHARES = {"single_large": 0.25, "single_medium": 0.15, "multi_same_species": 0.20, "multi_different_species": 0.15, "rare_species": 0.15, "high_action": 0.10}
CAMPAIGN_SHARES = {"single_large": 0.30, "single_medium": 0.20, "multi_same_species": 0.15, "multi_different_species": 0.15, "rare_species": 0.10, "high_action": 0.10}
TRAINING_SHARES = {
    "single_optimal": 0.20,
    "single_medium": 0.15,
    "single_tiny": 0.10,
    "single_huge": 0.05,
    "multi_same_species": 0.15,
    "multi_different_species": 0.15,
    "rare_species": 0.10,
    "high_action": 0.10,
}

#: Single animals by size, largest first: (category, least size).
SINGLE_RULES = {
    "v1": (("single_large", 0.15), ("single_medium", 0.02)),
    "improved": (("single_large", 0.05), ("single_medium", 0.001)),
    "training": (("single_huge", 0.80), ("single_optimal", 0.10), ("single_medium", 0.005), ("single_tiny", None)),
}
#: Sizes that count as action.
ACTION_SIZES = {"v1": (0.05, None), "improved": (0.005, None), "training": (0.05, 0.50)}
RULE_ORDER = ("single_huge", "single_large", "single_optimal", "single_medium", "single_tiny", "multi_same_species", "multi_different_species", "rare_species", "high_action")


@dataclass(frozen=True)
class SelectorConfig:
    """A named set of rules; everything else about selection is the same."""

    rules: str = "training"
    shares: dict[str, float] = field(default_factory=lambda: dict(TRAINING_SHARES))
    size_score: str = "gaussian"
    size_base: float = 0.3
    per_sequence: bool = False
    #: Categories of negative examples: half of the quota from the better half, the rest in hash order.
    negatives: tuple[str, ...] = ()
    detection_threshold: float = 0.3
    species_threshold: float = 0.5
    #: Decimals that scores are rounded to before ranking; None: raw.
    score_scale: int | None = None
    #: Never take a sequence twice, also across categories.
    strict_unique_sequences: bool = False
    seed: int = 0

    def quotas(self, total: int) -> dict[str, int]:
        return {c: int(total * p) for c, p in self.shares.items()}


PRESETS = {
    "v1": SelectorConfig("v1", dict(SIZE_SHARES), "log"),
    "improved": SelectorConfig("improved", dict(SIZE_SHARES), size_base=0.1),
    "campaign": SelectorConfig("improved", dict(CAMPAIGN_SHARES), size_base=0.1),
    "training": SelectorConfig(negatives=("single_tiny", "single_huge")),
    "sequence": SelectorConfig(per_sequence=True),
}


def preset(name: str, **changes) -> SelectorConfig:
    return replace(PRESETS[name], **changes)


def size_score(config: SelectorConfig, size: Column) -> Column:
    return log_size_score(size) if config.size_score == "log" else gaussian_size_score(size, config.size_base)


def assign_categories(config: SelectorConfig, has_rare: Column) -> Column:
    """The labels of an image, in rule order; one of size or number at most, and rare_species and high_action besides."""
    n, s = F.col("num_animals"), F.col("max_size")
    single = None
    for name, least in SINGLE_RULES[config.rules]:
        fits = F.lit(True) if least is None else s >= least
        single = F.when(fits, F.lit(name)) if single is None else single.when(fits, F.lit(name))
    several = F.when(F.col("num_species") <= 1, F.lit("multi_same_species")).otherwise(F.lit("multi_different_species"))
    least, most = ACTION_SIZES[config.rules]
    action = (F.col("max_confidence") >= 0.85) & (F.col("centrality") >= 0.7) & (s >= least)
    if most is not None:
        action = action & (s <= most)
    labels = F.array(
        F.when(n == 1, single).when(n > 1, several),
        F.when(has_rare, F.lit("rare_species")),
        F.when(action, F.lit("high_action")),
    )
    found = F.array_compact(labels)
    return F.when(F.size(found) == 0, F.array(F.lit("single_medium"))).otherwise(found)


def quality_score(config: SelectorConfig, category: Column, size: Column | None = None) -> Column:
    """The weighted sum of a category; size: the size score, where it is a column already."""
    z = size_score(config, F.col("max_size")) if size is None else size
    mc, ac, ce = F.col("max_confidence"), F.col("avg_confidence"), F.col("centrality")
    n, sp = F.col("num_animals"), F.col("num_species")
    score = (
        F.when(category.isin("single_tiny", "single_huge"), 0.5 * mc + 0.3 * ce + 0.2 * z)
        .when(category.isin("single_large", "single_optimal"), 0.5 * z + 0.3 * ce + 0.2 * mc)
        .when(category == "single_medium", 0.3 * z + 0.4 * ce + 0.3 * mc)
        .when(category == "multi_same_species", 0.3 * z + 0.3 * mc + 0.2 * ce + 0.2 * F.least(n / 5, F.lit(1.0)))
        .when(category == "multi_different_species", 0.25 * z + 0.25 * mc + 0.2 * ce + 0.3 * F.least(sp / 4, F.lit(1.0)))
        .when(category == "rare_species", 0.4 * mc + 0.4 * z + 0.2 * ce)
        .when(category == "high_action", 0.3 * mc + 0.3 * ce + 0.3 * z + 0.1 * F.least(ac, F.lit(1.0)))
        .otherwise((z + mc + ce) / 3)
    )
    return score if config.score_scale is None else F.round(score, config.score_scale)
