"""From scored candidates to a selection: representatives, quotas, fill.

Candidates have one row for each image and category: category, image_ord, quality_score, and what is carried along.
Ties follow the input order: of a burst the earlier image, of groups the one that appears first, of categories the
one that appears first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strata import RULE_ORDER, SelectorConfig
from ..storage import keep
from .order_stats import values_at

#: Spark prunes a ranked window per partition up to this rank; beyond, ordered limits do it.
WINDOW_LIMIT = 1000


def join_sequences(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Images with their sequence fields; images without metadata are dropped.

    Metadata have a row for each image, and a file's size tells little of theirs: they are dealt out, never sent whole
    through the driver on an estimate.
    """
    return images.join(metadata.hint("merge"), F.col("file") == F.col("file_name")).drop("file_name")


def best_per_sequence(candidates: DataFrame) -> DataFrame:
    """The best image of each (category, seq_id), the number of its images, and where the group first appears."""
    carried = [c for c in candidates.columns if c not in ("category", "seq_id")]
    order = F.struct(F.col("quality_score").alias("s"), (-F.col("image_ord")).alias("o"))
    best = candidates.groupBy("category", "seq_id").agg(F.max_by(F.struct(*carried), order).alias("best"), F.count("*").alias("sequence_size"), F.min("image_ord").alias("group_ord"))
    return best.select("category", "seq_id", *(F.col(f"best.{c}").alias(c) for c in carried), "sequence_size", "group_ord")


def image_groups(candidates: DataFrame) -> DataFrame:
    """Every candidate for itself, for the presets without sequences."""
    return candidates.withColumn("group_ord", F.col("image_ord"))


def by_number(values: dict[str, int], column: str = "category") -> Column:
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()), F.lit(None).cast("int"))


def category_top_k(groups: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """The best of each category up to its quota, with category_ord and rank (from 1)."""
    order = [F.desc("quality_score"), F.asc("group_ord")]
    numbers = {c: i for i, c in enumerate(quotas)}
    most = max(quotas.values(), default=0)
    if most <= WINDOW_LIMIT:
        ranked = groups.where(F.col("category").isin(list(quotas))).withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
        chosen = ranked.where(F.col("rank") <= most).where(F.col("rank") <= by_number(quotas))
    else:
        parts = [groups.where(F.col("category") == c).orderBy(*order).limit(q) for c, q in quotas.items()]
        chosen = parts[0]
        for part in parts[1:]:
            chosen = chosen.unionByName(part)
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    return chosen.withColumn("category_ord", by_number(numbers))


def negatives_mix(groups: DataFrame, quotas: dict[str, int], negatives: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Quotas for categories of negative examples: q // 2 of the better half, the rest of the other half in hash order.

    The border of the halves is an exact order statistic; both halves are ordered limits, never a sorted category.
    """
    numbers = {c: i for i, c in enumerate(quotas)}
    some = groups.where(F.col("category").isin(*negatives)).withColumn("_v", F.struct((-F.col("quality_score")).alias("q"), F.col("group_ord").alias("o")))
    border = keep(values_at(some, {"half": (1, 2)}, "category", "_v")).select("category", F.col("v").alias("_border"), F.col("n").alias("_n"))  # a row for each category
    placed = some.join(F.broadcast(border), "category")
    parts = None
    for category in negatives:
        mine, half = placed.where(F.col("category") == category), quotas[category] // 2
        better = mine.where("_v < _border").orderBy("_v").limit(half)
        better = better.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("_v")))
        order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("file"))), F.col("group_ord")]
        other = mine.where("_v >= _border").orderBy(*order).limit(quotas[category] - half)
        nth = F.row_number().over(Window.partitionBy("category").orderBy(*order))
        other = other.withColumn("rank", (F.least(F.lit(half), F.floor(F.col("_n") / 2)) + nth).cast("int"))
        for part in (better, other):
            parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("category_ord", by_number(numbers)).drop("_v", "_border", "_n")


def unselected_sequences(groups: DataFrame, selected: DataFrame) -> DataFrame:
    """selected: as many rows as the quotas at most; they travel to the groups, which are not dealt out again."""
    return groups.join(F.broadcast(selected.select("seq_id").distinct()), "seq_id", "left_anti")


def unselected_images(groups: DataFrame, selected: DataFrame) -> DataFrame:
    """selected: as many rows as the quotas at most; they travel to the groups, which are not dealt out again."""
    return groups.join(F.broadcast(selected.select("file").distinct()), "file", "left_anti")


def category_appearance(groups: DataFrame) -> DataFrame:
    """Of each category where it first appears; of categories that appear with one image, the rule's place."""
    places = {c: i for i, c in enumerate(RULE_ORDER)}
    return groups.groupBy("category").agg(F.min("group_ord").alias("_first")).withColumn("_rule", by_number(places))


def fill_remaining(groups: DataFrame, selected: DataFrame, total: int, per_sequence: bool, strict: bool = False) -> DataFrame:
    """The best groups that are not selected, as many as are missing from `total`; ranked from 1.

    strict: of each burst the best group alone, found before the cut, so that `total` is reached if there are bursts enough.
    """
    rest = unselected_sequences(groups, selected) if per_sequence else unselected_images(groups, selected)
    rest = rest.join(F.broadcast(category_appearance(groups)), "category")  # a row for each category
    if strict and per_sequence:
        order = F.struct((-F.col("quality_score")).alias("q"), "_first", "_rule", "group_ord")
        rest = rest.groupBy(F.col("seq_id").alias("_burst")).agg(F.min_by(F.struct(*rest.columns), order).alias("r")).select("r.*")
    order = [F.desc("quality_score"), F.asc("_first"), F.asc("_rule"), F.asc("group_ord")]
    top = rest.orderBy(*order).limit(total)  # no more can be missing
    missing = selected.agg((F.lit(total) - F.count("*")).alias("_missing"))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `total` rows at most
    return ranked.crossJoin(F.broadcast(missing)).where(F.col("rank") <= F.col("_missing")).drop("_missing", "_first", "_rule")


def select(groups: DataFrame, config: SelectorConfig, total: int) -> DataFrame:
    """Quota rows (phase 0), then fill rows (phase 1); rank inside each.

    Quota, missing count, anti join, category order and fill all read the groups, which are computed once and kept in
    the shared folder.
    """
    groups = keep(groups, "groups")
    quotas = config.quotas(total)
    plain = {c: q for c, q in quotas.items() if c not in config.negatives}
    numbers = {c: i for i, c in enumerate(quotas)}
    chosen = category_top_k(groups, plain)
    if config.negatives:
        chosen = chosen.unionByName(negatives_mix(groups, quotas, config.negatives, config.seed))
    chosen = chosen.withColumn("category_ord", by_number(numbers)).withColumn("phase", F.lit(0))
    if config.strict_unique_sequences and config.per_sequence:
        first = Window.partitionBy("seq_id").orderBy("category_ord", "rank")
        chosen = chosen.withColumn("_once", F.row_number().over(first)).where("_once = 1").drop("_once")
    fill = fill_remaining(groups, chosen, total, config.per_sequence, config.strict_unique_sequences)
    fill = fill.withColumn("category_ord", by_number(numbers)).withColumn("phase", F.lit(1))
    return chosen.unionByName(fill.select(chosen.columns))


# -- other selectors -----------------------------------------------------------------------------------------


def top_heuristic(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "image_ord").limit(n)


def hash_order(seed: int, name: Column) -> Column:
    """A reproducible random order, the same under any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def random_candidates(images: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return images.orderBy(hash_order(seed, F.col("file")), "image_ord").limit(n)


def dedupe_last(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), position).alias("r")).select("r.*")


def dedupe_first(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), position).alias("r")).select("r.*")


def hybrid_candidates(selections: list[tuple[str, DataFrame, str, float]], n: int) -> DataFrame:
    """Shares of several selectors, one after the other; of each file the first entry; n rows at most.

    selections: name, rows with `file`, the column that ranks them from 1, weight.
    """
    weight = sum(w for *_, w in selections)
    parts = None
    for i, (name, rows, rank, w) in enumerate(selections):
        part = rows.where(F.col(rank) <= int(w / weight * n)).select("file", F.lit(name).alias("source_selector"), (F.lit(i * (n + 1)) + F.col(rank)).cast("long").alias("position"))
        parts = part if parts is None else parts.unionByName(part)
    return dedupe_first(parts, "file", "position").orderBy("position").limit(n)
