"""The registered queries: every operator over the whole fixture views of the given tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import features as ft
from .functions import names, replies
from .functions.strata import preset
from .operators import comparison, labelling, profile, rarity, selection
from .plans import selectors
from .sources import detections as sources
from .sources import images as image_sources
from .sources import labels, sinks
from .storage import keep, scratch
from .streaming import labelling as streaming
from .streaming.calls import CallPolicy

TOTAL = 500
SAMPLE = 200
SEQUENCE = preset("sequence", score_scale=6)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, scale: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, scale) for c in columns})


# -- sources: the views are written as files to the shared folder and read back -------------------------------


#: Bytes of a range of a document: small, so that the given tables make several.
RANGE = 1 << 20


def _documents(rows, value, path, head, tail):
    """A document a partition, in the order of image_ord; value: an element's text, made where it is written."""
    sinks.write_documents(rows.repartitionByRange("image_ord").sortWithinPartitions("image_ord").select(value.alias("value")), path, head, tail)


@query
def read_detections(spark, sf_dir):
    at = scratch(spark, "detections")
    pairs = F.transform("detections", lambda d: F.struct(d.category.alias("category"), d.conf.alias("conf"), d.bbox.alias("bbox"), F.transform(d.classifications, lambda c: F.array(c.species_id, c.conf.cast("string"))).alias("classifications")))
    # Keys in both orders, quotes and brackets in strings, and a `file` and an `images` elsewhere in the document.
    other = F.struct(F.lit('a "]" and [{').alias("note"), pairs.alias("detections"), "file")
    element = F.when(F.col("image_ord") % 3 == 0, F.to_json(other)).otherwise(F.to_json(F.struct("file", pairs.alias("detections"))))
    # Kept, as dealing out by range reads the images twice: for the bounds and for the rows.
    _documents(keep(fx.images(spark, sf_dir), "images"), element, at, '{"info": {"file": "model.pt", "images": [{"file": "no"}]}, "images": [\n', '\n], "detection_categories": {"1": "animal"}, "rest": [{"file": "x\\\\"}]}')
    read = sources.read_detections(spark, at, RANGE).select("image_ord", "file", F.posexplode_outer("detections").alias("nth", "d"))
    named = F.array_join(F.transform("d.classifications", lambda c: c.species_id), ",")
    return rounded(read.select("image_ord", "file", "nth", "d.category", "d.conf", ft.size_of(F.col("d")).alias("size"), named.alias("species"), F.get("d.classifications", F.lit(0)).conf.alias("first_conf")), "size")


def _image_files(spark, sf_dir, at):
    """A file for each supplier, some of them images, in folders by nation."""
    ends = F.array(*(F.lit(e) for e in (".jpg", ".JPEG", ".png", ".txt")))
    name = F.concat(F.lit("sup"), F.col("s_suppkey").cast("string"), F.element_at(ends, (F.col("s_suppkey") % 4 + 1).cast("int")))
    rows = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{at}/n"), F.col("s_nationkey").cast("string"), F.lit("/"), name).alias("path"), F.col("s_name").alias("content"))
    sinks.write_files(rows).agg(F.sum("bytes")).collect()


def _below(path, at):
    return F.substring_index(path, f"{at.rsplit('/', 1)[1]}/", -1)


@query
def list_images(spark, sf_dir):
    at = scratch(spark, "images")
    _image_files(spark, sf_dir, at)
    return image_sources.list_images(spark, at, recursive=True).select(_below(F.col("path"), at).alias("path"), "length")


@query
def copy_images(spark, sf_dir):
    at, to = scratch(spark, "images"), scratch(spark, "copies")
    _image_files(spark, sf_dir, at)
    listing = image_sources.list_images(spark, at, recursive=True).select(_below(F.col("path"), at).alias("path"), "length")
    wanted = listing.select("path").unionByName(listing.select(F.concat(F.col("path"), F.lit(".gone")).alias("path"))).withColumnRenamed("path", "file")
    plan = keep(sinks.copy_plan(wanted, listing, to))
    sinks.copy_files(plan.where("crc32(source) % 3 = 0"), f"{at}/").agg(F.sum("moved")).collect()  # a run that did not get far
    done = keep(sinks.copy_files(plan, f"{at}/", tasks=8))
    there = image_sources.list_images(spark, to).select(_below(F.col("path"), to).alias("target"), "length")
    return done.select("source", "copied", _below(F.col("target"), to).alias("target")).join(there, "target", "left").select("source", "copied", F.when(F.col("copied"), F.col("target")).alias("target"), "length")


@query
def list_from_text(spark, sf_dir):
    at = scratch(spark, "paths")
    line = F.when(F.col("image_ord") % 7 == 0, F.concat(F.lit("# "), F.col("file"))).when(F.col("image_ord") % 11 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("  "), F.col("file"), F.lit(" ")))
    fx.image_list(spark, sf_dir).select(line.alias("value")).write.text(at)
    return image_sources.list_from_text(spark, at)


@query
def list_from_json(spark, sf_dir):
    at = scratch(spark, "paths")
    element = F.when(F.col("image_ord") % 7 == 0, F.col("image_ord").cast("string")).when(F.col("image_ord") % 11 == 0, F.lit('{"a": "b"}')).otherwise(F.concat(F.lit('"'), F.col("file"), F.lit('"')))
    _documents(fx.image_list(spark, sf_dir), element, at, "[", "]")
    return image_sources.list_from_json(spark, at, RANGE).select("path")


@query
def read_sequence_metadata(spark, sf_dir):
    at = scratch(spark, "metadata")
    entries = fx.metadata(spark, sf_dir).withColumn("image_ord", F.regexp_extract("file_name", r"(\d+)\.jpg", 1).cast("long"))
    again = entries.where("frame_num % 3 = 0").withColumn("location", F.lit("moved"))
    last = again.agg(F.max("image_ord").alias("most")).first().most or 0
    rows = entries.unionByName(again.withColumn("image_ord", F.col("image_ord") + last + 1))
    _documents(rows, F.to_json(F.struct("file_name", "seq_id", "frame_num", "seq_num_frames", "location")), at, '{"annotations": [{"images": []}], "images": [', "]}")
    return sources.read_sequence_metadata(spark, at, RANGE)


CHUNK = 1000


def _label_files(spark, sf_dir, at):
    """A label file for each model and CHUNK images; in every third one the totals stand in `checkpoint_info`."""
    r = _results(spark, sf_dir).withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    info = F.struct(F.col("model").alias("model_used"), F.size("results").alias("total_images"))
    files = sinks.label_document(r, info, ["model", "chunk"])
    content = F.when(F.col("chunk") % 3 == 2, F.replace(F.col("content"), F.lit('"labeling_info"'), F.lit('"checkpoint_info"'))).otherwise(F.col("content"))
    name = F.concat(F.lit("x_labels_"), F.col("model"), F.lit("_"), F.col("chunk").cast("string"), F.lit(".json"))
    sinks.write_files(files.select(F.concat(F.lit(f"{at}/"), name).alias("path"), content.alias("content"))).agg(F.sum("bytes")).collect()


@query
def read_label_files(spark, sf_dir):
    at = scratch(spark, "labels")
    _label_files(spark, sf_dir, at)
    return labels.read_label_files(spark, at).select("file_name", "info.model_used", F.col("info.total_images").cast("long").alias("total_images"), F.size("results").cast("long").alias("results"))


@query
def label_results(spark, sf_dir):
    at = scratch(spark, "labels")
    _label_files(spark, sf_dir, at)
    return labels.label_results(labels.read_label_files(spark, at)).select("file_name", F.col("pos").cast("long").alias("pos"), "image_path", "image_filename", "aesthetic_score", "reasoning", "success", "error")


@query
def read_batch_manifest(spark, sf_dir):
    at = scratch(spark, "manifests")
    rows = fx.image_list(spark, sf_dir).withColumn("chunk", F.floor(F.col("image_ord") / CHUNK))
    one = F.struct(F.col("image_ord").cast("int").alias("index"), F.col("file").alias("path"), names.flattened_name(F.col("file")).alias("filename"))
    job = F.struct(F.concat(F.lit("job"), F.col("chunk").cast("string")).alias("job_name"))
    files = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(one)).alias("image_list"))  # CHUNK images at most
    sinks.write_files(files.select(F.concat(F.lit(f"{at}/"), F.col("chunk").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(job.alias("batch_info"), "image_list")).alias("content"))).agg(F.sum("bytes")).collect()
    return labels.read_batch_manifest(spark, at).select("job_name", F.col("pos").cast("long").alias("pos"), F.col("index").cast("long").alias("index"), "path", "filename")


# -- features ------------------------------------------------------------------------------------------------


@query
def head_subset(spark, sf_dir):
    return sources.with_chunk(sources.head_subset(fx.image_list(spark, sf_dir), 10_000), 1000).select("image_ord", "file", "chunk_id")


@query
def animal_detections(spark, sf_dir):
    kept = fx.images(spark, sf_dir).select("image_ord", F.posexplode(ft.animal_detections(F.col("detections"))).alias("nth", "d"))
    return kept.select("image_ord", F.col("nth").cast("long").alias("nth"), "d.conf", F.size("d.classifications").cast("long").alias("classifications"))


@query
def image_features(spark, sf_dir):
    f = ft.image_features(fx.images(spark, sf_dir))
    return rounded(f.select("image_ord", "num_animals", "max_size", "avg_size", "max_confidence", "avg_confidence"), "max_size", "avg_size", "avg_confidence")


@query
def centrality(spark, sf_dir):
    return rounded(ft.image_features(fx.images(spark, sf_dir)).select("image_ord", "centrality"), "centrality")


@query
def species_in_image(spark, sf_dir):
    config = SEQUENCE
    f = selectors.features_with_rarity(fx.images(spark, sf_dir), config)
    return f.select("image_ord", F.array_join(F.sort_array("species_list"), ",").alias("species"), "num_species", "has_rare_species")


@query
def gaussian_size_score(spark, sf_dir):
    f = ft.image_features(fx.images(spark, sf_dir))
    return f.select("image_ord", F.round(ft.gaussian_size_score(F.col("max_size"), 0.3), 6).alias("live"), F.round(ft.gaussian_size_score(F.col("max_size"), 0.1), 6).alias("improved"))


@query
def log_size_score(spark, sf_dir):
    return ft.image_features(fx.images(spark, sf_dir)).select("image_ord", F.round(ft.log_size_score(F.col("max_size")), 6).alias("score"))


def _candidates(spark, sf_dir, config, with_metadata=True):
    metadata = fx.metadata(spark, sf_dir) if with_metadata else None
    return selectors.candidates(selectors.features_with_rarity(fx.images(spark, sf_dir), config, metadata), config)


def _assigned(name):
    def run(spark, sf_dir):
        return _candidates(spark, sf_dir, preset(name), False).select("image_ord", "category")

    run.__name__ = f"assign_categories_{name}"
    return query(run)


def _scored(name):
    def run(spark, sf_dir):
        return _candidates(spark, sf_dir, preset(name, score_scale=6), False).select("image_ord", "category", "quality_score")

    run.__name__ = f"quality_score_{name}"
    return query(run)


for _name in ("v1", "improved", "training"):
    _assigned(_name)
    _scored(_name)


@query
def heuristic_score(spark, sf_dir):
    return selectors.heuristic_scores(fx.images(spark, sf_dir), 6).select("image_ord", "score")


@query
def selection_criteria(spark, sf_dir):
    f = ft.image_features(fx.images(spark, sf_dir)).select("image_ord", ft.selection_criteria().alias("c"))
    rows = f.select("image_ord", "c.num_animals", "c.max_animal_size", "c.avg_animal_size", "c.max_confidence", "c.avg_confidence", "c.species_count", F.array_join(F.sort_array("c.species_list"), ",").alias("species"))
    return rounded(rows, "max_animal_size", "avg_animal_size", "avg_confidence")


@query
def flattened_name(spark, sf_dir):
    f = F.col("file")
    flat = names.flattened_name(f)
    return fx.image_list(spark, sf_dir).select("image_ord", flat.alias("flattened"), names.display_safe(flat).alias("display"), names.basename(f).alias("basename"))


@query
def sanitize_model(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "models/").otherwise(""), F.lit("vendor/m-"), F.col("p_partkey").cast("string"), F.lit(":latest")).alias("model"))
    m = F.col("model")
    return part.select("model", names.sanitize_model(m).alias("cloud"), names.sanitize_model(m, False).alias("local"), names.with_prefix(m).alias("prefixed"), names.without_prefix(m).alias("bare"))


@query
def resize_plan(spark, sf_dir):
    size = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4000 + 1).alias("width"), (F.col("l_suppkey") * 37 % 3000 + 1).alias("height"))
    w, h = F.col("width"), F.col("height")
    full, preview = names.resize_plan(w, h), names.resize_plan(w, h, 400, False)
    return size.select("l_orderkey", "l_linenumber", "width", "height", full[0].alias("new_width"), full[1].alias("new_height"), preview[0].alias("preview_width"), preview[1].alias("preview_height"))


@query
def token_cost(spark, sf_dir):
    model = F.when(F.col("p_partkey") % 3 == 0, "gemini-2.5-flash").when(F.col("p_partkey") % 3 == 1, "models/Gemini-2-5-Pro").otherwise("other")
    part = fx.table(spark, sf_dir, "part").select(model.alias("model"), (F.col("p_partkey") % 3000 + 1).alias("w"), (F.col("p_partkey") * 7 % 2000 + 1).alias("h"))
    rows = part.select("model", names.image_tokens(F.col("w"), F.col("h")).alias("tokens"), names.image_cost(F.col("model"), "batch").alias("batch"), names.image_cost(F.col("model"), "sync").alias("sync"))
    return rows.groupBy("model").agg(F.count("*").alias("images"), F.sum("tokens").alias("tokens"), F.round(F.sum("batch"), 6).alias("batch_cost"), F.round(F.sum("sync"), 6).alias("sync_cost"))


def _results(spark, sf_dir, mode="local"):
    """The parsed replies as label results; pos is their order within a model."""
    parsed = replies.parse_responses(fx.replies(spark, sf_dir), mode)
    return parsed.select("model", F.col("image_ord").alias("pos"), "image_path", "image_filename", "score", "reasoning", "success", F.col("failure_kind").alias("error"))


@query
def score_display(spark, sf_dir):
    r = _results(spark, sf_dir)
    error = F.when(F.col("error") == "bad_json", F.col("error"))
    return r.select("model", "image_filename", names.score_bucket(F.col("score")).alias("bucket"), names.score_display(F.col("score"), F.col("success"), error).alias("shown"))


@query
def link_text(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    kinds = F.array(*(F.lit(x) for x in ("local_ollama", "local_vllm", "gemini_batch", "gemini_sync", "batch_api", "synchronous_api")))
    method = F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.select("p_partkey", names.link_text(method, F.concat(F.lit("m"), F.col("p_partkey").cast("string"))).alias("link"))


def _parsed(mode):
    def run(spark, sf_dir):
        return replies.parse_responses(fx.replies(spark, sf_dir), mode).select("model", "image_ord", "score", "reasoning", "returned_filename", "success", "failure_kind")

    run.__name__ = f"parse_responses_{mode}"
    return query(run)


for _mode in replies.MODES:
    _parsed(_mode)


def _requests(kind, name):
    def run(spark, sf_dir):
        images = fx.image_list(spark, sf_dir).select("image_ord", names.flattened_name(F.col("file")).alias("image_filename"), F.col("file").cast("binary").alias("content"))
        return replies.build_requests(images, "Rate the image.", kind, "m1").select("image_ord", "image_filename", "request")

    run.__name__ = name
    return query(run)


_requests("generate", "build_requests")
_requests("batch", "build_requests_batch")
_requests("chat", "build_requests_chat")


# -- joins ---------------------------------------------------------------------------------------------------


@query
def join_sequences(spark, sf_dir):
    joined = selection.join_sequences(fx.image_list(spark, sf_dir), fx.metadata(spark, sf_dir))
    return joined.select("image_ord", "file", "seq_id", "frame_num", "seq_num_frames", "location")


@query
def rare_species_join(spark, sf_dir):
    f = selectors.features_with_rarity(fx.images(spark, sf_dir), SEQUENCE)
    return f.groupBy("has_rare_species").agg(F.count("*").alias("images"), F.sum("num_species").alias("species"))


@query
def rarity_lookup(spark, sf_dir):
    images = keep(fx.images(spark, sf_dir), "images")
    f = rarity.with_rarity(ft.image_features(images), rarity.species_counts(images))
    return f.select("image_ord", F.round("rarity", 6).alias("rarity"))


def _groups(spark, sf_dir):
    return selection.best_per_sequence(_candidates(spark, sf_dir, SEQUENCE))


def _quota_rows(spark, sf_dir):
    return selection.category_top_k(_groups(spark, sf_dir), SEQUENCE.quotas(TOTAL))


@query
def unselected_sequences(spark, sf_dir):
    groups = keep(_groups(spark, sf_dir), "groups")
    chosen = selection.category_top_k(groups, SEQUENCE.quotas(TOTAL))
    return selection.unselected_sequences(groups, chosen).select("category", "seq_id", "file", "quality_score")


@query
def unselected_images(spark, sf_dir):
    config = preset("improved", score_scale=6)
    groups = keep(selection.image_groups(_candidates(spark, sf_dir, config, False)), "groups")
    chosen = selection.category_top_k(groups, config.quotas(TOTAL))
    return selection.unselected_images(groups, chosen).select("category", "file", "quality_score")


@query
def resume_pending(spark, sf_dir):
    done = fx.replies(spark, sf_dir).where("model = 'model0'").select(names.basename(F.col("image_path")).alias("image_filename"))
    return labelling.resume_pending(fx.image_list(spark, sf_dir).withColumnRenamed("file", "path"), done).select("image_ord", "path")


@query
def reconcile_responses(spark, sf_dir):
    r = fx.replies(spark, sf_dir)
    parsed = replies.parse_responses(r, "batch").drop("image_ord", "image_path", "image_filename")
    expected = r.select("model", "image_filename", "image_path", "image_ord")
    return labelling.reconcile_responses(parsed, expected, by=("model",), check=False).select("model", "image_ord", "image_path", "score", "reasoning")


@query
def response_violations(spark, sf_dir):
    r = fx.replies(spark, sf_dir)
    parsed = replies.parse_responses(r, "batch")
    repeated = parsed.unionByName(parsed.where("image_ord % 97 = 0"))
    return labelling.violations(repeated, r, by=("model",)).select("model", "violation", "subject", "n")


def _sample(spark, sf_dir):
    return comparison.sample_filenames(fx.image_list(spark, sf_dir).select(names.flattened_name(F.col("file")).alias("image_filename")), SAMPLE, 42)


@query
def sample_join(spark, sf_dir):
    return comparison.sample_join(_sample(spark, sf_dir), _results(spark, sf_dir).where("model = 'model1'"), "x_labels_model1.json", "model1")


@query
def model_grid(spark, sf_dir):
    models = fx.replies(spark, sf_dir).select("model").distinct()
    files = models.select("model", F.concat(F.lit("x_labels_"), "model", F.lit(".json")).alias("file_name"))
    return comparison.model_grid(_sample(spark, sf_dir), _results(spark, sf_dir), files)


@query
def verify_paths(spark, sf_dir):
    listing = fx.metadata(spark, sf_dir).select(F.col("file_name").alias("path"))
    return sinks.missing_and_found(fx.image_list(spark, sf_dir), listing).groupBy("found").agg(F.count("*").alias("files"))


@query
def copy_plan(spark, sf_dir):
    listing = fx.metadata(spark, sf_dir).select(F.col("file_name").alias("path"))
    return sinks.copy_plan(fx.image_list(spark, sf_dir), listing, "out/")


@query
def model_run_name(spark, sf_dir):
    order = fx.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("models/v/m"), F.col("p_partkey").cast("string")).alias("model"))
    return order.select("p_partkey", sinks.run_name(F.lit("gemini_batch"), F.col("model"), F.lit("20250102_030405")).alias("name"), sinks.run_name(F.lit("local_vllm"), F.col("model"), F.lit("20250102_030405"), True).alias("checkpoint"))


# -- aggregations --------------------------------------------------------------------------------------------


@query
def species_counts(spark, sf_dir):
    return rarity.species_counts(fx.images(spark, sf_dir))


@query
def rare_species(spark, sf_dir):
    return rarity.rare_species(rarity.species_counts(fx.images(spark, sf_dir)))


@query
def category_stats(spark, sf_dir):
    return profile.category_stats(_candidates(spark, sf_dir, SEQUENCE))


@query
def dataset_summary(spark, sf_dir):
    return profile.dataset_summary(fx.images(spark, sf_dir))


@query
def top_species(spark, sf_dir):
    return profile.top_species(rarity.species_counts(fx.images(spark, sf_dir)))


@query
def value_quantiles(spark, sf_dir):
    return rounded(profile.value_quantiles(fx.images(spark, sf_dir)), "min", "q25", "median", "q75", "max")


@query
def threshold_counts(spark, sf_dir):
    return profile.threshold_counts(fx.images(spark, sf_dir))


@query
def funnel(spark, sf_dir):
    return profile.funnel(fx.images(spark, sf_dir), fx.metadata(spark, sf_dir))


@query
def high_conf_with_cls(spark, sf_dir):
    return profile.high_conf_with_classifications(fx.images(spark, sf_dir))


def _selected(spark, sf_dir):
    return selectors.select_sequence_aware(fx.images(spark, sf_dir), fx.metadata(spark, sf_dir), TOTAL, SEQUENCE)


@query
def selection_summary(spark, sf_dir):
    return profile.selection_summary(_selected(spark, sf_dir))


@query
def category_distribution(spark, sf_dir):
    return profile.category_distribution(_selected(spark, sf_dir))


@query
def size_distribution(spark, sf_dir):
    return rounded(profile.size_distribution(_selected(spark, sf_dir)), "min", "max", "p10", "p25", "median", "p75", "p90")


@query
def category_sizes(spark, sf_dir):
    return rounded(profile.category_sizes(_selected(spark, sf_dir)), "min_size", "max_size")


def _methods(spark, sf_dir):
    scored = keep(selectors.heuristic_scores(fx.images(spark, sf_dir), 6), "scored")
    return selection.top_heuristic(scored, TOTAL), selection.random_candidates(scored, TOTAL, 7)


@query
def selector_comparison(spark, sf_dir):
    top, random = _methods(spark, sf_dir)
    return profile.selector_comparison(top.withColumn("method", F.lit("heuristic")).unionByName(random.withColumn("method", F.lit("random"))))


@query
def label_stats(spark, sf_dir):
    return labelling.label_stats(_results(spark, sf_dir, "sync"))


@query
def response_audit(spark, sf_dir):
    return labelling.response_audit(replies.parse_responses(fx.replies(spark, sf_dir), "batch"))


@query
def dashboard(spark, sf_dir):
    stats = labelling.label_stats(_results(spark, sf_dir, "sync"))
    info = F.struct(
        F.when(F.col("model") == "model0", "gemini_sync").when(F.col("model") == "model1", "local_vllm").alias("processing_method"), F.col("model").alias("model_used"), "total_images", F.when(F.col("model") != "model2", F.col("success_rate")).alias("success_rate"),
        F.struct("avg_score").alias("statistics"), F.when(F.col("model") == "model0", "2025-01-02 03:04:05").alias("timestamp"),
    )
    return comparison.dashboard(stats.select(F.concat(F.col("model"), F.lit("_labels_x.json")).alias("file_name"), info.alias("info")))


# -- ranking and selection -----------------------------------------------------------------------------------


@query
def best_per_sequence(spark, sf_dir):
    return _groups(spark, sf_dir).select("category", "seq_id", "file", "quality_score", "sequence_size")


@query
def sequence_size(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("category", "sequence_size").agg(F.count("*").alias("groups"))


@query
def category_top_k(spark, sf_dir):
    return _quota_rows(spark, sf_dir).select("category", F.col("rank").cast("long").alias("rank"), "seq_id", "file", "quality_score")


@query
def fill_remaining(spark, sf_dir):
    groups = keep(_groups(spark, sf_dir), "groups")
    chosen = selection.category_top_k(groups, SEQUENCE.quotas(TOTAL // 2))
    return selection.fill_remaining(groups, chosen, TOTAL, True).select("category", "seq_id", "file", F.col("rank").cast("long").alias("rank"), "quality_score")


PICKED = ("phase", "category", "file", "quality_score", "max_size", "num_animals", "num_species")


@query
def select_sequence_aware(spark, sf_dir):
    rows = rounded(_selected(spark, sf_dir), "max_size")
    return rows.select(*PICKED, F.col("rank").cast("long").alias("rank"), "seq_id", "frame_num", "seq_num_frames", "sequence_size", "max_confidence")


STRICT_TOTAL = 900


@query
def select_sequence_aware_strict(spark, sf_dir):
    """A burst once over all categories."""
    rows = selectors.select_sequence_aware(fx.images(spark, sf_dir), fx.metadata(spark, sf_dir), STRICT_TOTAL, preset("sequence", score_scale=6, strict_unique_sequences=True))
    return rows.select("phase", "category", "file", "seq_id", "quality_score", F.col("rank").cast("long").alias("rank"))


def _stratified(name):
    def run(spark, sf_dir):
        rows = selectors.select_stratified(fx.images(spark, sf_dir), TOTAL, preset(name, score_scale=6))
        return rounded(rows, "max_size").select(*PICKED, F.col("rank").cast("long").alias("rank"))

    run.__name__ = f"select_stratified_{name}"
    return query(run)


for _name in ("v1", "improved", "campaign", "training"):
    _stratified(_name)


@query
def negatives_mix(spark, sf_dir):
    config = preset("training", score_scale=6)
    groups = keep(selection.image_groups(_candidates(spark, sf_dir, config, False)))
    rows = selection.negatives_mix(groups, config.quotas(TOTAL), config.negatives)
    return rows.select("category", "file", "quality_score", F.col("rank").cast("long").alias("rank"))


@query
def dedupe_last(spark, sf_dir):
    rows = _results(spark, sf_dir).select("image_filename", (F.col("pos") * 3 + F.substring("model", 6, 1).cast("int")).alias("pos"), "model", "score")
    return selection.dedupe_last(rows, "image_filename", "pos")


@query
def dedupe_first(spark, sf_dir):
    rows = _results(spark, sf_dir).select("image_path", (F.col("pos") * 3 + F.substring("model", 6, 1).cast("int")).alias("pos"), "model", "score")
    return selection.dedupe_first(rows, "image_path", "pos")


@query
def top_heuristic(spark, sf_dir):
    return _methods(spark, sf_dir)[0].select("image_ord", "file", "score")


@query
def random_candidates(spark, sf_dir):
    return _methods(spark, sf_dir)[1].select("image_ord", "file")


@query
def hybrid_candidates(spark, sf_dir):
    return selectors.select_hybrid({"HeuristicSelector": 0.7, "RandomSelector": 0.3}, fx.images(spark, sf_dir), TOTAL).select("file", "source_selector")


@query
def sample_filenames(spark, sf_dir):
    return _sample(spark, sf_dir)


@query
def display_order(spark, sf_dir):
    rows = _results(spark, sf_dir, "sync").where("model = 'model2'")
    shown = comparison.displayed(rows, "score", sample=SAMPLE, seed=3)
    place = F.row_number().over(Window.orderBy(*comparison.display_order(rows)))  # SAMPLE rows
    return shown.withColumn("place", place.cast("long")).select("place", "image_filename", "score", "success")


@query
def limit_images(spark, sf_dir):
    from .sources.images import limit_images as first

    return first(fx.image_list(spark, sf_dir).select(F.col("file").alias("path")), 1000)


@query
def select_by_name(spark, sf_dir):
    """A selector of the caller's beside the known ones: the largest animals."""
    selectors.register_selector("LargestAnimals", largest_animals)
    return selectors.select_hybrid({"LargestAnimals": 0.5, "RandomSelector": 0.5}, fx.images(spark, sf_dir), TOTAL).select("file", "source_selector")


def largest_animals(images, n):
    top = rounded(ft.image_features(images), "max_size").orderBy(F.desc("max_size"), "image_ord").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("max_size"), "image_ord")))  # n rows


# -- sinks and streams ---------------------------------------------------------------------------------------


@query
def write_candidates(spark, sf_dir):
    at = scratch(spark, "candidates")
    sinks.write_candidates(_selected(spark, sf_dir), at)
    return rounded(spark.read.parquet(f"{at}/candidates"), "max_size")


@query
def write_candidate_summaries(spark, sf_dir):
    at = scratch(spark, "candidates")
    sinks.write_candidates(_selected(spark, sf_dir), at)
    return spark.read.parquet(f"{at}/categories").crossJoin(F.broadcast(spark.read.parquet(f"{at}/summary").select("total_candidates", "unique_sequences")))


@query
def write_labels(spark, sf_dir):
    at = scratch(spark, "labels")
    sinks.write_labels(_results(spark, sf_dir, "sync"), at)
    return spark.read.parquet(f"{at}/results").select("model", F.col("pos").alias("image_ord"), "image_filename", "score", "success")


@query
def write_label_info(spark, sf_dir):
    at = scratch(spark, "labels")
    sinks.write_labels(_results(spark, sf_dir, "sync"), at)
    return spark.read.parquet(f"{at}/labeling_info")


@query
def append_checkpoint(spark, sf_dir):
    at, rows = scratch(spark, "checkpoint"), _results(spark, sf_dir).select("model", "pos", "score", "success")
    for part in (0, 1, 2):
        sinks.append_checkpoint(rows.where(F.col("pos") % 3 == part), at)
    return spark.read.parquet(at)


def make_client():
    """A scorer for the fixture's paths: the image's number decides; every ninth one cannot be read."""

    def client(path):
        number = int(path.rsplit("/", 1)[1].split(".")[0])
        if number % 9 == 0:
            raise OSError("unreadable")
        return f'{{"score": {number % 11}, "reasoning": "r"}}' if number % 10 else "no JSON"

    return client


@query
def score_images(spark, sf_dir):
    scored = streaming.score_images(fx.image_list(spark, sf_dir).select(F.col("file").alias("path")), make_client)
    return streaming.to_results(scored, "m1").select("path", "image_filename", "score", "success", "error")


def _streamed(spark, sf_dir):
    """Two drops of paths, some of them in both, with a restart between them; the places of results and statistics, and the results' schema."""
    source, results, checkpoint, statistics = (scratch(spark, n) for n in ("arriving", "labelled", "progress", "statistics"))
    paths = fx.image_list(spark, sf_dir).select("image_ord", F.col("file").alias("value"))
    for drop in (paths.where("image_ord % 2 = 0"), paths.where("image_ord % 2 = 1 or image_ord % 10 = 0")):
        drop.select("value").write.mode("append").text(source)
        streaming.stream_label(spark, source, results, checkpoint, make_client, "m1", statistics=statistics).awaitTermination()
    return results, spark.read.parquet(results).schema, statistics


@query
def stream_label(spark, sf_dir):
    results, schema, _ = _streamed(spark, sf_dir)
    return spark.read.schema(schema).parquet(results).select("path", "image_filename", "score", "success", "error")


@query
def stream_label_stats(spark, sf_dir):
    return streaming.stream_label_stats(spark, _streamed(spark, sf_dir)[2])


#: Paths whose first call has failed, in a worker.
TRIED: set[str] = set()


def make_slow_client():
    """As make_client, but every 700th image hangs, and the first call of every 50th fails."""
    client = make_client()

    def slow(path):
        number = int(path.rsplit("/", 1)[1].split(".")[0])
        if number % 700 == 0:
            time.sleep(30)
        if number % 50 == 0 and path not in TRIED:
            TRIED.add(path)
            raise OSError("busy")
        return client(path)

    return slow


@query
def score_images_in_windows(spark, sf_dir):
    """Several calls at a time, with a deadline that some overrun and a retry that some need."""
    policy = CallPolicy(window=32, deadline=2.0, retries=1, backoff=0.01)
    scored = streaming.score_images(fx.image_list(spark, sf_dir).select(F.col("file").alias("path")), make_slow_client, 4, policy)
    rows = streaming.to_results(scored, "m1")
    return rows.select("path", "image_filename", "score", "success", F.when(F.startswith("error", F.lit("TimeoutError")), "timeout").otherwise(F.col("error")).alias("error"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
