"""The registered queries once more, as flat SQL for DuckDB over the same tables: unnested rows and windows, where the
jobs use arrays and aggregates."""

from __future__ import annotations

from .fixtures import cte
from .functions.strata import ACTION_SIZES, PRESETS, RULE_ORDER, SINGLE_RULES

TOTAL, SAMPLE = 500, 200

ANIMALS = """
animals AS (
  SELECT *, w * h AS size, 1 - sqrt(power(x + w / 2 - 0.5, 2) + power(y + h / 2 - 0.5, 2)) AS centre
  FROM fx_detections WHERE category = '1' AND conf >= 0.3
),
cls AS (
  SELECT image_ord, det_ord, category, conf AS dconf, sp1 AS species, c1 AS cconf FROM fx_detections WHERE sp1 IS NOT NULL
  UNION ALL SELECT image_ord, det_ord, category, conf, sp2, c2 FROM fx_detections WHERE sp2 IS NOT NULL
),
sp_counts AS (SELECT species, COUNT(*) AS n FROM cls WHERE category = '1' AND cconf >= 0.5 GROUP BY species),
sp_ranked AS (SELECT *, row_number() OVER (ORDER BY n, species) - 1 AS place, COUNT(*) OVER () AS kinds FROM sp_counts),
rare AS (SELECT species, n, (SELECT n FROM sp_ranked WHERE place = kinds // 5) AS threshold FROM sp_counts WHERE n <= (SELECT n FROM sp_ranked WHERE place = kinds // 5)),
sp_image AS (SELECT DISTINCT image_ord, species FROM cls WHERE category = '1' AND dconf >= 0.3 AND cconf >= 0.5),
sp_sum AS (
  SELECT image_ord, COUNT(*) AS num_species, string_agg(species, ',' ORDER BY species) AS species, bool_or(species IN (SELECT species FROM rare)) AS has_rare
  FROM sp_image GROUP BY image_ord
),
largest AS (SELECT image_ord, centre FROM (SELECT *, row_number() OVER (PARTITION BY image_ord ORDER BY size DESC, det_ord) AS k FROM animals) WHERE k = 1),
feat AS (
  SELECT i.image_ord, i.file, a.num_animals, a.max_size, a.avg_size, a.max_confidence, a.avg_confidence, l.centre AS centrality,
    COALESCE(s.num_species, 0) AS num_species, COALESCE(s.species, '') AS species, COALESCE(s.has_rare, FALSE) AS has_rare
  FROM (SELECT image_ord, COUNT(*) AS num_animals, MAX(size) AS max_size, AVG(size) AS avg_size, MAX(conf) AS max_confidence, AVG(conf) AS avg_confidence FROM animals GROUP BY image_ord) a
  JOIN fx_images i USING (image_ord) JOIN largest l USING (image_ord) LEFT JOIN sp_sum s USING (image_ord)
)"""

GAUSS = "({b} + (1 - {b}) * exp(-power(max_size - 0.25, 2) / (2 * 0.15 * 0.15)))"
LOG = "(least(log10(max_size + 0.0001) + 4, 10.0) / 10)"


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join([cte(), ANIMALS, *parts]) + "\n" + body


def candidates(name: str, with_metadata: bool) -> str:
    """cand: a row for each image and category with the rounded score."""
    config = PRESETS[name]
    labels = []
    seen = "n = 1"
    for category, least in SINGLE_RULES[config.rules]:
        fits = "TRUE" if least is None else f"max_size >= {least}"
        labels.append((category, f"{seen} AND {fits}"))
        seen += f" AND NOT ({fits})"
    labels += [("multi_same_species", "n > 1 AND num_species <= 1"), ("multi_different_species", "n > 1 AND num_species > 1"), ("rare_species", "has_rare")]
    low, high = ACTION_SIZES[config.rules]
    labels.append(("high_action", f"max_confidence >= 0.85 AND centrality >= 0.7 AND max_size >= {low}" + (f" AND max_size <= {high}" if high else "")))
    z = LOG if config.size_score == "log" else GAUSS.format(b=config.size_base)
    rows = " UNION ALL ".join(f"SELECT *, '{c}' AS category FROM f WHERE {when}" for c, when in labels)
    meta = "JOIN fx_metadata m ON m.file_name = feat.file" if with_metadata else ""
    fields = "m.seq_id, m.frame_num, m.seq_num_frames," if with_metadata else ""
    return f"""
f AS (SELECT feat.*, {fields} num_animals AS n FROM feat {meta}),
labelled AS ({rows}),
every AS (SELECT * FROM labelled UNION ALL SELECT *, 'single_medium' AS category FROM f WHERE image_ord NOT IN (SELECT image_ord FROM labelled)),
cand AS (
  SELECT *, round(CASE
    WHEN category IN ('single_tiny', 'single_huge') THEN 0.5 * max_confidence + 0.3 * centrality + 0.2 * {z}
    WHEN category IN ('single_large', 'single_optimal') THEN 0.5 * {z} + 0.3 * centrality + 0.2 * max_confidence
    WHEN category = 'single_medium' THEN 0.3 * {z} + 0.4 * centrality + 0.3 * max_confidence
    WHEN category = 'multi_same_species' THEN 0.3 * {z} + 0.3 * max_confidence + 0.2 * centrality + 0.2 * least(n / 5, 1.0)
    WHEN category = 'multi_different_species' THEN 0.25 * {z} + 0.25 * max_confidence + 0.2 * centrality + 0.3 * least(num_species / 4, 1.0)
    WHEN category = 'rare_species' THEN 0.4 * max_confidence + 0.4 * {z} + 0.2 * centrality
    ELSE 0.3 * max_confidence + 0.3 * centrality + 0.3 * {z} + 0.1 * least(avg_confidence, 1.0) END, 6) AS quality_score
  FROM every
)"""


SEQUENCE_GROUPS = """
groups AS (
  SELECT * FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY category, seq_id) AS sequence_size, MIN(image_ord) OVER (PARTITION BY category, seq_id) AS group_ord,
      row_number() OVER (PARTITION BY category, seq_id ORDER BY quality_score DESC, image_ord) AS k
    FROM cand) WHERE k = 1
)"""
IMAGE_GROUPS = "groups AS (SELECT *, image_ord AS group_ord FROM cand)"


def quotas(name: str, total: int = TOTAL) -> str:
    rows = ", ".join(f"('{c}', {i}, {q})" for i, (c, q) in enumerate(PRESETS[name].quotas(total).items()))
    return f"quotas AS (SELECT * FROM (VALUES {rows}) t(category, category_ord, quota))"


def chosen(name: str) -> str:
    negatives = PRESETS[name].negatives
    named = ", ".join(f"'{c}'" for c in negatives) or "''"
    top = f"""
ordered AS (
  SELECT g.*, q.category_ord, q.quota, row_number() OVER (PARTITION BY g.category ORDER BY quality_score DESC, group_ord) AS rank, COUNT(*) OVER (PARTITION BY g.category) AS members
  FROM groups g JOIN quotas q ON q.category = g.category
),
picked AS (SELECT * FROM ordered WHERE rank <= quota AND category NOT IN ({named}))"""
    if not negatives:
        return top + ", chosen AS (SELECT * FROM picked)"
    return (
        top
        + f""",
lower_half AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('0:' || file), group_ord) AS nth
  FROM ordered WHERE category IN ({named}) AND rank > members // 2
),
mixed AS (
  SELECT * FROM ordered WHERE category IN ({named}) AND rank <= members // 2 AND rank <= quota // 2
  UNION ALL
  SELECT * EXCLUDE (nth) REPLACE (least(quota // 2, members // 2) + nth AS rank) FROM lower_half WHERE nth <= quota - quota // 2
),
chosen AS (SELECT * FROM picked UNION ALL SELECT * FROM mixed)"""
    )


def filled(name: str, total: int = TOTAL, strict: bool = False) -> str:
    key = "seq_id" if PRESETS[name].per_sequence else "file"
    rules = ", ".join(f"('{c}', {i})" for i, c in enumerate(RULE_ORDER))
    once = "WHERE once = 1" if strict else ""
    return f"""
rules AS (SELECT * FROM (VALUES {rules}) t(category, rule)),
appearance AS (SELECT category, MIN(group_ord) AS first_seen FROM groups GROUP BY category),
fill AS (
  SELECT * FROM (
    SELECT * EXCLUDE (once), row_number() OVER (ORDER BY quality_score DESC, first_seen, rule, group_ord) AS rank FROM (
      SELECT g.*, first_seen, rule, row_number() OVER (PARTITION BY {key} ORDER BY quality_score DESC, first_seen, rule, group_ord) AS once
      FROM groups g JOIN appearance USING (category) JOIN rules USING (category)
      WHERE g.{key} NOT IN (SELECT {key} FROM chosen)) {once}) WHERE rank <= {total} - (SELECT COUNT(*) FROM chosen)
)"""


def selected(name: str, extra: str = "") -> str:
    fields = f"category, file, quality_score, max_size, num_animals, num_species, rank{extra}"
    return f"sel AS (SELECT 0 AS phase, {fields} FROM chosen UNION ALL SELECT 1 AS phase, {fields} FROM fill)"


SEQ_EXTRA = ", seq_id, frame_num, seq_num_frames, sequence_size, max_confidence"
SEQ = (candidates("sequence", True), SEQUENCE_GROUPS)
SEQ_CHOSEN = (*SEQ, quotas("sequence"), chosen("sequence"))
SEQ_SELECTED = (*SEQ_CHOSEN, filled("sequence"), selected("sequence", SEQ_EXTRA))

#: A burst once: the first of its quota rows, then the best group of each burst that is left.
STRICT_TOTAL = 900
SEQ_STRICT = (
    *SEQ,
    quotas("sequence", STRICT_TOTAL),
    chosen("sequence").replace("SELECT * FROM picked", "SELECT * EXCLUDE (once) FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY category_ord, rank) AS once FROM picked) WHERE once = 1"),
    filled("sequence", STRICT_TOTAL, strict=True),
    selected("sequence", ", seq_id"),
)


def image_selection(name: str) -> tuple[str, ...]:
    return candidates(name, False), IMAGE_GROUPS, quotas(name), chosen(name), filled(name), selected(name)


HEURISTIC = """
total_cls AS (SELECT SUM(n) AS total FROM sp_counts),
rarity AS (SELECT image_ord, MAX(1 - c.n / t.total) AS bonus FROM sp_image s JOIN sp_counts c USING (species) CROSS JOIN total_cls t GROUP BY image_ord),
heur AS (
  SELECT f.*, round(greatest(0, a.best_size) * 3 + greatest(0, a.best_centre) * 2 + f.max_confidence
    + CASE WHEN f.num_animals > 1 THEN least(log2(f.num_animals), 2.0) ELSE 0 END * 1.5
    + CASE WHEN f.num_species > 1 THEN least(f.num_species * 0.5, 2.0) ELSE 0 END * 2 + greatest(0, COALESCE(r.bonus, 0)), 6) AS score
  FROM feat f JOIN (SELECT image_ord, MAX(log10(size + 0.0001) + 4) AS best_size, MAX(centre) AS best_centre FROM animals GROUP BY image_ord) a USING (image_ord)
  LEFT JOIN rarity r USING (image_ord)
)"""
METHODS = f"""{HEURISTIC},
top_h AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, image_ord) AS r FROM heur) WHERE r <= {TOTAL}),
top_r AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || file), image_ord) AS r FROM heur) WHERE r <= {TOTAL})"""

STRIPPED = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _reply_parts() -> str:
    first = STRIPPED.format(t="reply")
    opened = f"CASE WHEN starts_with({first}, '```json') THEN substr({first}, 8) ELSE {first} END"
    return f"""
opened AS (SELECT *, {opened} AS t1 FROM fx_replies),
closed AS (SELECT *, {STRIPPED.format(t="CASE WHEN ends_with(t1, '```') THEN substr(t1, 1, length(t1) - 3) ELSE t1 END")} AS t2 FROM opened),
reply_json AS (SELECT *, CASE WHEN t2 <> '' AND json_valid(t2) AND json_type(t2) = 'OBJECT' THEN CAST(t2 AS JSON) END AS j FROM closed),
parts AS (
  SELECT *, json_type(j, '$.score') AS score_type, TRY_CAST(json_extract_string(j, '$.score') AS DOUBLE) AS number,
    json_exists(j, '$.score') AS has_score, json_exists(j, '$.reasoning') AS has_reasoning
  FROM reply_json
)"""


def parsed(mode: str) -> str:
    kinds = ["WHEN t2 = '' THEN 'empty'", "WHEN j IS NULL THEN 'bad_json'"]
    if mode == "batch":
        kinds.append("WHEN COALESCE(json_extract_string(j, '$.image_filename'), '') = '' THEN 'missing_filename'")
    if mode != "local":
        kinds.append("WHEN NOT has_score THEN 'missing_score'")
    kinds.append("WHEN has_score AND (score_type = 'NULL' OR number IS NULL) THEN 'bad_score'")
    if mode == "sync":
        kinds.append("WHEN number < 0 OR number > 10 THEN 'out_of_range'")
    if mode != "local":
        kinds.append("WHEN NOT has_reasoning THEN 'missing_reasoning'")
    value = "COALESCE(number, 0.0)" if mode == "local" else "number"
    reasoning = "COALESCE(json_extract_string(j, '$.reasoning'), 'No reasoning provided')" if mode == "local" else "json_extract_string(j, '$.reasoning')"
    name = "NULLIF(json_extract_string(j, '$.image_filename'), '')" if mode == "batch" else "CASE WHEN failure_kind IS NULL THEN image_filename END"
    return (
        _reply_parts()
        + f""",
judged AS (SELECT *, CASE {" ".join(kinds)} END AS failure_kind FROM parts),
parsed AS (
  SELECT model, image_ord, image_path, image_filename, reply,
    CASE WHEN failure_kind IS NULL THEN {value} ELSE {"0.0" if mode == "sync" else "NULL"} END AS score,
    CASE WHEN failure_kind IS NULL THEN {reasoning} END AS reasoning, {name} AS returned_filename,
    failure_kind IS NULL AS success, failure_kind
  FROM judged
)"""
    )


STATS = """
SELECT model, COUNT(*) AS total_images, COUNT(*) FILTER (success) AS successful_labels, COUNT(*) FILTER (NOT success) AS failed_labels,
  round(COUNT(*) FILTER (success) * 100.0 / COUNT(*), 6) AS success_rate, round(COALESCE(AVG(score) FILTER (success), 0.0), 6) AS avg_score,
  COALESCE(MIN(score) FILTER (success), 0.0) AS min_score, COALESCE(MAX(score) FILTER (success), 0.0) AS max_score
FROM parsed GROUP BY model"""

SAMPLE_CTE = f"names AS (SELECT replace(file, '/', '#') AS image_filename FROM fx_images), sampled AS (SELECT image_filename FROM names ORDER BY md5('42:' || image_filename), image_filename LIMIT {SAMPLE})"


def grid_fields(model: str) -> str:
    gone = "p.model IS NULL"
    return f"""CASE WHEN {gone} THEN '' ELSE p.image_path END AS image_path, COALESCE(p.score, 0.0) AS score, CASE WHEN {gone} THEN 'Image not found in ' || {model} || ' results' ELSE p.reasoning END AS reasoning,
  COALESCE(p.success, FALSE) AS success, CASE WHEN {gone} THEN 'No results available for this image in x_labels_' || {model} || '.json' ELSE p.failure_kind END AS error, {gone} AS missing"""


def quantiles(measure: str, value: str, source: str) -> str:
    at = lambda a, b: f"MAX(v) FILTER (k = floor(n * {a} / {b}))"
    return f"""SELECT '{measure}' AS measure, round(MIN(v), 8) AS min, round({at(1, 4)}, 8) AS q25, round({at(1, 2)}, 8) AS median, round({at(3, 4)}, 8) AS q75, round(MAX(v), 8) AS max
FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS k, COUNT(*) OVER () AS n FROM {source})"""


def oracle_sql() -> dict[str, str]:
    out = {
        "read_sequence_metadata": sql("""
SELECT file_name, seq_id, CAST(frame_num AS INT) AS frame_num, seq_num_frames, CASE WHEN frame_num % 3 = 0 THEN 'moved' ELSE location END AS location FROM fx_metadata"""),
        "head_subset": sql("SELECT image_ord, file, CAST(floor(image_ord / 1000) AS BIGINT) AS chunk_id FROM fx_images WHERE image_ord < 10000"),
        "animal_detections": sql("""
SELECT image_ord, row_number() OVER (PARTITION BY image_ord ORDER BY det_ord) - 1 AS nth, conf, CAST((sp1 IS NOT NULL)::INT + (sp2 IS NOT NULL)::INT AS BIGINT) AS classifications FROM animals"""),
        "image_features": sql("SELECT image_ord, num_animals, round(max_size, 8) AS max_size, round(avg_size, 8) AS avg_size, max_confidence, round(avg_confidence, 8) AS avg_confidence FROM feat"),
        "centrality": sql("SELECT image_ord, round(centrality, 8) AS centrality FROM feat"),
        "species_in_image": sql("SELECT image_ord, species, num_species, has_rare AS has_rare_species FROM feat"),
        "gaussian_size_score": sql(f"SELECT image_ord, round({GAUSS.format(b=0.3)}, 6) AS live, round({GAUSS.format(b=0.1)}, 6) AS improved FROM feat"),
        "log_size_score": sql(f"SELECT image_ord, round({LOG}, 6) AS score FROM feat"),
        "heuristic_score": sql("SELECT image_ord, score FROM heur", HEURISTIC),
        "selection_criteria": sql("""
SELECT image_ord, num_animals, round(max_size, 8) AS max_animal_size, round(avg_size, 8) AS avg_animal_size, max_confidence, round(avg_confidence, 8) AS avg_confidence,
  num_species AS species_count, species FROM feat"""),
        "flattened_name": sql("SELECT image_ord, replace(file, '/', '#') AS flattened, replace(file, '/', '_') AS display, split_part(file, '/', 2) AS basename FROM fx_images"),
        "sanitize_model": """
SELECT m AS model, 'vendor-m-' || p || '-latest' AS cloud, replace(replace(m, '/', '-'), ':', '-') AS local, 'models/vendor/m-' || p || ':latest' AS prefixed, 'vendor/m-' || p || ':latest' AS bare
FROM (SELECT p_partkey AS p, CASE WHEN p_partkey % 2 = 0 THEN 'models/' ELSE '' END || 'vendor/m-' || p_partkey || ':latest' AS m FROM part)""",
        "resize_plan": """
SELECT l_orderkey, l_linenumber, width, height, CASE WHEN width > height THEN 768 ELSE CAST(floor(width * 768 / height) AS BIGINT) END AS new_width,
  CASE WHEN width > height THEN CAST(floor(height * 768 / width) AS BIGINT) ELSE 768 END AS new_height,
  CASE WHEN width > height THEN side ELSE CAST(floor(width * side / height) AS BIGINT) END AS preview_width,
  CASE WHEN width > height THEN CAST(floor(height * side / width) AS BIGINT) ELSE side END AS preview_height
FROM (SELECT *, least(greatest(width, height), 400) AS side FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4000 + 1 AS width, l_suppkey * 37 % 3000 + 1 AS height FROM lineitem))""",
        "token_cost": """
SELECT model, COUNT(*) AS images, CAST(SUM(((w + 767) // 768) * ((h + 767) // 768) * 258) AS BIGINT) AS tokens, round(SUM(batch), 6) AS batch_cost, round(SUM(sync), 6) AS sync_cost
FROM (SELECT p_partkey % 3000 + 1 AS w, p_partkey * 7 % 2000 + 1 AS h, CASE p_partkey % 3 WHEN 0 THEN 'gemini-2.5-flash' WHEN 1 THEN 'models/Gemini-2-5-Pro' ELSE 'other' END AS model,
  CASE p_partkey % 3 WHEN 0 THEN 0.0003337::DOUBLE WHEN 1 THEN 0.00134875::DOUBLE END AS batch, CASE p_partkey % 3 WHEN 0 THEN 0.0006674::DOUBLE WHEN 1 THEN 0.0026975::DOUBLE END AS sync FROM part)
GROUP BY model""",
        "score_display": sql("""
SELECT model, image_filename, CAST(trunc(score) AS INT) AS bucket, CASE WHEN success THEN printf('%.1f', score) WHEN failure_kind = 'bad_json' THEN 'Unavailable' ELSE 'FAILED' END AS shown FROM parsed""", parsed("local")),
        "link_text": """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Ollama' WHEN 1 THEN 'vLLM' WHEN 2 THEN 'Gemini Batch' WHEN 3 THEN 'Gemini' WHEN 4 THEN 'batch_api' ELSE 'synchronous_api' END || ': m' || p_partkey AS link FROM part""",
        "build_requests": sql("""
SELECT image_ord, fn AS image_filename, '{"model":"m1","prompt":"Rate the image.\\n\\nImage filename: ' || fn || '","images":["' || base64(encode(file)) || '"],"stream":false,"options":{"temperature":0.1,"num_predict":300}}' AS request
FROM (SELECT *, replace(file, '/', '#') AS fn FROM fx_images)"""),
        "join_sequences": sql("SELECT i.image_ord, i.file, m.seq_id, m.frame_num, m.seq_num_frames, m.location FROM fx_images i JOIN fx_metadata m ON m.file_name = i.file"),
        "rare_species_join": sql("SELECT has_rare AS has_rare_species, COUNT(*) AS images, CAST(SUM(num_species) AS BIGINT) AS species FROM feat GROUP BY 1"),
        "rarity_lookup": sql("SELECT f.image_ord, round(greatest(0.0, COALESCE(r.bonus, 0.0)), 6) AS rarity FROM feat f LEFT JOIN rarity r USING (image_ord)", HEURISTIC),
        "unselected_sequences": sql("SELECT category, seq_id, file, quality_score FROM groups WHERE seq_id NOT IN (SELECT seq_id FROM chosen)", *SEQ_CHOSEN),
        "unselected_images": sql("""
SELECT category, file, quality_score FROM (
  SELECT category, file, quality_score, bool_or(place <= coalesce(quota, 0)) OVER (PARTITION BY file) AS taken FROM (
    SELECT g.category, g.file, g.quality_score, q.quota, row_number() OVER (PARTITION BY g.category ORDER BY g.quality_score DESC, g.group_ord) AS place FROM groups g LEFT JOIN quotas q ON q.category = g.category))
WHERE NOT taken""", candidates("improved", False), IMAGE_GROUPS.replace("groups AS (", "groups AS MATERIALIZED ("), quotas("improved")),
        "resume_pending": sql("SELECT image_ord, file AS path FROM fx_images WHERE split_part(file, '/', 2) NOT IN (SELECT split_part(image_path, '/', 2) FROM fx_replies WHERE model = 'model0')"),
        "reconcile_responses": sql("SELECT p.model, r.image_ord, r.image_path, p.score, p.reasoning FROM parsed p JOIN fx_replies r ON r.model = p.model AND r.image_filename = p.returned_filename WHERE p.success", parsed("batch")),
        "response_violations": sql("""
SELECT model, 'duplicate_filename' AS violation, returned_filename AS subject, COUNT(*) AS n FROM twice WHERE returned_filename IS NOT NULL GROUP BY model, returned_filename HAVING COUNT(*) > 1
UNION ALL
SELECT g.model, 'reply_count', NULL, g.n FROM (SELECT model, COUNT(*) AS n FROM twice GROUP BY model) g JOIN (SELECT model, COUNT(*) AS n FROM fx_replies GROUP BY model) w ON w.model = g.model AND w.n <> g.n""",
            parsed("batch"), "twice AS (SELECT * FROM parsed UNION ALL SELECT * FROM parsed WHERE image_ord % 97 = 0)"),
        "sample_join": sql(f"SELECT s.image_filename, {grid_fields("'model1'")} FROM sampled s LEFT JOIN parsed p ON p.image_filename = s.image_filename AND p.model = 'model1'", parsed("local"), SAMPLE_CTE),
        "model_grid": sql(f"SELECT s.image_filename, m.model, {grid_fields('m.model')} FROM sampled s CROSS JOIN (SELECT DISTINCT model FROM fx_replies) m LEFT JOIN parsed p ON p.image_filename = s.image_filename AND p.model = m.model", parsed("local"), SAMPLE_CTE),
        "verify_paths": sql("SELECT m.file_name IS NOT NULL AS found, COUNT(*) AS files FROM fx_images i LEFT JOIN fx_metadata m ON m.file_name = i.file GROUP BY 1"),
        "copy_plan": sql("SELECT i.file AS source, 'out/' || replace(i.file, '/', '#') AS target, m.file_name IS NOT NULL AS exists FROM fx_images i LEFT JOIN fx_metadata m ON m.file_name = i.file"),
        "model_run_name": "SELECT p_partkey, 'gemini_batch_labels_v-m' || p_partkey || '_20250102_030405.json' AS name, 'local_vllm_labels_v-m' || p_partkey || '_20250102_030405.tmp.json' AS checkpoint FROM part",
        "species_counts": sql("SELECT species, n FROM sp_counts"),
        "rare_species": sql("SELECT species, n, threshold FROM rare"),
        "category_stats": sql("SELECT category, COUNT(*) AS images, COUNT(DISTINCT seq_id) AS sequences FROM cand GROUP BY category", candidates("sequence", True)),
        "dataset_summary": sql("""
SELECT total_images, with_animals, with_high_conf, with_classifications, multi_animal, multi_species, round(with_animals * 100.0 / total_images, 6) AS with_animals_pct,
  round(with_high_conf * 100.0 / total_images, 6) AS with_high_conf_pct, round(with_classifications * 100.0 / total_images, 6) AS with_classifications_pct,
  round(multi_animal * 100.0 / with_animals, 6) AS multi_animal_pct, round(multi_species * 100.0 / with_animals, 6) AS multi_species_pct
FROM (SELECT COUNT(*) AS total_images, COUNT(*) FILTER (n > 0) AS with_animals, COUNT(*) FILTER (sure > 0) AS with_high_conf, COUNT(*) FILTER (named > 0) AS with_classifications,
    COUNT(*) FILTER (n > 1) AS multi_animal, COUNT(*) FILTER (kinds > 1) AS multi_species
  FROM fx_images LEFT JOIN (SELECT image_ord, COUNT(*) AS n, COUNT(*) FILTER (conf >= 0.3) AS sure, COUNT(*) FILTER (sp1 IS NOT NULL OR sp2 IS NOT NULL) AS named FROM fx_detections WHERE category = '1' GROUP BY 1) d USING (image_ord)
  LEFT JOIN (SELECT image_ord, COUNT(DISTINCT species) AS kinds FROM cls WHERE category = '1' AND cconf >= 0.5 GROUP BY 1) s USING (image_ord))"""),
        "top_species": sql("SELECT species, n FROM sp_counts ORDER BY n DESC, species LIMIT 20"),
        "value_quantiles": sql(" UNION ALL ".join([quantiles("bbox_size", "w * h", "fx_detections WHERE category = '1'"), quantiles("detection_conf", "conf", "fx_detections WHERE category = '1'"), quantiles("classification_conf", "cconf", "cls WHERE category = '1'")])),
        "threshold_counts": sql("SELECT COUNT(*) AS detections, COUNT(*) FILTER (w * h > 0.1) AS large, COUNT(*) FILTER (conf > 0.8) AS confident FROM fx_detections WHERE category = '1'"),
        "funnel": sql("SELECT COUNT(*) AS images, COUNT(m.file_name) AS with_metadata, COUNT(*) FILTER (m.file_name IS NOT NULL AND f.image_ord IS NOT NULL) AS with_animals FROM fx_images i LEFT JOIN fx_metadata m ON m.file_name = i.file LEFT JOIN feat f ON f.image_ord = i.image_ord"),
        "high_conf_with_cls": sql("SELECT COUNT(*) AS images, COUNT(*) FILTER (sp1 IS NOT NULL OR sp2 IS NOT NULL) AS first_with_classifications FROM (SELECT *, row_number() OVER (PARTITION BY image_ord ORDER BY det_ord) AS k FROM animals) WHERE k = 1"),
        "selection_summary": sql("""
SELECT COUNT(*) AS total_candidates, COUNT(DISTINCT seq_id) AS unique_sequences, round(COUNT(DISTINCT seq_id) * 100.0 / COUNT(*), 6) AS sequence_diversity_percent, round(AVG(sequence_size), 6) AS avg_sequence_size,
  MIN(sequence_size) AS min_sequence_size, MAX(sequence_size) AS max_sequence_size, COUNT(*) - COUNT(DISTINCT seq_id) AS duplicates FROM sel""", *SEQ_SELECTED),
        "category_distribution": sql("SELECT category, COUNT(*) AS n, round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sel), 6) AS percent FROM sel GROUP BY category", *SEQ_SELECTED),
        "size_distribution": sql("""
SELECT round(MIN(s), 8) AS min, round(MAX(s), 8) AS max, round(AVG(s), 6) AS mean, round(MAX(s) FILTER (k = n // 10), 8) AS p10, round(MAX(s) FILTER (k = n // 4), 8) AS p25, round(MAX(s) FILTER (k = n // 2), 8) AS median,
  round(MAX(s) FILTER (k = n * 3 // 4), 8) AS p75, round(MAX(s) FILTER (k = n * 9 // 10), 8) AS p90
FROM (SELECT max_size AS s, row_number() OVER (ORDER BY max_size) - 1 AS k, COUNT(*) OVER () AS n FROM sel)""", *SEQ_SELECTED),
        "category_sizes": sql("SELECT category, round(MIN(max_size), 8) AS min_size, round(MAX(max_size), 8) AS max_size, round(AVG(max_size), 6) AS mean_size, round(AVG(sequence_size), 6) AS avg_sequence_size FROM sel GROUP BY category", *SEQ_SELECTED),
        "selector_comparison": sql("""
SELECT method, COUNT(*) AS n, round(AVG(max_size), 6) AS avg_max_size, round(AVG(max_confidence), 6) AS avg_max_confidence, round(AVG(num_animals), 6) AS avg_animals, round(AVG(num_species), 6) AS avg_species,
  COUNT(*) FILTER (num_animals > 1) AS multi_animal, COUNT(*) FILTER (num_species > 1) AS multi_species
FROM (SELECT 'heuristic' AS method, * FROM top_h UNION ALL SELECT 'random', * FROM top_r) GROUP BY method""", METHODS),
        "label_stats": sql(STATS, parsed("sync")),
        "response_audit": sql("""
SELECT a.*, COALESCE(unique_filenames, 0) AS unique_filenames, COALESCE(duplicate_filenames, 0) AS duplicate_filenames FROM (
  SELECT model, COUNT(*) AS replies, COUNT(reply) AS has_response, COUNT(*) FILTER (failure_kind IS NULL OR failure_kind <> 'empty') AS has_text,
    COUNT(*) FILTER (failure_kind IS NULL OR failure_kind NOT IN ('empty', 'bad_json')) AS parse_ok, COUNT(*) FILTER (failure_kind = 'empty') AS empty, COUNT(*) FILTER (failure_kind = 'bad_json') AS bad_json,
    COUNT(*) FILTER (failure_kind = 'missing_score') AS missing_score, COUNT(*) FILTER (failure_kind = 'bad_score') AS bad_score, COUNT(*) FILTER (failure_kind = 'out_of_range') AS out_of_range,
    COUNT(*) FILTER (failure_kind = 'missing_reasoning') AS missing_reasoning, COUNT(*) FILTER (failure_kind = 'missing_filename') AS missing_filename
  FROM parsed GROUP BY model) a LEFT JOIN (
  SELECT model, COUNT(*) AS unique_filenames, COUNT(*) FILTER (times > 1) AS duplicate_filenames FROM (SELECT model, returned_filename, COUNT(*) AS times FROM parsed WHERE returned_filename IS NOT NULL GROUP BY 1, 2) GROUP BY model) b USING (model)""", parsed("batch")),
        "dashboard": sql("""
SELECT model || '_labels_x.json' AS file_name, CASE model WHEN 'model0' THEN 'Gemini' WHEN 'model1' THEN 'vLLM' ELSE 'Unknown' END || ': ' || model AS link_text, total_images,
  CASE WHEN model = 'model2' THEN 0.0 ELSE success_rate END AS success_rate, avg_score, CASE WHEN model = 'model0' THEN '2025-01-02 03:04:05' ELSE 'Unknown' END AS timestamp FROM stats""", parsed("sync"), f"stats AS ({STATS})"),
        "best_per_sequence": sql("SELECT category, seq_id, file, quality_score, sequence_size FROM groups", *SEQ),
        "sequence_size": sql("SELECT category, sequence_size, COUNT(*) AS groups FROM groups GROUP BY 1, 2", *SEQ),
        "category_top_k": sql("SELECT category, rank, seq_id, file, quality_score FROM chosen", *SEQ_CHOSEN),
        "fill_remaining": sql("SELECT category, seq_id, file, rank, quality_score FROM fill", *SEQ, quotas("sequence", TOTAL // 2), chosen("sequence"), filled("sequence")),
        "select_sequence_aware_strict": sql("SELECT phase, category, file, seq_id, quality_score, rank FROM sel", *SEQ_STRICT),
        "select_sequence_aware": sql("SELECT phase, category, file, quality_score, round(max_size, 8) AS max_size, num_animals, num_species, rank, seq_id, frame_num, seq_num_frames, sequence_size, max_confidence FROM sel", *SEQ_SELECTED),
        "negatives_mix": sql("SELECT category, file, quality_score, rank FROM mixed", candidates("training", False), IMAGE_GROUPS, quotas("training"), chosen("training")),
        "dedupe_last": sql("SELECT image_filename, pos, model, score FROM (SELECT *, row_number() OVER (PARTITION BY image_filename ORDER BY pos DESC) AS k FROM p2) WHERE k = 1", parsed("local"), "p2 AS (SELECT *, image_ord * 3 + CAST(substr(model, 6, 1) AS INT) AS pos FROM parsed)"),
        "dedupe_first": sql("SELECT image_path, pos, model, score FROM (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY pos) AS k FROM p2) WHERE k = 1", parsed("local"), "p2 AS (SELECT *, image_ord * 3 + CAST(substr(model, 6, 1) AS INT) AS pos FROM parsed)"),
        "top_heuristic": sql("SELECT image_ord, file, score FROM top_h", METHODS),
        "random_candidates": sql("SELECT image_ord, file FROM top_r", METHODS),
        "hybrid_candidates": sql(f"""
SELECT file, source_selector FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY position) AS k FROM (
    SELECT file, 'HeuristicSelector' AS source_selector, r AS position FROM top_h WHERE r <= {int(0.7 / (0.7 + 0.3) * TOTAL)}
    UNION ALL SELECT file, 'RandomSelector', {TOTAL + 1} + r FROM top_r WHERE r <= {int(0.3 / (0.7 + 0.3) * TOTAL)}))
WHERE k = 1 ORDER BY position LIMIT {TOTAL}""", METHODS),
        "sample_filenames": sql("SELECT image_filename FROM sampled", SAMPLE_CTE),
        "display_order": sql("SELECT row_number() OVER (ORDER BY success DESC, CASE WHEN success THEN score END DESC NULLS LAST, image_filename) AS place, image_filename, score, success FROM shown",
            parsed("sync"), f"shown AS (SELECT * FROM parsed WHERE model = 'model2' ORDER BY md5('3:' || image_filename), image_filename LIMIT {SAMPLE})"),
        "limit_images": sql("SELECT file AS path FROM fx_images ORDER BY file LIMIT 1000"),
        "write_candidates": sql("SELECT file AS original_path, replace(file, '/', '#') AS flattened_filename, category, quality_score, seq_id, frame_num, seq_num_frames, round(max_size, 8) AS max_size, max_confidence, num_animals, num_species FROM sel", *SEQ_SELECTED),
    }
    supplier = "SELECT s_suppkey, s_name, 'n' || s_nationkey || '/sup' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' ELSE '.txt' END AS path FROM supplier"
    fields = "image_path, image_filename, score AS aesthetic_score, reasoning, success, failure_kind AS error"
    labelled = f"""
SELECT 'm1' AS model, file AS path, split_part(file, '/', 2) AS image_filename, CASE WHEN image_ord % 9 <> 0 AND image_ord % 10 <> 0 THEN CAST(image_ord % 11 AS DOUBLE) END AS score,
  image_ord % 9 <> 0 AND image_ord % 10 <> 0 AS success, CASE WHEN image_ord % 9 = 0 THEN 'OSError: unreadable' WHEN image_ord % 10 = 0 THEN 'bad_json' END AS error FROM fx_images"""
    scored = sql(f"SELECT path, image_filename, score, success, error FROM ({labelled})")
    chunked = f"chunked AS (SELECT *, 'x_labels_' || model || '_' || (image_ord // 1000) || '.json' AS file_name, row_number() OVER (PARTITION BY model, image_ord // 1000 ORDER BY image_ord) - 1 AS pos FROM parsed)"
    out |= {
        "read_detections": sql("""
SELECT i.place AS image_ord, i.file, CAST(d.det_ord AS BIGINT) AS nth, d.category, d.conf, round(d.w * d.h, 8) AS size, CASE WHEN d.image_ord IS NOT NULL THEN concat_ws(',', d.sp1, d.sp2) END AS species, CASE WHEN sp1 IS NOT NULL THEN c1 WHEN sp2 IS NOT NULL THEN c2 END AS first_conf
FROM (SELECT *, row_number() OVER (ORDER BY image_ord) - 1 AS place FROM fx_images) i LEFT JOIN fx_detections d USING (image_ord)"""),
        "list_images": f"SELECT path, CAST(strlen(s_name) AS BIGINT) AS length FROM ({supplier}) WHERE s_suppkey % 4 < 3",
        "copy_images": f"""
WITH i AS (SELECT path, strlen(s_name) AS length FROM ({supplier}) WHERE s_suppkey % 4 < 3)
SELECT path AS source, TRUE AS copied, replace(path, '/', '#') AS target, length FROM i UNION ALL SELECT path || '.gone', FALSE, NULL, NULL FROM i""",
        "list_from_text": sql("SELECT file AS path FROM fx_images WHERE image_ord % 7 <> 0 AND image_ord % 11 <> 0"),
        "list_from_json": sql("SELECT file AS path FROM fx_images WHERE image_ord % 7 <> 0 AND image_ord % 11 <> 0"),
        "read_label_files": sql("SELECT file_name, model AS model_used, COUNT(*) AS total_images, COUNT(*) AS results FROM chunked GROUP BY 1, 2", parsed("local"), chunked),
        "label_results": sql(f"SELECT file_name, pos, {fields} FROM chunked", parsed("local"), chunked),
        "read_batch_manifest": sql("SELECT 'job' || (image_ord // 1000) AS job_name, row_number() OVER (PARTITION BY image_ord // 1000 ORDER BY image_ord) - 1 AS pos, image_ord AS index, file AS path, replace(file, '/', '#') AS filename FROM fx_images"),
        "build_requests_batch": sql("""
SELECT image_ord, fn AS image_filename, '{"contents":[{"parts":[{"text":"Rate the image.\\n\\nImage filename: ' || fn || '"},{"inline_data":{"mime_type":"image/jpeg","data":"' || base64(encode(file)) || '"}}]}],"generation_config":{"temperature":0.1,"max_output_tokens":300}}' AS request
FROM (SELECT *, replace(file, '/', '#') AS fn FROM fx_images)"""),
        "build_requests_chat": sql("""
SELECT image_ord, fn AS image_filename, '{"model":"m1","temperature":0.1,"max_tokens":300,"messages":[{"role":"user","content":[{"type":"text","text":"Rate the image.\\n\\nImage filename: ' || fn || '"},{"type":"image_url","image_url":{"url":"data:image/jpeg;base64,' || base64(encode(file)) || '"}}]}]}' AS request
FROM (SELECT *, replace(file, '/', '#') AS fn FROM fx_images)"""),
        "select_by_name": sql(f"""
SELECT file, source_selector FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY position) AS k FROM (
    SELECT file, 'LargestAnimals' AS source_selector, r AS position FROM top_l WHERE r <= {TOTAL // 2}
    UNION ALL SELECT file, 'RandomSelector', {TOTAL + 1} + r FROM top_r WHERE r <= {TOTAL // 2}))
WHERE k = 1 ORDER BY position LIMIT {TOTAL}""", METHODS, "top_l AS (SELECT *, row_number() OVER (ORDER BY round(max_size, 8) DESC, image_ord) AS r FROM feat)"),
        "write_candidate_summaries": sql("""
SELECT category, COUNT(*) AS n, round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sel), 6) AS percent, (SELECT COUNT(*) FROM sel) AS total_candidates, (SELECT COUNT(DISTINCT seq_id) FROM sel) AS unique_sequences
FROM sel GROUP BY category""", *SEQ_SELECTED),
        "write_labels": sql("SELECT model, image_ord, image_filename, score, success FROM parsed", parsed("sync")),
        "write_label_info": sql(STATS, parsed("sync")),
        "append_checkpoint": sql("SELECT model, image_ord AS pos, score, success FROM parsed", parsed("local")),
        "score_images": scored,
        "score_images_in_windows": sql(f"""
SELECT path, image_filename, CASE WHEN NOT hangs THEN score END AS score, success AND NOT hangs AS success, CASE WHEN hangs THEN 'timeout' ELSE error END AS error
FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)[.]jpg', 1) AS BIGINT) % 700 = 0 AS hangs FROM ({labelled}))"""),
        "stream_label": scored,
        "stream_label_stats": sql(STATS, f"parsed AS ({labelled})"),
    }
    for name in ("v1", "improved", "training"):
        out[f"assign_categories_{name}"] = sql("SELECT image_ord, category FROM cand", candidates(name, False))
        out[f"quality_score_{name}"] = sql("SELECT image_ord, category, quality_score FROM cand", candidates(name, False))
    for name in ("v1", "improved", "campaign", "training"):
        out[f"select_stratified_{name}"] = sql("SELECT phase, category, file, quality_score, round(max_size, 8) AS max_size, num_animals, num_species, rank FROM sel", *image_selection(name))
    for mode in ("batch", "sync", "local"):
        out[f"parse_responses_{mode}"] = sql("SELECT model, image_ord, score, reasoning, returned_filename, success, failure_kind FROM parsed", parsed(mode))
    return out
