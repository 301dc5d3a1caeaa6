"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_extract, language_id, license_scan, lm_scoring, ngram_join, packing, periodic_runs, sentencepiece_viterbi, token_counts, topk_mtree, toxicity
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model, extra={"held_out": held_out})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id and text; of the documents whose id's crc32 is divisible by 10, the words from a place on repeat the first of them.

    A null id counts as the empty text, as everywhere here.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("words"))
    placed = chosen.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    changed = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_words(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("r.period")
    return rows.select("doc_id", "n_runs", (-F.col("r.start")).alias("start"), "r.length", period.alias("period"), F.floor(1000 * F.col("r.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def lm_scoring_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op1, which SQL can express; the sum of logarithms rounded."""
    return op1_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 about its fixed phrases."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_language_id": op2_language_id,
        "op3_toxicity": op3_toxicity,
        "op4_license_scan": op4_license_scan,
        "op5_topk_mtree": op5_topk_mtree,
        "op6_decontaminate": op6_decontaminate,
        "op7_html_text": op7_html_text,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_token_counts": op9_token_counts,
        "op10_ngram_join": op10_ngram_join,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_packing": op13_packing,
        "lm_scoring_base": lm_scoring_base,
        "license_scan_base": license_scan_base,
    }


TOP_K_SQL = """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vecs q JOIN vecs c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


HARD_NEGATIVES_SQL = """
WITH vecs AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS own,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vecs a JOIN vecs c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), pairs AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.own AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
)
SELECT * FROM pairs WHERE rank <= 5
"""


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of the id as text: a table of 256 made by its rule, then a step for each digit.
LM_BASE_SQL = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), docs AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 7 = 2 AS held_out
  FROM documents, crc_table
), tokens AS (
  SELECT doc_id, held_out, unnest(list_append(words, NULL)) AS word FROM docs
), counts AS (SELECT word, COUNT(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
totals AS (SELECT CAST(coalesce(SUM(c), 0) AS BIGINT) AS n, COUNT(*) AS v FROM counts)
SELECT t.doc_id, t.held_out, COUNT(*) AS n_tokens, COUNT(c.c) AS n_known, n AS train_tokens, round(SUM(log10((coalesce(c.c, 0) + 1.0::DOUBLE) / (n + v + 1))), 4) AS base_score
FROM tokens t LEFT JOIN counts c ON c.word IS NOT DISTINCT FROM t.word CROSS JOIN totals GROUP BY t.doc_id, t.held_out, n, v
"""

LICENSE_BASE_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {", ".join(f"('{p}', '{label}')" for p, label in license_scan.BASE_PHRASES.items())}) t(phrase, label)),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(words) - len(p) + 2), lambda i: words[i] = p[1] AND words[i : i + len(p) - 1] = p)) - 1 AS place
  FROM docs, phrases WHERE list_has_all(words, p)
), found AS (SELECT doc_id, COUNT(*) AS n, MIN(place) AS low, MAX(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(labels, '') AS base_labels FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk_mtree": TOP_K_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "lm_scoring_base": LM_BASE_SQL, "license_scan_base": LICENSE_BASE_SQL}
