"""The reference's inputs from the given tables: orders are images, line items detections, customers bursts.

The views are plain SQL for Spark and DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items that a task sorts and nests by image, about; few enough to do so in memory, whatever the number of shuffle partitions.
ROWS_A_TASK = 500_000

FX_IMAGES = "SELECT o_orderkey AS image_ord, CONCAT('cam', o_custkey % 100, '/', o_orderkey, '.jpg') AS file FROM {orders}"

FX_METADATA = """
SELECT CONCAT('cam', o_custkey % 100, '/', o_orderkey, '.jpg') AS file_name, CONCAT('seq', o_custkey) AS seq_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS frame_num,
  CAST(COUNT(*) OVER (PARTITION BY o_custkey) AS INT) AS seq_num_frames, CONCAT('loc', o_custkey % 100) AS location
FROM {orders} WHERE o_orderkey % 50 <> 0
"""

FX_DETECTIONS = """
SELECT l_orderkey AS image_ord,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS det_ord,
  CASE WHEN l_suppkey % 10 = 0 THEN '2' WHEN l_suppkey % 10 = 1 THEN '3' ELSE '1' END AS category,
  CAST((l_partkey*37 + l_linenumber*11) % 101 AS DOUBLE)/100 AS conf,
  (1 - l_quantity*2/100) * CAST(l_partkey % 101 AS DOUBLE)/100 AS x,
  (1 - CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) % 100 + 1 AS DOUBLE)/100) * CAST(l_suppkey % 101 AS DOUBLE)/100 AS y,
  l_quantity*2/100 AS w, CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) % 100 + 1 AS DOUBLE)/100 AS h,
  CASE WHEN CAST(l_quantity AS BIGINT) % 11 = 3 THEN NULL ELSE CONCAT('sp', CAST(FLOOR(SQRT(l_partkey)) AS BIGINT)) END AS sp1,
  CAST((l_partkey*13 + l_suppkey*7) % 101 AS DOUBLE)/100 AS c1,
  CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 AND CAST(l_quantity AS BIGINT) % 11 <> 3 THEN CONCAT('g', l_linenumber % 5) END AS sp2,
  CAST((l_suppkey*3 + l_linenumber*17) % 101 AS DOUBLE)/100 AS c2 FROM {lineitem}
"""

FX_REPLIES = """
SELECT CONCAT('model', m) AS model, image_ord, file AS image_path, fn AS image_filename,
  CASE (image_ord + m) % 16 WHEN 0 THEN '' WHEN 1 THEN '{{"score": '
    WHEN 2 THEN CONCAT(' ```json', CHR(10), '{{"score": ', sc, ', "reasoning": "r", "image_filename": "', fn, '"}}', CHR(10), '```', CHR(10))
    WHEN 3 THEN CONCAT('{{"reasoning": "r", "image_filename": "', fn, '"}}')
    WHEN 4 THEN CONCAT('{{"score": 12, "reasoning": "r", "image_filename": "', fn, '"}}')
    WHEN 5 THEN CONCAT('{{"score": "7.5", "reasoning": "r", "image_filename": "', fn, '"}}')
    WHEN 6 THEN CONCAT('{{"score": ', sc, ', "reasoning": "r"}}')
    WHEN 7 THEN CONCAT('{{"score": ', sc, ', "reasoning": "r", "image_filename": "x', fn, '"}}')
    WHEN 8 THEN CONCAT('```', CHR(10), '{{"score": ', sc, '}}', CHR(10), '```')
    WHEN 9 THEN CONCAT('{{"score": null, "reasoning": "r", "image_filename": "', fn, '"}}')
    WHEN 10 THEN CONCAT('{{"score": ', sc, ', "image_filename": "', fn, '"}}')
    WHEN 11 THEN CONCAT('{{"score": ', sc, ', "reasoning": "r", "image_filename": ""}}')
    WHEN 12 THEN CONCAT('{{"score": null, "reasoning": "r", "image_filename": "twice', CAST(FLOOR(image_ord / 500) AS BIGINT), '"}}')
    ELSE CONCAT('{{"score": ', sc, ', "reasoning": "r", "image_filename": "', fn, '"}}') END AS reply
FROM (SELECT image_ord, file, REPLACE(file, '/', '#') AS fn, m, CAST(CAST((image_ord*7 + m*3) % 21 AS DOUBLE)/2 AS STRING) AS sc
  FROM {fx_images} CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2) ms WHERE (image_ord + m) % (m + 4) <> 0) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_IMAGES, orders=table(spark, sf_dir, "orders"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by customer before the view computes its names, as its windows would deal out the names too."""
    return spark.sql(FX_METADATA, orders=table(spark, sf_dir, "orders").repartition("o_custkey"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by image before the view computes its columns: the table's own columns travel, and they do so once.

    Over more tasks than there are shuffle partitions where these would be too large to sort in memory.
    """
    items = table(spark, sf_dir, "lineitem")
    tasks = -(-items.count() // ROWS_A_TASK)
    many = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(FX_DETECTIONS, lineitem=items.repartition(tasks, "l_orderkey") if many else items.repartition("l_orderkey"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_REPLIES, fx_images=image_list(spark, sf_dir))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image with its detections nested; an image without any has null."""
    first, second = (F.struct(F.col(s).alias("species_id"), F.col(c).alias("conf")) for s, c in (("sp1", "c1"), ("sp2", "c2")))
    both, none = F.array(first, second), F.array().cast("array<struct<species_id:string,conf:double>>")
    there = F.when(F.col("sp1").isNull(), F.when(F.col("sp2").isNull(), none).otherwise(F.array(second))).when(F.col("sp2").isNull(), F.array(first)).otherwise(both)
    one = F.struct("det_ord", "category", "conf", F.array("x", "y", "w", "h").alias("bbox"), there.alias("classifications"))
    nested = detections(spark, sf_dir).groupBy("image_ord").agg(F.sort_array(F.collect_list(one)).alias("d"))
    typed = nested.select(F.col("image_ord"), F.transform("d", lambda d: F.struct(d.category.alias("category"), d.conf.alias("conf"), d.bbox.alias("bbox"), d.classifications.alias("classifications"))).alias("detections"))
    return image_list(spark, sf_dir).join(typed, "image_ord", "left").select("file", "image_ord", "detections")


def cte(orders: str = "orders", lineitem: str = "lineitem") -> str:
    """The views as common table expressions, for SQL that runs over the given tables."""
    parts = {"fx_images": FX_IMAGES, "fx_metadata": FX_METADATA, "fx_detections": FX_DETECTIONS, "fx_replies": FX_REPLIES}
    return ", ".join(f"{name} AS ({sql.format(orders=orders, lineitem=lineitem, fx_images='fx_images').strip()})" for name, sql in parts.items())
