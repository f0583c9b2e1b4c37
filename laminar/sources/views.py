"""Deterministic views of the driver's tables as scan tables; each has the same view in DuckDB SQL.

`trace`, `map_cell`, `path`, `mask_pixel`, `pixel`, `label_pixel`, `scan`, `measurement`,
`bscan_meta` and `profile` have the columns that the operators expect.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Table rows to a part of those that are dealt by image. A map has seven times as many cells as rows.
PART_ROWS = 100_000


def dealt(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows by image_id in as many parts as the table `of` asks for, so that a task's share doesn't grow with it. All that is counted
    by image behind this needs no further shuffle; the table's count reads its files' footers only."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, ceil(of.count() / PART_ROWS)), "image_id")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of map_cell, dealt as it is."""
    li = table(spark, sf_dir, "lineitem")
    return dealt(li.select(F.col("l_suppkey").alias("image_id")).distinct(), li)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    rank = F.col("vec_id") % 4
    layer = F.element_at(F.array(*[F.lit(x) for x in ("ILM", "RNFL", "ELM", "BM")]), (rank + 1).cast("int"))
    y = F.floor(100 * (rank + 1) + 80 * F.col("e").cast("double")).cast("double")
    missing = (F.col("vec_id") + F.col("x")) % 37 == 0
    return e.select(F.expr("vec_id div 20").alias("image_id"), (F.expr("vec_id div 4") % 5).cast("int").alias("bscan"), layer.alias("layer"), "x", F.when(~missing, y).alias("y"))


def trace_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("image_id")).distinct()


TRACE = """trace AS (SELECT vec_id // 20 AS image_id, CAST((vec_id // 4) % 5 AS INT) AS bscan,
  ['ILM','RNFL','ELM','BM'][CAST(vec_id % 4 AS INT) + 1] AS layer, x,
  CASE WHEN (vec_id + x) % 37 <> 0 THEN floor(100*(vec_id % 4 + 1) + 80*CAST(e AS DOUBLE)) END AS y
  FROM (SELECT vec_id, unnest(embedding) AS e, CAST(unnest(range(len(embedding))) AS INT) AS x FROM embeddings))"""


def map_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    at = li.select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_orderkey") % 64).cast("int").alias("y"), "l_quantity")
    return dealt(at, li).groupBy("image_id", "x", "y").agg(F.floor(F.avg("l_quantity")).cast("double").alias("value"))


MAP_CELL = """map_cell AS (SELECT l_suppkey AS image_id, CAST(l_partkey % 64 AS INT) AS x, CAST(l_orderkey % 64 AS INT) AS y,
  floor(avg(l_quantity)) AS value FROM lineitem GROUP BY 1, 2, 3)"""


def mask_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_cell(spark, sf_dir).filter("value >= 25").select("image_id", F.lit("vessel").alias("mask"), "x", "y", (F.col("value") / 50).alias("p"))


MASK = MAP_CELL + """, mask_pixel AS (SELECT image_id, 'vessel' AS mask, x, y, value / 50 AS p FROM map_cell WHERE value >= 25)"""


def label_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.max("l_returnflag")
    gray = F.when(flag == "A", 191).when(flag == "N", 127).otherwise(255)
    return li.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_orderkey") % 64).cast("int").alias("y")).agg(gray.alias("gray"))


LABEL = """label_pixel AS (SELECT l_suppkey AS image_id, CAST(l_partkey % 64 AS INT) AS x, CAST(l_orderkey % 64 AS INT) AS y,
  CASE max(l_returnflag) WHEN 'A' THEN 191 WHEN 'N' THEN 127 ELSE 255 END AS gray FROM lineitem GROUP BY 1, 2, 3)"""


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(order) - 1
    e = table(spark, sf_dir, "events").withColumn("seq", seq)
    kind = F.when(F.col("user_id") % 2 == 0, "artery").otherwise("vein")
    return e.select(F.expr("user_id div 10").alias("image_id"), kind.alias("vessel_map"), F.col("user_id").alias("path_id"), "seq", F.col("seq").alias("row"), F.floor(F.col("value") / 10).cast("int").alias("col"))


PATH = """path AS (SELECT user_id // 10 AS image_id, CASE WHEN user_id % 2 = 0 THEN 'artery' ELSE 'vein' END AS vessel_map,
  user_id AS path_id, CAST(s AS INT) AS seq, CAST(s AS INT) AS row, CAST(floor(value / 10) AS INT) AS col
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM events))"""


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.expr("vec_id div 20").alias("image_id"), F.lit(0).alias("bscan"), "x", (F.col("vec_id") % 20).cast("int").alias("y"), ((F.col("e").cast("double") + 1) / 2).alias("v"))


PIXEL = """pixel AS (SELECT vec_id // 20 AS image_id, 0 AS bscan, x, CAST(vec_id % 20 AS INT) AS y, (CAST(e AS DOUBLE) + 1) / 2 AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, CAST(unnest(range(len(embedding))) AS INT) AS x FROM embeddings))"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.substring("o_orderpriority", 1, 1)
    pattern = F.when(first == "1", "H-line").when(first == "2", "V-line").when(first == "3", "Radial").when(first == "4", "Ppole").otherwise("Peripapillary")
    return table(spark, sf_dir, "orders").select(
        k.alias("image_id"),
        F.concat(F.lit("scan_"), k.cast("string"), F.when(k % 13 == 0, "_ANGIO").otherwise("")).alias("filename"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 2 == 0, "OD").otherwise("OS").alias("eye"),
        pattern.alias("pattern"),
        F.lit(768).alias("slo_res"),
        F.lit(11.49).cast("double").alias("scale_x"),
        F.lit(3.87).cast("double").alias("scale_y"),
        F.when(pattern.isin("Radial", "Ppole"), 120.0).otherwise(0.0).alias("scale_z"),
        (F.col("o_totalprice") / 10000).alias("quality"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        (k % 700).cast("int").alias("fovea_x"),
        (k % 650).cast("int").alias("fovea_y"),
        (k * 7 % 768).cast("int").alias("disc_x"),
        (k * 3 % 768).cast("int").alias("disc_y"),
        (40 + k % 20).cast("int").alias("disc_radius"),
        (F.col("o_orderstatus") == "P").alias("failed"),
    )


SCAN = """scan AS (SELECT o_orderkey AS image_id, 'scan_' || o_orderkey || CASE WHEN o_orderkey % 13 = 0 THEN '_ANGIO' ELSE '' END AS filename,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'OD' ELSE 'OS' END AS eye,
  CASE o_orderpriority[1] WHEN '1' THEN 'H-line' WHEN '2' THEN 'V-line' WHEN '3' THEN 'Radial' WHEN '4' THEN 'Ppole' ELSE 'Peripapillary' END AS pattern,
  768 AS slo_res, CAST(11.49 AS DOUBLE) AS scale_x, CAST(3.87 AS DOUBLE) AS scale_y,
  CASE WHEN o_orderpriority[1] IN ('3','4') THEN CAST(120 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS scale_z,
  o_totalprice / 10000 AS quality, CAST(o_orderdate AS DATE) AS visit_date,
  CAST(o_orderkey % 700 AS INT) AS fovea_x, CAST(o_orderkey % 650 AS INT) AS fovea_y,
  CAST(o_orderkey * 7 % 768 AS INT) AS disc_x, CAST(o_orderkey * 3 % 768 AS INT) AS disc_y, CAST(40 + o_orderkey % 20 AS INT) AS disc_radius,
  o_orderstatus = 'P' AS failed FROM orders)"""


def bscan_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition lines: mm positions and quality by file and B-scan."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("bscan")).agg(
        F.max("l_quantity").alias("quality"),
        F.when(F.max("l_partkey") % 3 == 0, 0.0005).otherwise(F.max("l_discount") * 10).alias("start_x_mm"),
        (F.max("l_tax") * 10).alias("start_y_mm"),
        (F.max("l_quantity") / 10).alias("end_x_mm"),
        F.when(F.max("l_partkey") % 4 == 0, -0.0005).otherwise(F.max("l_tax") * 20).alias("end_y_mm"),
    )


BSCAN = """bscan_meta AS (SELECT l_orderkey AS image_id, l_linenumber AS bscan, max(l_quantity) AS quality,
  CASE WHEN max(l_partkey) % 3 = 0 THEN CAST(0.0005 AS DOUBLE) ELSE max(l_discount) * 10 END AS start_x_mm, max(l_tax) * 10 AS start_y_mm,
  max(l_quantity) / 10 AS end_x_mm, CASE WHEN max(l_partkey) % 4 = 0 THEN CAST(-0.0005 AS DOUBLE) ELSE max(l_tax) * 20 END AS end_y_mm
  FROM lineitem GROUP BY 1, 2)"""


def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements: image, layer and feature; -1 where measuring failed."""
    li = table(spark, sf_dir, "lineitem")
    layer = F.element_at(F.array(*[F.lit(x) for x in ("ILM_RNFL", "RNFL_ELM", "ELM_BM", "ILM_BM", "ILM_ELM", "GCL_IPL", "CHORupper_CHORlower")]), F.col("l_linenumber"))
    rows = dealt(li.select(F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_partkey"), li)
    wide = rows.groupBy("image_id", layer.alias("layer")).agg(F.max("l_quantity").alias("thickness"), F.max("l_extendedprice").alias("area"), F.max("l_discount").alias("vascular_index"), F.max("l_partkey").alias("part"))
    features = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in ("thickness", "area", "vascular_index")])
    long = wide.select("image_id", "layer", "part", F.explode(features).alias("m")).select("image_id", "layer", "part", "m.*")  # rows stay dealt by image
    return long.select("image_id", "layer", "feature", F.when(F.col("part") % 11 == 0, -1.0).otherwise(F.col("value")).alias("value"))


MEASUREMENT = """measurement AS (SELECT image_id, layer, feature, CASE WHEN part % 11 = 0 THEN CAST(-1 AS DOUBLE) ELSE value END AS value FROM (
  SELECT l_orderkey AS image_id, ['ILM_RNFL','RNFL_ELM','ELM_BM','ILM_BM','ILM_ELM','GCL_IPL','CHORupper_CHORlower'][l_linenumber] AS layer,
    max(l_partkey) AS part, unnest(['thickness','area','vascular_index']) AS feature,
    unnest([max(l_quantity), max(l_extendedprice), max(l_discount)]) AS value FROM lineitem GROUP BY 1, 2))"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular thickness profiles of 64 samples; some missing."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    value = F.floor(100 + 80 * F.col("e").cast("double")).cast("double")
    return e.select(F.col("vec_id").alias("image_id"), "x", F.when((F.col("vec_id") * 3 + F.col("x")) % 11 >= 2, value).alias("value"))


PROFILE = """profile AS (SELECT vec_id AS image_id, x, CASE WHEN (vec_id * 3 + x) % 11 >= 2 THEN floor(100 + 80*CAST(e AS DOUBLE)) END AS value
  FROM (SELECT vec_id, unnest(embedding) AS e, CAST(unnest(range(len(embedding))) AS INT) AS x FROM embeddings))"""
