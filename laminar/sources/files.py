"""File catalogue, incremental selection, and the stored result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import discard, materialise

RESULT = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("pattern", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("layer", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])


def catalogue(spark: SparkSession, folder: str, glob: str = "*.vol") -> DataFrame:
    """SRC-1. Files below a folder: path, stem as image_id, size and time. Contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("image_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def drop_angiography(files: DataFrame, column: str = "filename") -> DataFrame:
    """SRC-2. Names with _ANGIO go before anything else sees them."""
    return files.filter(~F.col(column).contains("_ANGIO"))


def pending(files: DataFrame, done: DataFrame, fresh: DataFrame) -> DataFrame:
    """SRC-3. Files that have no result yet, or an annotation that hasn't been used."""
    waiting = files.join(done.select("image_id"), "image_id", "left_anti")
    again = files.join(done.select("image_id"), "image_id", "left_semi").join(fresh.select("image_id"), "image_id", "left_semi")
    return waiting.unionByName(again)


def fresh_annotations(files: DataFrame, used: DataFrame) -> DataFrame:
    """SRC-4. Annotations that aren't among the used ones; using one means adding it to that table."""
    return files.join(used.select("image_id", "path"), ["image_id", "path"], "left_anti")


def commit(df: DataFrame, root: str, run: str, parts: list[str]) -> None:
    """Write df as the rows of one run, then note the run as finished. A run that is written again replaces itself, and one that breaks off
    before the note is never read."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/data/run={run}")
    note = spark.range(1).select(F.lit(run).alias("name"), F.current_timestamp().alias("finished"))
    note.write.mode("overwrite").parquet(f"{root}/manifest/note={run}")


def committed(spark: SparkSession, root: str, key: str = "image_id") -> DataFrame:
    """Rows of finished runs; of a key that several runs have measured, those of the run finished last."""
    at = F.row_number().over(W.orderBy("finished", "name"))  # one row a run; rows are sent with this number only
    notes = spark.read.parquet(f"{root}/manifest").select(F.col("name").alias("run"), at.alias("at"))
    rows = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data").withColumn("run", F.col("run").cast("string")).join(F.broadcast(notes), "run")
    last = rows.groupBy(key).agg(F.max("at").alias("__last"))
    return rows.join(last, key).filter("at >= __last").drop("run", "at", "__last")  # by = it would be a key of the join, and the keys dealt twice


def load_results(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """SRC-5. Stored results of the patterns; only their partitions are read. No store yet: an empty table."""
    try:
        stored = committed(spark, root)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], RESULT)
    return stored.filter(F.col("pattern").isin(*patterns))


def write_results(results: DataFrame, root: str, run: str = "first") -> None:
    """SRC-7. One partition per pattern and kind that has rows, with a file at most from each task of `results`: rows are sorted where they
    are, an image's together, and not shuffled. Writing a run again changes nothing."""
    commit(results.sortWithinPartitions("pattern", "kind", "image_id"), root, run, ["pattern", "kind"])


def in_buckets(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"))


def write_per_image(df: DataFrame, root: str, buckets: int = 256, run: str = "first") -> None:
    """SRC-8. Results addressed by image: partitioned by a bucket of the id, never one file per image; writing a run again changes nothing."""
    commit(in_buckets(df, buckets).repartition("bucket").sortWithinPartitions("bucket", "image_id"), root, run, ["bucket"])


def replace_zone(df: DataFrame, root: str, buckets: int = 64) -> None:
    """SRC-9. Replace the zones that df has of its images; other zones and other images stay.

    Only the (bucket, zone) partitions that df touches are read and written: their other rows and df's are put aside as a table,
    which then takes the partitions' place.
    """
    spark, new = df.sparkSession, in_buckets(df, buckets)
    try:
        old = spark.read.parquet(root)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = spark.createDataFrame([], new.schema)
    touched = old.join(new.select("bucket", "zone").distinct(), ["bucket", "zone"], "left_semi")
    kept = touched.join(new.select("image_id", "zone").distinct(), ["image_id", "zone"], "left_anti")
    aside = materialise(kept.unionByName(new, allowMissingColumns=True), "zones-aside")
    aside.repartition("bucket", "zone").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "zone").parquet(root)
    discard(aside)


def collect_logs(log: DataFrame) -> DataFrame:
    """SRC-10. All log lines (image_id, seq, level, msg) in order, as text."""
    return log.orderBy("image_id", "seq").select(F.concat_ws(" ", F.col("image_id").cast("string"), F.concat(F.lit("["), "level", F.lit("]")), "msg").alias("value"))


def write_logs(log: DataFrame, path: str) -> None:
    collect_logs(log).write.mode("overwrite").text(path)
