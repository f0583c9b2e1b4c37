"""Resumable ingestion: new files are measured once, reruns skip what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_ingest(spark: SparkSession, folder: str, schema: StructType, measure: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_trigger: int = 1000) -> None:
    """OPS-5. Measure the files that have arrived since the last run.

    The checkpoint remembers files; results are written by batch number, so a batch that is
    run again after a failure overwrites what it had written.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        measure(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_remeasure(spark: SparkSession, folder: str, schema: StructType, notes: str, notes_schema: StructType, measure: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str, files_per_trigger: int = 1000) -> None:
    """OPS-5 with annotations. Measure files that have arrived, and once more the images that new annotations (image_id, ...) name.

    Files and annotations are two streams with a checkpoint each. `measure(images, notes)` gets the batch's images and all annotations
    of theirs so far, so an annotation may also come before its image. Results are written by stream and batch number; `latest` reads them.
    """

    def run(source: str, kind: StructType, name: str, images_of: Callable[[DataFrame], DataFrame]) -> None:
        def write(batch: DataFrame, number: int) -> None:
            images = images_of(batch)
            of_theirs = spark.read.schema(notes_schema).parquet(notes).join(images.select("image_id").distinct(), "image_id", "left_semi")
            measure(images, of_theirs).write.mode("overwrite").parquet(f"{out}/stream={name}/batch={number}")

        arrivals = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        arrivals.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()

    run(folder, schema, "files", lambda batch: batch)
    known = spark.read.schema(schema).parquet(folder)
    run(notes, notes_schema, "notes", lambda batch: known.join(batch.select("image_id").distinct(), "image_id", "left_semi"))


def latest(spark: SparkSession, out: str) -> DataFrame:
    """What `stream_remeasure` has written: of each image the rows that its newest annotation led to, else those of its file."""
    rows = spark.read.parquet(out).withColumn("at", F.struct((F.col("stream") == "notes").alias("noted"), F.col("batch").cast("long").alias("batch")))
    last = rows.groupBy("image_id").agg(F.max("at").alias("at"))
    return rows.join(last, ["image_id", "at"], "left_semi").drop("stream", "batch", "at")
