"""Pixel intensities: normalisation, gamma to a target mean, compensation of vessel shadows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dimensions import num

IMAGE = ["image_id", "bscan"]


def spread(df: DataFrame, aggregates: dict) -> DataFrame:
    """df with aggregates of its image; pre-aggregated before the shuffle, unlike a window over all pixels."""
    return df.join(df.groupBy(*IMAGE).agg(*[c.alias(n) for n, c in aggregates.items()]), IMAGE)


def normalise(pixels: DataFrame, low: float = 0, high: float = 1) -> DataFrame:
    """INT-1. Values of each image stretched to [low, high]; a flat image becomes low."""
    got = spread(pixels, {"lo": F.min("v"), "hi": F.max("v")})
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return got.withColumn("v", num(low) + num(high - low) * share).drop("lo", "hi")


def gamma_to_mean(pixels: DataFrame, target: float = 0.2) -> DataFrame:
    """INT-2. A power that would take the mean to the target, then INT-1."""
    got = spread(pixels, {"mean": F.avg("v")})
    return normalise(got.withColumn("v", F.pow("v", F.ln(num(target)) / F.ln("mean"))).drop("mean"))


def shadow_compensate(pixels: DataFrame, window: int = 75, gamma: float = 1.0) -> DataFrame:
    """INT-3. Columns scaled to the rolling mean energy about them; black columns take no part and stay black."""
    half = window // 2
    order = W.partitionBy(*IMAGE).orderBy("x")
    energy = pixels.groupBy(*IMAGE, "x").agg(F.sum(F.pow("v", num(gamma))).alias("energy")).filter("energy > 0")
    rolled = energy.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(W.partitionBy(*IMAGE)), "mean": F.avg("energy").over(order.rowsBetween(-half, half))})
    inside = (F.col("i") > half) & (F.col("i") <= F.col("n") - half)
    ratio = F.when(inside, F.col("mean") / F.col("energy")).otherwise(1.0)
    return pixels.join(rolled.select(*IMAGE, "x", ratio.alias("ratio")), [*IMAGE, "x"], "left").withColumn("v", F.col("v") * F.pow(F.coalesce("ratio", F.lit(1.0)), num(1 / gamma))).drop("ratio")


def scale_255(pixels: DataFrame) -> DataFrame:
    """INT-4. Raw 8-bit values to [0, 1]."""
    return pixels.withColumn("v", F.col("v") / 255)
