"""Circular scans about the optic disc: profiles (image_id, x, value) over N samples, sectors, zones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dimensions import SECTORS, truncated
from .maps import by_eye
from .mask import components, region_props


def disc_offset(mask: DataFrame, scan: DataFrame) -> DataFrame:
    """PPL-1. Distance between the circle's and the disc's centre over the disc's integer mean diameter."""
    disc = region_props(components(mask)).filter("label = 1")
    j = scan.select("image_id", "circle_x", "circle_y").join(disc, "image_id")
    return j.select("image_id", F.bround(F.hypot(F.col("cx") - F.col("circle_x"), F.col("cy") - F.col("circle_y")) / F.expr("cast((major + minor) / 2 as int)"), 4).alias("offset_ratio"))


def temporal_index(scan: DataFrame, n: int) -> DataFrame:
    """PPL-2. The circle's sample nearest to where the line from the disc to the fovea leaves the circle; ties to the first."""
    to_fovea = F.atan2(F.col("fovea_y") - F.col("disc_y"), F.col("fovea_x") - F.col("disc_x"))
    px, py = F.col("disc_x") + F.col("circle_radius") * F.cos(to_fovea), F.col("disc_y") + F.col("circle_radius") * F.sin(to_fovea)
    at = scan.select("image_id", px.alias("px"), py.alias("py"), "disc_x", "disc_y", "circle_radius", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    turn = 2 * F.pi() * F.col("i") / n
    d2 = F.pow(F.col("disc_x") + F.col("circle_radius") * F.cos(turn) - F.col("px"), 2) + F.pow(F.col("disc_y") + F.col("circle_radius") * F.sin(turn) - F.col("py"), 2)
    return at.groupBy("image_id").agg(F.min_by("i", F.struct(F.round(d2, 6), "i")).alias("temporal_index"))


def temporal_default(scan: DataFrame, n: int) -> DataFrame:
    """PPL-3. Without a localiser: the middle sample in right eyes, the first in left ones."""
    return scan.select("image_id", F.when(F.col("eye") == "Right", n // 2).otherwise(0).alias("temporal_index"))


def circular_fill(profile: DataFrame, n: int) -> DataFrame:
    """PPL-4. Missing samples linearly between the known ones before and after, around the circle. A profile without any value stays empty."""
    ring = profile.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("at", F.col("x") + F.col("turn") * n)
    known = F.when(F.col("value").isNotNull(), F.struct("at", "value"))
    order = W.partitionBy("image_id").orderBy("at")
    filled = ring.withColumns({"a": F.last(known, True).over(order.rowsBetween(W.unboundedPreceding, 0)), "b": F.first(known, True).over(order.rowsBetween(0, W.unboundedFollowing))}).filter("turn = 0")
    between = F.col("a.value") + (F.col("at") - F.col("a.at")) * (F.col("b.value") - F.col("a.value")) / (F.col("b.at") - F.col("a.at"))
    return filled.select("image_id", "x", F.when(F.col("value").isNotNull(), F.col("value")).otherwise(between).alias("value"))


def circular_shift(profile: DataFrame, temporal: DataFrame, n: int, eye: DataFrame) -> DataFrame:
    """PPL-5. Samples turned so that the temporal one is in the middle; left eyes run the other way."""
    j = profile.join(temporal, "image_id").join(eye.select("image_id", "eye"), "image_id")
    right = F.pmod(F.col("x") - F.col("temporal_index") + n // 2, F.lit(n))
    left = F.pmod(F.col("temporal_index") - F.col("x") + n // 2, F.lit(n))
    return j.select("image_id", F.when(F.col("eye") == "Right", right).otherwise(left).cast("int").alias("x"), "value")


def circular_mean(profile: DataFrame, n: int, window: int = 32) -> DataFrame:
    """PPL-6. Moving mean over window // 2 samples before to one less after, around the circle."""
    half = window // 2
    ring = profile.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("at", F.col("x") + F.col("turn") * n).filter(F.col("at").between(-half, n + half - 1))
    near = W.partitionBy("image_id").orderBy("at").rowsBetween(-half, window - half - 1)
    return ring.withColumn("m", F.avg("value").over(near)).filter("turn = 0").select("image_id", "x", F.col("m").alias("value"))


def sector(profile: DataFrame, n: int) -> DataFrame:
    """PPL-7. Sector of each sample; bounds are int(n * degrees / 360)."""
    name = F.lit(None).cast("string")
    for s, lo, hi in reversed(SECTORS):
        name = F.when(F.col("x").between(int(n * lo / 360), int(n * hi / 360) - 1), s).otherwise(name)
    return profile.withColumn("sector", name)


def sector_means(profile: DataFrame, n: int) -> DataFrame:
    """PPL-8. A mean that rounding errors leave just short of a whole number counts as that number. Means of each sector, of all samples, of the bundle (samples 30 to 59 of the temporal sector) cut to integers; nasal by temporal ratio."""
    placed = sector(profile, n)
    order = W.partitionBy("image_id").orderBy("x")
    bundle = placed.filter("sector = 'temporal'").withColumn("i", F.row_number().over(order) - 1).filter("i between 30 and 59").withColumn("sector", F.lit("PMB"))
    every = placed.unionByName(placed.withColumn("sector", F.lit("All"))).unionByName(bundle.drop("i"))
    means = every.groupBy("image_id", "sector").agg(truncated(F.round(F.avg("value"), 9)).cast("double").alias("value"))
    of = lambda s: F.max(F.when(F.col("sector") == s, F.col("value")))
    ratio = means.groupBy("image_id").agg(F.lit("N/T").alias("sector"), F.try_divide(of("nasal"), of("temporal")).alias("value"))
    return means.unionByName(ratio)


def peripapillary_zone(cells: DataFrame, scan: DataFrame) -> DataFrame:
    """PPL-9. Zone of a localiser cell about the disc: six sectors and the centre (a third of the radius); null beyond the circle."""
    j = cells.join(scan.select("image_id", "eye", "disc_x", "disc_y", "circle_radius").hint("shuffle_hash"), "image_id")  # cells aren't sorted
    dx, dy = F.col("x") - F.col("disc_x"), F.col("y") - F.col("disc_y")
    d, up = F.hypot(dx, dy), F.degrees(F.atan2(-dy, dx))
    side = by_eye(F.when(dx > 0, "right").otherwise("left"))
    steep = F.abs(F.degrees(F.atan2(F.abs(dy), F.abs(dx))))
    name = F.when(steep <= 45, side).otherwise(F.concat(F.when(up > 0, "supero_").otherwise("infero_"), side))
    return j.withColumn("zone", F.when(d <= F.floor(F.col("circle_radius") / 3), "centre").when(d <= F.col("circle_radius"), name)).drop("eye", "disc_x", "disc_y", "circle_radius")


def profile_means(value: np.ndarray, temporal: int, right: bool, window: int) -> dict[str, float]:
    """Sector means of one profile (NaN: missing): gaps filled, turned, smoothed; as PPL-4 to PPL-8 do it with rows. NaN: no value."""
    n, half, known = len(value), window // 2, ~np.isnan(value)
    at = np.arange(n)
    if known.any():
        value = np.interp(at, at[known], value[known], period=n)
    turned = np.empty(n)
    turned[((at - temporal if right else temporal - at) + n // 2) % n] = value
    ring = np.concatenate([[0], np.cumsum(np.concatenate([turned[n - half :], turned, turned[: window - half - 1]]))]) if half else np.concatenate([[0], np.cumsum(turned)])
    smooth = (ring[window:] - ring[:-window])[:n] / window if half else turned
    parts = {s: smooth[int(n * lo / 360) : int(n * hi / 360)] for s, lo, hi in SECTORS if s not in ("temporal", "nasal")}
    for wanted in ("temporal", "nasal"):
        parts[wanted] = np.concatenate([smooth[int(n * lo / 360) : int(n * hi / 360)] for s, lo, hi in SECTORS if s == wanted])
    parts |= {"PMB": parts["temporal"][30:60], "All": smooth}
    means = {s: float(np.trunc(np.round(x.mean(), 9))) for s, x in parts.items() if len(x)}
    return means | {"N/T": means["nasal"] / means["temporal"] if means["temporal"] else np.nan}


def peripapillary_measure(profiles: DataFrame, temporal: DataFrame, eye: DataFrame, n: int, window: int = 32) -> DataFrame:
    """PPL-10. Sector means (image_id, layer, sector, value) of all layers' profiles; each layer is a profile of its own.

    The one shuffle of samples gathers a profile into a row of n values; samples that have no row count as missing.
    """
    sample = [F.collect_list("x").alias("x"), F.collect_list(F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))).alias("value")]
    rows = profiles.groupBy("image_id", "layer").agg(*sample).join(temporal.select("image_id", "temporal_index"), "image_id").join(eye.select("image_id", "eye"), "image_id")
    schema = T.StructType([profiles.schema["image_id"], profiles.schema["layer"], T.StructField("sector", T.StringType()), T.StructField("value", T.DoubleType())])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for image, layer, x, value, index, side in zip(*(pdf[c] for c in ("image_id", "layer", "x", "value", "temporal_index", "eye")), strict=True):
                whole = np.full(n, np.nan)
                whole[x] = value
                made += [(image, layer, s, v) for s, v in profile_means(whole, int(index), side == "Right", window).items()]
            out = pd.DataFrame(made, columns=schema.names)
            yield out.assign(value=out["value"].astype(float))

    return rows.mapInPandas(measure, schema).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
