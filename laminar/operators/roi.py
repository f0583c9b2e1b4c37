"""Measurement of a region about the fovea on line scans: arc-spaced samples, thickness, enclosed area, vascular index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import SCALE_X, SCALE_Y, num, truncated
from ..sources.shared import materialise
from . import trace as tr

SLAB = ["image_id", "bscan", "pair"]


def lattice(distance: int, sx: float = SCALE_X) -> tuple[int, list[int]]:
    """ROI-1. Odd number of samples, at least 3, and their arc distances to one side."""
    n = max(3, int(2 * distance / sx))
    n += 1 - n % 2
    step = 2 * distance // (n - 1)
    return n, [k * step for k in range((n - 1) // 2 + 1)]


def upper(slab: DataFrame) -> DataFrame:
    return slab.select("image_id", "bscan", F.col("pair").alias("layer"), "x", F.col("y_top").alias("y"))


def samples(slab: DataFrame, fovea: DataFrame, distance: int, sx: float = SCALE_X, sy: float = SCALE_Y, force: bool = False) -> DataFrame:
    """ROI-2. Upper and lower points at arc distances either side of the upper point nearest the fovea (image_id, bscan, px, py).

    Samples count from 0 at the left; a sample that the boundary is too short for has null x,
    or with `force` the boundary's end.
    """
    n, distances = lattice(distance, sx)
    top = upper(slab)
    ref = tr.nearest_point(top, fovea).select(*tr.LINE, "ref")
    at = tr.curve_location(top, ref, distances, sx, sy)
    if force:
        last = top.groupBy(*tr.LINE).agg((F.count("*") - 1).cast("int").alias("last"))
        at = at.join(last, tr.LINE).withColumns({"idx_left": F.coalesce("idx_left", F.lit(0)), "idx_right": F.coalesce("idx_right", "last")})
    step = distances[1]
    k = truncated(F.round(F.col("distance") / step))
    middle = (n - 1) // 2
    both = at.select(*tr.LINE, F.explode(F.array(F.struct((middle - k).alias("sample"), F.col("idx_left").alias("i")), F.struct((middle + k).alias("sample"), F.col("idx_right").alias("i")))).alias("s")).select(*tr.LINE, "s.sample", "s.i").distinct()
    points = tr.steps(top, sx, sy).select(*tr.LINE, "i", "x")
    located = both.join(points, [*tr.LINE, "i"], "left").withColumnRenamed("layer", "pair")
    return located.join(slab, [*SLAB, "x"], "left").select(*SLAB, "sample", "x", "y_top", "y_bot")


def roi_thickness(sampled: DataFrame, n: int, sy: float = SCALE_Y) -> DataFrame:
    """ROI-3 and ROI-8. Mean and subfoveal mean thickness, cut to integers; -1 with a reason where a sample is missing.

    The subfoveal mean takes the five samples from n // 2 - 3. A mean that rounding errors leave just
    short of a whole number counts as that number.
    """
    t = F.abs(F.col("y_bot") - F.col("y_top")) * num(sy)
    near = F.col("sample").between(n // 2 - 3, n // 2 + 1)
    out = sampled.groupBy(*SLAB).agg(F.avg(t).alias("mean"), F.avg(F.when(near, t)).alias("sub"), F.count("x").alias("found"))
    return sentinel(out, F.col("found") < n, {"thickness": truncated(F.round("mean", 9)).cast("double"), "subfoveal_thickness": truncated(F.round("sub", 9)).cast("double")}).drop("mean", "sub", "found")


def sentinel(df: DataFrame, failed, values: dict) -> DataFrame:
    """ROI-8. Values are -1 where measuring failed, and `reason` says why."""
    return df.withColumns({k: F.when(failed, -1.0).otherwise(v) for k, v in values.items()} | {"reason": F.when(failed, "boundary too short for the region of interest")})


def roi_thickness_n(slab: DataFrame, sampled: DataFrame, averages: int = 4, sy: float = SCALE_Y) -> DataFrame:
    """ROI-4. Each sample's thickness as the rounded mean over neighbouring columns."""
    half = averages // 2
    about = sampled.filter("x is not null").select(*SLAB, "sample", F.explode(F.expr(f"sequence(x - {half}, x + {half})")).alias("x"))
    t = F.abs(F.col("y_bot") - F.col("y_top")) * num(sy)
    return about.join(slab, [*SLAB, "x"]).groupBy(*SLAB, "sample").agg(F.rint(F.avg(t)).alias("thickness"))


def enclosed_pixels(slab: DataFrame, quad: DataFrame) -> DataFrame:
    """Pixels between the boundaries, from the left to before the right side of quad.

    quad (image_id, bscan, pair, left_x1, left_y1, left_x2, left_y2, right_...): sides join an upper with
    a lower point; a side's x at a row is cut to an integer. Each column's interval is
    exploded, so the work is the area itself.
    """
    joined = slab.join(quad, SLAB)
    span = joined.filter((F.col("x") >= F.least("left_x1", "left_x2")) & (F.col("x") <= F.greatest("right_x1", "right_x2")) & (F.col("y_bot") >= F.col("y_top")))
    px = span.withColumn("y", F.explode(F.sequence("y_top", "y_bot")))

    def side(s: str):
        x1, y1, x2, y2 = (F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2"))
        return F.when(x1 == x2, x1).otherwise(truncated(x1 + (F.col("y") - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0))))

    return px.filter((F.col("x") >= side("left")) & (F.col("x") < side("right"))).select(*SLAB, "x", "y")


def sides(sampled: DataFrame, n: int) -> DataFrame:
    """The first and last sample's points as quad."""
    at = lambda k, c: F.max(F.when(F.col("sample") == k, F.col(c)))
    cols = [at(k, c).alias(f"{s}_{name}") for s, k in (("left", 0), ("right", n - 1)) for name, c in (("x1", "x"), ("y1", "y_top"), ("x2", "x"), ("y2", "y_bot"))]
    return sampled.groupBy(*SLAB).agg(*cols).dropna()


def enclosed_area(pixels: DataFrame, sx: float = SCALE_X, sy: float = SCALE_Y) -> DataFrame:
    """ROI-5. Square millimetres of the enclosed pixels."""
    return pixels.groupBy(*SLAB).agg(F.count("*").alias("pixels")).withColumn("area", F.bround(F.col("pixels") * num(sx) * num(sy) * num(1e-6), 6))


def vascular_index(pixels: DataFrame, vessel: DataFrame, sx: float = SCALE_X, sy: float = SCALE_Y) -> DataFrame:
    """ROI-6 and ROI-7. Vessel share of the enclosed pixels, looked up one row above each, and the vessel area in square millimetres."""
    v = vessel.select("image_id", "bscan", "x", (F.col("y") + 1).alias("y"), "p")
    total = pixels.join(v, ["image_id", "bscan", "x", "y"], "left").groupBy(*SLAB).agg(F.count("*").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("s"))
    return total.select(*SLAB, F.bround(F.col("s") / F.col("n"), 5).alias("vascular_index"), F.bround(F.col("s") * num(sx * sy * 1e-6), 6).alias("vessel_area"))


def linescan_measure(trace: DataFrame, fovea: DataFrame, distance: int, sx: float = SCALE_X, sy: float = SCALE_Y, force: bool = False) -> DataFrame:
    """ROI-9. Thickness, subfoveal thickness and area of every slab of every B-scan; -1 with a reason where it can't be measured."""
    slab = materialise(tr.drop_missing(tr.pair_layers(tr.interp_trace(trace).withColumn("y", F.col("y").cast("double")))), "slabs")
    n, _ = lattice(distance, sx)
    sampled = materialise(samples(slab, fovea, distance, sx, sy, force), "samples")
    thick = roi_thickness(sampled, n, sy)
    area = enclosed_area(enclosed_pixels(slab, sides(sampled, n)), sx, sy).select(*SLAB, F.col("area").alias("roi_area"))
    joined = slab.select(*SLAB).distinct().join(thick, SLAB, "left").join(area, SLAB, "left")
    bad = F.col("reason").isNotNull() | F.col("thickness").isNull()
    why = F.when(F.col("thickness").isNull(), "no fovea").otherwise(F.col("reason"))
    return joined.select(*SLAB, *[F.when(bad, -1.0).otherwise(F.coalesce(c, num(0))).alias(a) for c, a in (("thickness", "thickness"), ("subfoveal_thickness", "subfoveal_thickness"), ("roi_area", "area"))], why.alias("reason"))
