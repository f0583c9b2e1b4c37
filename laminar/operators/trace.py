"""Boundary traces: one row per boundary point (image_id, bscan, layer, x, y), slabs with two boundaries.

Keys start with image_id, so one shuffle on (image_id, bscan) serves a chain of these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dimensions import CHOROID, SCALE_X, SCALE_Y, layer_rank, num, truncated

LINE = ["image_id", "bscan", "layer"]


def present_pairs(trace: DataFrame, custom: list[str] = ()) -> DataFrame:
    """(image_id, pair, upper, lower): neighbours among a scan's layers with BM last, whole-depth slabs, the choroid, and asked pairs."""
    layers = trace.filter("y is not null").select("image_id", "layer").distinct()
    retina = layers.filter(~F.col("layer").isin(*CHOROID))
    order = W.partitionBy("image_id").orderBy(F.col("layer") == "BM", layer_rank("layer"))
    near = retina.select("image_id", F.col("layer").alias("upper"), F.lead("layer").over(order).alias("lower")).filter("lower is not null")
    wanted = [("ILM", "BM"), ("ILM", "ELM"), ("ELM", "BM"), CHOROID, *(tuple(c.split("_")) for c in custom)]
    named = layers.groupBy("image_id").agg(F.collect_set("layer").alias("has"))  # at most 13 names
    asked = named.select("image_id", "has", F.explode(F.array(*[F.struct(F.lit(a).alias("upper"), F.lit(b).alias("lower")) for a, b in wanted])).alias("p"))
    asked = asked.filter(F.array_contains("has", F.col("p.upper")) & F.array_contains("has", F.col("p.lower"))).select("image_id", "p.upper", "p.lower")
    return near.unionByName(asked).distinct().withColumn("pair", F.concat_ws("_", "upper", "lower"))


def pair_layers(trace: DataFrame, custom: list[str] = ()) -> DataFrame:
    """TRC-1. Slabs (image_id, bscan, pair, x, y_top, y_bot). Layers of one A-scan meet in one row, then pairs are read off it."""
    column = trace.groupBy("image_id", "bscan", "x").agg(F.map_from_entries(F.collect_list(F.struct("layer", "y"))).alias("y"))  # at most 13 entries
    joined = column.join(present_pairs(trace, custom), "image_id")
    both = joined.filter(F.map_contains_key("y", F.col("upper")) & F.map_contains_key("y", F.col("lower")))
    return both.select("image_id", "bscan", "pair", "x", F.element_at("y", F.col("upper")).alias("y_top"), F.element_at("y", F.col("lower")).alias("y_bot"))


def drop_missing(slab: DataFrame) -> DataFrame:
    """TRC-2. Columns where either boundary is missing go; values are cut to integers."""
    good = slab.filter("y_top is not null and y_bot is not null and not isnan(y_top) and not isnan(y_bot)")
    return good.withColumns({"y_top": truncated(F.col("y_top")), "y_bot": truncated(F.col("y_bot"))})


def interp_trace(trace: DataFrame) -> DataFrame:
    """TRC-3. A value at every x from the first to before the last, linear between known points, cut to integers."""
    order = W.partitionBy(*LINE).orderBy("x")
    known = trace.filter("y is not null").select(*LINE, "x", "y", F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).filter("x2 is not null")
    dense = known.withColumn("at", F.explode(F.sequence("x", F.col("x2") - 1)))
    y = F.col("y") + (F.col("at") - F.col("x")) * (F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))
    return dense.select(*LINE, F.col("at").alias("x"), truncated(y).alias("y"))


def align(slab: DataFrame) -> DataFrame:
    """TRC-4. Both boundaries from the later start to before the earlier end."""
    span = W.partitionBy("image_id", "bscan", "pair")
    top, bot = F.when(F.col("y_top").isNotNull(), F.col("x")), F.when(F.col("y_bot").isNotNull(), F.col("x"))
    lo, hi = F.greatest(F.min(top).over(span), F.min(bot).over(span)), F.least(F.max(top).over(span), F.max(bot).over(span))
    return slab.withColumns({"lo": lo, "hi": hi}).filter("x >= lo and x < hi").drop("lo", "hi")


def smart_crop(trace: DataFrame, k: int = 20, threshold: float = 1) -> DataFrame:
    """TRC-5. A jump of more than `threshold` among the first or last k points cuts off what lies outside it."""
    order = W.partitionBy(*LINE).orderBy("x")
    whole = W.partitionBy(*LINE)
    points = trace.filter("y is not null").withColumns({"i": F.row_number().over(order), "n": F.count("*").over(whole), "jump": F.abs(F.lead("y").over(order) - F.col("y")) > threshold})
    left = F.max(F.when(F.col("jump") & (F.col("i") < k), F.col("i"))).over(whole)
    right = F.min(F.when(F.col("jump") & (F.col("i") > F.col("n") - k), F.col("i"))).over(whole)
    cut = points.withColumns({"from": F.coalesce(left, F.lit(0)), "to": F.coalesce(right, F.col("n"))})
    return cut.filter(F.col("i").between(F.col("from") + 1, F.col("to"))).select(*LINE, "x", "y")


def extract_bounds(mask: DataFrame) -> DataFrame:
    """TRC-6. First and last set pixel of every column."""
    return mask.groupBy("image_id", "mask", "x").agg(F.min("y").alias("y_top"), F.max("y").alias("y_bot"))


def largest_component(mask: DataFrame) -> DataFrame:
    """TRC-7. The largest 8-connected region of each mask; of equal ones the one labelled first."""
    from .mask import components

    labelled = components(mask)
    rank = W.partitionBy("image_id", "mask").orderBy(F.desc("size"), "label")
    best = labelled.groupBy("image_id", "mask", "label").agg(F.count("*").alias("size")).withColumn("r", F.row_number().over(rank)).filter("r = 1")
    return labelled.join(best.select("image_id", "mask", "label"), ["image_id", "mask", "label"], "left_semi").drop("label")


def mask_to_trace(mask: DataFrame, threshold: float = 0.5) -> DataFrame:
    """TRC-8. Slab of the largest region above the threshold, edges cropped, aligned. Without a threshold 0.5 holds."""
    bounds = extract_bounds(largest_component(mask.filter(F.col("p") > threshold)))
    base = bounds.select("image_id", F.lit(0).alias("bscan"), "mask", "x", "y_top", "y_bot")
    lines = base.unpivot(["image_id", "bscan", "mask", "x"], ["y_top", "y_bot"], "layer", "y").withColumn("layer", F.concat_ws("|", "mask", "layer"))
    dense = interp_trace(smart_crop(lines.select(*LINE, "x", F.col("y").cast("double").alias("y"))))
    named = dense.withColumns({"pair": F.substring_index("layer", "|", 1), "side": F.substring_index("layer", "|", -1)})
    slab = named.groupBy("image_id", "bscan", "pair", "x").agg(F.max(F.when(F.col("side") == "y_top", F.col("y"))).alias("y_top"), F.max(F.when(F.col("side") == "y_bot", F.col("y"))).alias("y_bot"))
    return align(slab).filter("y_top is not null and y_bot is not null")


def fill_between(slab: DataFrame) -> DataFrame:
    """TRC-9. Pixels from the upper boundary to before the lower one."""
    some = slab.filter("y_bot > y_top")
    return some.select("image_id", "bscan", F.col("pair").alias("mask"), "x", F.explode(F.sequence("y_top", F.col("y_bot") - 1)).alias("y"))


def melt_traces(wide: DataFrame, columns: list[str]) -> DataFrame:
    """TRC-10. Columns of a wide sheet to points; 0 is no value; gaps are filled linearly."""
    long = wide.unpivot(["image_id", "bscan", "layer"], columns, "column", "y").filter("y <> 0")
    return interp_trace(long.select(*LINE, F.regexp_extract("column", "([0-9]+)$", 1).cast("int").alias("x"), F.col("y").cast("double").alias("y")))


def widen_traces(trace: DataFrame, n: int) -> DataFrame:
    """TRC-11. One array of n values per boundary line, 0 where there is none."""
    points = trace.filter(F.col("x").between(0, n - 1) & F.col("y").isNotNull()).groupBy(*LINE).agg(F.map_from_entries(F.collect_list(F.struct("x", truncated(F.col("y")).alias("y")))).alias("at"))
    return points.select(*LINE, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.coalesce(F.try_element_at("at", x), F.lit(0).cast("bigint"))).alias("y"))


def steps(trace: DataFrame, sx: float = SCALE_X, sy: float = SCALE_Y) -> DataFrame:
    """Points with their index and the micron length of the step from the point before."""
    order = W.partitionBy(*LINE).orderBy("x")
    return trace.withColumns({"i": F.row_number().over(order) - 1, "step": F.hypot((F.col("x") - F.lag("x").over(order)) * num(sx), (F.col("y") - F.lag("y").over(order)) * num(sy))})


def curve_length(trace: DataFrame, sx: float = SCALE_X, sy: float = SCALE_Y) -> DataFrame:
    """TRC-12. Length of each boundary line in microns; missing points are skipped."""
    return steps(trace.filter("y is not null"), sx, sy).groupBy(*LINE).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_um"))


def curve_location(trace: DataFrame, refs: DataFrame, distances: list[float], sx: float = SCALE_X, sy: float = SCALE_Y) -> DataFrame:
    """TRC-13. Index on either side of refs' (…, ref) at each arc distance.

    The search counts the steps whose running length is below the distance; to the
    left it starts one point left of the reference. Where all steps are below it, the
    line is too short and the reference itself is the answer; beyond 200 microns that is null.
    """
    points = steps(trace, sx, sy).join(refs, LINE)
    right = W.partitionBy(*LINE).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    left = W.partitionBy(*LINE).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    ahead = F.lead("step").over(W.partitionBy(*LINE).orderBy("i"))
    summed = points.withColumn("back", ahead).withColumns({"to_right": F.sum(F.when(F.col("i") > F.col("ref"), F.col("step"))).over(right), "to_left": F.sum(F.when(F.col("i") < F.col("ref") - 1, F.col("back"))).over(left)})
    asked = summed.withColumn("distance", F.explode(F.array(*[num(d) for d in distances])))
    r = F.min(F.when((F.col("i") > F.col("ref")) & (F.col("to_right") >= F.col("distance")), F.col("i") - F.col("ref") - 1))
    k = F.min(F.when((F.col("i") < F.col("ref") - 1) & (F.col("to_left") >= F.col("distance")), F.col("ref") - 2 - F.col("i")))
    found = asked.groupBy(*LINE, "ref", "distance").agg(r.alias("r"), k.alias("k"))
    far = F.col("distance") > 200
    place = lambda c, sign: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.when(~far, F.col("ref"))).otherwise(F.col("ref") + sign * F.col(c))
    return found.select(*LINE, "ref", "distance", place("k", -1).alias("idx_left"), place("r", 1).alias("idx_right"))


def nearest_point(trace: DataFrame, points: DataFrame) -> DataFrame:
    """TRC-14. For each point (image_id, bscan, px, py) the nearest boundary point of each line; ties go to the first."""
    indexed = steps(trace.filter("y is not null"))
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    best = F.min_by(F.struct("i", "x", "y"), F.struct(d2, "i"))
    return indexed.join(points, ["image_id", "bscan"]).groupBy(*LINE, "px", "py").agg(best.alias("p")).select(*LINE, "px", "py", F.col("p.i").alias("ref"), F.col("p.x").alias("ref_x"), F.col("p.y").alias("ref_y"))


def tangent_points(trace: DataFrame, k: int = 15) -> DataFrame:
    """TRC-15. Each point with the points k before and after it, the line's ends where it stops short."""
    order = W.partitionBy(*LINE).orderBy("x")
    whole = W.partitionBy(*LINE).orderBy("x").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = F.struct("x", "y")
    return trace.withColumns({"before": F.coalesce(F.lag(at, k).over(order), F.first(at).over(whole)), "after": F.coalesce(F.lead(at, k).over(order), F.last(at).over(whole))})


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """TRC-16. Slope and intercept through two points; a vertical line has an infinite slope and its x as intercept."""
    slope = F.when(x1 == x2, F.lit(float("inf"))).otherwise((y2 - y1) / (x2 - x1))
    return slope, F.when(x1 == x2, x1).otherwise(y1 - slope * x1)


def walk_normals(x: np.ndarray, top: np.ndarray, deepest: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (wx, wy) on the normals of upper points in the order of x, a row a point: every whole y from the point down to `deepest`; NaN where none is.

    The tangent joins the points `offset` before and after, or the line's ends.
    """
    n = len(x)
    before, after = np.maximum(np.arange(n) - offset, 0), np.minimum(np.arange(n) + offset, n - 1)
    dx, dy = x[after] - x[before], top[after] - top[before]
    steps = np.arange(max(0, int(deepest - np.nanmin(top))) + 1)
    wy = top[:, None] + steps
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(dx != 0, dy / dx, np.nan)
    wx = x[:, None] - slope[:, None] * (wy - top[:, None])
    gone = (wy > deepest) | np.isnan(wx)
    return np.where(gone, np.nan, wx), np.where(gone, np.nan, wy)


def feet(x: np.ndarray, bottom: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fx, fy, miss) of each normal: the lower point nearest to one of its places, of those in a place's column; miss is infinite without one."""
    first = int(x.min())
    low = np.full(int(x.max()) - first + 1, np.nan)
    low[(x - first).astype(int)] = bottom
    column = np.trunc(wx) - first
    inside = (column >= 0) & (column < len(low))
    column = np.where(inside, column, 0).astype(int)
    # The root of the squares' sum, as SQL has it: hypot may break a tie, or miss the tolerance, by its last digit.
    d = np.where(inside, np.sqrt((wx - (column + first)) ** 2 + (wy - low[column]) ** 2), np.inf)
    d[np.isnan(d)] = np.inf
    best, rows = d.argmin(1), np.arange(len(d))
    at = column[rows, best]
    return at + first, low[at], d[rows, best]


def perpendicular_foot(slab: DataFrame, offset: int = 15, tolerance: float = 2) -> DataFrame:
    """TRC-17. For each upper point the lower point that its normal meets.

    The normal is walked by whole y from the upper point to the lowest y of the lower boundary; each place is
    compared with the lower point in its column, and the nearest within the tolerance is the foot. A boundary pair of a
    B-scan is one group, so nothing is multiplied by depth in a shuffle.
    """
    keys = ["image_id", "bscan", "pair"]
    kinds = slab.schema
    schema = T.StructType([*(kinds[c] for c in (*keys, "x", "y_top")), T.StructField("fx", T.LongType()), T.StructField("fy", kinds["y_bot"].dataType), T.StructField("miss", T.DoubleType())])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable").reset_index(drop=True)
        x, top, bottom = (pdf[c].to_numpy(float, na_value=np.nan) for c in ("x", "y_top", "y_bot"))
        if np.isnan(top).all() or np.isnan(bottom).all():
            return pdf.iloc[:0].assign(fx=0, fy=0, miss=0.0)[schema.names]
        fx, fy, miss = feet(x, bottom, *walk_normals(x, top, np.nanmax(bottom), offset))
        met = miss <= tolerance
        return pdf[met].assign(fx=fx[met], fy=fy[met], miss=miss[met])[schema.names]

    return slab.select(*keys, "x", "y_top", "y_bot").groupBy(*keys).applyInPandas(find, schema)


def thickness(slab: DataFrame, sx: float = SCALE_X, sy: float = SCALE_Y) -> DataFrame:
    """TRC-18. Micron distance between boundaries, straight down or, with foot columns fx and fy, to the foot."""
    if "fx" in slab.columns:
        return slab.withColumn("thickness", F.hypot((F.col("fx") - F.col("x")) * num(sx), (F.col("fy") - F.col("y_top")) * num(sy)))
    return slab.withColumn("thickness", F.abs(F.col("y_bot") - F.col("y_top")) * num(sy))


def stack_thickness(slab: DataFrame, n: int, sy: float = SCALE_Y, how: str = "vertical") -> DataFrame:
    """TRC-19. Thickness at all n columns of every B-scan, straight down or along normals; -1 where it isn't measured."""
    full = slab.select("image_id", "bscan", "pair").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    measured = drop_missing(slab)
    if how == "perpendicular":
        measured = perpendicular_foot(measured)
    got = thickness(measured, SCALE_X, sy).select("image_id", "bscan", "pair", "x", "thickness")
    return full.join(got, ["image_id", "bscan", "pair", "x"], "left").withColumn("thickness", F.coalesce("thickness", num(-1)))


def normal_counts(slab: DataFrame, region: DataFrame, vessel: DataFrame, offset: int, tolerance: float) -> DataFrame:
    """(image_id, bscan, x, region_px, vessel_px): pixels of the region, and of vessels in it, on the normal of each upper point of slab that has
    a foot. slab has one pair; a B-scan with its pixels is one group."""
    keys = ["image_id", "bscan"]
    schema = T.StructType([*(slab.schema[c] for c in (*keys, "x")), T.StructField("region_px", T.LongType()), T.StructField("vessel_px", T.LongType())])
    pixels = region.select(*keys, "x", "y", F.lit(0).alias("v")).unionByName(vessel.select(*keys, "x", "y", F.lit(1).alias("v")))

    def count(lines: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("x", kind="stable").reset_index(drop=True)
        x, top, bottom = (lines[c].to_numpy(float, na_value=np.nan) for c in ("x", "y_top", "y_bot"))
        if not len(lines) or np.isnan(top).all() or np.isnan(bottom).all():
            return pd.DataFrame({c: [] for c in schema.names}).astype("int64")
        wx, wy = walk_normals(x, top, np.nanmax(bottom), offset)
        met = feet(x, bottom, wx, wy)[2] <= tolerance
        cx, cy, v = (px[c].to_numpy(np.int64) for c in ("x", "y", "v"))
        x0, y0 = (int(c.min()) if len(c) else 0 for c in (cx, cy))
        shape = (int(cy.max()) - y0 + 1, int(cx.max()) - x0 + 1) if len(px) else (1, 1)
        found = np.zeros((2, *shape), bool)
        found[v, cy - y0, cx - x0] = True
        column, row = np.trunc(wx[met]) - x0, wy[met] - y0
        inside = (column >= 0) & (column < shape[1]) & (row >= 0) & (row < shape[0])
        column, row = (np.where(inside, c, 0).astype(int) for c in (column, row))
        in_region = found[0][row, column] & inside
        hit = found[1][row, column] & in_region
        return lines[met][[*keys, "x"]].assign(region_px=in_region.sum(1), vessel_px=hit.sum(1))

    lines = slab.select(*[F.col(c).alias(c) for c in (*keys, "x", "y_top", "y_bot")])  # pixels may come from the same table
    pixels = pixels.select(*[F.col(c).alias(c) for c in pixels.columns])
    return lines.groupBy(*keys).cogroup(pixels.groupBy(*keys)).applyInPandas(count, schema)


def column_density(region: DataFrame, vessel: DataFrame, sx: float = SCALE_X, sy: float = SCALE_Y, how: str = "vertical", slab: DataFrame | None = None, offset: int = 15, tolerance: float = 2) -> DataFrame:
    """TRC-20. Vessel and region pixels of each column or, with the boundaries in slab, along each normal (`perpendicular`); their ratio (null for
    an empty one) and the vessel area in square microns."""
    keys = ["image_id", "bscan", "x"]
    if how == "perpendicular":
        counts = normal_counts(slab, region, vessel, offset, tolerance)
    else:
        both = region.select(*keys, "y").join(vessel.select(*keys, "y", F.lit(1).alias("v")), [*keys, "y"], "left")
        counts = both.groupBy(*keys).agg(F.count("*").alias("region_px"), F.count("v").alias("vessel_px"))
    return counts.withColumns({"density": F.try_divide("vessel_px", "region_px"), "vessel_area": F.col("vessel_px") * num(sx * sy)})
