"""Vessel metrics over ordered paths (image_id, vessel_map, path_id, seq, row, col) and vessel masks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dimensions import KNUDTSON, VESSEL_FEATURES, VESSEL_MAPS, WHOLE_ONLY, ZONES, num
from ..functions.nearest import nearest_point, nearest_targets
from ..sources.shared import materialise
from .mask import MASK, boundary

PATH = ["image_id", "vessel_map", "path_id"]


def box_count(mask: DataFrame, sizes: list[int]) -> DataFrame:
    """VES-1. Boxes of each size that are neither empty nor full.

    Pixels are shuffled once, by picture, and counted in boxes of the largest size that divides all others; larger boxes are sums of these.
    """
    least = int(np.gcd.reduce(sizes))
    fine = mask.select(*MASK, "x", "y").repartition(*MASK).groupBy(*MASK, F.expr(f"x div {least}").alias("x"), F.expr(f"y div {least}").alias("y")).agg(F.count("*").alias("n"))
    sized = fine.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    boxes = sized.groupBy(*MASK, "size", F.expr(f"x div (size div {least})").alias("bx"), F.expr(f"y div (size div {least})").alias("by")).agg(F.sum("n").alias("n"))
    return boxes.filter(F.col("n") < F.col("size") * F.col("size")).groupBy(*MASK, "size").agg(F.count("*").alias("boxes"))


def fractal_dimension(mask: DataFrame, side: int) -> DataFrame:
    """VES-2. Minus the slope of log box count over log size, for sizes from the largest power of two within the side to 4."""
    counts = box_count(mask, [1 << k for k in range(side.bit_length() - 1, 1, -1)])
    return counts.groupBy(*MASK).agg((-F.regr_slope(F.ln("boxes"), F.ln("size"))).alias("fractal_dimension"))


def vessel_density(mask: DataFrame, height: int, width: int) -> DataFrame:
    """VES-3. Share of vessel pixels in the image."""
    return mask.groupBy(*MASK).agg((F.count("*") / num(height * width)).alias("vessel_density"))


def global_calibre(mask: DataFrame, skeleton: DataFrame, scale: float) -> DataFrame:
    """VES-4. Vessel pixels per skeleton pixel, times the scale."""
    count = lambda df, name: df.groupBy(*MASK).agg(F.count("*").alias(name))
    return count(mask, "v").join(count(skeleton, "s"), MASK).select(*MASK, (F.col("v") / F.col("s") * num(scale)).alias("average_global_calibre"))


class Remaining:
    """The pixels of a component that no step has taken, filed by square, so that the nearest one is found ring by ring."""

    def __init__(self, rows: list[int], cols: list[int], side: int = 16):
        self.side, self.left = side, set(zip(rows, cols, strict=True))
        self.squares: dict[tuple[int, int], set] = {}
        for p in self.left:
            self.squares.setdefault((p[0] // side, p[1] // side), set()).add(p)
        at = list(self.squares)
        self.rings = max(max(x[k] for x in at) - min(x[k] for x in at) for k in (0, 1)) + 1

    def take(self, p: tuple[int, int]) -> None:
        self.left.discard(p)
        key = p[0] // self.side, p[1] // self.side
        self.squares[key].discard(p)
        if not self.squares[key]:
            del self.squares[key]

    def beside(self, p: tuple[int, int]) -> list[tuple[int, int]]:
        r, c = p
        return [q for q in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c), (r - 1, c - 1), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c + 1)) if q in self.left]

    def nearest(self, p: tuple[int, int]) -> tuple[int, int]:
        """By distance, then row and column."""
        far = lambda q: ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, q)
        r, c, best = p[0] // self.side, p[1] // self.side, None
        for ring in range(self.rings + 1):
            if best and best[0] < ((ring - 1) * self.side + 1) ** 2:  # what lies in this ring or beyond is further away
                break
            if 8 * ring > len(self.squares):  # few squares are left: look at all of them
                return min(map(far, self.left))[1]
            edge = range(-ring, ring + 1)
            for key in [(r + i, c + j) for i in edge for j in (edge if abs(i) == ring else {-ring, ring})]:
                found = self.squares.get(key)
                if found:
                    near = min(map(far, found))
                    best = near if best is None else min(best, near)
        return best[1] if best else min(map(far, self.left))[1]


def walk_pixels(rows: list[int], cols: list[int], origin: tuple[float, float] | None) -> list[tuple[int, int]]:
    """Pixels in order: from the endpoint nearest the origin, to a neighbour where there is one, else to the nearest pixel left."""
    rest = Remaining(rows, cols)
    ends = sorted(p for p in rest.left if len(rest.beside(p)) <= 1) or [min(rest.left)]
    at = ends[0] if origin is None else min(ends, key=lambda p: ((p[0] - origin[0]) ** 2 + (p[1] - origin[1]) ** 2, p))
    order = [at]
    rest.take(at)
    while rest.left:
        ahead = rest.beside(at)
        at = ahead[0] if ahead else rest.nearest(at)  # a branch was left behind
        order.append(at)
        rest.take(at)
    return order


def order_paths(skeleton: DataFrame, origin: DataFrame) -> DataFrame:
    """VES-5. Pixels (image_id, vessel_map, path_id, row, col) of each linear component in order, as seq.

    Begins at the endpoint nearest the image's origin (row0, col0); without an origin, or in a loop, at
    the first by row and column. A component is one task's group: a thin line of one image.
    """
    started = skeleton.join(origin.select("image_id", "row0", "col0"), "image_id", "left")
    schema = T.StructType([*(skeleton.schema[c] for c in PATH), T.StructField("seq", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row0"].iloc[0], pdf["col0"].iloc[0]
        rows = np.array(walk_pixels(pdf["row"].astype(int).tolist(), pdf["col"].astype(int).tolist(), None if pd.isna(r0) else (r0, c0)), np.int32)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in PATH}, "seq": np.arange(len(rows), dtype=np.int32), "row": rows[:, 0], "col": rows[:, 1]})

    return started.groupBy(*PATH).applyInPandas(walk, schema)


def path_length(path: DataFrame) -> DataFrame:
    """VES-6. Sum of the steps of each path."""
    order = W.partitionBy(*PATH).orderBy("seq")
    step = F.hypot(F.col("row") - F.lag("row").over(order), F.col("col") - F.lag("col").over(order))
    return path.select(*PATH, step.alias("step")).groupBy(*PATH).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def chord_length(path: DataFrame) -> DataFrame:
    """VES-7. Distance from first to last point."""
    at = F.struct("row", "col")
    ends = path.groupBy(*PATH).agg(F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"))
    return ends.select(*PATH, F.hypot(F.col("b.row") - F.col("a.row"), F.col("b.col") - F.col("a.col")).alias("chord"))


def tortuosity_distance(path: DataFrame) -> DataFrame:
    """VES-8. Mean over the paths of length by chord; closed paths, which have no chord, don't count."""
    order, at = W.partitionBy(*PATH).orderBy("seq"), F.struct("row", "col")
    stepped = path.withColumn("step", F.hypot(F.col("row") - F.lag("row").over(order), F.col("col") - F.lag("col").over(order)))
    ends = stepped.groupBy(*PATH).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"))  # one pass: no join of two sums
    chord = F.hypot(F.col("b.row") - F.col("a.row"), F.col("b.col") - F.col("a.col"))
    ratio = ends.select(*PATH, F.try_divide("length", chord).alias("r"))
    return ratio.groupBy("image_id", "vessel_map").agg(F.avg("r").alias("tortuosity_distance"))


def inflections(path: DataFrame) -> DataFrame:
    """VES-9. Paths with `turn`: the direction across rows changes sign at this point."""
    order = W.partitionBy(*PATH).orderBy("seq")
    before, after = F.signum(F.col("col") - F.lag("col").over(order)), F.signum(F.lead("col").over(order) - F.col("col"))
    return path.withColumn("turn", F.coalesce(before != after, F.lit(False)))


def tortuosity_density(path: DataFrame, proper: bool = False) -> DataFrame:
    """VES-10. Mean over the paths of (n - 1) / n + sum(segment curve / chord - 1) / length.

    Segments lie between turns; what follows the last turn is left out, and so are segments
    without a chord. A path without turns has 0. `proper`: (n - 1) / length * sum instead.
    """
    order = W.partitionBy(*PATH).orderBy("seq")
    upto, whole = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*PATH)
    seg = inflections(path).withColumns({"segment": F.sum(F.col("turn").cast("int")).over(upto)})
    seg = seg.withColumn("n", F.max("segment").over(whole))
    inside = W.partitionBy(*PATH, "segment").orderBy("seq")
    seg = seg.withColumns({"whole_step": F.hypot(F.col("row") - F.lag("row").over(order), F.col("col") - F.lag("col").over(order)), "step": F.hypot(F.col("row") - F.lag("row").over(inside), F.col("col") - F.lag("col").over(inside))})
    at = F.struct("row", "col")
    per = seg.groupBy(*PATH, "segment").agg(F.max("n").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("curve"), F.coalesce(F.sum("whole_step"), F.lit(0.0)).alias("part"), F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"))
    chord = F.hypot(F.col("b.row") - F.col("a.row"), F.col("b.col") - F.col("a.col"))
    excess = F.when((F.col("segment") < F.col("n")) & (chord > 0), F.col("curve") / chord - 1).otherwise(0.0)
    paths = per.withColumn("excess", excess).groupBy(*PATH).agg(F.max("n").alias("n"), F.sum("part").alias("length"), F.sum("excess").alias("excess"))
    n = F.col("n")
    value = (n - 1) / F.col("length") * F.col("excess") if proper else (n - 1) / n + F.try_divide("excess", "length")
    return paths.withColumn("t", F.when(n == 0, 0.0).otherwise(value)).groupBy("image_id", "vessel_map").agg(F.avg("t").alias("tortuosity_density"))


def smooth_path(path: DataFrame, window: int = 4) -> DataFrame:
    """VES-11. Trailing mean of up to `window` points, cut to integers."""
    back = W.partitionBy(*PATH).orderBy("seq").rowsBetween(1 - window, 0)
    return path.withColumns({c: F.avg(c).over(back).cast("smallint") for c in ("row", "col")})


def distances(inside: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each set cell to the nearest cell that isn't; without one, twice the sides' sum.

    Along rows first, from the last and the next unset cell; then up and down the columns, step by step, until no cell
    further away can be nearer.
    """
    height, width = inside.shape
    far, at = 2 * (width + height), np.arange(width)
    left = at - np.maximum.accumulate(np.where(inside, -far, at), axis=1)
    right = np.minimum.accumulate(np.where(inside, far + width, at)[:, ::-1], axis=1)[:, ::-1] - at
    row = np.minimum(np.minimum(left, right), far).astype(np.int64) ** 2
    best = row.copy()
    for step in range(1, height):
        if step * step >= best.max():
            break
        np.minimum(best[step:], row[:-step] + step * step, out=best[step:])
        np.minimum(best[:-step], row[step:] + step * step, out=best[:-step])
    return np.sqrt(best)


def distance_map(mask: DataFrame, width: int, height: int) -> DataFrame:
    """VES-12. Exact Euclidean distance of each mask pixel to the nearest background pixel of the image. A picture is one group of one shuffle."""
    pixels = mask.select(*MASK, "x", "y")
    schema = T.StructType([*pixels.schema.fields, T.StructField("distance", T.DoubleType())])

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["x"].between(0, width - 1) & pdf["y"].between(0, height - 1)].drop_duplicates(["x", "y"])
        grid = np.zeros((height, width), bool)
        grid[pdf["y"], pdf["x"]] = True
        return pdf.assign(distance=distances(grid)[pdf["y"], pdf["x"]])

    return pixels.groupBy(*MASK).applyInPandas(measure, schema)


def vessel_edges(path: DataFrame) -> DataFrame:
    """VES-13. Both points at `distance` along the path's normal at each point (path with a distance column)."""
    order = W.partitionBy(*PATH).orderBy("seq")

    def slope(c: str) -> Column:
        a, b = F.lag(c).over(order), F.lead(c).over(order)
        return F.when(a.isNull(), b - F.col(c)).when(b.isNull(), F.col(c) - a).otherwise((b - a) / 2)

    angle = F.atan2(slope("col"), slope("row")) + F.pi() / 2
    # Places are rounded, so that points as far from two pixels are so on every machine.
    moved = lambda sign: {f"row{1 if sign > 0 else 2}": F.round(F.col("row") + sign * F.col("distance") * F.cos("angle"), 6), f"col{1 if sign > 0 else 2}": F.round(F.col("col") + sign * F.col("distance") * F.sin("angle"), 6)}
    return path.withColumn("angle", angle).withColumns(moved(1) | moved(-1)).drop("angle")


def snap(edges: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """VES-14. The mask's boundary pixel nearest to each edge point (keys, px, py) of the same keys."""
    return nearest_point(edges.select(*keys, "px", "py").distinct(), boundary(mask).withColumnRenamed("mask", "vessel_map").select(*keys, "x", "y"), list(keys))


def vessel_width(edges: DataFrame, mask: DataFrame, scale: float = 1.0, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """VES-15. Mean distance between the snapped edge points, for each path. Edges and boundary of a picture are one group; its paths' means leave it."""
    ends = ["row1", "col1", "row2", "col2"]
    some = edges.select(*PATH, *ends).dropna()
    to = boundary(mask).withColumnRenamed("mask", "vessel_map").select(*keys, "x", "y")
    schema = T.StructType([*(edges.schema[c] for c in PATH), T.StructField("width", T.DoubleType())])

    def measure(at: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        if not len(at) or not len(to):
            return at.iloc[:0].assign(width=0.0)[schema.names]
        x, y = to["x"].to_numpy(float), to["y"].to_numpy(float)
        (x1, y1, _), (x2, y2, _) = (nearest_targets(at[f"col{k}"].to_numpy(float), at[f"row{k}"].to_numpy(float), x, y) for k in (1, 2))
        means = at.assign(width=np.hypot(x1 - x2, y1 - y2)).groupby(PATH, sort=False, as_index=False)["width"].mean()
        return means.assign(width=means["width"] * scale)[schema.names]

    return some.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInPandas(measure, schema)


def zones(points: DataFrame, scan: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """VES-16. Points with each zone they are in: whole; B from 2 to 3 and C from 3 to 5 disc radii from the disc's centre."""
    d = F.hypot(F.col(x) - F.col("disc_x"), F.col(y) - F.col("disc_y"))
    r = F.col("disc_radius")
    inner = F.when((d > 2 * r) & (d <= 3 * r), "B").when((d > 3 * r) & (d <= 5 * r), "C")
    joined = points.join(scan.select("image_id", "disc_x", "disc_y", "disc_radius"), "image_id")
    return joined.withColumn("zone", F.explode(F.array_compact(F.array(F.lit("whole"), inner)))).drop("disc_x", "disc_y", "disc_radius")


def zonal_paths(zoned: DataFrame, least: int = 10) -> DataFrame:
    """VES-17. A zone keeps paths with at least `least` points in it, and of these the points in it; `whole` keeps all."""
    n = F.count("*").over(W.partitionBy(*PATH, "zone"))
    return zoned.withColumn("n", n).filter((F.col("zone") == "whole") | (F.col("n") >= least)).drop("n")


def top_widths(width: DataFrame, k: int = 6) -> DataFrame:
    """VES-18. The k largest widths of each image, vessel kind and zone, ascending; fewer than k: null."""
    keys = ["image_id", "vessel_map", "zone"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("width"), "path_id"))
    top = width.withColumn("r", rank).filter(F.col("r") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("width")).alias("widths"))
    return top.withColumn("widths", F.when(F.size("widths") == k, F.col("widths")))


def knudtson(top: DataFrame) -> DataFrame:
    """VES-19. Equivalent calibre of six widths: smallest with largest, three times over; -1 without six."""
    c = F.when(F.col("vessel_map") == "artery", KNUDTSON["artery"]).otherwise(KNUDTSON["vein"])
    pair = lambda a, b: c * F.sqrt(a * a + b * b)
    w = [F.get("widths", F.lit(k)) for k in range(6)]
    first = F.array_sort(F.array(pair(w[0], w[5]), pair(w[1], w[4]), pair(w[2], w[3])))
    second = F.array_sort(F.array(pair(F.get(first, F.lit(0)), F.get(first, F.lit(2))), F.get(first, F.lit(1))))
    value = pair(F.get(second, F.lit(0)), F.get(second, F.lit(1)))
    return top.select("image_id", "vessel_map", "zone", F.coalesce(value, num(-1)).alias("equivalent"))


def avr(equivalent: DataFrame) -> DataFrame:
    """VES-20. Artery by vein equivalent of each zone; -1 where one failed; `warning` above 1."""
    of = lambda kind: F.max(F.when(F.col("vessel_map") == kind, F.col("equivalent")))
    both = equivalent.groupBy("image_id", "zone").agg(of("artery").alias("crae"), of("vein").alias("crve"))
    bad = (F.coalesce("crae", num(-1)) == -1) | (F.coalesce("crve", num(-1)) == -1)
    ratio = F.when(bad, -1.0).otherwise(F.try_divide("crae", "crve"))
    return both.select("image_id", "zone", ratio.alias("AVR"), (ratio > 1).alias("warning"))


def append_avr(m: DataFrame, ratio: DataFrame, features: list[str]) -> DataFrame:
    """VES-21. An artery-vein row for each zone: the ratio, and -1 for every other feature."""
    rows = ratio.select("image_id", F.lit("artery-vein").alias("vessel_map"), "zone", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("AVR") if f == "AVR" else num(-1)).alias("value")) for f in ["AVR", *features]])).alias("m"))
    return m.unionByName(rows.select("image_id", "vessel_map", "zone", "m.feature", "m.value"))


def null_zone_features(m: DataFrame) -> DataFrame:
    """VES-22. Whole-image features are -1 in zones B and C."""
    return m.withColumn("value", F.when(F.col("feature").isin(*WHOLE_ONLY) & F.col("zone").isin("B", "C"), -1.0).otherwise(F.col("value")))


def split_zones(m: DataFrame) -> dict[str, DataFrame]:
    """VES-23. One table per zone, in the order binary, artery, vein, artery-vein."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VESSEL_MAPS]), F.col("vessel_map"))
    return {z: m.filter(F.col("zone") == z).orderBy("image_id", rank, "feature") for z in ZONES}


def zonal_widths(zoned: DataFrame, zone_mask: DataFrame, side: int) -> DataFrame:
    """Width in pixels of each path (its kind and zone as vessel_map): edges along the smoothed path's normals, two pixels
    beyond its distance to the background of the kind's mask in the zone, snapped to that mask's boundary."""
    distance = distance_map(zone_mask, side, side).select("image_id", F.col("mask").alias("vessel_map"), F.col("x").alias("col"), F.col("y").alias("row"), "distance")
    smooth = smooth_path(zoned).join(distance.hint("merge"), ["image_id", "vessel_map", "row", "col"], "left")  # compressed tables look small enough to be broadcast
    edges = vessel_edges(smooth.withColumn("distance", F.coalesce("distance", num(0)) + 2))
    return vessel_width(edges, zone_mask, 1.0, ("image_id", "vessel_map"))


def vessel_measure(path: DataFrame, mask: DataFrame, skeleton: DataFrame, scan: DataFrame, side: int, scale: float = 1.0, least: int = 10) -> DataFrame:
    """VES-24. Long measurements (image_id, vessel_map, zone, feature, value) of VESSEL_FEATURES in all zones, and the ratio rows.

    mask and skeleton (image_id, mask, x, y) have a path's vessel_map as mask. A feature that wasn't
    measured is -1: whole-image features in zones B and C, equivalents but for the kind's own in these zones, and those of
    fewer than six vessels. A zone without a vessel has null in its path features.
    """
    zoned = zonal_paths(zones(path, scan, "col", "row"), least)
    # The zone becomes part of the path's kind, so one pass serves all zones.
    keyed = materialise(zoned.withColumn("vessel_map", F.concat_ws("|", "vessel_map", "zone")).drop("zone"), "zonal-paths")
    zone_mask = materialise(zones(mask, scan).withColumn("mask", F.concat_ws("|", "mask", "zone")).select(*MASK, "x", "y").distinct(), "zonal-masks")
    kind, zone = F.substring_index("vessel_map", "|", 1), F.substring_index("vessel_map", "|", -1)
    width = materialise(zonal_widths(keyed, zone_mask, side).select("image_id", kind.alias("vessel_map"), zone.alias("zone"), "path_id", "width"), "widths")
    local = width.groupBy("image_id", "vessel_map", "zone").agg((F.avg("width") * num(scale)).alias("average_local_calibre"))
    long = [p.select("image_id", kind.alias("vessel_map"), zone.alias("zone"), p.columns[-1]) for p in (tortuosity_density(keyed), tortuosity_distance(keyed))]
    whole = [fractal_dimension(mask, side), vessel_density(mask, side, side), global_calibre(mask, skeleton, scale)]
    long += [local, *(p.select("image_id", F.col("mask").alias("vessel_map"), F.lit("whole").alias("zone"), p.columns[-1]) for p in whole)]
    own = knudtson(top_widths(width.filter(F.col("zone").isin("B", "C") & F.col("vessel_map").isin("artery", "vein"))))
    own = materialise(own.withColumn("equivalent", F.when(F.col("equivalent") == -1, -1.0).otherwise(F.col("equivalent") * num(scale))), "equivalents")
    named = [own.select("image_id", "vessel_map", "zone", F.when(F.col("vessel_map") == k, F.col("equivalent")).alias(f)) for k, f in (("artery", "CRAE_Knudtson"), ("vein", "CRVE_Knudtson"))]
    rows = [p.select("image_id", "vessel_map", "zone", F.lit(p.columns[-1]).alias("feature"), F.col(p.columns[-1]).alias("value")) for p in [*long, *named]]
    measured = reduce(DataFrame.unionByName, rows).filter("value is not null")
    kinds = path.select("image_id", "vessel_map").union(mask.select("image_id", "mask")).distinct()
    asked = kinds.select("image_id", "vessel_map", F.explode(F.array(*[F.lit(z) for z in ZONES])).alias("zone")).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in VESSEL_FEATURES])))
    full = asked.join(measured.hint("merge"), ["image_id", "vessel_map", "zone", "feature"], "left").withColumn("value", F.when(F.col("feature").endswith("_Knudtson"), F.coalesce("value", num(-1))).otherwise(F.col("value")))
    ratio = kinds.select("image_id").distinct().withColumn("zone", F.explode(F.array(*[F.lit(z) for z in ZONES]))).join(avr(own).hint("merge"), ["image_id", "zone"], "left").withColumn("AVR", F.coalesce("AVR", num(-1)))
    return append_avr(null_zone_features(full), ratio, list(VESSEL_FEATURES))
