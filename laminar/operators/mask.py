"""Masks as sparse pixels (image_id, mask, x, y[, p]): regions, morphology, neighbourhoods, landmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import graph
from ..functions.dimensions import CODEBOOK

MASK = ["image_id", "mask"]
EIGHT = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
FOUR = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def offsets(pairs: list[tuple[int, int]]) -> Column:
    """An array of fixed pixel offsets, to be exploded next to a pixel."""
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in pairs])


def shifted(mask: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Each pixel once per offset, moved by it."""
    return mask.select(*MASK, "x", "y").withColumn("o", F.explode(offsets(pairs))).select(*MASK, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))


def label_pixels(x: np.ndarray, y: np.ndarray, slack: int) -> np.ndarray:
    """Labels of one picture's pixels: its rows' runs, each united with the runs of the next row that it touches."""
    width = int(x.max()) - int(x.min()) + 3
    place = (y.astype(np.int64) - int(y.min())) * width + x - int(x.min()) + 1
    order = np.argsort(place, kind="stable")
    sorted_ = place[order]
    new = np.concatenate([[True], sorted_[1:] > sorted_[:-1] + 1])
    run = np.cumsum(new) - 1
    first, last = sorted_[new], sorted_[np.concatenate([new[1:], [True]])]
    # Runs of the next row that end no earlier and begin no later than this run, slack aside, stand side by side.
    lo, hi = np.searchsorted(last, first + width - slack), np.searchsorted(first, last + width + slack, "right")
    each = np.maximum(hi - lo, 0)
    upper = np.repeat(np.arange(len(first)), each)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
    root = graph.roots(len(first), upper, lower)
    own = root == np.arange(len(first))
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(own)[root][run]
    return out


def components(mask: DataFrame, conn: int = 8, least: int = 1) -> DataFrame:
    """MSK-1. Pixels with the label of their region: 1, 2, ... in the order of regions' first pixels, row by row. Regions below `least` pixels
    go and have no label. A picture is one group of one shuffle."""
    pixels = mask.select(*MASK, "x", "y")
    schema = T.StructType([*pixels.schema.fields, T.StructField("label", T.IntegerType())])

    def label(table: pa.Table) -> pa.Table:
        x, y = (table[c].to_numpy().astype(np.int64) for c in "xy")
        once = np.unique((y - y.min()) * (int(x.max()) - int(x.min()) + 1) + x - x.min(), return_index=True)[1]
        made = label_pixels(x[once], y[once], 1 if conn == 8 else 0)
        sizes = np.bincount(made) >= least
        sizes[0] = False
        kept = sizes[made]
        return table.take(once[kept]).append_column("label", pa.array(np.cumsum(sizes)[made[kept]].astype(np.int32)))

    return pixels.groupBy(*MASK).applyInArrow(label, schema)


def region_props(labelled: DataFrame) -> DataFrame:
    """MSK-2. Area, centroid, axis lengths and eccentricity of each region, from its second moments; a pixel has moment 1/12."""
    m = labelled.groupBy(*MASK, "label").agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.var_pop("x") + 1 / 12).alias("vx"), (F.var_pop("y") + 1 / 12).alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    root = F.sqrt(F.pow(F.col("vx") - F.col("vy"), 2) + 4 * F.pow("vxy", 2))
    big, small = (F.col("vx") + F.col("vy") + root) / 2, F.greatest(F.lit(0.0), (F.col("vx") + F.col("vy") - root) / 2)
    return m.select(*MASK, "label", "area", "cx", "cy", (4 * F.sqrt(big)).alias("major"), (4 * F.sqrt(small)).alias("minor"), F.sqrt(F.greatest(F.lit(0.0), 1 - small / big)).alias("eccentricity"))


def filter_small(mask: DataFrame, least: int = 150, hole: int = 10) -> DataFrame:
    """MSK-3. Regions below `least` pixels go; holes below `hole` pixels, within the frame of the mask, are filled."""
    kept = components(mask, least=least).drop("label")
    frame = kept.groupBy(*MASK).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    lattice = frame.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    empty = components(lattice.join(kept, [*MASK, "x", "y"], "left_anti").select(*MASK, "x", "y"), 4)
    inside = empty.join(frame, MASK).groupBy(*MASK, "label").agg(F.count("*").alias("n"), F.bool_or((F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))).alias("edge"))
    holes = empty.join(inside.filter(~F.col("edge") & (F.col("n") < hole)), [*MASK, "label"], "left_semi")
    return kept.select(*MASK, "x", "y").union(holes.select(*MASK, "x", "y"))


def footprint_hits(grid: np.ndarray, footprint: list[tuple[int, int]], every: bool) -> np.ndarray:
    """Where some (or every) of the pixels (x - dx, y - dy) is set. A row of the footprint is looked up as runs of a running sum, so
    a disk costs two or three passes a row, whatever its area."""
    height, width = grid.shape
    sums = np.zeros((height, width + 1), np.int32)
    np.cumsum(grid, axis=1, out=sums[:, 1:])
    out = np.full(grid.shape, every)
    for dy in {dy for _, dy in footprint}:
        run: list[int] = []
        row = sorted({dx for dx, y in footprint if y == dy})
        for dx in row:
            run.append(dx)
            if dx + 1 in row:
                continue
            first, last = np.clip(np.arange(width) - run[-1], 0, width), np.clip(np.arange(width) - run[0] + 1, 0, width)
            hits = np.zeros(grid.shape, np.int32)
            to, of = slice(max(dy, 0), height + min(dy, 0)), slice(max(-dy, 0), height + min(-dy, 0))
            hits[to] = sums[of][:, last] - sums[of][:, first]
            out = out & (hits == len(run)) if every else out | (hits > 0)
            run = []
    return out


def by_footprint(mask: DataFrame, *steps: tuple[list[tuple[int, int]], bool]) -> DataFrame:
    """Steps (footprint, every) one after another. A picture is one group of one shuffle, whatever the number of steps."""
    reach = sum(max([0, *(max(abs(dx), abs(dy)) for dx, dy in footprint)]) for footprint, _ in steps)
    pixels = mask.select(*MASK, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        x0, y0 = int(x.min()) - reach, int(y.min()) - reach
        grid = np.zeros((int(y.max()) - y0 + reach + 1, int(x.max()) - x0 + reach + 1), bool)
        grid[y - y0, x - x0] = True
        for footprint, every in steps:
            grid = footprint_hits(grid, footprint, every)
        row, column = np.nonzero(grid)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in MASK}, "x": (column + x0).astype(np.int32), "y": (row + y0).astype(np.int32)})

    return pixels.groupBy(*MASK).applyInPandas(run, pixels.schema)


def mirrored(footprint: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(-dx, -dy) for dx, dy in footprint]


def dilate(mask: DataFrame, footprint: list[tuple[int, int]]) -> DataFrame:
    """MSK-4."""
    return by_footprint(mask, (footprint, False))


def erode(mask: DataFrame, footprint: list[tuple[int, int]]) -> DataFrame:
    """MSK-4. A pixel stays if the whole footprint about it is set."""
    return by_footprint(mask, (mirrored(footprint), True))


def close(mask: DataFrame, footprint: list[tuple[int, int]]) -> DataFrame:
    """MSK-4. Dilation, then erosion."""
    return by_footprint(mask, (footprint, False), (mirrored(footprint), True))


def bridge_gaps(mask: DataFrame, radius: int = 3, least: int = 10, eccentricity: float = 0.95, minor: float = 5) -> DataFrame:
    """MSK-5. Long thin regions that closing adds join the mask."""
    plain = mask.select(*MASK, "x", "y").distinct()
    gaps = components(close(plain, disk(radius)).join(plain, [*MASK, "x", "y"], "left_anti"))
    thin = region_props(gaps).filter((F.col("area") >= least) & (F.col("eccentricity") >= eccentricity) & (F.col("minor") <= minor))
    return plain.union(gaps.join(thin, [*MASK, "label"], "left_semi").select(*MASK, "x", "y"))


def neighbours(x: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """For each pixel how many of the pixels (x - dx, y - dy) are among them; a pixel given twice counts once."""
    reach = max([0, *(abs(dx) for dx, _ in pairs)])
    width = int(x.max()) - int(x.min()) + 1 + 2 * reach
    place = (y - y.min()) * width + x - x.min() + reach
    have = np.unique(place)
    n = np.zeros(len(x), np.int64)
    for dx, dy in pairs:
        wanted = place - dy * width - dx
        n += have[np.minimum(np.searchsorted(have, wanted), len(have) - 1)] == wanted
    return n


def neighbour_count(mask: DataFrame, pairs: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """MSK-6. For each set pixel the set pixels in its 3 x 3 window, itself included. A picture is one group of one shuffle."""
    plain = mask.select(*MASK, "x", "y")
    schema = T.StructType([*plain.schema.fields, T.StructField("n", T.LongType())])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["x", "y"])
        return pdf.assign(n=neighbours(pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64), pairs))

    return plain.groupBy(*MASK).applyInPandas(count, schema)


def drop_branch_points(skeleton: DataFrame) -> DataFrame:
    """MSK-7. Skeleton pixels whose 3 x 3 window holds over three pixels go."""
    return neighbour_count(skeleton).filter("n <= 3").drop("n")


def drop_short(skeleton: DataFrame, least: int = 10) -> DataFrame:
    """MSK-8. Segments of at least `least` pixels, labelled without gaps."""
    return components(skeleton, least=least)


def endpoints(skeleton: DataFrame) -> DataFrame:
    """MSK-9. Pixels with exactly one neighbour."""
    return neighbour_count(skeleton).filter("n = 2").drop("n")


def boundary(mask: DataFrame) -> DataFrame:
    """MSK-10. Pixels with one of their four neighbours unset."""
    return neighbour_count(mask, FOUR).filter("n < 4").drop("n")


def trim_map(cells: DataFrame, times: int = 2) -> DataFrame:
    """MSK-11. The measured area's outermost pixels are set to -1, `times` times over. A map is one group of one shuffle."""

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, value = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64), pdf["value"].to_numpy(float, na_value=np.nan)
        kept = np.flatnonzero((value != -1) & ~np.isnan(value))
        for _ in range(times):
            if len(kept):
                kept = kept[neighbours(x[kept], y[kept], FOUR) == 4]
        out = np.full(len(value), -1.0)
        out[kept] = value[kept]
        return pdf.assign(value=out)

    return cells.groupBy("image_id", "map").applyInPandas(trim, cells.schema)


def combine_classes(mask: DataFrame) -> DataFrame:
    """MSK-12. One class per pixel: disc over vein over artery."""
    rank = F.when(F.col("mask") == "disc", 3).when(F.col("mask") == "vein", 2).otherwise(1)
    return mask.groupBy("image_id", "x", "y").agg(F.max_by("mask", rank).alias("class"))


def argmax_class(prob: DataFrame, vessel: DataFrame) -> DataFrame:
    """MSK-13. Within the vessel mask the likelier of artery and vein; ties are arteries."""
    inside = prob.join(vessel.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi").filter(F.col("mask").isin("artery", "vein"))
    return inside.groupBy("image_id", "x", "y").agg(F.max_by("mask", F.struct("p", F.col("mask") == "artery")).alias("class"))


def vessel_union(binary: DataFrame, classes: DataFrame) -> DataFrame:
    """MSK-14. Binary vessels, arteries and veins together, without the disc."""
    at = ["image_id", "x", "y"]
    every = binary.select(*at).union(classes.filter(F.col("mask").isin("artery", "vein")).select(*at)).distinct()
    return every.join(classes.filter("mask = 'disc'").select(*at), at, "left_anti")


def threshold(prob: DataFrame, t: float) -> DataFrame:
    """MSK-15."""
    return prob.filter(F.col("p") > t)


def centroid(mask: DataFrame) -> DataFrame:
    """MSK-16. Truncated centroid of the largest region; an image without one has no row."""
    from .trace import largest_component

    return largest_component(mask).groupBy(*MASK).agg(F.avg("x").cast("int").alias("x"), F.avg("y").cast("int").alias("y"))


def marginal_peak(prob: DataFrame, k: int = 21, least: float = 0.1) -> DataFrame:
    """MSK-17. Where the row and column sums, smoothed by a triangle of k taps (reflected at the frame), peak.

    Below `least` the landmark is (0, 0). Ties, to nine decimals, go to the first position.
    """
    half = k // 2
    weight = 1 - F.abs(F.col("d")) / (half + 1)
    found = None
    for axis in ("x", "y"):
        sums = prob.groupBy(*MASK, F.col(axis).alias("at")).agg(F.sum("p").alias("s"))
        size = prob.groupBy(*MASK).agg((F.max(axis) + 1).alias("n"))
        spread = sums.join(size, MASK).withColumn("to", F.explode(F.array(F.col("at"), -1 - F.col("at"), 2 * F.col("n") - 1 - F.col("at"))))
        spread = spread.withColumn("d", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("at", F.col("to") + F.col("d")).filter("at >= 0 and at < n")
        smooth = spread.groupBy(*MASK, "at").agg((F.sum(F.col("s") * weight) / (half + 1)).alias("score"))
        best = smooth.groupBy(*MASK).agg(F.max_by("at", F.struct(F.round("score", 9), -F.col("at"))).alias(axis), F.max("score").alias(f"score_{axis}"))
        found = best if found is None else found.join(best, MASK)
    score = F.least("score_x", "score_y")
    return found.select(*MASK, *[F.when(score >= least, F.col(a)).otherwise(0).alias(a) for a in "xy"], score.alias("score"))


def disc_radius(mask: DataFrame) -> DataFrame:
    """MSK-18. A quarter of the axes' sum, truncated, of the mask's first region."""
    return region_props(components(mask)).filter("label = 1").select(*MASK, ((F.col("minor") + F.col("major")) / 4).cast("int").alias("radius"))


def disc_radius_line(mask: DataFrame, scan: DataFrame) -> DataFrame:
    """MSK-19. Distance from the disc's centre to the boundary pixel that the line to the fovea meets first."""
    edge = boundary(mask).select("image_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    way = scan.select("image_id", "disc_x", "disc_y", "fovea_x", "fovea_y").withColumn("steps", F.ceil(F.hypot(F.col("fovea_x") - F.col("disc_x"), F.col("fovea_y") - F.col("disc_y"))) + 1)
    way = way.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), "steps")))
    place = lambda a: F.round(F.col(f"disc_{a}") + (F.col(f"fovea_{a}") - F.col(f"disc_{a}")) * F.col("t") / F.col("steps")).cast("bigint")
    on_line = way.select("image_id", "disc_x", "disc_y", "t", place("x").alias("x"), place("y").alias("y"))
    hit = on_line.join(edge, ["image_id", "x", "y"])
    return hit.groupBy("image_id").agg(F.min_by(F.hypot(F.col("x") - F.col("disc_x"), F.col("y") - F.col("disc_y")), "t").alias("radius"))


def clip_to_region(vessel: DataFrame, region: DataFrame) -> DataFrame:
    """MSK-20. Vessel pixels inside the region."""
    return vessel.join(region.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")


def decode_labels(pixels: DataFrame, codebook: dict[int, str] | None = None) -> DataFrame:
    """SRC-6. Grey values to classes; every value above 0 is also `any`. With {255: name} binary masks are read."""
    codes = CODEBOOK if codebook is None else codebook
    name = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("gray"))
    return pixels.filter("gray > 0").withColumn("mask", F.explode(F.array_compact(F.array(name, F.lit("any"))))).select("image_id", "mask", "x", "y")

