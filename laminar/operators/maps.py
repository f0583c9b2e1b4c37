"""Macular maps (image_id, map, x, y, value; -1 is unmeasured): building, rotation, grids, statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dimensions import RINGS_UM, SQUARE_N, SQUARE_UM, SUMMARY, num, truncated
from ..functions.nearest import fill_groups

MAP = ["image_id", "map"]


def place_rows(thick: DataFrame, centre: DataFrame, n: int) -> DataFrame:
    """MAP-1. B-scan rows (image_id, map, bscan, x, value) shifted so that their own centre meets the acquisition's
    (image_id, cx, n_x), on n columns: value with -1 outside, and edge, the nearest measured value of the row."""
    moved = thick.join(centre, "image_id").select(*MAP, "bscan", (F.col("x") + F.col("cx") - F.expr("n_x div 2")).cast("int").alias("x"), "value").filter(F.col("x").between(0, n - 1))
    rows = moved.select(*MAP, "bscan").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = rows.join(moved, [*MAP, "bscan", "x"], "left")
    known = F.when(F.col("value") != -1, F.col("value"))
    order = W.partitionBy(*MAP, "bscan").orderBy("x")
    back, ahead = F.last(known, True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first(known, True).over(order.rowsBetween(0, W.unboundedFollowing))
    return full.withColumn("edge", F.coalesce(back, ahead)).withColumn("value", F.coalesce("value", num(-1)))


def map_geometry(scan: DataFrame) -> DataFrame:
    """MAP-2. Localiser rows between B-scans, and B-scans above and below the centre slice."""
    return scan.withColumns({"line_distance": F.col("scale_z") / F.col("scale_x"), "above": F.col("centre_slice"), "below": F.col("n_bscans") - 1 - F.col("centre_slice")})


def resample_rows(rows: DataFrame, height: int, how: str = "linear") -> DataFrame:
    """MAP-3. B-scan rows to `height` map rows: between the two B-scans about a row, or the nearest one."""
    last = F.max("bscan").alias("last")
    size = rows.groupBy(*MAP).agg(last)
    target = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("at", F.col("y") * F.col("last") / num(max(1, height - 1)))
    if how == "nearest":
        near = target.select(*MAP, "y", F.floor(F.col("at") + 0.5).cast("int").alias("bscan"))
        return near.join(rows, [*MAP, "bscan"]).select(*MAP, "x", "y", "value")
    lo = F.floor("at").cast("int")
    two = target.select(*MAP, "y", F.explode(F.array(F.struct(lo.alias("b"), (1 - (F.col("at") - lo)).alias("w")), F.struct((lo + 1).alias("b"), (F.col("at") - lo).alias("w")))).alias("p")).select(*MAP, "y", F.col("p.b").alias("bscan"), F.col("p.w").alias("w")).filter("w > 0")
    return two.join(rows, [*MAP, "bscan"]).groupBy(*MAP, "x", "y").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def blur(n: int, sigma: float) -> np.ndarray:
    """Weights of n sources (columns) at n targets: taps to four sigma, reflected at the frame."""
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    out = np.zeros((n, n))
    for d, w in zip(range(-radius, radius + 1), taps / taps.sum(), strict=True):
        at = np.arange(n) + d
        at = np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at))
        np.add.at(out, (at, np.arange(n)), w)
    return out


def smoothed(grid: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """grid (NaN: unmeasured) blurred by rows, then by columns; unmeasured cells don't count."""
    share = lambda v, w: np.divide(v, w, out=np.zeros_like(v), where=w > 0)
    weight = (~np.isnan(grid)).astype(float) @ across.T
    rows = share(np.nan_to_num(grid) @ across.T, weight)
    return share(down @ rows, down @ (weight > 0))


def gaussian(cells: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """MAP-4. Separable smoothing, taps to four sigma, reflected at the frame; unmeasured cells stay -1 and don't count.

    A map is one task's group: an image of width by height cells.
    """
    across, down = blur(width, sigma), blur(height, sigma)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, value = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["value"].to_numpy(float)
        some = (value != -1) & ~np.isnan(value)
        grid = np.full((height, width), np.nan)
        grid[y[some], x[some]] = value[some]
        grid = smoothed(grid, across, down)
        return pdf.assign(value=np.where(some, grid[y, x], -1.0))

    return cells.groupBy(*MAP).applyInPandas(smooth, cells.schema)


def place_on_localiser(cells: DataFrame, top: int, height: int) -> DataFrame:
    """MAP-5. Rows flipped, the first B-scan being the lowest, and moved down by top."""
    return cells.withColumn("y", (top + height - 1 - F.col("y")).cast("int"))


def acq_angle(acq: DataFrame) -> DataFrame:
    """MAP-6. Slope of each acquisition line in degrees; a vertical line has 90."""
    dx, dy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    return acq.withColumn("angle", F.when(dx == 0, 90.0).otherwise(F.degrees(F.atan(dy / dx))))


def fovea_on_localiser(acq: DataFrame, fovea: DataFrame) -> DataFrame:
    """MAP-7. The B-scan column of the fovea as a localiser point on its acquisition line, truncated; without a fovea the line's middle."""
    j = acq.join(fovea, ["image_id", "bscan"], "left")
    share = F.coalesce(F.col("fovea_x") / F.nullif(F.col("n_x") - 1, F.lit(0)), F.lit(0.5))
    return j.select("image_id", "bscan", *[truncated(F.col(f"start_{a}") + (F.col(f"end_{a}") - F.col(f"start_{a}")) * share).alias(f"slo_{a}") for a in "xy"])


def acq_centre(acq: DataFrame) -> DataFrame:
    """MAP-8. Truncated centroid of the quadrilateral between the first and the last line."""
    at = F.struct("start_x", "start_y", "end_x", "end_y")
    q = acq.groupBy("image_id").agg(F.min_by(at, "bscan").alias("a"), F.max_by(at, "bscan").alias("b"))
    px = [F.col("a.start_x"), F.col("a.end_x"), F.col("b.end_x"), F.col("b.start_x")]
    py = [F.col("a.start_y"), F.col("a.end_y"), F.col("b.end_y"), F.col("b.start_y")]
    cross = [px[k] * py[(k + 1) % 4] - px[(k + 1) % 4] * py[k] for k in range(4)]
    area = sum(cross[1:], cross[0]) / 2

    def part(p: list[Column]) -> Column:
        terms = [(p[k] + p[(k + 1) % 4]) * cross[k] for k in range(4)]
        mean = sum(p[1:], p[0]) / 4
        return truncated(F.when(F.abs(area) < 1e-6, mean).otherwise(sum(terms[1:], terms[0]) / (6 * area)))

    return q.select("image_id", part(px).alias("centre_x"), part(py).alias("centre_y"))


def turned_grid(grid: np.ndarray, angle: float, cx: float, cy: float) -> np.ndarray:
    """grid (NaN: unmeasured) read at the places turned by angle about (cx, cy): bilinear between measured cells, NaN where the nearest cell is none."""
    height, width = grid.shape
    a = np.radians(angle)
    dx, dy = np.arange(width)[None, :] - cx, np.arange(height)[:, None] - cy
    # Places are rounded so that turns by right angles fall on cells.
    sx, sy = np.round(cx + dx * np.cos(a) - dy * np.sin(a), 9), np.round(cy + dx * np.sin(a) + dy * np.cos(a), 9)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    frame = np.pad(grid, 1, constant_values=np.nan)
    read = lambda y, x: frame[np.clip(y + 1, 0, height + 1), np.clip(x + 1, 0, width + 1)]
    total, weight = np.zeros(grid.shape), np.zeros(grid.shape)
    for j in (0, 1):
        for i in (0, 1):
            w = (sx - x0 if i else 1 - (sx - x0)) * (sy - y0 if j else 1 - (sy - y0))
            v = read(y0 + j, x0 + i)
            known = ~np.isnan(v)
            total += np.where(known, v * w, 0)
            weight += np.where(known, w, 0)
    hit = ~np.isnan(read(np.floor(sy + 0.5).astype(int), np.floor(sx + 0.5).astype(int)))
    return np.where(hit, total / np.where(hit, weight, 1), np.nan)


def whole_map(table: pa.Table, grid: np.ndarray) -> pa.Table:
    """All cells of the map whose keys table holds; -1 where grid is NaN."""
    y, x = (c.ravel() for c in np.mgrid[: grid.shape[0], : grid.shape[1]].astype(np.int32))
    keys = [pa.repeat(table[c][0], grid.size) for c in MAP]
    return pa.Table.from_arrays([*keys, pa.array(x), pa.array(y), pa.array(np.nan_to_num(grid.ravel(), nan=-1.0))], names=[*MAP, "x", "y", "value"])


def whole_map_schema(cells: DataFrame) -> T.StructType:
    return T.StructType([*(cells.schema[c] for c in MAP), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("value", T.DoubleType())])


def as_pose(pose: DataFrame) -> DataFrame:
    return pose.select("image_id", *[F.col(c).cast("double").alias(f"pose_{c}") for c in ("angle", "cx", "cy")])


def pose_of(table: pa.Table) -> list[float]:
    return [table[f"pose_{c}"][0].as_py() for c in ("angle", "cx", "cy")]


def rotate_map(cells: DataFrame, pose: DataFrame, width: int, height: int) -> DataFrame:
    """MAP-9. Maps turned by -angle about (cx, cy) (pose: image_id, angle, cx, cy): each target cell is read at its
    turned place, bilinear between measured cells; it is -1 where the nearest source cell is unmeasured or outside.

    A map is one row, the list of its measured cells, and one group; unmeasured cells don't leave the aggregate.
    """
    value = F.col("value").cast("double")
    some = (value != -1) & ~F.isnan(value) & F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    gathered = cells.groupBy(*MAP).agg(F.collect_list(F.when(some, F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), value.alias("value")))).alias("some"))
    posed = gathered.join(as_pose(pose).hint("shuffle_hash"), "image_id")

    def turn(table: pa.Table) -> pa.Table:
        x, y, v = (c.to_numpy(zero_copy_only=False) for c in table["some"].combine_chunks().flatten().flatten())
        grid = np.full((height, width), np.nan)
        grid[y, x] = v
        return whole_map(table, turned_grid(grid, *pose_of(table)))

    return posed.groupBy(*MAP).applyInArrow(turn, whole_map_schema(cells))


def placed_grid(bscan: np.ndarray, x: np.ndarray, value: np.ndarray, null: np.ndarray, width: int, height: int) -> np.ndarray:
    """MAP-1 and MAP-3 within a map: the rows of its B-scans on `width` columns and `height` rows, the mask of the nearest B-scan upon their edges; NaN: unmeasured."""
    scans, row = np.unique(bscan, return_inverse=True)
    m, have = np.full((len(scans), width), -1.0), np.zeros((len(scans), width), bool)
    some = ~null
    m[row[some], x[some]] = value[some]
    have[row[some], x[some]] = value[some] != -1
    # The last measured value up to a column, else the first one behind it.
    places = np.where(have, np.arange(width), -1)
    at = np.maximum.accumulate(places, axis=1)
    at = np.where(at < 0, have.argmax(1)[:, None], at)
    known = have.any(1)
    edge = np.take_along_axis(m, at, 1)
    # Of the B-scans about a row those that exist count; one without a measured value takes its weight and gives none.
    where = np.arange(height) * int(scans[-1]) / max(1, height - 1)
    low = np.floor(where)
    total, weight, given = np.zeros((height, width)), np.zeros(height), np.zeros(height, bool)
    for b, w in ((low, 1 - (where - low)), (low + 1, where - low)):
        k = np.minimum(np.searchsorted(scans, b), len(scans) - 1)
        there = (scans[k] == b) & (w > 0)
        weight += np.where(there, w, 0)
        there &= known[k]
        total[there] += edge[k[there]] * w[there, None]
        given |= there
    near = np.floor(where + 0.5)
    k = np.minimum(np.searchsorted(scans, near), len(scans) - 1)
    good = ((scans[k] == near) & given)[:, None] & (m[k] != -1)
    return np.where(good, total / np.where(weight > 0, weight, 1)[:, None], np.nan)


def build_map(thick: DataFrame, centre: DataFrame, pose: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """MAP-10. B-scan thickness rows to a smoothed map on the localiser, turned to the acquisition angle.

    A map is one group from its rows to its turned cells: nothing but the rows is shuffled.
    """
    frame = centre.select("image_id", F.col("cx").alias("to_x"), "n_x").join(as_pose(pose), "image_id")
    at = (F.col("x") + F.col("to_x") - F.expr("n_x div 2")).cast("int").alias("x")
    moved = thick.join(frame, "image_id").select(*MAP, F.col("bscan").cast("long").alias("bscan"), at, F.col("value").cast("double").alias("value"), "pose_angle", "pose_cx", "pose_cy")
    moved = moved.filter(F.col("x").between(0, width - 1)).dropna(subset=[*MAP, "bscan"])
    across, down = blur(width, sigma), blur(height, sigma)

    def build(table: pa.Table) -> pa.Table:
        null = table["value"].is_null().to_numpy()
        grid = placed_grid(*(table[c].to_numpy() for c in ("bscan", "x", "value")), null, width, height)
        grid = np.where(np.isnan(grid), np.nan, smoothed(grid, across, down))
        return whole_map(table, turned_grid(grid[::-1], *pose_of(table)))

    return moved.groupBy(*MAP).applyInArrow(build, whole_map_schema(thick))


def density_rows(density: DataFrame, n: int, layer: str = "choroid") -> DataFrame:
    """Rows of the maps `<layer>_vessel` (areas) and `<layer>_ratio` (vascular index) of the densities of columns or normals (TRC-20): -1 in
    those of the n columns of a B-scan that have none."""
    each = F.explode(F.array(*[F.struct(F.lit(f"{layer}_{m}").alias("map"), F.col(c).cast("double").alias("value")) for m, c in (("vessel", "vessel_area"), ("ratio", "density"))])).alias("m")
    got = density.select("image_id", "bscan", "x", each).select("image_id", "m.map", "bscan", "x", "m.value")
    # A B-scan's row is completed in place: the densities are made once.
    rows = got.groupBy(*MAP, "bscan").agg(F.collect_list(F.struct("x", F.coalesce("value", num(-1)).alias("value"))).alias("got"))
    columns = F.sequence(F.lit(0), F.lit(n - 1))
    gone = F.transform(F.array_except(columns, F.col("got.x").cast("array<int>")), lambda x: F.struct(x.alias("x"), num(-1).alias("value")))
    there = F.transform(F.filter("got", lambda g: g["x"].between(0, n - 1)), lambda g: F.struct(g["x"].cast("int").alias("x"), g["value"].alias("value")))
    return rows.select(*MAP, "bscan", F.explode(F.concat(there, gone)).alias("p")).select(*MAP, "bscan", "p.x", "p.value")


def build_vessel_maps(density: DataFrame, n: int, centre: DataFrame, pose: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """MAP-10 of vessels: the area map and the ratio map on the localiser, built like a thickness map and in one pass."""
    return build_map(density_rows(density, n), centre, pose, sigma, width, height)


def select_maps(slab: DataFrame, all_layers: bool = False, custom: list[str] = ()) -> DataFrame:
    """MAP-11. Whole-depth slabs and asked ones, or all; whole-depth slabs get their map names."""
    chosen = slab if all_layers else slab.filter(F.col("pair").isin(*SUMMARY, *custom))
    return chosen.withColumn("map", F.col("pair")).replace(SUMMARY, subset=["map"]).drop("pair")


def in_circle(r: Column) -> Column:
    """MAP-12. Whether a cell is within r of the grid's centre (cx, cy)."""
    return F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= r


def turned(angle: Column) -> tuple[Column, Column]:
    a, dx, dy = F.radians(angle), F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a)


def side(u: Column, v: Column) -> Column:
    """Sector of a turned place (u, v)."""
    return F.when(F.abs(v) >= F.abs(u), F.when(v <= 0, "superior").otherwise("inferior")).when(u > 0, "right").otherwise("left")


def quadrant(angle: Column) -> Column:
    """MAP-13. Sector of a cell about (cx, cy), turned by angle: superior, right, inferior or left; y points down.

    Diagonals belong to superior and inferior.
    """
    return side(*turned(angle))


def by_eye(side: Column) -> Column:
    """Left and right as temporal and nasal: in a right eye the nose is on the right."""
    right = F.col("eye") == "Right"
    return F.when(side == "right", F.when(right, "nasal").otherwise("temporal")).when(side == "left", F.when(right, "temporal").otherwise("nasal")).otherwise(side)


def etdrs_subfield(cells: DataFrame, scan: DataFrame) -> DataFrame:
    """MAP-14. Subfield of each cell: central, inner_* and outer_* rings; null outside. scan: image_id, eye, cx, cy, slo_scale, angle."""
    # Radii and the angle's sine and cosine are made once an image, a cell's distance and turned place once a cell.
    r = [F.ceil(num(d) / F.col("slo_scale") / 2).cast("int").alias(f"__r{k}") for k, d in enumerate(RINGS_UM)]
    turn = F.radians(F.col("angle"))
    frame = scan.select("image_id", "eye", "cx", "cy", F.cos(turn).alias("__cos"), F.sin(turn).alias("__sin"), *r)
    j = cells.join(frame.hint("shuffle_hash"), "image_id")  # cells aren't sorted
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    placed = j.withColumns({"__away": F.hypot(dx, dy), "__u": dx * F.col("__cos") + dy * F.col("__sin"), "__v": dy * F.col("__cos") - dx * F.col("__sin")})
    where = by_eye(side(F.col("__u"), F.col("__v")))
    within = [F.col("__away") <= F.col(f"__r{k}") for k in range(3)]
    name = F.when(within[0], "central").when(within[1], F.concat(F.lit("inner_"), where)).when(within[2], F.concat(F.lit("outer_"), where))
    # Exploded, so that a filter by subfield doesn't work it out a second time within the join.
    return placed.select(*cells.columns, F.explode(F.array(name)).alias("subfield"))


def square_subfield(cells: DataFrame, scan: DataFrame, n: int = SQUARE_N, side_um: float = SQUARE_UM) -> DataFrame:
    """MAP-15. row.col of each cell in a turned n x n grid, counted from 1 at the top left; null outside.

    Edges are evenly spaced from the centre minus half the side, truncated. Left eyes are mirrored.
    """
    half = num(side_um) / F.col("slo_scale") / 2

    def edges(centre: str) -> Column:
        return F.array(*[truncated(F.col(centre) - half + 2 * half * F.lit(k) / n) for k in range(n + 1)])

    # Edges are made once an image and a cell's rounded place, a column of its own, once a cell.
    frame = scan.select("image_id", "eye", "cx", "cy", "angle", edges("cx").alias("edges_x"), edges("cy").alias("edges_y"))
    u, v = turned(F.col("angle"))
    placed = cells.join(frame.hint("shuffle_hash"), "image_id").withColumns({"place_x": F.round(u + F.col("cx"), 9), "place_y": F.round(v + F.col("cy"), 9)})
    place_x, place_y = F.col("place_x"), F.col("place_y")

    def bucket(place: Column, edges: Column) -> Column:
        return sum(((edges[k] <= place).cast("int") for k in range(1, n)), F.lit(1))

    def within(place: Column, edges: Column) -> Column:
        return (edges[0] <= place) & (place < edges[n])

    ex, ey = F.col("edges_x"), F.col("edges_y")
    col = bucket(place_x, ex)
    mirrored = F.when(F.col("eye") == "Right", col).otherwise(n + 1 - col)
    name = F.when(within(place_x, ex) & within(place_y, ey), F.concat_ws(".", bucket(place_y, ey), mirrored))
    return placed.withColumn("subfield", name).drop("eye", "cx", "cy", "angle", "edges_x", "edges_y", "place_x", "place_y")


def grid_fits(scan: DataFrame, size: int, side_um: float = SQUARE_UM) -> DataFrame:
    """MAP-16. Whether a grid lies within a frame of `size` pixels; where it doesn't, the whole frame is the subfield `all`."""
    half = num(side_um) / F.col("slo_scale") / 2
    inside = (F.col("cx") - half >= 0) & (F.col("cx") + half <= size) & (F.col("cy") - half >= 0) & (F.col("cy") + half <= size)
    return scan.withColumns({"grid_fits": inside, "warning": F.when(~inside, "grid leaves the frame: the whole image is measured")})


def inside(cells: DataFrame) -> DataFrame:
    return cells.filter("subfield is not null")


def share_missing(column: str = "value") -> Column:
    return F.bround(100 * F.avg(F.when(F.col(column) == -1, 1.0).otherwise(0.0)), 2).alias("missing_percent")


def mean_value(ratio: bool = False) -> Column:
    return (F.bround(F.avg("value"), 3) if ratio else truncated(F.avg("value")).cast("double")).alias("mean")


def volume_of(scale: float, vessel: bool = False) -> Column:
    return F.bround(F.sum("value") * num(scale * 1e-9 if vessel else scale * scale * 1e-9), 3).alias("volume")


def missing_share(cells: DataFrame) -> DataFrame:
    """MAP-17. Percentage of unmeasured cells of each subfield."""
    return inside(cells).groupBy(*MAP, "subfield").agg(share_missing())


def with_fill(cells: DataFrame) -> DataFrame:
    """Cells of subfields with `raw`, their value as it is, and as value that of the nearest measured cell of their own subfield.

    All subfields of a map are filled in one group, an image's map, dealt by one shuffle.
    """
    rows = inside(cells).withColumn("raw", F.col("value"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf["value"].mask(pdf["value"] == -1).to_numpy(float)
        out = fill_groups(pd.factorize(pdf["subfield"])[0], pdf["x"].to_numpy(), pdf["y"].to_numpy(), out)
        return pdf.assign(value=np.where(np.isnan(out), -1.0, out))

    return rows.groupBy(*MAP).applyInPandas(fill, rows.schema)


def nearest_fill(cells: DataFrame) -> DataFrame:
    """MAP-18. Unmeasured cells take the nearest measured value of their own subfield."""
    return with_fill(cells).drop("raw")


def subfield_mean(cells: DataFrame, ratio: bool = False) -> DataFrame:
    """MAP-19. Mean of each subfield, cut to an integer; of ratio maps to three decimals."""
    return inside(cells).groupBy(*MAP, "subfield").agg(mean_value(ratio))


def subfield_volume(cells: DataFrame, scale: float, vessel: bool = False) -> DataFrame:
    """MAP-20. Cubic millimetres of each subfield; vessel maps hold areas, so one scale factor goes."""
    return inside(cells).groupBy(*MAP, "subfield").agg(volume_of(scale, vessel))


def subfield_parts(cells: DataFrame, scale: float, ratio: bool = False, vessel: bool = False) -> DataFrame:
    """MAP-17, 19 and 20 of each subfield in one pass: missing_percent, mean and volume."""
    return inside(cells).groupBy(*MAP, "subfield").agg(share_missing(), mean_value(ratio), volume_of(scale, vessel))


def grid_total(cells: DataFrame, scale: float, ratio: bool = False, vessel: bool = False) -> DataFrame:
    """MAP-21. `all`: mean and volume over all subfields of the map as it is, unmeasured cells included; a ratio map has no volume."""
    volume = F.lit(None).cast("double").alias("volume") if ratio else volume_of(scale, vessel)
    return inside(cells).groupBy(*MAP).agg(F.lit("all").alias("subfield"), mean_value(ratio), volume)


def clip_value(cells: DataFrame, exact: bool = True) -> DataFrame:
    """MAP-22. 99.5 % quantile of the measured cells; the approximate form keeps a sketch instead of all values."""
    measured = F.when(F.col("value") != -1, F.col("value"))
    q = F.percentile(measured, 0.995) if exact else F.percentile_approx(measured, 0.995, 10_000)
    return cells.groupBy(*MAP).agg(q.alias("clip_value"))


def filled_sums(placed: DataFrame, grids: dict[str, str]) -> DataFrame:
    """Sums of each subfield (MAP, grid, subfield, filled, raw, n, gone) of all grids (name: column of subfields): filled as with_fill does it.

    A map is one group for all grids, and only its sums leave it.
    """
    rows = placed.select(*MAP, "x", "y", "value", *grids.values())
    schema = T.StructType([*(placed.schema[c] for c in MAP), *(T.StructField(c, T.StringType()) for c in ("grid", "subfield")), *(T.StructField(c, T.DoubleType()) for c in ("filled", "raw")), *(T.StructField(c, T.LongType()) for c in ("n", "gone"))])

    def sums(table: pa.Table) -> pa.Table:
        x, y, raw = (table[c].to_numpy() for c in ("x", "y", "value"))
        known = np.where((raw == -1) | np.isnan(raw), np.nan, raw)
        made: list[tuple] = []
        for grid, column in grids.items():
            codes = table[column].combine_chunks().dictionary_encode()
            names = codes.dictionary.to_pylist()
            code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(code >= 0)
            code = code[at]
            full = fill_groups(code, x[at], y[at], known[at])
            total = lambda w: np.bincount(code, w, len(names))  # noqa: E731, B023
            parts = total(np.where(np.isnan(full), -1.0, full)), total(np.nan_to_num(raw[at])), total(None), total(raw[at] == -1)
            made += [(grid, name, float(f), float(r), int(n), int(g)) for name, f, r, n, g in zip(names, *parts, strict=True)]
        keys = [pa.repeat(table[c][0], len(made)) for c in MAP]
        return pa.Table.from_arrays([*keys, *(pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())))], names=schema.names)

    return rows.groupBy(*MAP).applyInArrow(sums, schema)


def stats_by_kind(placed: DataFrame, scale: float, fill: bool, kind: Column, grids: dict[str, str]) -> DataFrame:
    """Mean, volume and missing share by subfield, `all` and, when filling, `all_filled`, of each grid (name: column of subfields), for maps of
    the kind thickness, vessel or ratio.

    Cells are shuffled once; behind that only sums by subfield are.
    """
    if fill:
        sums = filled_sums(placed, grids)
    else:
        each = placed.withColumn("g", F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.col(c).alias("subfield")) for g, c in grids.items()])))
        at = inside(each.select(*MAP, "g.grid", "g.subfield", "value"))
        sums = at.groupBy(*MAP, "grid", "subfield").agg(F.sum("value").alias("filled"), F.sum("value").alias("raw"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == -1).alias("gone"))
    none = F.lit(None).cast("double")
    part = F.struct("subfield", F.col("filled").alias("total"), "n", F.bround(100 * (F.col("gone") / F.col("n")), 2).alias("missing_percent"))
    over_all = [F.struct(F.lit(name).alias("subfield"), F.sum(c).alias("total"), F.sum("n").alias("n"), none.alias("missing_percent")) for name, c in (("all", "raw"), ("all_filled", "filled"))[: 1 + fill]]
    each = sums.groupBy(*MAP, "grid").agg(F.concat(F.collect_list(part), F.array(*over_all)).alias("parts"))  # a grid has few subfields
    each = each.select(*MAP, "grid", F.explode("parts").alias("p")).select(*MAP, "grid", "p.*").withColumn("kind", kind)
    ratio, mean = F.col("kind") == "ratio", F.col("total") / F.col("n")
    volume = lambda vessel: F.bround(F.col("total") * num(scale * 1e-9 if vessel else scale * scale * 1e-9), 3)
    value = F.when(ratio, F.bround(mean, 3)).otherwise(truncated(mean).cast("double")).alias("mean")
    return each.select(*MAP, "subfield", value, F.when(ratio, none).when(F.col("kind") == "vessel", volume(True)).otherwise(volume(False)).alias("volume"), "missing_percent", "grid")


def subfield_stats(cells: DataFrame, scale: float, fill: bool = True, ratio: bool = False, vessel: bool = False) -> DataFrame:
    """MAP-23. Mean, volume and missing share by subfield with `all` and `all_filled`; without filling, -1 cells take part."""
    return stats_by_kind(cells, scale, fill, F.lit("ratio" if ratio else "vessel" if vessel else "thickness"), {"one": "subfield"}).drop("grid")


def map_kind(name: Column) -> Column:
    """ratio (means to three decimals, no volume), vessel (areas, which one scale factor makes a volume of) or thickness."""
    return F.when(name.rlike("ratio|index"), "ratio").when(name.contains("vessel"), "vessel").otherwise("thickness")


def volume_measure(cells: DataFrame, scan: DataFrame, scale: float, fill: bool = True, kind: Column | None = None) -> DataFrame:
    """MAP-24. Every map on both grids: (image_id, grid, map, subfield, mean, volume, missing_percent). `kind`: by the map's name unless given."""
    kind = map_kind(F.col("map")) if kind is None else kind
    placed = square_subfield(etdrs_subfield(cells, scan).withColumnRenamed("subfield", "etdrs"), scan).withColumnRenamed("subfield", "square")
    return stats_by_kind(placed, scale, fill, kind, {"etdrs": "etdrs", "square": "square"})
