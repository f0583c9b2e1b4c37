"""Cases whose results are known in closed form."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminar.functions.dimensions import VESSEL_FEATURES
from laminar.functions.nearest import nearest_point
from laminar.operators import batch, disc, intensity, maps, mask, meta, roi, shape, trace, vessel
from laminar.sources import files
from laminar.streaming import ingest


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def line(spark, ys, layer="ILM", image=1, bscan=0):
    return spark.createDataFrame([(image, bscan, layer, x, None if y is None else float(y)) for x, y in enumerate(ys)], "image_id long, bscan int, layer string, x int, y double")


def flat_slab(spark, n=768, top=100, bot=150):
    both = line(spark, [top] * n).union(line(spark, [bot] * n, "BM"))
    return trace.drop_missing(trace.pair_layers(both))


def pixels(spark, points, name="m", image=1):
    return spark.createDataFrame([(image, name, x, y) for x, y in points], "image_id long, mask string, x int, y int")


def grid(spark, value, n=64, holes=()):
    return spark.createDataFrame([(1, "retina", x, y, -1.0 if (x, y) in holes else float(value)) for x in range(n) for y in range(n)], "image_id long, map string, x int, y int, value double")


def pose(spark, eye="Right"):
    return spark.createDataFrame([(1, eye, 32, 32, 110.0, 0.0)], "image_id long, eye string, cx int, cy int, slo_scale double, angle double")


def test_flat_slab_thickness(spark):
    got = trace.thickness(flat_slab(spark).filter("pair = 'ILM_BM'"))
    assert {round(t, 6) for (t,) in values(got, "thickness")} == {193.5} and got.count() == 768


def test_pairs_and_custom_slab(spark):
    t = line(spark, [1] * 5).union(line(spark, [2] * 5, "RNFL")).union(line(spark, [3] * 5, "ELM")).union(line(spark, [4] * 5, "BM")).union(line(spark, [9] * 5, "CHORupper")).union(line(spark, [12] * 5, "CHORlower"))
    got = {p for (p,) in values(trace.pair_layers(t, ["RNFL_BM"]).select("pair").distinct(), "pair")}
    assert got == {"ILM_RNFL", "RNFL_ELM", "ELM_BM", "ILM_BM", "ILM_ELM", "RNFL_BM", "CHORupper_CHORlower"}


def test_interpolation_and_crop(spark):
    got = values(trace.interp_trace(line(spark, [0, None, 4, None, None, 10, 10])), "x", "y")
    assert got == [(0, 0), (1, 2), (2, 4), (3, 6), (4, 8), (5, 10)]
    ys = [5, 5, 9, 9, *[9] * 40, 9, 3, 3]
    assert sorted(x for (x,) in values(trace.smart_crop(line(spark, ys)), "x")) == list(range(2, 45))


def test_fill_round_trip(spark):
    filled = trace.fill_between(flat_slab(spark, 20))
    assert set(values(trace.extract_bounds(filled), "y_top", "y_bot")) == {(100, 149)}


def test_mask_to_trace(spark):
    m = spark.createDataFrame([(1, "r", x, y, 0.9) for x in range(60) for y in range(20, 31)] + [(1, "r", 100, 3, 0.9), (1, "r", 5, 60, 0.2)], "image_id long, mask string, x int, y int, p double")
    got = values(trace.mask_to_trace(m), "x", "y_top", "y_bot")
    assert len(got) == 58 and {(a, b) for _, a, b in got} == {(20, 30)}


def test_melt_and_widen(spark):
    wide = spark.createDataFrame([(1, 0, "ILM", 4, 0, 8, 9)], "image_id long, bscan int, layer string, x_0 int, x_1 int, x_2 int, x_3 int")
    long = trace.melt_traces(wide, ["x_0", "x_1", "x_2", "x_3"])
    assert values(long, "x", "y") == [(0, 4), (1, 6), (2, 8)]
    assert trace.widen_traces(long, 5).first()["y"] == [4, 6, 8, 0, 0]


def test_short_trace_fails_with_a_reason(spark):
    t = line(spark, [100] * 50).union(line(spark, [150] * 50, "BM"))
    fovea = spark.createDataFrame([(1, 0, 25, 100)], "image_id long, bscan int, px int, py int")
    got = roi.linescan_measure(t, fovea, 1500).filter("pair = 'ILM_BM'").first()
    assert (got["thickness"], got["subfoveal_thickness"], got["area"]) == (-1, -1, -1) and "short" in got["reason"]


def test_forced_roi_uses_the_ends(spark):
    t = line(spark, [100] * 50).union(line(spark, [150] * 50, "BM"))
    fovea = spark.createDataFrame([(1, 0, 25, 100)], "image_id long, bscan int, px int, py int")
    got = roi.linescan_measure(t, fovea, 1500, force=True).filter("pair = 'ILM_BM'").first()
    assert got["thickness"] == 193 and got["reason"] is None and got["area"] > 0


def test_perpendicular_thickness(spark):
    t = trace.stack_thickness(flat_slab(spark, 80).filter("pair = 'ILM_BM'"), 80, how="perpendicular")
    assert {round(v, 6) for (v,) in values(t, "thickness")} == {193.5}


def test_roi_of_a_flat_slab(spark):
    t = line(spark, [100] * 300).union(line(spark, [150] * 300, "BM"))
    fovea = spark.createDataFrame([(1, 0, 150, 100)], "image_id long, bscan int, px int, py int")
    got = roi.linescan_measure(t, fovea, 1000).filter("pair = 'ILM_BM'").first()
    assert (got["thickness"], got["subfoveal_thickness"], got["reason"]) == (193.0, 193.0, None) and got["area"] == pytest.approx(51 * 166 * 11.49 * 3.87e-6, abs=1e-6)
    n, distances = roi.lattice(1000)
    assert n == 175 and distances[1] == 2000 // 174


def test_roi_thickness_n(spark):
    slab = flat_slab(spark, 60).filter("pair = 'ILM_BM'")
    sampled = slab.filter("x in (20, 30)").withColumn("sample", F.col("x").cast("long"))
    assert set(values(roi.roi_thickness_n(slab, sampled), "thickness")) == {(194.0,)}


def test_components(spark):
    two = pixels(spark, [(0, 0), (1, 0), (2, 1), (0, 1), (1, 2), (10, 10), (10, 11), (11, 12)])
    sizes = sorted(r["count"] for r in mask.components(two).groupBy("label").count().collect())
    assert sizes == [3, 5] and trace.largest_component(two).count() == 5
    touch = pixels(spark, [(0, 0), (1, 1)])
    assert mask.components(touch).select("label").distinct().count() == 1 and mask.components(touch, 4).select("label").distinct().count() == 2
    spiral = pixels(spark, [(x, 0) for x in range(40)] + [(39, y) for y in range(40)] + [(x, 39) for x in range(40)] + [(0, y) for y in range(2, 40)] + [(x, 2) for x in range(37)])
    assert mask.components(spiral).select("label").distinct().count() == 1


def test_regions_and_morphology(spark):
    square = [(x, y) for x in range(20) for y in range(20)]
    m = pixels(spark, square)
    p = mask.region_props(mask.components(m)).first()
    assert (p["area"], p["cx"], p["cy"]) == (400, 9.5, 9.5) and p["major"] == pytest.approx(p["minor"]) and p["eccentricity"] == pytest.approx(0, abs=1e-6)
    assert mask.disc_radius(m).first()["radius"] == int((p["major"] + p["minor"]) / 4)
    assert mask.erode(m, mask.disk(1)).count() == 18 * 18 and mask.dilate(m, mask.disk(1)).count() == 400 + 80
    assert mask.boundary(m).count() == 76
    holed = pixels(spark, [q for q in square if q not in {(5, 5), (5, 6)}] + [(50, 50)])
    assert mask.filter_small(holed, 150, 10).count() == 400
    assert values(mask.centroid(m), "x", "y") == [(9, 9)]
    gap = pixels(spark, [(x, y) for x in range(60) for y in (0, 1, 2, 6, 7, 8)])
    assert mask.bridge_gaps(gap).count() > gap.count()


def test_skeleton_parts(spark):
    s = pixels(spark, [(x, 5) for x in range(20)] + [(10, 6), (10, 7)])
    assert mask.endpoints(pixels(spark, [(x, 5) for x in range(20)])).count() == 2
    assert mask.drop_branch_points(s).count() < s.count()
    assert mask.drop_short(pixels(spark, [(x, 5) for x in range(20)] + [(50, 50)]), 10).count() == 20


def test_disc_radius_along_line(spark):
    m = pixels(spark, [(x, y) for x in range(81) for y in range(81) if (x - 40) ** 2 + (y - 40) ** 2 <= 400])
    s = spark.createDataFrame([(1, 40, 40, 100, 40)], "image_id long, disc_x int, disc_y int, fovea_x int, fovea_y int")
    assert mask.disc_radius_line(m, s).first()["radius"] == pytest.approx(20, abs=1)


def test_marginal_peak(spark):
    m = pixels(spark, [(x, y) for x in range(30, 41) for y in range(50, 61)]).union(pixels(spark, [(99, 99)])).withColumn("p", F.lit(1.0))
    got = mask.marginal_peak(m).first()
    assert (got["x"], got["y"]) == (35, 55)
    assert mask.marginal_peak(m.withColumn("p", F.lit(0.001))).first()["x"] == 0


def test_constant_map(spark):
    placed = maps.etdrs_subfield(grid(spark, 7), pose(spark))
    got = maps.subfield_stats(placed, 110.0).collect()
    assert {r["mean"] for r in got} == {7.0} and {r["missing_percent"] for r in got if not r["subfield"].startswith("all")} == {0.0} and len(got) == 11


def test_hole_in_map(spark):
    holes = {(x, y) for x in range(30, 34) for y in range(30, 34)}
    cells = grid(spark, 7, holes=holes)
    placed = maps.etdrs_subfield(cells, pose(spark))
    stats = {r["subfield"]: r for r in maps.subfield_stats(placed, 110.0).collect()}
    assert stats["central"]["mean"] == 7 and stats["central"]["missing_percent"] > 0 and stats["all"]["mean"] == 6
    assert {r["subfield"]: r for r in maps.subfield_stats(placed, 110.0, fill=False).collect()}["central"]["mean"] < 7


def test_eye_mirror(spark):
    name = lambda eye: dict((((r["x"], r["y"])), r["subfield"]) for r in maps.etdrs_subfield(grid(spark, 1), pose(spark, eye)).filter("y = 32").collect())
    right, left = name("Right"), name("Left")
    assert right[44, 32] == "inner_nasal" and left[44, 32] == "inner_temporal" and right[32, 32] == left[32, 32] == "central"
    cols = lambda eye: {r["subfield"] for r in maps.square_subfield(grid(spark, 1), pose(spark, eye)).filter("x = 2 and y = 2").collect()}
    assert cols("Right") == {"1.1"} and cols("Left") == {"1.8"}


def test_rotation_by_zero_is_identity(spark):
    cells = grid(spark, 3, 16, {(4, 4)}).withColumn("value", F.when(F.col("value") == -1, -1.0).otherwise(F.col("x") + 100.0 * F.col("y")))
    p = spark.createDataFrame([(1, 0.0, 8.0, 8.0)], "image_id long, angle double, cx double, cy double")
    assert values(maps.rotate_map(cells, p, 16, 16), "x", "y", "value") == values(cells, "x", "y", "value")


def test_gaussian_keeps_constants(spark):
    got = maps.gaussian(grid(spark, 5, 32, {(3, 3)}), 2.0, 32, 32)
    assert {round(r["value"], 6) for r in got.collect()} == {5.0, -1.0}


def test_map_rows(spark):
    thick = spark.createDataFrame([(1, "retina", b, x, 10.0 * (b + 1)) for b in range(3) for x in range(8)], "image_id long, map string, bscan int, x int, value double")
    centre = spark.createDataFrame([(1, 8, 8)], "image_id long, cx int, n_x int")
    rows = maps.place_rows(thick, centre, 16)
    first = {r["x"]: (r["value"], r["edge"]) for r in rows.filter("bscan = 0").collect()}
    assert first[4] == (10.0, 10.0) and first[0] == (-1.0, 10.0)
    got = {r["y"]: r["value"] for r in maps.resample_rows(rows.select("image_id", "map", "bscan", "x", F.col("edge").alias("value")), 5).filter("x = 5").collect()}
    assert got == {0: 10, 1: 15, 2: 20, 3: 25, 4: 30}
    p = spark.createDataFrame([(1, 0.0, 8.0, 2.0)], "image_id long, angle double, cx double, cy double")
    built = {(r["x"], r["y"]): r["value"] for r in maps.build_map(thick, centre, p, 0.2, 16, 5).collect()}
    assert built[5, 4] == pytest.approx(10, rel=1e-4) and built[0, 0] == -1
    s = spark.createDataFrame([(1, 120.0, 12.0, 30, 61)], "image_id long, scale_z double, scale_x double, centre_slice int, n_bscans int")
    assert values(maps.map_geometry(s), "line_distance", "above", "below") == [(10.0, 30, 30)]


def test_map_extras(spark):
    s = spark.createDataFrame([(1, 32, 32, 110.0), (2, 10, 32, 110.0)], "image_id long, cx int, cy int, slo_scale double")
    assert [f for _, f in values(maps.grid_fits(s, 64), "image_id", "grid_fits")] == [True, False]
    acq = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0, 11), (2, 0, 0.0, 5.0, 10.0, 5.0, 11)], "image_id long, bscan int, start_x double, start_y double, end_x double, end_y double, n_x int")
    fovea = spark.createDataFrame([(1, 0, 3)], "image_id long, bscan int, fovea_x int")
    assert values(maps.fovea_on_localiser(acq, fovea), "image_id", "slo_x", "slo_y") == [(1, 3, 0), (2, 5, 5)]
    slabs = spark.createDataFrame([(1, "ILM_BM"), (1, "ILM_RNFL")], "image_id long, pair string")
    assert values(maps.select_maps(slabs), "map") == [("retina",)]
    v = maps.volume_measure(grid(spark, 7), pose(spark), 110.0)
    assert {r["mean"] for r in v.collect()} == {7.0} and {r["grid"] for r in v.collect()} == {"etdrs", "square"}


def test_circular_profile(spark):
    n = 64
    p = spark.createDataFrame([(1, x, float(x)) for x in range(n)], "image_id long, x int, value double")
    eye = spark.createDataFrame([(1, "Right")], "image_id long, eye string")
    at = lambda k: spark.createDataFrame([(1, k)], "image_id long, temporal_index int")
    assert values(disc.circular_shift(p, at(n // 2), n, eye), "x", "value") == values(p, "x", "value")
    assert dict(values(disc.circular_shift(p, at(0), n, eye), "x", "value"))[n // 2] == 0
    gap = p.withColumn("value", F.when(F.col("x").isin(0, 1, 63), None).otherwise(10.0))
    assert {v for _, v in values(disc.circular_fill(gap, n), "x", "value")} == {10.0}
    flat = p.withColumn("value", F.lit(4.0))
    assert {v for _, v in values(disc.circular_mean(flat, n), "x", "value")} == {4.0}
    means = dict(values(disc.sector_means(flat, n), "sector", "value"))
    assert means["All"] == 4 and means["N/T"] == 1 and len(means) == 8
    assert values(disc.temporal_default(eye, 64), "temporal_index") == [(32,)]
    m = pixels(spark, [(x, y) for x in range(20) for y in range(20)])
    s = spark.createDataFrame([(1, 9.5, 9.5)], "image_id long, circle_x double, circle_y double")
    assert disc.disc_offset(m, s).first()["offset_ratio"] == 0


def path(spark, cols, rows=None):
    rows = list(range(len(cols))) if rows is None else rows
    return spark.createDataFrame([(1, "artery", 7, k, r, c) for k, (r, c) in enumerate(zip(rows, cols, strict=True))], "image_id long, vessel_map string, path_id long, seq int, row int, col int")


def test_straight_and_zigzag(spark):
    straight = path(spark, [0] * 30)
    assert vessel.tortuosity_distance(straight).first()["tortuosity_distance"] == 1
    assert vessel.tortuosity_density(straight).first()["tortuosity_density"] == 0
    zigzag = vessel.inflections(path(spark, [k % 2 for k in range(10)]))
    assert [s for s, t in values(zigzag, "seq", "turn") if t] == list(range(1, 9))


def test_knudtson_and_ratio(spark):
    w = spark.createDataFrame([(1, v, "B", k, 10.0) for v, n in (("artery", 6), ("vein", 7)) for k in range(n)] + [(2, "artery", "B", k, 10.0) for k in range(5)], "image_id long, vessel_map string, zone string, path_id long, width double")
    e = vessel.knudtson(vessel.top_widths(w))
    got = {(r["image_id"], r["vessel_map"]): r["equivalent"] for r in e.collect()}
    for kind, c in (("artery", 0.88), ("vein", 0.95)):
        assert got[1, kind] == pytest.approx(c * c * 10 * math.sqrt(4 * c * c + 2))
    assert got[2, "artery"] == -1
    ratio = vessel.avr(e)
    assert values(ratio.filter("image_id = 2"), "AVR") == [(-1.0,)]
    m = spark.createDataFrame([(1, "artery", "B", "vessel_density", 0.1), (1, "artery", "whole", "vessel_density", 0.1)], "image_id long, vessel_map string, zone string, feature string, value double")
    nulled = vessel.null_zone_features(m)
    assert values(nulled, "zone", "value") == [("B", -1.0), ("whole", 0.1)]
    full = vessel.append_avr(nulled, ratio, ["vessel_density"])
    assert full.filter("vessel_map = 'artery-vein'").count() == 4 and set(vessel.split_zones(full)) == {"B", "C", "whole"}
    wide = shape.wide_vessel(full, ["vessel_density", "tortuosity_distance"], ["B", "whole"]).filter("image_id = 1").first().asDict()
    assert wide["vessel_density_artery_whole"] == 0.1 and wide["vessel_density_artery_B"] is None and wide["AVR_B"] > 0


def test_path_ordering(spark):
    s = spark.createDataFrame([(1, "artery", 1, r, c) for r, c in [(0, 0), (1, 1), (2, 1), (3, 2)]] + [(1, "artery", 2, r, c) for r, c in [(0, 10), (0, 11), (1, 10), (1, 11)]], "image_id long, vessel_map string, path_id long, row int, col int")
    origin = spark.createDataFrame([(1, 5, 5)], "image_id long, row0 int, col0 int")
    got = [(r, c) for _, r, c in values(vessel.order_paths(s, origin).filter("path_id = 1"), "seq", "row", "col")]
    assert got == [(3, 2), (2, 1), (1, 1), (0, 0)]
    assert vessel.order_paths(s, origin.filter("image_id = 9")).count() == 8


def test_boxes_and_width(spark):
    m = pixels(spark, [(x, y) for x in range(64) for y in range(16)])
    boxes = {r["size"]: r["boxes"] for r in vessel.box_count(m, [64, 32, 16]).collect()}
    assert boxes == {64: 1, 32: 2}
    tube = pixels(spark, [(x, y) for x in range(10, 15) for y in range(60)], "vessel")
    p = path(spark, [12] * 40, list(range(10, 50))).withColumn("distance", F.lit(3.0))
    got = vessel.vessel_width(vessel.vessel_edges(p), tube).first()
    assert got["width"] == pytest.approx(4, abs=0.5)
    lone = spark.createDataFrame([(1, 100.0, 100.0)], "image_id long, px double, py double")
    near = nearest_point(lone, pixels(spark, [(10, 10), (100, 160)]), ["image_id"]).first()
    assert (near["tx"], near["ty"]) == (100, 160)
    away = spark.createDataFrame([(1, 5000.0, 9000.0)], "image_id long, px double, py double")
    near = nearest_point(away, pixels(spark, [(10, 10), (100, 160)]), ["image_id"]).first()
    assert (near["tx"], near["ty"]) == (100, 160)


def test_vessel_driver(spark):
    """A tube of five pixels: one artery, too few for an equivalent."""
    p = path(spark, [12] * 40, list(range(40)))
    tube = pixels(spark, [(x, y) for x in range(10, 15) for y in range(40)], "artery")
    s = spark.createDataFrame([(1, 12, 0, 10)], "image_id long, disc_x int, disc_y int, disc_radius int")
    got = {(r["vessel_map"], r["zone"], r["feature"]): r["value"] for r in vessel.vessel_measure(p, tube, pixels(spark, [(12, y) for y in range(40)], "artery"), s, 64, 2.0).collect()}
    assert {k[1] for k in got} == {"whole", "B", "C"} and {k[2] for k in got} == {*VESSEL_FEATURES, "AVR"} and len(got) == 3 * 8 + 3 * 9
    assert got["artery", "whole", "average_global_calibre"] == 10 and got["artery", "B", "average_global_calibre"] == -1
    assert got["artery", "whole", "average_local_calibre"] == pytest.approx(8, abs=0.5) and got["artery", "C", "average_local_calibre"] is None
    assert got["artery", "B", "tortuosity_distance"] == 1 and got["artery", "whole", "tortuosity_density"] == 0
    assert got["artery", "B", "CRAE_Knudtson"] == got["artery-vein", "B", "AVR"] == got["artery-vein", "whole", "vessel_density"] == -1


def test_intensity(spark):
    px = spark.createDataFrame([(1, 0, x, y, 51.0 * (x % 5)) for x in range(20) for y in range(4)], "image_id long, bscan int, x int, y int, v double")
    assert {round(v, 6) for (v,) in values(intensity.normalise(px, 0, 1), "v")} == {0, 0.25, 0.5, 0.75, 1}
    assert max(v for (v,) in values(intensity.scale_255(px), "v")) == 0.8
    flat = px.withColumn("v", F.lit(0.5))
    assert {v for (v,) in values(intensity.shadow_compensate(flat, 5), "v")} == {0.5}


def test_meta(spark):
    s = spark.createDataFrame([(1, True, False, 0.0, 0.0, 1.0), (2, False, True, 3.0, 0.0, 1.0), (3, False, False, 3.0, 0.0, 1.0), (4, False, False, 0.0, 0.0, 1.0), (5, False, False, 0.0, 1.0, 0.0), (6, False, False, 0.0, 1.0, 1.0)], "image_id long, circular boolean, radial boolean, scale_z double, start_x_mm double, end_y_mm double")
    assert [p for _, p in values(meta.classify_pattern(s), "image_id", "pattern")] == ["Peripapillary", "Radial", "Ppole", "H-line", "V-line", "AV-line"]
    t = spark.createDataFrame([(1, 0.01149, 0.00387, 0.12, "x")], "image_id long, scale_x double, scale_y double, scale_z double, eye string")
    assert meta.scan_projection(t).first()["scale_x_um"] == pytest.approx(11.49)
    one = spark.createDataFrame([(1, 2.0)], "image_id long, roi_mm double")
    assert meta.effective_roi(one, 1200).first()["roi_um"] == 1500 and meta.effective_roi(one, 900).first()["roi_um"] == 900


def test_shapes(spark):
    m = spark.createDataFrame([(1, "retina", "central", "mean", 5.0), (1, "retina", "central", "volume", 0.1), (1, "vessel_ratio", "central", "mean", None)], "image_id long, map string, subfield string, feature string, value double")
    got = shape.wide_grid(m, ["retina", "vessel_ratio"], ["central"]).first().asDict()
    assert got == {"image_id": 1, "central_retina_[um]": 5.0, "central_retina_[mm3]": 0.1, "central_vessel_ratio": None}
    p = spark.createDataFrame([(1, "RNFL", "nasal", 80.0)], "image_id long, layer string, sector string, value double")
    assert shape.wide_peripapillary(p, ["RNFL"], ["nasal", "All"]).first().asDict() == {"image_id": 1, "RNFL_nasal": 80.0, "RNFL_All": None}
    d = spark.createDataFrame([("layer", "the slab"), ("other", "not there")], "column string, description string")
    assert values(shape.describe_columns(p, d), "column") == [("layer",)]
    o = spark.createDataFrame([(1, x) for x in ("CHORupper_CHORlower", "RNFL_BM", "GCL_IPL", "ILM_BM", "ILM_RNFL")], "image_id long, layer string")
    assert [r["layer"] for r in shape.order_maps(o).collect()] == ["ILM_BM", "ILM_RNFL", "GCL_IPL", "RNFL_BM", "CHORupper_CHORlower"]


def test_failed_scan_is_quarantined(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "image_id long")
    schema = T.StructType([T.StructField("v", T.DoubleType())])
    got = batch.safe_apply(df, lambda r: {"v": 1.0 / int(r["image_id"] - 2)}, schema)
    assert [s for _, s in values(got, "image_id", "status")] == ["OK", "OK", "FAILED", "OK", "OK"] and "ZeroDivision" in got.filter("status = 'FAILED'").first()["error"]


def test_scoring_and_routing(spark):
    df = spark.createDataFrame([(k, "Macula" if k % 2 else "Optic disc", k / 40) for k in range(40)], "image_id long, location string, q double")
    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("p", T.DoubleType())])

    def load():
        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            assert len(pdf) <= 16
            return pd.DataFrame({"image_id": pdf["image_id"], "p": pdf["q"]})

        return model

    got = batch.route_scorer(df, {"Macula": (load, 0.5), "Optic disc": (load, 0.25)}, schema)
    assert {i for (i,) in values(got, "image_id")} == {k for k in range(40) if k / 40 > (0.5 if k % 2 else 0.25)}


def test_edits(spark):
    m = pixels(spark, [(0, 0)], "disc").union(pixels(spark, [(1, 1)], "vein"))
    new, images = batch.apply_edits(m, pixels(spark, [(5, 5), (6, 6)], "disc"))
    assert values(new, "mask", "x") == [("disc", 5), ("disc", 6), ("vein", 1)] and values(images, "image_id") == [(1,)]


def test_files_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.vol", "b_ANGIO.vol", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"x" * 10)
    got = files.drop_angiography(files.catalogue(spark, str(tmp_path / "in")), "image_id")
    assert values(got, "image_id", "size") == [("a", 10)]
    root = str(tmp_path / "results")
    assert files.load_results(spark, root, ["Ppole"]).count() == 0
    res = spark.createDataFrame([(1, "Ppole", "ppole_etdrs", "retina", "mean", 1.0), (2, "H-line", "linescan", "retina", "mean", 2.0)], files.RESULT)
    files.write_results(res, root)
    assert values(files.load_results(spark, root, ["Ppole"]), "image_id") == [(1,)]
    files.write_results(res, root)
    assert values(files.load_results(spark, root, ["Ppole", "H-line"]), "image_id", "value") == [(1, 1.0), (2, 2.0)]
    files.write_results(res.filter("image_id = 2").withColumn("value", F.lit(5.0)), root, "again")
    res.withColumn("value", F.lit(7.0)).write.partitionBy("pattern", "kind").parquet(root + "/data/run=broken")  # without a note of its end
    assert values(files.load_results(spark, root, ["Ppole", "H-line"]), "image_id", "value") == [(1, 1.0), (2, 5.0)]
    for _ in range(2):
        files.write_per_image(res, str(tmp_path / "per"))
    assert files.committed(spark, str(tmp_path / "per")).count() == 2
    zone = lambda z, v: spark.createDataFrame([(1, z, v)], "image_id long, zone string, value double")
    files.replace_zone(zone("B", 1.0).union(zone("C", 2.0)), str(tmp_path / "zones"), 4)
    other = spark.createDataFrame([(i, "B", 4.0) for i in range(2, 200)], "image_id long, zone string, value double")
    files.replace_zone(other, str(tmp_path / "zones"), 4)
    for _ in range(2):
        files.replace_zone(zone("B", 9.0), str(tmp_path / "zones"), 4)
    kept = spark.read.parquet(str(tmp_path / "zones"))
    assert values(kept.filter("image_id = 1"), "zone", "value") == [("B", 9.0), ("C", 2.0)] and sorted(r["image_id"] for r in kept.filter("image_id > 1 AND value = 4").collect()) == list(range(2, 200)) and kept.count() == 200
    log = spark.createDataFrame([(2, 0, "INFO", "z"), (1, 1, "WARN", "y"), (1, 0, "INFO", "x")], "image_id long, seq int, level string, msg string")
    files.write_logs(log, str(tmp_path / "log"))
    assert [r["value"] for r in files.collect_logs(log).collect()] == ["1 [INFO] x", "1 [WARN] y", "2 [INFO] z"]


def test_ingest_resumes(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "check")}
    write = lambda ids: spark.createDataFrame([(i, float(i)) for i in ids], "image_id long, v double").write.mode("append").parquet(at["in"])
    run = lambda: ingest.stream_ingest(spark, at["in"], spark.read.parquet(at["in"]).schema, lambda b: b.withColumn("w", F.col("v") * 2), at["out"], at["check"])
    write([1, 2])
    run()
    run()
    write([3])
    run()
    assert values(spark.read.parquet(at["out"]), "image_id", "w") == [(1, 2.0), (2, 4.0), (3, 6.0)]


def test_totals_of_ratio_and_vessel_maps(spark):
    flat = grid(spark, 7).withColumn("value", F.when((F.col("x") + F.col("y")) % 4 == 0, -1.0).otherwise(0.4))
    both = flat.withColumn("map", F.lit("choroid_ratio")).unionByName(flat.withColumns({"map": F.lit("choroid_vessel"), "value": F.when(F.col("value") == -1, -1.0).otherwise(400.0)}))
    got = {(r["map"], r["grid"], r["subfield"]): r for r in maps.volume_measure(both, pose(spark), 110.0).collect()}
    for g in ("etdrs", "square"):
        ratio, filled, area = (got[m, g, s] for m, s in (("choroid_ratio", "all"), ("choroid_ratio", "all_filled"), ("choroid_vessel", "all_filled")))
        assert 0 < ratio["mean"] < 0.1 and ratio["volume"] is None and filled["mean"] == 0.4 and area["mean"] == 400
    cells = maps.etdrs_subfield(flat, pose(spark)).filter("subfield is not null").count()
    assert got["choroid_vessel", "etdrs", "all_filled"]["volume"] == round(cells * 400 * 110e-9, 3)
    total = maps.grid_total(maps.etdrs_subfield(flat, pose(spark)), 110.0, ratio=True).collect()[0]
    assert total["mean"] == got["choroid_ratio", "etdrs", "all"]["mean"] and total["volume"] is None


def test_annotations_are_measured_again(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "notes", "out", "check")}
    images, kinds = (lambda ids: spark.createDataFrame([(i, float(i)) for i in ids], "image_id long, v double")), "image_id long, shift double"
    note = lambda rows: spark.createDataFrame(rows, kinds).write.mode("append").parquet(at["notes"])
    measure = lambda b, n: b.join(n.groupBy("image_id").agg(F.max("shift").alias("shift")), "image_id", "left").select("image_id", (F.col("v") + F.coalesce("shift", F.lit(0.0))).alias("w"))

    def run():
        ingest.stream_remeasure(spark, at["in"], images([]).schema, at["notes"], spark.createDataFrame([], kinds).schema, measure, at["out"], at["check"])
        return values(ingest.latest(spark, at["out"]), "image_id", "w")

    images([1, 2]).write.parquet(at["in"])
    note([])
    assert run() == [(1, 1.0), (2, 2.0)]
    note([(2, 10.0), (3, 100.0)])  # image 3 hasn't come yet
    assert run() == [(1, 1.0), (2, 12.0)]
    images([3]).write.mode("append").parquet(at["in"])
    assert run() == [(1, 1.0), (2, 12.0), (3, 103.0)]
    assert run() == [(1, 1.0), (2, 12.0), (3, 103.0)]


def test_density_along_normals(spark):
    lines = spark.createDataFrame([(1, 0, "p", x, 10 + x, 40 + x) for x in range(60)], "image_id long, bscan int, pair string, x int, y_top long, y_bot long")
    region = trace.fill_between(lines)
    got = trace.column_density(region, region.filter("x % 2 = 0"), how="perpendicular", slab=lines).filter("x = 45").collect()[0]
    # The normal of a slope of 1 leaves (45, 55) by (-1, 1); it meets the lower line 15 columns further on.
    assert (got["region_px"], got["vessel_px"]) == (15, 7) and abs(got["density"] - 7 / 15) < 1e-9


def test_labels_of_random_pictures(spark):
    import random

    rnd = random.Random(2)
    for conn in (8, 4):
        points = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(420)}
        near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (conn == 8 or not dx or not dy)]
        label = {}
        for p in sorted(points, key=lambda q: (q[1], q[0])):
            if p not in label:
                n, todo = len(set(label.values())) + 1, [p]
                while todo:
                    q = todo.pop()
                    if q in points and q not in label:
                        label[q] = n
                        todo += [(q[0] + dx, q[1] + dy) for dx, dy in near]
        made = mask.components(pixels(spark, [*points, *list(points)[:5]]), conn)
        assert {(r["x"], r["y"]): r["label"] for r in made.collect()} == label and made.count() == len(points)


def test_footprints_distances_and_turns_of_random_pictures(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    for footprint in (mask.disk(3), mask.FOUR, [(0, 0), (2, -1), (4, 0), (5, 0)]):
        points = {tuple(p) for p in rnd.integers(0, 20, (150, 2)).tolist()}
        wide = {(x + dx, y + dy) for x, y in points for dx, dy in footprint}
        full = {(x, y) for x in range(-9, 30) for y in range(-9, 30) if all((x + dx, y + dy) in wide for dx, dy in footprint)}
        got = lambda df: {(r["x"], r["y"]) for r in df.collect()}
        assert got(mask.dilate(pixels(spark, list(points)), footprint)) == wide
        assert got(mask.close(pixels(spark, list(points)), footprint)) == full
    grid = rnd.random((17, 23)) < 0.9
    away = vessel.distances(grid)
    holes = np.argwhere(~grid)
    assert all(away[y, x] == np.sqrt(((holes - (y, x)) ** 2).sum(1).min()) for y, x in np.argwhere(grid))
    assert (vessel.distances(np.ones((4, 5), bool)) == 18).all() and vessel.distances(np.ones((768, 768), bool)).shape == (768, 768)
    cells = rnd.random((9, 9))
    assert np.allclose(maps.turned_grid(cells, 90.0, 4, 4), np.rot90(cells)) or np.allclose(maps.turned_grid(cells, 90.0, 4, 4), np.rot90(cells, -1))


def plain_walk(points, origin):
    """Nearest pixel left by looking at all of them."""
    left = set(points)
    near = lambda p: [q for q in ((p[0] + dr, p[1] + dc) for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))) if q in left]
    ends = sorted(p for p in left if len(near(p)) <= 1) or [min(left)]
    at, order = min(ends, key=lambda p: ((p[0] - origin[0]) ** 2 + (p[1] - origin[1]) ** 2, p)), []
    while True:
        order.append(at)
        left.discard(at)
        if not left:
            return order
        ahead = near(at)
        at = ahead[0] if ahead else min(left, key=lambda p: ((p[0] - at[0]) ** 2 + (p[1] - at[1]) ** 2, p))


def test_walks_of_random_and_long_paths():
    import random
    import time

    rnd = random.Random(3)
    for _ in range(60):
        side = rnd.choice([6, 40, 300])
        points = list({(rnd.randrange(side), rnd.randrange(side)) for _ in range(rnd.randint(1, 150))})
        rows, cols = map(list, zip(*points, strict=True))
        assert vessel.walk_pixels(rows, cols, (0, 5)) == plain_walk(points, (0, 5))
    comb = [(0, c) for c in range(50_000)] + [(r, c) for c in range(0, 50_000, 50) for r in range(1, 51)]
    began = time.time()
    assert len(vessel.walk_pixels(*map(list, zip(*comb, strict=True)), (0, 0))) == 100_000 and time.time() - began < 30
