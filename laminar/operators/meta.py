"""Scan metadata rules: projections and predicates on one row per scan, and small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import CHOROID, ROI_UM, UNITS, layer_rank, num

NEAR = 1e-3


def classify_pattern(scan: DataFrame) -> DataFrame:
    """META-1. Circular scans, volumes by their line layout, then lines by where they start and end."""
    near = lambda c: F.abs(F.col(c)) <= NEAR
    line = F.when(near("start_x_mm"), "H-line").when(near("end_y_mm"), "V-line").otherwise("AV-line")
    volume = F.when(F.col("radial"), "Radial").otherwise("Ppole")
    return scan.withColumn("pattern", F.when(F.col("circular"), "Peripapillary").when(F.col("scale_z") != 0, volume).otherwise(line))


def laterality(scan: DataFrame) -> DataFrame:
    """META-2. OD is right, OS is left, anything else unknown."""
    return scan.withColumn("eye", F.when(F.col("eye") == "OD", "Right").when(F.col("eye") == "OS", "Left"))


def quality(bscan_meta: DataFrame) -> DataFrame:
    """META-3. Mean and population deviation of the B-scans' quality."""
    return bscan_meta.groupBy("image_id").agg(F.avg("quality").alias("quality_mean"), F.stddev_pop("quality").alias("quality_std"))


def acquisition_px(bscan_meta: DataFrame, scan: DataFrame) -> DataFrame:
    """META-4. End points of acquisition lines in localiser pixels; the end's x is one less."""
    s = scan.select("image_id", "slo_res", (F.col("scale_x") * F.col("slo_res") / 1000).alias("fov_mm"))
    px = lambda c: F.col("slo_res") * F.col(c) / F.col("fov_mm")
    return bscan_meta.join(s, "image_id").select("image_id", "bscan", px("start_x_mm").alias("start_x"), px("start_y_mm").alias("start_y"), (px("end_x_mm") - 1).alias("end_x"), px("end_y_mm").alias("end_y"))


def fov(scan: DataFrame) -> DataFrame:
    """META-5. Side of the localiser's field, in the scale's unit."""
    return scan.withColumn("field_of_view", F.col("scale_x") * F.col("slo_res"))


def roi_mm(bscan_meta: DataFrame, circular: Column) -> DataFrame:
    """META-6. Length of each acquisition line: end point distance, or the circle's circumference from its radius in x."""
    dx, dy = F.col("end_x_mm") - F.col("start_x_mm"), F.col("end_y_mm") - F.col("start_y_mm")
    return bscan_meta.withColumn("roi_mm", F.when(circular, 2 * F.pi() * F.abs(dx)).otherwise(F.hypot(dx, dy)))


def scan_projection(scan: DataFrame) -> DataFrame:
    """META-8. Scales in micron per pixel under their result names; internal columns dropped."""
    keep = scan.drop("circle_x", "circle_y", "circle_radius", "failed")
    return keep.withColumns({c: F.col(c) * 1e3 for c in ("scale_x", "scale_y", "scale_z") if c in keep.columns}).withColumnsRenamed({"scale_x": "scale_x_um", "scale_y": "scale_y_um", "scale_z": "scale_z_um"})


def layer_availability(trace: DataFrame) -> DataFrame:
    """META-9. Segmented layers of a scan and what kind of segmentation that is: 2 layers, all 17, or other."""
    by_layer = trace.groupBy("image_id", "layer").agg(F.bool_or(F.col("y").isNotNull()).alias("present"))
    kind = F.when(F.col("n_layers") == 2, "two").when(F.col("n_layers") == 17, "all").otherwise("other")
    return by_layer.groupBy("image_id").agg(F.count(F.when(F.col("present"), 1)).alias("n_layers"), F.array_sort(F.collect_set(F.when(F.col("present"), F.col("layer")))).alias("layers")).withColumn("segmentation", kind)


def layer_fallback(slab: DataFrame) -> DataFrame:
    """META-10. Where over half of the B-scans lack ILM_RNFL, only ILM_BM is kept."""
    has = F.bool_or(F.col("pair") == "ILM_RNFL")
    per_scan = slab.groupBy("image_id", "bscan").agg(has.alias("has"))
    few = per_scan.groupBy("image_id").agg((F.count(F.when(~F.col("has"), 1)) > F.floor(F.count("*") / 2)).alias("fallback"))
    return slab.join(few, "image_id").filter(~F.col("fallback") | (F.col("pair") == "ILM_BM")).drop("fallback")


def effective_roi(scan: DataFrame, distance_um: float) -> DataFrame:
    """META-11. The asked distance, or the default where twice that is longer than the scan."""
    return scan.withColumn("roi_um", F.when(2 * num(distance_um) > 1000 * F.col("roi_mm"), F.lit(ROI_UM)).otherwise(F.lit(int(distance_um))))


def normalise_slabs(requests: DataFrame) -> DataFrame:
    """META-13. Slab requests `A_B`: unknown and choroid layers dropped, anatomical order, no doubles."""
    at = requests.select(F.split("pair", "_").alias("p")).filter(F.size("p") == 2)
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    ranked = at.select(a.alias("a"), b.alias("b"), layer_rank(a).alias("ra"), layer_rank(b).alias("rb"))
    good = ranked.filter((F.col("ra") > 0) & (F.col("rb") > 0) & (F.col("ra") != F.col("rb")) & ~F.col("a").isin(*CHOROID) & ~F.col("b").isin(*CHOROID))
    swap = F.col("ra") > F.col("rb")
    return good.select(F.concat_ws("_", F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))).alias("pair")).distinct()


def check_scale(scan: DataFrame) -> DataFrame:
    """META-14. Localiser scale outside 3 to 20 micron per pixel is unusable: no scale, unit px."""
    good = F.col("slo_scale").between(3, 20)
    return scan.withColumns({"unit": F.when(good, "um").otherwise("px"), "slo_scale": F.when(good, F.col("slo_scale"))})


def infer_location(scan: DataFrame) -> DataFrame:
    """META-15. A disc well inside the image makes it a disc scan."""
    inside = (F.col("disc_x") > 0.1 * F.col("slo_res")) & (F.col("disc_x") < 0.9 * F.col("slo_res"))
    return scan.withColumn("location", F.when(inside, "Optic disc").otherwise("Macula"))


def infer_eye(scan: DataFrame, mask: DataFrame) -> DataFrame:
    """META-16. The given eye; else the disc lies nasal of the fovea; else the disc's side, 5 % about the middle
    excluded; else the half with more vessel pixels. Right eyes have the disc on the right."""
    half = mask.join(scan.select("image_id", "slo_res"), "image_id").groupBy("image_id").agg(F.count_if(F.col("x") >= F.col("slo_res") / 2).alias("right"), F.count_if(F.col("x") < F.col("slo_res") / 2).alias("left"))
    side = lambda right: F.when(right, "Right").otherwise("Left")
    fovea, disc, n = F.col("fovea_x") + F.col("fovea_y") > 0, F.col("disc_x") + F.col("disc_y") > 0, F.col("slo_res")
    by_disc = F.when(disc & (F.abs(F.col("disc_x") - n / 2) > 0.05 * n), side(F.col("disc_x") > n / 2))
    found = F.coalesce(F.when(F.col("eye").isin("Right", "Left"), F.col("eye")), F.when(fovea & disc, side(F.col("disc_x") > F.col("fovea_x"))), by_disc, F.when(F.col("right").isNotNull(), side(F.col("right") >= F.col("left"))))
    return scan.join(half, "image_id", "left").withColumn("eye", found).drop("right", "left")


def landmark_flags(scan: DataFrame) -> DataFrame:
    """META-17. (0, 0) stands for a landmark that wasn't found."""
    return scan.withColumns({"missing_fovea": F.col("fovea_x") + F.col("fovea_y") == 0, "missing_disc": F.col("disc_x") + F.col("disc_y") == 0})


def measurement_flags(measurement: DataFrame) -> DataFrame:
    """META-18. Whether any thickness failed, for retinal and for choroidal layers."""
    failed = (F.col("feature") == "thickness") & (F.col("value") == -1)
    choroid = F.col("layer").startswith("CHOR")
    return measurement.groupBy("image_id").agg(F.bool_or(failed & ~choroid).alias("missing_retinal_oct_measurements"), F.bool_or(failed & choroid).alias("missing_choroid_oct_measurements"))


def disc_warning(scan: DataFrame, limit: float = 15.0) -> DataFrame:
    """META-19. Offset of the scan circle as a share of the disc's diameter, and whether it is too large."""
    return scan.withColumn("offset_percent", 100 * F.col("offset_px") / (2 * F.col("disc_radius"))).withColumn("off_centre", F.col("offset_percent") > limit)


def radial_angles(scan: DataFrame) -> DataFrame:
    """META-20. Angle of each B-scan of a radial scan, truncated."""
    return scan.select("image_id", F.explode(F.sequence(F.lit(0), F.col("n_bscans") - 1)).alias("bscan"), "n_bscans").select("image_id", "bscan", F.expr("cast(90 - bscan * 360 / (2.0D * n_bscans) as int)").alias("angle"))


def with_units(df: DataFrame) -> DataFrame:
    """META-21. Constant unit columns."""
    return df.withColumns({f"{k}_units": F.lit(v) for k, v in UNITS.items()})


def pick_fovea_slice(scores: DataFrame) -> DataFrame:
    """META-22. The B-scan with the highest fovea score and the fovea there; ties go to the lowest B-scan."""
    best = F.max_by(F.struct("bscan", "fovea_x", "fovea_y", "score"), F.struct("score", -F.col("bscan")))
    return scores.groupBy("image_id").agg(best.alias("best")).select("image_id", "best.*")
