"""Registered queries, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import LAYERS
from ..operators import disc, intensity, maps, mask, meta, roi, shape, trace, vessel
from ..sources import files, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


SLAB = f"""{views.TRACE}, slab AS (
  SELECT a.image_id, a.bscan, a.layer || '_' || b.layer AS pair, a.x, CAST(trunc(a.y) AS BIGINT) AS y_top, CAST(trunc(b.y) AS BIGINT) AS y_bot
  FROM trace a JOIN trace b USING (image_id, bscan, x)
  WHERE (a.layer, b.layer) IN (('ILM','RNFL'), ('RNFL','ELM'), ('ELM','BM'), ('ILM','BM'), ('ILM','ELM')) AND a.y IS NOT NULL AND b.y IS NOT NULL)"""


def slab(spark: SparkSession, sf: str) -> DataFrame:
    return trace.drop_missing(trace.pair_layers(views.trace(spark, sf)))


# ---- traces -----------------------------------------------------------------


@query(f"""WITH {SLAB}, t AS (SELECT image_id, pair, (y_bot - y_top) * CAST(3.87 AS DOUBLE) AS th FROM slab),
m AS (SELECT image_id, CASE pair WHEN 'ILM_BM' THEN 'retina' WHEN 'ILM_ELM' THEN 'inner_retina' WHEN 'ELM_BM' THEN 'outer_retina' ELSE pair END AS layer, round(avg(th), 6) AS v FROM t GROUP BY 1, 2)
SELECT image_id, max(CASE WHEN layer = 'retina' THEN v END) AS retina, max(CASE WHEN layer = 'inner_retina' THEN v END) AS inner_retina,
 max(CASE WHEN layer = 'outer_retina' THEN v END) AS outer_retina, max(CASE WHEN layer = 'ILM_RNFL' THEN v END) AS "ILM_RNFL", max(CASE WHEN layer = 'RNFL_ELM' THEN v END) AS "RNFL_ELM"
FROM m GROUP BY 1""")
def trc_thickness_by_scan(spark, sf):
    t = trace.thickness(slab(spark, sf)).groupBy("image_id", F.col("pair").alias("layer")).agg(F.round(F.avg("thickness"), 6).alias("value"))
    named = shape.rename_layers(t).withColumnRenamed("layer", "feature")
    return shape.pivot_features(named, ["image_id"], ["retina", "inner_retina", "outer_retina", "ILM_RNFL", "RNFL_ELM"])


@query(f"WITH {SLAB} SELECT * FROM slab")
def trc_slabs(spark, sf):
    return slab(spark, sf)


INTERP = f"""{views.TRACE}, known AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM trace WHERE y IS NOT NULL WINDOW w AS (PARTITION BY image_id, bscan, layer ORDER BY x)),
interp AS (SELECT image_id, bscan, layer, CAST(pos AS INT) AS x, CAST(trunc(y + (pos - x) * (y2 - y) / (x2 - x)) AS BIGINT) AS y
FROM (SELECT *, unnest(range(x, x2)) AS pos FROM known WHERE x2 IS NOT NULL))"""


@query(f"WITH {INTERP} SELECT * FROM interp")
def trc_interpolated(spark, sf):
    return trace.interp_trace(views.trace(spark, sf))


@query(f"""WITH {INTERP}, s AS (SELECT *, hypot_ FROM (SELECT *, sqrt(((x - lag(x) OVER w) * CAST(11.49 AS DOUBLE))**2 + ((y - lag(y) OVER w) * CAST(3.87 AS DOUBLE))**2) AS hypot_ FROM interp WINDOW w AS (PARTITION BY image_id, bscan, layer ORDER BY x)))
SELECT image_id, bscan, layer, round(coalesce(sum(hypot_), 0), 6) AS length_um FROM s GROUP BY 1, 2, 3""".replace("s AS (SELECT *, hypot_ FROM", "s AS (SELECT * FROM"))
def trc_curve_length(spark, sf):
    return trace.curve_length(trace.interp_trace(views.trace(spark, sf))).select("image_id", "bscan", "layer", *r6("length_um"))


@query(f"""WITH {views.TRACE}, p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image_id, bscan, layer) AS n, abs(lead(y) OVER w - y) > 60 AS jump FROM trace WHERE y IS NOT NULL WINDOW w AS (PARTITION BY image_id, bscan, layer ORDER BY x)),
c AS (SELECT *, max(CASE WHEN jump AND i < 20 THEN i END) OVER q AS l, min(CASE WHEN jump AND i > n - 20 THEN i END) OVER q AS r FROM p WINDOW q AS (PARTITION BY image_id, bscan, layer))
SELECT image_id, bscan, layer, x, y FROM c WHERE i > coalesce(l, 0) AND i <= coalesce(r, n)""")
def trc_smart_crop(spark, sf):
    return trace.smart_crop(views.trace(spark, sf), 20, 60)


@query(f"""WITH {views.TRACE}, s AS (SELECT a.image_id, a.bscan, 'ILM_BM' AS pair, a.x, a.y AS y_top, b.y AS y_bot FROM trace a JOIN trace b USING (image_id, bscan, x) WHERE a.layer = 'ILM' AND b.layer = 'BM'),
e AS (SELECT image_id, bscan, greatest(min(CASE WHEN y_top IS NOT NULL THEN x END), min(CASE WHEN y_bot IS NOT NULL THEN x END)) AS lo, least(max(CASE WHEN y_top IS NOT NULL THEN x END), max(CASE WHEN y_bot IS NOT NULL THEN x END)) AS hi FROM s GROUP BY 1, 2)
SELECT s.* FROM s JOIN e USING (image_id, bscan) WHERE x >= lo AND x < hi""")
def trc_aligned(spark, sf):
    return trace.align(trace.pair_layers(views.trace(spark, sf)).filter("pair = 'ILM_BM'"))


@query(f"""WITH {SLAB}, px AS (SELECT image_id, bscan, pair AS mask, x, unnest(range(y_top, y_bot)) AS y FROM slab WHERE pair = 'ILM_RNFL')
SELECT image_id, mask, x, min(y) AS y_top, max(y) AS y_bot FROM px GROUP BY 1, 2, 3""")
def trc_fill_and_bounds(spark, sf):
    return trace.extract_bounds(trace.fill_between(slab(spark, sf).filter("pair = 'ILM_RNFL'")))


@query(f"""WITH {views.TRACE} SELECT image_id, bscan, layer, list(coalesce(CAST(trunc(y) AS BIGINT), 0) ORDER BY x) AS y FROM trace GROUP BY 1, 2, 3""")
def trc_widened(spark, sf):
    return trace.widen_traces(views.trace(spark, sf), 64)


@query(f"""WITH {SLAB}, lat AS (SELECT DISTINCT image_id, bscan, pair FROM slab)
SELECT image_id, bscan, pair, CAST(l.x AS INT) AS x, round(coalesce((y_bot - y_top) * CAST(3.87 AS DOUBLE), -1), 6) AS thickness
FROM (SELECT *, unnest(range(64)) AS x FROM lat) l LEFT JOIN slab USING (image_id, bscan, pair, x)""")
def trc_stack_thickness(spark, sf):
    return trace.stack_thickness(slab(spark, sf), 64).select("image_id", "bscan", "pair", "x", *r6("thickness"))


@query(f"""WITH {SLAB}, reg AS (SELECT image_id, bscan, x, unnest(range(y_top, y_bot)) AS y FROM slab WHERE pair = 'ILM_RNFL')
SELECT image_id, bscan, x, count(*) AS region_px, count(CASE WHEN (x * 7 + y) % 3 = 0 THEN 1 END) AS vessel_px,
 round(count(CASE WHEN (x * 7 + y) % 3 = 0 THEN 1 END) / count(*), 6) AS density, round(count(CASE WHEN (x * 7 + y) % 3 = 0 THEN 1 END) * (CAST(11.49 AS DOUBLE) * CAST(3.87 AS DOUBLE)), 6) AS vessel_area
FROM reg GROUP BY 1, 2, 3""")
def trc_column_density(spark, sf):
    region = trace.fill_between(slab(spark, sf).filter("pair = 'ILM_RNFL'"))
    return trace.column_density(region, region.filter("(x * 7 + y) % 3 = 0")).select("image_id", "bscan", "x", "region_px", "vessel_px", *r6("density", "vessel_area"))


@query(f"""WITH {INTERP}, ix AS (SELECT *, row_number() OVER (PARTITION BY image_id, bscan, layer ORDER BY x) - 1 AS i FROM interp),
d AS (SELECT *, (x - 32)**2 + (y - 150)**2 AS d2 FROM ix)
SELECT image_id, bscan, layer, 32 AS px, 150 AS py, min_by(i, (d2, i)) AS ref, min_by(x, (d2, i)) AS ref_x, min_by(y, (d2, i)) AS ref_y FROM d GROUP BY 1, 2, 3""")
def trc_nearest_point(spark, sf):
    t = trace.interp_trace(views.trace(spark, sf))
    fovea = t.select("image_id", "bscan").distinct().selectExpr("image_id", "bscan", "32 AS px", "150 AS py")
    return trace.nearest_point(t, fovea).withColumn("ref", F.col("ref").cast("bigint"))


@query(f"""WITH {INTERP}, ix AS (SELECT *, row_number() OVER w - 1 AS i, sqrt(((x - lag(x) OVER w) * CAST(11.49 AS DOUBLE))**2 + ((y - lag(y) OVER w) * CAST(3.87 AS DOUBLE))**2) AS step FROM interp WINDOW w AS (PARTITION BY image_id, bscan, layer ORDER BY x)),
dist AS (SELECT unnest([0, 100, 180, 400, 100000]) AS d),
rr AS (SELECT image_id, bscan, layer, i, sum(CASE WHEN i > 30 THEN step END) OVER (PARTITION BY image_id, bscan, layer ORDER BY i) AS cr FROM ix),
ll AS (SELECT a.image_id, a.bscan, a.layer, a.i, sum(b.step) AS cl FROM ix a JOIN ix b ON a.image_id = b.image_id AND a.bscan = b.bscan AND a.layer = b.layer AND b.i > a.i AND b.i < 30 WHERE a.i < 29 GROUP BY 1, 2, 3, 4),
g AS (SELECT DISTINCT image_id, bscan, layer, CAST(d AS DOUBLE) AS d FROM ix, dist),
f AS (SELECT g.*, (SELECT min(i) - 31 FROM rr WHERE rr.image_id = g.image_id AND rr.bscan = g.bscan AND rr.layer = g.layer AND rr.i > 30 AND cr >= d) AS r,
  (SELECT min(28 - i) FROM ll WHERE ll.image_id = g.image_id AND ll.bscan = g.bscan AND ll.layer = g.layer AND cl >= d) AS k FROM g)
SELECT image_id, bscan, layer, 30 AS ref, d AS distance, CASE WHEN coalesce(k, 0) = 0 THEN CASE WHEN d <= 200 THEN 30 END ELSE 30 - k END AS idx_left,
 CASE WHEN coalesce(r, 0) = 0 THEN CASE WHEN d <= 200 THEN 30 END ELSE 30 + r END AS idx_right FROM f""")
def trc_curve_location(spark, sf):
    t = trace.interp_trace(views.trace(spark, sf))
    refs = t.select("image_id", "bscan", "layer").distinct().withColumn("ref", F.lit(30))
    out = trace.curve_location(t, refs, [0, 100, 180, 400, 100000])
    return out.select("image_id", "bscan", "layer", "ref", "distance", F.col("idx_left").cast("bigint").alias("idx_left"), F.col("idx_right").cast("bigint").alias("idx_right"))


FOOT = f"""{views.TRACE}, t AS (SELECT image_id, bscan, x, y AS y_top FROM trace WHERE layer = 'ILM' AND y IS NOT NULL), b AS (SELECT image_id, bscan, x AS fx, CAST(y AS BIGINT) AS fy FROM trace WHERE layer = 'RNFL' AND y IS NOT NULL),
s AS (SELECT t.image_id, t.bscan, t.x, CAST(t.y_top AS BIGINT) AS y_top FROM t JOIN b ON t.image_id = b.image_id AND t.bscan = b.bscan AND t.x = b.fx),
low AS (SELECT b.* FROM b JOIN s ON b.image_id = s.image_id AND b.bscan = s.bscan AND b.fx = s.x),
g AS (SELECT *, coalesce(lag(x, 15) OVER w, first(x) OVER q) AS bx, coalesce(lag(y_top, 15) OVER w, first(y_top) OVER q) AS by_, coalesce(lead(x, 15) OVER w, last(x) OVER q) AS ax, coalesce(lead(y_top, 15) OVER w, last(y_top) OVER q) AS ay
 FROM s WINDOW w AS (PARTITION BY image_id, bscan ORDER BY x), q AS (PARTITION BY image_id, bscan ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
deep AS (SELECT image_id, bscan, max(fy) AS deepest FROM low GROUP BY 1, 2),
w AS (SELECT *, x - (ay - by_) / (ax - bx) * (wy - y_top) AS wx FROM (SELECT g.*, unnest(range(y_top, deepest + 1)) AS wy FROM g JOIN deep USING (image_id, bscan) WHERE ax <> bx)),
m AS (SELECT w.image_id, w.bscan, w.x, w.y_top, wy, low.fx, low.fy, sqrt((wx - low.fx)**2 + (wy - low.fy)**2) AS d FROM w JOIN low ON w.image_id = low.image_id AND w.bscan = low.bscan AND CAST(trunc(wx) AS BIGINT) = low.fx)"""


@query(f"""WITH {FOOT}
SELECT image_id, bscan, 'ILM_RNFL' AS pair, x, y_top, CAST(min_by(fx, (d, wy)) AS BIGINT) AS fx, min_by(fy, (d, wy)) AS fy, round(min(d), 6) AS miss FROM m GROUP BY 1, 2, 4, 5 HAVING min(d) <= 2""")
def trc_perpendicular_foot(spark, sf):
    out = trace.perpendicular_foot(slab(spark, sf).filter("pair = 'ILM_RNFL'"))
    return out.select("image_id", "bscan", "pair", "x", "y_top", "fx", "fy", *r6("miss"))


@query(f"""WITH {views.TRACE}, p AS (SELECT image_id, layer, bool_or(y IS NOT NULL) AS present FROM trace GROUP BY 1, 2)
SELECT image_id, CAST(count(CASE WHEN present THEN 1 END) AS BIGINT) AS n_layers, list(layer ORDER BY layer) FILTER (present) AS layers, CASE count(CASE WHEN present THEN 1 END) WHEN 2 THEN 'two' WHEN 17 THEN 'all' ELSE 'other' END AS segmentation FROM p GROUP BY 1""")
def meta_layer_availability(spark, sf):
    return meta.layer_availability(views.trace(spark, sf))


@query(f"""WITH {SLAB}, s AS (SELECT * FROM slab WHERE NOT (pair = 'ILM_RNFL' AND (image_id % 3 = 0 OR bscan = 1))), h AS (SELECT image_id, bscan, bool_or(pair = 'ILM_RNFL') AS has FROM s GROUP BY 1, 2),
f AS (SELECT image_id, count(CASE WHEN NOT has THEN 1 END) > count(*) // 2 AS fb FROM h GROUP BY 1) SELECT s.* FROM s JOIN f USING (image_id) WHERE NOT fb OR pair = 'ILM_BM'""")
def meta_layer_fallback(spark, sf):
    return meta.layer_fallback(slab(spark, sf).filter("NOT (pair = 'ILM_RNFL' AND (image_id % 3 = 0 OR bscan = 1))")).select("image_id", "bscan", "pair", "x", "y_top", "y_bot")


# ---- scan metadata ----------------------------------------------------------


@query(f"""WITH {views.SCAN}, {views.BSCAN}, f AS (SELECT image_id, min_by(start_x_mm, bscan) AS sx, min_by(end_y_mm, bscan) AS ey FROM bscan_meta GROUP BY 1)
SELECT image_id, CASE WHEN pattern = 'Peripapillary' THEN 'Peripapillary' WHEN scale_z <> 0 THEN CASE WHEN pattern = 'Radial' THEN 'Radial' ELSE 'Ppole' END
 WHEN abs(sx) <= 0.001 THEN 'H-line' WHEN abs(ey) <= 0.001 THEN 'V-line' ELSE 'AV-line' END AS pattern FROM scan JOIN f USING (image_id)""")
def meta_pattern(spark, sf):
    first = views.bscan_meta(spark, sf).groupBy("image_id").agg(F.min_by("start_x_mm", "bscan").alias("start_x_mm"), F.min_by("end_y_mm", "bscan").alias("end_y_mm"))
    s = views.scan(spark, sf).select("image_id", "scale_z", (F.col("pattern") == "Peripapillary").alias("circular"), (F.col("pattern") == "Radial").alias("radial")).join(first, "image_id")
    return meta.classify_pattern(s).select("image_id", "pattern")


@query(f"""WITH {views.BSCAN} SELECT image_id, round(avg(quality), 6) AS quality_mean, round(stddev_pop(quality), 6) AS quality_std FROM bscan_meta GROUP BY 1""")
def meta_quality(spark, sf):
    return meta.quality(views.bscan_meta(spark, sf)).select("image_id", *r6("quality_mean", "quality_std"))


ACQ = f"""{views.SCAN}, {views.BSCAN}, acq AS (SELECT image_id, bscan, 768 * start_x_mm / fov AS start_x, 768 * start_y_mm / fov AS start_y, 768 * end_x_mm / fov - 1 AS end_x, 768 * end_y_mm / fov AS end_y
FROM (SELECT image_id, bscan, start_x_mm, start_y_mm, end_x_mm, end_y_mm, scale_x * slo_res / 1000 AS fov FROM bscan_meta JOIN scan USING (image_id)))"""


@query(f"""WITH {ACQ} SELECT image_id, bscan, round(start_x, 6) AS start_x, round(start_y, 6) AS start_y, round(end_x, 6) AS end_x, round(end_y, 6) AS end_y,
 round(CASE WHEN end_x = start_x THEN 90 ELSE degrees(atan((end_y - start_y) / (end_x - start_x))) END, 6) AS angle FROM acq""")
def map_acquisition_angle(spark, sf):
    return maps.acq_angle(meta.acquisition_px(views.bscan_meta(spark, sf), views.scan(spark, sf))).select("image_id", "bscan", *r6("start_x", "start_y", "end_x", "end_y", "angle"))


@query(f"""WITH {views.BSCAN} SELECT image_id, bscan, round(CASE WHEN image_id % 5 = 0 THEN 2 * pi() * abs(end_x_mm - start_x_mm) ELSE sqrt((end_x_mm - start_x_mm)**2 + (end_y_mm - start_y_mm)**2) END, 6) AS roi_mm,
 CASE WHEN 3000 > 1000 * (CASE WHEN image_id % 5 = 0 THEN 2 * pi() * abs(end_x_mm - start_x_mm) ELSE sqrt((end_x_mm - start_x_mm)**2 + (end_y_mm - start_y_mm)**2) END) THEN 1500 ELSE 1500 END AS roi_um FROM bscan_meta""")
def meta_roi(spark, sf):
    r = meta.roi_mm(views.bscan_meta(spark, sf), F.col("image_id") % 5 == 0)
    return meta.effective_roi(r, 1500).select("image_id", "bscan", *r6("roi_mm"), "roi_um")


@query(f"""WITH {views.SCAN}, s AS (SELECT *, CASE eye WHEN 'OD' THEN 'Right' WHEN 'OS' THEN 'Left' END AS side, CASE WHEN image_id % 4 = 0 THEN CAST(25 AS DOUBLE) ELSE scale_x END AS sc FROM scan WHERE filename NOT LIKE '%\\_ANGIO%' ESCAPE '\\')
SELECT image_id, side AS eye, CASE WHEN sc BETWEEN 3 AND 20 THEN sc END AS slo_scale, CASE WHEN sc BETWEEN 3 AND 20 THEN 'um' ELSE 'px' END AS unit,
 CASE WHEN disc_x > 0.1 * slo_res AND disc_x < 0.9 * slo_res THEN 'Optic disc' ELSE 'Macula' END AS location, fovea_x + fovea_y = 0 AS missing_fovea, disc_x + disc_y = 0 AS missing_disc,
 round(scale_x * slo_res, 6) AS field_of_view, round(100 * sqrt((disc_x - fovea_x)**2 + (disc_y - fovea_y)**2) / (2 * disc_radius), 6) AS offset_percent,
 100 * sqrt((disc_x - fovea_x)**2 + (disc_y - fovea_y)**2) / (2 * disc_radius) > 15 AS off_centre, 'um' AS thickness_units FROM s""")
def meta_scan_rules(spark, sf):
    s = meta.laterality(files.drop_angiography(views.scan(spark, sf))).withColumn("slo_scale", F.when(F.col("image_id") % 4 == 0, 25.0).otherwise(F.col("scale_x")))
    s = meta.fov(meta.landmark_flags(meta.infer_location(meta.check_scale(s)))).withColumn("offset_px", F.hypot(F.col("disc_x") - F.col("fovea_x"), F.col("disc_y") - F.col("fovea_y")))
    s = meta.with_units(meta.disc_warning(s))
    return s.select("image_id", "eye", "slo_scale", "unit", "location", "missing_fovea", "missing_disc", *r6("field_of_view", "offset_percent"), "off_centre", "thickness_units")


@query(f"""WITH {views.SCAN}, {views.MASK}, h AS (SELECT image_id, count(CASE WHEN x >= 384 THEN 1 END) AS r, count(CASE WHEN x < 384 THEN 1 END) AS l FROM mask_pixel GROUP BY 1)
SELECT image_id, coalesce(CASE eye WHEN 'OD' THEN 'Right' WHEN 'OS' THEN 'Left' END, CASE WHEN fovea_x + fovea_y > 0 AND disc_x + disc_y > 0 THEN CASE WHEN disc_x > fovea_x THEN 'Right' ELSE 'Left' END END,
 CASE WHEN disc_x + disc_y > 0 AND abs(disc_x - 384) > 0.05 * 768 THEN CASE WHEN disc_x > 384 THEN 'Right' ELSE 'Left' END END, CASE WHEN r IS NOT NULL THEN CASE WHEN r >= l THEN 'Right' ELSE 'Left' END END) AS eye FROM scan LEFT JOIN h USING (image_id)""")
def meta_infer_eye(spark, sf):
    return meta.infer_eye(meta.laterality(views.scan(spark, sf)), views.mask_pixel(spark, sf)).select("image_id", "eye")


@query(f"""WITH {views.MEASUREMENT} SELECT image_id, bool_or(feature = 'thickness' AND value = -1 AND layer NOT LIKE 'CHOR%') AS missing_retinal_oct_measurements,
 bool_or(feature = 'thickness' AND value = -1 AND layer LIKE 'CHOR%') AS missing_choroid_oct_measurements FROM measurement GROUP BY 1""")
def meta_measurement_flags(spark, sf):
    return meta.measurement_flags(views.measurement(spark, sf))


@query("""WITH r AS (SELECT string_split(l_returnflag || '_' || l_linestatus, '_') AS p FROM lineitem), k AS (SELECT ['ILM','RNFL','GCL','IPL','INL','OPL','ELM','PR1','PR2','RPE','BM'] AS n),
q AS (SELECT n[CAST(l_orderkey % 11 AS INT) + 1] AS a, n[CAST(l_partkey % 11 AS INT) + 1] AS b, l_orderkey % 11 AS ra, l_partkey % 11 AS rb FROM lineitem, k)
SELECT DISTINCT CASE WHEN ra < rb THEN a || '_' || b ELSE b || '_' || a END AS pair FROM q WHERE ra <> rb""")
def meta_slab_requests(spark, sf):
    li = views.table(spark, sf, "lineitem")
    names = F.array(*[F.lit(x) for x in LAYERS if not x.startswith("CHOR")])
    at = lambda c: F.element_at(names, (F.col(c) % 11 + 1).cast("int"))
    asked = li.select(F.concat_ws("_", at("l_orderkey"), at("l_partkey")).alias("pair")).union(li.select(F.concat_ws("_", F.lit("XYZ"), at("l_partkey")).alias("pair")))
    return meta.normalise_slabs(asked)


@query(f"""WITH {views.BSCAN}, n AS (SELECT image_id, CAST(count(*) AS INT) AS n FROM bscan_meta GROUP BY 1)
SELECT image_id, CAST(b AS INT) AS bscan, CAST(trunc(90 - b * 360 / (CAST(2 AS DOUBLE) * n)) AS INT) AS angle FROM (SELECT *, unnest(range(n)) AS b FROM n)""")
def meta_radial_angles(spark, sf):
    n = views.bscan_meta(spark, sf).groupBy("image_id").agg(F.count("*").cast("int").alias("n_bscans"))
    return meta.radial_angles(n)


@query(f"""WITH {views.BSCAN} SELECT image_id, max_by(bscan, (quality, -bscan)) AS bscan, round(max_by(start_x_mm, (quality, -bscan)), 6) AS fovea_x, max(quality) AS score FROM bscan_meta GROUP BY 1""")
def meta_fovea_slice(spark, sf):
    b = views.bscan_meta(spark, sf).select("image_id", "bscan", F.col("start_x_mm").alias("fovea_x"), F.col("start_y_mm").alias("fovea_y"), F.col("quality").alias("score"))
    return meta.pick_fovea_slice(b).select("image_id", "bscan", *r6("fovea_x"), "score")


@query(f"""WITH {ACQ}, q AS (SELECT image_id, min_by(start_x, bscan) AS x0, min_by(start_y, bscan) AS y0, min_by(end_x, bscan) AS x1, min_by(end_y, bscan) AS y1, max_by(end_x, bscan) AS x2, max_by(end_y, bscan) AS y2, max_by(start_x, bscan) AS x3, max_by(start_y, bscan) AS y3 FROM acq GROUP BY 1),
c AS (SELECT *, x0*y1 - x1*y0 AS c0, x1*y2 - x2*y1 AS c1, x2*y3 - x3*y2 AS c2, x3*y0 - x0*y3 AS c3 FROM q), a AS (SELECT *, (c0 + c1 + c2 + c3) / 2 AS ar FROM c)
SELECT image_id, CAST(trunc(CASE WHEN abs(ar) < 1e-6 THEN (x0 + x1 + x2 + x3) / 4 ELSE ((x0+x1)*c0 + (x1+x2)*c1 + (x2+x3)*c2 + (x3+x0)*c3) / (6 * ar) END) AS BIGINT) AS centre_x,
 CAST(trunc(CASE WHEN abs(ar) < 1e-6 THEN (y0 + y1 + y2 + y3) / 4 ELSE ((y0+y1)*c0 + (y1+y2)*c1 + (y2+y3)*c2 + (y3+y0)*c3) / (6 * ar) END) AS BIGINT) AS centre_y FROM a""")
def map_acquisition_centre(spark, sf):
    return maps.acq_centre(meta.acquisition_px(views.bscan_meta(spark, sf), views.scan(spark, sf)))


# ---- measurement tables -----------------------------------------------------


@query(f"""WITH {views.MEASUREMENT} SELECT image_id, layer, max(CASE WHEN feature = 'thickness' THEN value END) AS thickness, max(CASE WHEN feature = 'area' THEN value END) AS area, max(CASE WHEN feature = 'vascular_index' THEN value END) AS vascular_index
FROM (SELECT * FROM measurement WHERE (image_id, layer) IN (SELECT (image_id, layer) FROM measurement GROUP BY image_id, layer HAVING bool_or(value <> -1))) GROUP BY 1, 2""")
def shp_pivot(spark, sf):
    m = shape.drop_all_sentinel(views.measurement(spark, sf), ["image_id", "layer"])
    return shape.pivot_features(m, ["image_id", "layer"], ["thickness", "area", "vascular_index"])


@query(f"""WITH {views.MEASUREMENT}, m AS (SELECT image_id, layer, feature, value FROM measurement WHERE value <> -1 AND layer NOT LIKE 'CHOR%')
SELECT image_id, max(CASE WHEN layer = 'ILM_BM' AND feature = 'thickness' THEN value END) AS "ILM_BM_thickness_0", max(CASE WHEN layer = 'ILM_BM' AND feature = 'area' THEN value END) AS "ILM_BM_area_0",
 max(CASE WHEN layer = 'GCL_IPL' AND feature = 'thickness' THEN value END) AS "GCL_IPL_thickness_0", max(CASE WHEN layer = 'GCL_IPL' AND feature = 'area' THEN value END) AS "GCL_IPL_area_0" FROM m GROUP BY 1""")
def shp_wide_linescan(spark, sf):
    m = shape.drop_sentinel(shape.without_choroid(views.measurement(spark, sf))).withColumn("scan_number", F.lit(0))
    return shape.wide_linescan(m, ["ILM_BM", "GCL_IPL"], ["thickness", "area"], [0])


@query(f"""WITH {views.MEASUREMENT}, {views.SCAN} SELECT image_id, CASE layer WHEN 'ILM_BM' THEN 'retina' WHEN 'ILM_ELM' THEN 'inner_retina' WHEN 'ELM_BM' THEN 'outer_retina' ELSE layer END AS layer, feature, value, pattern,
 CASE WHEN pattern IN ('H-line','V-line','AV-line') THEN 'linescan' WHEN pattern = 'Radial' THEN 'radial' WHEN pattern = 'Peripapillary' THEN 'peripapillary' ELSE 'ppole_etdrs' END AS kind
FROM measurement JOIN scan USING (image_id) WHERE NOT failed AND (image_id, layer) IN (SELECT (image_id, layer) FROM measurement GROUP BY image_id, layer HAVING bool_or(value <> -1))""")
def shp_collate(spark, sf):
    tables = shape.collate(views.scan(spark, sf), views.measurement(spark, sf), [])
    tables.pop("failed")
    return shape.union_results(list(tables.values())).select("image_id", "layer", "feature", "value", "pattern", "kind")


@query(f"""WITH {views.SCAN} SELECT image_id, filename FROM scan WHERE failed OR fovea_x + fovea_y = 0""")
def shp_failed(spark, sf):
    return shape.failed(meta.landmark_flags(views.scan(spark, sf)), ["failed", "missing_fovea", "not_there"]).select("image_id", "filename")


@query(f"""WITH {views.MEASUREMENT}, u AS (SELECT * FROM (VALUES ('thickness', 'um'), ('area', 'mm2')) t(map, unit)) SELECT image_id, layer, feature AS map, value, unit FROM measurement JOIN u ON feature = map""")
def shp_map_units(spark, sf):
    units = views.table(spark, sf, "region").select(F.explode(F.array(F.struct(F.lit("thickness").alias("map"), F.lit("um").alias("unit")), F.struct(F.lit("area").alias("map"), F.lit("mm2").alias("unit")))).alias("u")).select("u.*").distinct()
    return shape.with_map_units(views.measurement(spark, sf).withColumnRenamed("feature", "map"), units).select("image_id", "layer", "map", "value", "unit")


@query(f"""WITH {views.MEASUREMENT} SELECT image_id, layer, CAST(row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN layer IN ('ILM_BM','ILM_ELM','ELM_BM') THEN 0 WHEN layer LIKE 'CHOR%' THEN 3 WHEN layer IN ('ILM_RNFL','GCL_IPL') THEN 1 ELSE 2 END,
 list_position(['ILM','RNFL','GCL','IPL','INL','OPL','ELM','PR1','PR2','RPE','BM','CHORupper','CHORlower'], string_split(layer, '_')[1]), list_position(['ILM','RNFL','GCL','IPL','INL','OPL','ELM','PR1','PR2','RPE','BM','CHORupper','CHORlower'], string_split(layer, '_')[2])) AS INT) AS place FROM measurement WHERE feature = 'thickness'""")
def shp_anatomical_order(spark, sf):
    from pyspark.sql import Window as W

    m = views.measurement(spark, sf).filter("feature = 'thickness'")
    return m.select("image_id", "layer", F.row_number().over(W.partitionBy("image_id").orderBy(shape.map_order(F.col("layer")))).alias("place"))


@query(f"""WITH {views.TRACE} SELECT DISTINCT layer, CASE layer WHEN 'ILM' THEN 'Inner Limiting Membrane' WHEN 'RNFL' THEN 'Retinal Nerve Fiber Layer' WHEN 'ELM' THEN 'External Limiting Membrane' ELSE 'Bruch''s Membrane Complex' END AS description,
 CASE layer WHEN 'ILM' THEN 1 WHEN 'RNFL' THEN 2 WHEN 'ELM' THEN 7 ELSE 11 END AS rank FROM trace WHERE y IS NOT NULL""")
def shp_layer_keys(spark, sf):
    return shape.layer_keys(views.trace(spark, sf))


@query(f"""WITH {views.MEASUREMENT} SELECT image_id, layer, feature, value FROM measurement""")
def shp_flatten_map(spark, sf):
    m = views.measurement(spark, sf)
    inner = m.groupBy("image_id", "layer").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("f"))
    nested = inner.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("layer", "f"))).alias("m"))
    return shape.flatten_map(nested)


# ---- masks ------------------------------------------------------------------


COMPONENT_NEXT = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"


@query(f"""WITH {views.MASK} SELECT a.image_id, a.mask, a.x, a.y, count(*) AS n FROM mask_pixel a JOIN mask_pixel b ON a.image_id = b.image_id AND {COMPONENT_NEXT} GROUP BY 1, 2, 3, 4""")
def msk_neighbour_count(spark, sf):
    return mask.neighbour_count(views.mask_pixel(spark, sf))


@query(f"""WITH {views.MASK}, n AS (SELECT a.image_id, a.mask, a.x, a.y, count(*) AS n8, count(CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = 1 THEN 1 END) AS n4 FROM mask_pixel a JOIN mask_pixel b ON a.image_id = b.image_id AND {COMPONENT_NEXT} GROUP BY 1, 2, 3, 4)
SELECT 'endpoint' AS kind, image_id, mask, x, y FROM n WHERE n8 = 2 UNION ALL SELECT 'linear', image_id, mask, x, y FROM n WHERE n8 <= 3 UNION ALL SELECT 'boundary', image_id, mask, x, y FROM n WHERE n4 < 4""")
def msk_pixel_kinds(spark, sf):
    m = views.mask_pixel(spark, sf)
    parts = {"endpoint": mask.endpoints(m), "linear": mask.drop_branch_points(m), "boundary": mask.boundary(m)}
    return shape.union_results([df.select(F.lit(k).alias("kind"), "image_id", "mask", "x", "y") for k, df in parts.items()])


OFFS = "(VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx, dy)"


@query(f"""WITH {views.MASK}, d AS (SELECT DISTINCT image_id, mask, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM mask_pixel, {OFFS}),
c AS (SELECT image_id, mask, x + dx AS x, y + dy AS y FROM d, {OFFS}) SELECT image_id, mask, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) = 5""")
def msk_close(spark, sf):
    return mask.close(views.mask_pixel(spark, sf), mask.disk(1))


LABELS = f"""{views.MASK}, px AS (SELECT image_id, x, y, y * 1000 + x AS id FROM mask_pixel), adj AS (SELECT a.image_id, a.id AS a, b.id AS b FROM px a JOIN px b ON a.image_id = b.image_id AND {COMPONENT_NEXT}),
reach(image_id, id, root) AS (SELECT image_id, id, id FROM px UNION SELECT r.image_id, adj.b, r.root FROM reach r JOIN adj ON adj.image_id = r.image_id AND adj.a = r.id WHERE adj.b > r.root),
roots AS (SELECT image_id, id, min(root) AS root FROM reach GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {LABELS} SELECT image_id, 'vessel' AS mask, CAST(id % 1000 AS INT) AS x, CAST(id // 1000 AS INT) AS y, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS label FROM roots""")
def msk_components(spark, sf):
    return mask.components(views.mask_pixel(spark, sf))


@query(f"""WITH RECURSIVE {LABELS}, l AS (SELECT image_id, root, id % 1000 AS x, id // 1000 AS y FROM roots), m AS (SELECT image_id, root, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(x) + CAST(1 AS DOUBLE)/12 AS vx, var_pop(y) + CAST(1 AS DOUBLE)/12 AS vy, covar_pop(x, y) AS vxy FROM l GROUP BY 1, 2),
e AS (SELECT *, sqrt((vx - vy)**2 + 4 * vxy**2) AS rt FROM m)
SELECT image_id, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(4 * sqrt((vx + vy + rt) / 2), 4) AS major, round(4 * sqrt(greatest(0, (vx + vy - rt) / 2)), 4) AS minor FROM e""")
def msk_region_props(spark, sf):
    p = mask.region_props(mask.components(views.mask_pixel(spark, sf)))
    return p.select("image_id", "area", *r6("cx", "cy"), F.round("major", 4).alias("major"), F.round("minor", 4).alias("minor"))


@query(f"""WITH RECURSIVE {LABELS}, s AS (SELECT image_id, root, count(*) AS n FROM roots GROUP BY 1, 2), b AS (SELECT image_id, root FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, root) AS r FROM s) WHERE r = 1)
SELECT image_id, 'vessel' AS mask, CAST(trunc(avg(id % 1000)) AS INT) AS x, CAST(trunc(avg(id // 1000)) AS INT) AS y FROM roots JOIN b USING (image_id, root) GROUP BY 1""")
def msk_centroid(spark, sf):
    return mask.centroid(views.mask_pixel(spark, sf))


@query(f"""WITH {views.LABEL}, m AS (SELECT image_id, CASE gray WHEN 191 THEN 'artery' WHEN 127 THEN 'vein' ELSE 'disc' END AS mask, x, y FROM label_pixel UNION ALL SELECT image_id, 'any', x, y FROM label_pixel WHERE gray > 0)
SELECT * FROM m""")
def src_decode_labels(spark, sf):
    return mask.decode_labels(views.label_pixel(spark, sf))


@query(f"""WITH {views.LABEL}, {views.MASK}, u AS (SELECT image_id, x, y FROM mask_pixel UNION SELECT image_id, x, y FROM label_pixel WHERE gray IN (191, 127)) SELECT * FROM u WHERE (image_id, x, y) NOT IN (SELECT (image_id, x, y) FROM label_pixel WHERE gray = 255)""")
def msk_vessel_union(spark, sf):
    return mask.vessel_union(views.mask_pixel(spark, sf), mask.decode_labels(views.label_pixel(spark, sf)))


@query(f"""WITH {views.LABEL} SELECT image_id, x, y, CASE gray WHEN 191 THEN 'artery' WHEN 127 THEN 'vein' ELSE 'disc' END AS class FROM label_pixel""")
def msk_combine_classes(spark, sf):
    return mask.combine_classes(mask.decode_labels(views.label_pixel(spark, sf)).filter("mask <> 'any'"))


@query(f"""WITH {views.MASK}, v AS (SELECT image_id, x, y FROM mask_pixel WHERE p > 0.6), pr AS (SELECT image_id, 'artery' AS mask, x, y, p FROM mask_pixel UNION ALL SELECT image_id, 'vein', x, y, CASE WHEN x % 2 = 0 THEN p ELSE p - 0.1 END + CASE WHEN y % 3 = 0 THEN 0.2 ELSE 0 END FROM mask_pixel)
SELECT image_id, x, y, max_by(mask, (p, mask = 'artery')) AS class FROM pr SEMI JOIN v USING (image_id, x, y) GROUP BY 1, 2, 3""")
def msk_argmax_class(spark, sf):
    m = views.mask_pixel(spark, sf)
    vein = m.select("image_id", F.lit("vein").alias("mask"), "x", "y", (F.when(F.col("x") % 2 == 0, F.col("p")).otherwise(F.col("p") - 0.1) + F.when(F.col("y") % 3 == 0, 0.2).otherwise(0.0)).alias("p"))
    return mask.argmax_class(m.withColumn("mask", F.lit("artery")).unionByName(vein), mask.threshold(m, 0.6))


@query(f"""WITH {views.MASK}, s AS (SELECT image_id, axis, pos, sum(p) AS s FROM (SELECT image_id, 'x' AS axis, x AS pos, p FROM mask_pixel UNION ALL SELECT image_id, 'y', y, p FROM mask_pixel) GROUP BY 1, 2, 3), n AS (SELECT image_id, axis, max(pos) + 1 AS n FROM s GROUP BY 1, 2),
sp AS (SELECT image_id, axis, n, s, unnest([pos, -1 - pos, 2 * n - 1 - pos]) AS pos FROM s JOIN n USING (image_id, axis)), c AS (SELECT image_id, axis, n, pos + d AS pos, s * (1 - abs(d) / CAST(11 AS DOUBLE)) / 11 AS v FROM sp, (SELECT unnest(range(-10, 11)) AS d)),
k AS (SELECT image_id, axis, pos, sum(v) AS v FROM c WHERE pos >= 0 AND pos < n GROUP BY 1, 2, 3), b AS (SELECT image_id, axis, max(v) AS v, max_by(pos, (round(v, 9), -pos)) AS pos FROM k GROUP BY 1, 2)
SELECT image_id, round(min(v), 6) AS score, CAST(max(CASE WHEN axis = 'x' THEN pos END) AS INT) AS x, CAST(max(CASE WHEN axis = 'y' THEN pos END) AS INT) AS y FROM b GROUP BY 1""")
def msk_marginal_peak(spark, sf):
    return mask.marginal_peak(views.mask_pixel(spark, sf)).select("image_id", *r6("score"), "x", "y")


# ---- maps -------------------------------------------------------------------


def cells(spark, sf) -> DataFrame:
    """The whole lattice of each map; -1 where nothing was measured. Columns of a map are gathered, so no cell is shuffled; tables of an image's cells stay dealt as map_cell."""
    got = views.map_cell(spark, sf)
    column = got.groupBy("image_id", "x").agg(F.map_from_entries(F.collect_list(F.struct("y", "value"))).alias("m"))  # at most 64 entries
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda y: F.coalesce(F.try_element_at("m", y), F.lit(-1.0)))
    whole = column.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("x", values))).alias("m")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(63))))
    values = F.coalesce(F.try_element_at("m", F.col("x")), F.array_repeat(F.lit(-1.0), 64))
    return whole.select("image_id", F.lit("retina").alias("map"), "x", F.posexplode(values).alias("y", "value"))


def measured(spark, sf) -> DataFrame:
    """The measured cells of `cells`, for operators that make the lattice themselves; each of its maps has one at least."""
    return views.map_cell(spark, sf).select("image_id", F.lit("retina").alias("map"), "x", "y", "value")


def grid_scan(spark, sf) -> DataFrame:
    s = views.images(spark, sf)
    return s.select("image_id", F.when(F.col("image_id") % 2 == 0, "Right").otherwise("Left").alias("eye"), F.lit(32).alias("cx"), F.lit(31).alias("cy"), F.lit(110.0).alias("slo_scale"), F.lit(0.0).alias("angle"))


CELLS = f"""{views.MAP_CELL}, cells AS MATERIALIZED (SELECT image_id, 'retina' AS map, CAST(l.x AS INT) AS x, CAST(l.y AS INT) AS y, coalesce(value, -1) AS value FROM (SELECT image_id, x, unnest(range(64)) AS y FROM (SELECT image_id, unnest(range(64)) AS x FROM (SELECT DISTINCT image_id FROM map_cell))) l LEFT JOIN map_cell USING (image_id, x, y))"""
ETDRS = f"""{CELLS}, pol AS (SELECT *, sqrt((x - 32)**2 + (y - 31)**2) AS d, CASE WHEN abs(y - 31) >= abs(x - 32) THEN CASE WHEN y <= 31 THEN 'superior' ELSE 'inferior' END WHEN (x > 32) = (image_id % 2 = 0) THEN 'nasal' ELSE 'temporal' END AS side FROM cells),
sub AS (SELECT image_id, map, x, y, value, CASE WHEN d <= ceil(1000 / CAST(110 AS DOUBLE) / 2) THEN 'central' WHEN d <= ceil(3000 / CAST(110 AS DOUBLE) / 2) THEN 'inner_' || side WHEN d <= ceil(6000 / CAST(110 AS DOUBLE) / 2) THEN 'outer_' || side END AS subfield FROM pol)"""


@query(f"WITH {ETDRS} SELECT * FROM sub")
def map_etdrs_subfields(spark, sf):
    return maps.etdrs_subfield(cells(spark, sf), grid_scan(spark, sf)).select("image_id", "map", "x", "y", "value", "subfield")


NEAREST = f"""{ETDRS}, s AS (SELECT * FROM sub WHERE subfield IS NOT NULL), known AS MATERIALIZED (SELECT image_id, subfield, x, y FROM s WHERE value <> -1), open_ AS MATERIALIZED (SELECT image_id, subfield, x, y FROM s WHERE value = -1),
best AS (SELECT a.image_id, a.x, a.y, min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 4096 + b.y * 64 + b.x) % 4096 AS k FROM open_ a JOIN known b ON a.image_id = b.image_id AND a.subfield = b.subfield GROUP BY 1, 2, 3),
nf AS (SELECT s.image_id, s.map, s.subfield, s.x, s.y, coalesce(f.value, s.value) AS value FROM s LEFT JOIN best ON best.image_id = s.image_id AND best.x = s.x AND best.y = s.y LEFT JOIN cells f ON f.image_id = best.image_id AND f.x = best.k % 64 AND f.y = best.k // 64)"""


@query(f"WITH {NEAREST} SELECT * FROM nf")
def map_nearest_fill(spark, sf):
    placed = maps.etdrs_subfield(cells(spark, sf), grid_scan(spark, sf))
    return maps.nearest_fill(placed).select("image_id", "map", "subfield", "x", "y", "value")


@query(f"""WITH {ETDRS}, s AS (SELECT * FROM sub WHERE subfield IS NOT NULL)
SELECT image_id, subfield, CAST(trunc(avg(value)) AS DOUBLE) AS mean, round(round_even(sum(value) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3), 6) AS volume, round_even(100 * avg(CASE WHEN value = -1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS missing_percent FROM s GROUP BY 1, 2
UNION ALL SELECT image_id, 'all', CAST(trunc(avg(value)) AS DOUBLE), round(round_even(sum(value) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3), 6), NULL FROM s GROUP BY 1""")
def map_subfield_stats(spark, sf):
    placed = maps.etdrs_subfield(cells(spark, sf), grid_scan(spark, sf))
    return maps.subfield_stats(placed, 110.0, fill=False).select("image_id", "subfield", "mean", *r6("volume"), "missing_percent")


@query(f"""WITH {CELLS}, e AS (SELECT list(CAST(trunc(32 - h + 2 * h * k / 8) AS BIGINT) ORDER BY k) AS ex, list(CAST(trunc(31 - h + 2 * h * k / 8) AS BIGINT) ORDER BY k) AS ey FROM (SELECT 7000 / CAST(110 AS DOUBLE) / 2 AS h, unnest(range(9)) AS k)),
b AS (SELECT c.*, len(list_filter(ex, lambda t: t <= x)) AS cx, len(list_filter(ey, lambda t: t <= y)) AS cy FROM cells c, e)
SELECT image_id, x, y, CASE WHEN cx BETWEEN 1 AND 8 AND cy BETWEEN 1 AND 8 THEN cy || '.' || CASE WHEN image_id % 2 = 0 THEN cx ELSE 9 - cx END END AS subfield FROM b""")
def map_square_subfields(spark, sf):
    return maps.square_subfield(cells(spark, sf), grid_scan(spark, sf)).select("image_id", "x", "y", "subfield")


@query(f"WITH {CELLS} SELECT image_id, map, round(quantile_cont(value, 0.995) FILTER (value <> -1), 6) AS clip_value FROM cells GROUP BY 1, 2")
def map_clip_value(spark, sf):
    return maps.clip_value(cells(spark, sf)).select("image_id", "map", *r6("clip_value"))


@query(f"""WITH {CELLS}, t0 AS (SELECT image_id, x, y FROM cells WHERE value <> -1), t1 AS (SELECT a.* FROM t0 a SEMI JOIN (SELECT image_id, x + 1 AS x, y FROM t0) b USING (image_id, x, y)),
t2 AS (SELECT a.* FROM t1 a SEMI JOIN (SELECT image_id, x - 1 AS x, y FROM t0) b USING (image_id, x, y)), t3 AS (SELECT a.* FROM t2 a SEMI JOIN (SELECT image_id, x, y + 1 AS y FROM t0) b USING (image_id, x, y)),
t4 AS (SELECT a.*, 1 AS kept FROM t3 a SEMI JOIN (SELECT image_id, x, y - 1 AS y FROM t0) b USING (image_id, x, y))
SELECT image_id, map, x, y, CASE WHEN kept = 1 THEN value ELSE CAST(-1 AS DOUBLE) END AS value FROM cells LEFT JOIN t4 USING (image_id, x, y)""")
def msk_trim_map(spark, sf):
    return mask.trim_map(cells(spark, sf), 1).select("image_id", "map", "x", "y", "value")


@query(f"""WITH {CELLS} SELECT image_id, map, y AS x, CAST(63 - x AS INT) AS y, value FROM cells""")
def map_rotate(spark, sf):
    pose = views.images(spark, sf).selectExpr("image_id", "90.0D AS angle", "31.5D AS cx", "31.5D AS cy")
    return maps.rotate_map(measured(spark, sf), pose, 64, 64).select("image_id", "map", F.col("x"), F.col("y"), F.round("value", 6).alias("value"))


KERNEL = "(SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-0.5 * (d / CAST(1.5 AS DOUBLE))**2) AS w FROM (SELECT unnest(range(-6, 7)) AS d)))"


@query(f"""WITH {CELLS}, k AS {KERNEL}, m AS (SELECT * FROM cells WHERE value <> -1),
a AS (SELECT image_id, y, CASE WHEN x + d < 0 THEN -1 - (x + d) WHEN x + d >= 64 THEN 127 - (x + d) ELSE x + d END AS x, sum(value * w) / sum(w) AS value FROM m, k GROUP BY 1, 2, 3),
b AS (SELECT image_id, x, CASE WHEN y + d < 0 THEN -1 - (y + d) WHEN y + d >= 64 THEN 127 - (y + d) ELSE y + d END AS y, sum(value * w) / sum(w) AS value FROM a, k GROUP BY 1, 2, 3)
SELECT c.image_id, c.x, c.y, round(CASE WHEN c.value = -1 THEN -1 ELSE b.value END, 6) AS value FROM cells c LEFT JOIN b ON b.image_id = c.image_id AND b.x = c.x AND b.y = c.y""")
def map_gaussian(spark, sf):
    return maps.gaussian(cells(spark, sf), 1.5, 64, 64).select("image_id", "x", "y", *r6("value"))


# ---- circular profiles ------------------------------------------------------


FILLED = f"""{views.PROFILE}, ring AS (SELECT image_id, x, x + t * 64 AS pos, t, value FROM profile, (VALUES (-1), (0), (1)) q(t)),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS a1, last_value(value IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS a2, first_value(value IGNORE NULLS) OVER f AS v2 FROM ring
 WINDOW b AS (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY image_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT image_id, x, CASE WHEN value IS NOT NULL THEN value ELSE v1 + (pos - a1) * (v2 - v1) / (a2 - a1) END AS value FROM w WHERE t = 0)"""


@query(f"WITH {FILLED} SELECT image_id, x, round(value, 6) AS value FROM filled")
def ppl_circular_fill(spark, sf):
    return disc.circular_fill(views.profile(spark, sf), 64).select("image_id", "x", *r6("value"))


@query(f"""WITH {FILLED}, sh AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN (x - image_id % 64 + 32 + 128) % 64 ELSE (image_id % 64 - x + 32 + 128) % 64 END AS x, value FROM filled), r2 AS (SELECT image_id, x, x + t * 64 AS pos, t, value FROM sh, (VALUES (-1), (0), (1)) q(t)),
mm AS (SELECT image_id, x, t, avg(value) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) AS value FROM r2 WHERE pos BETWEEN -16 AND 79), s AS (SELECT image_id, x, value, CASE WHEN x < 8 OR x >= 56 THEN 'nasal' WHEN x < 16 THEN 'supero_nasal' WHEN x < 24 THEN 'supero_temporal' WHEN x < 40 THEN 'temporal' WHEN x < 48 THEN 'infero_temporal' ELSE 'infero_nasal' END AS sector FROM mm WHERE t = 0),
me AS (SELECT image_id, sector, CAST(trunc(round(avg(value), 9)) AS DOUBLE) AS value FROM (SELECT image_id, sector, value FROM s UNION ALL SELECT image_id, 'All', value FROM s) GROUP BY 1, 2)
SELECT * FROM me UNION ALL SELECT image_id, 'N/T', round(max(CASE WHEN sector = 'nasal' THEN value END) / nullif(max(CASE WHEN sector = 'temporal' THEN value END), 0), 6) FROM me GROUP BY 1""")
def ppl_sector_means(spark, sf):
    p = views.profile(spark, sf).withColumn("layer", F.lit("RNFL"))
    ids = p.select("image_id").distinct()
    temporal = ids.select("image_id", (F.col("image_id") % 64).cast("int").alias("temporal_index"))
    eye = ids.select("image_id", F.when(F.col("image_id") % 2 == 0, "Right").otherwise("Left").alias("eye"))
    return disc.peripapillary_measure(p, temporal, eye, 64).select("image_id", "sector", *r6("value"))


@query(f"""WITH {views.SCAN}, i AS (SELECT image_id, disc_x, disc_y, atan2(fovea_y - disc_y, fovea_x - disc_x) AS a, unnest(range(96)) AS i FROM scan)
SELECT image_id, CAST(min_by(i, (round((100 * cos(2*pi()*i/96) - 100 * cos(a))**2 + (100 * sin(2*pi()*i/96) - 100 * sin(a))**2, 6), i)) AS INT) AS temporal_index FROM i GROUP BY 1""")
def ppl_temporal_index(spark, sf):
    return disc.temporal_index(views.scan(spark, sf).withColumn("circle_radius", F.lit(100)), 96)


@query(f"""WITH {CELLS}, p AS (SELECT *, x - 32 AS dx, y - 30 AS dy, sqrt((x - 32)**2 + (y - 30)**2) AS d, CASE WHEN (x - 32 > 0) = (image_id % 2 = 0) THEN 'nasal' ELSE 'temporal' END AS side FROM cells)
SELECT image_id, x, y, CASE WHEN d <= 6 THEN 'centre' WHEN d <= 20 THEN CASE WHEN abs(degrees(atan2(abs(dy), abs(dx)))) <= 45 THEN side WHEN dy < 0 THEN 'supero_' || side ELSE 'infero_' || side END END AS zone FROM p""")
def ppl_zones(spark, sf):
    s = grid_scan(spark, sf).selectExpr("image_id", "eye", "32 AS disc_x", "30 AS disc_y", "20 AS circle_radius")
    return disc.peripapillary_zone(cells(spark, sf), s).select("image_id", "x", "y", "zone")


# ---- vessels ----------------------------------------------------------------


STEPS = f"""{views.PATH}, st AS (SELECT *, sqrt((row - lag(row) OVER w)**2 + (col - lag(col) OVER w)**2) AS step FROM path WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
len AS (SELECT image_id, vessel_map, path_id, coalesce(sum(step), 0) AS length, sqrt((max_by(row, seq) - min_by(row, seq))**2 + (max_by(col, seq) - min_by(col, seq))**2) AS chord FROM st GROUP BY 1, 2, 3)"""


@query(f"WITH {STEPS} SELECT image_id, vessel_map, round(avg(length / nullif(chord, 0)), 6) AS tortuosity_distance FROM len GROUP BY 1, 2")
def ves_tortuosity_distance(spark, sf):
    return vessel.tortuosity_distance(views.path(spark, sf)).select("image_id", "vessel_map", *r6("tortuosity_distance"))


@query(f"""WITH {STEPS}, tn AS (SELECT *, coalesce(sign(col - lag(col) OVER w) <> sign(lead(col) OVER w - col), false) AS turn FROM st WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
sg AS (SELECT *, sum(CAST(turn AS INT)) OVER (PARTITION BY path_id ORDER BY seq) AS seg, sum(CAST(turn AS INT)) OVER (PARTITION BY path_id) AS n FROM tn),
ss AS (SELECT *, CASE WHEN lag(seg) OVER (PARTITION BY path_id ORDER BY seq) = seg THEN step END AS inner_ FROM sg),
pr AS (SELECT image_id, vessel_map, path_id, seg, max(n) AS n, coalesce(sum(inner_), 0) AS curve, coalesce(sum(step), 0) AS part, sqrt((max_by(row, seq) - min_by(row, seq))**2 + (max_by(col, seq) - min_by(col, seq))**2) AS ch FROM ss GROUP BY 1, 2, 3, 4),
pp AS (SELECT image_id, vessel_map, path_id, max(n) AS n, sum(part) AS length, sum(CASE WHEN seg < n AND ch > 0 THEN curve / ch - 1 ELSE 0 END) AS ex FROM pr GROUP BY 1, 2, 3)
SELECT image_id, vessel_map, round(avg(CASE WHEN n = 0 THEN 0 ELSE (n - 1) / n + ex / nullif(length, 0) END), 6) AS tortuosity_density FROM pp GROUP BY 1, 2""")
def ves_tortuosity_density(spark, sf):
    return vessel.tortuosity_density(views.path(spark, sf)).select("image_id", "vessel_map", *r6("tortuosity_density"))


@query(f"""WITH {views.PATH} SELECT image_id, vessel_map, path_id, seq, CAST(trunc(avg(row) OVER w) AS SMALLINT) AS row, CAST(trunc(avg(col) OVER w) AS SMALLINT) AS col FROM path WINDOW w AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def ves_smooth_path(spark, sf):
    return vessel.smooth_path(views.path(spark, sf))


@query(f"""WITH {views.MASK}, b AS (SELECT image_id, mask, s AS size, x // s AS bx, y // s AS by_, count(*) AS n FROM mask_pixel, (SELECT unnest([64, 32, 16, 8, 4]) AS s) GROUP BY 1, 2, 3, 4, 5), c AS (SELECT image_id, mask, size, count(*) AS boxes FROM b WHERE n < size * size GROUP BY 1, 2, 3)
SELECT image_id, mask, round(-regr_slope(ln(boxes), ln(size)), 6) AS fractal_dimension FROM c GROUP BY 1, 2""")
def ves_fractal_dimension(spark, sf):
    return vessel.fractal_dimension(views.mask_pixel(spark, sf), 64).select("image_id", "mask", *r6("fractal_dimension"))


@query(f"""WITH {views.MASK}, sk AS (SELECT * FROM mask_pixel WHERE (x + y) % 3 = 0) SELECT v.image_id, round(v.n / CAST(4096 AS DOUBLE), 6) AS vessel_density, round(v.n / s.n * CAST(11.49 AS DOUBLE), 4) AS average_global_calibre
FROM (SELECT image_id, count(*) AS n FROM mask_pixel GROUP BY 1) v JOIN (SELECT image_id, count(*) AS n FROM sk GROUP BY 1) s USING (image_id)""")
def ves_density_and_calibre(spark, sf):
    m = views.mask_pixel(spark, sf)
    d, c = vessel.vessel_density(m, 64, 64), vessel.global_calibre(m, m.filter("(x + y) % 3 = 0"), 11.49)
    return d.join(c, ["image_id", "mask"]).select("image_id", *r6("vessel_density"), F.round("average_global_calibre", 4).alias("average_global_calibre"))


@query(f"""WITH {views.MASK}, lat AS (SELECT image_id, x, unnest(range(64)) AS y FROM (SELECT image_id, unnest(range(64)) AS x FROM (SELECT DISTINCT image_id FROM mask_pixel))),
bg AS (SELECT * FROM lat ANTI JOIN mask_pixel USING (image_id, x, y)) SELECT m.image_id, m.mask, m.x, m.y, round(sqrt(min((m.x - bg.x)**2 + (m.y - bg.y)**2)), 6) AS distance
FROM mask_pixel m JOIN bg ON bg.image_id = m.image_id GROUP BY 1, 2, 3, 4""")
def ves_distance_map(spark, sf):
    return vessel.distance_map(views.mask_pixel(spark, sf), 64, 64).select("image_id", "mask", "x", "y", *r6("distance"))


ZONED = f"""{views.PATH}, zp AS (SELECT *, sqrt((col - 5)**2 + (row - 100)**2) AS d FROM path), zz AS (SELECT image_id, vessel_map, path_id, seq, row, col, 'whole' AS zone FROM zp UNION ALL SELECT image_id, vessel_map, path_id, seq, row, col, 'B' FROM zp WHERE d > 20 AND d <= 30 UNION ALL SELECT image_id, vessel_map, path_id, seq, row, col, 'C' FROM zp WHERE d > 30 AND d <= 50)"""


@query(f"""WITH {ZONED}, k AS (SELECT *, count(*) OVER (PARTITION BY path_id, zone) AS n FROM zz) SELECT image_id, vessel_map, path_id, seq, row, col, zone FROM k WHERE zone = 'whole' OR n >= 10""")
def ves_zonal_paths(spark, sf):
    p = views.path(spark, sf)
    s = p.select("image_id").distinct().selectExpr("image_id", "5 AS disc_x", "100 AS disc_y", "10 AS disc_radius")
    return vessel.zonal_paths(vessel.zones(p, s, "col", "row")).select("image_id", "vessel_map", "path_id", "seq", "row", "col", "zone")


@query(f"""WITH w AS (SELECT user_id // 30 AS image_id, CASE WHEN user_id % 2 = 0 THEN 'artery' ELSE 'vein' END AS vessel_map, 'B' AS zone, user_id AS path_id, round(avg(value), 6) AS width FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, vessel_map ORDER BY width DESC, path_id) AS r FROM w), t AS (SELECT image_id, vessel_map, zone, list(width ORDER BY width) AS v FROM r WHERE r <= 6 GROUP BY 1, 2, 3),
c AS (SELECT *, CASE vessel_map WHEN 'artery' THEN CAST(0.88 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS c FROM t), p AS (SELECT *, list_sort([c*sqrt(v[1]**2+v[6]**2), c*sqrt(v[2]**2+v[5]**2), c*sqrt(v[3]**2+v[4]**2)]) AS f FROM c), q AS (SELECT *, list_sort([c*sqrt(f[1]**2+f[3]**2), f[2]]) AS g FROM p),
e AS (SELECT image_id, vessel_map, zone, CASE WHEN len(v) = 6 THEN c*sqrt(g[1]**2+g[2]**2) ELSE -1 END AS e FROM q), b AS (SELECT image_id, zone, coalesce(max(CASE WHEN vessel_map = 'artery' THEN e END), -1) AS a, coalesce(max(CASE WHEN vessel_map = 'vein' THEN e END), -1) AS v FROM e GROUP BY 1, 2)
SELECT image_id, zone, round(CASE WHEN a = -1 OR v = -1 THEN -1 ELSE a / v END, 6) AS "AVR", CASE WHEN a = -1 OR v = -1 THEN false ELSE a / v > 1 END AS warning FROM b""")
def ves_artery_vein_ratio(spark, sf):
    e = views.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("width"))
    w = e.select(F.expr("user_id div 30").alias("image_id"), F.when(F.col("user_id") % 2 == 0, "artery").otherwise("vein").alias("vessel_map"), F.lit("B").alias("zone"), F.col("user_id").alias("path_id"), "width")
    return vessel.avr(vessel.knudtson(vessel.top_widths(w))).select("image_id", "zone", *r6("AVR"), "warning")


# ---- intensity --------------------------------------------------------------


@query(f"""WITH {views.PIXEL}, m AS (SELECT *, avg(v) OVER (PARTITION BY image_id) AS mean FROM pixel), g AS (SELECT image_id, x, y, pow(v, ln(CAST(0.2 AS DOUBLE)) / ln(mean)) AS v FROM m), n AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM g)
SELECT image_id, x, y, round((v - lo) / (hi - lo), 6) AS v FROM n""")
def int_gamma(spark, sf):
    return intensity.gamma_to_mean(views.pixel(spark, sf)).select("image_id", "x", "y", *r6("v"))


@query(f"""WITH {views.PIXEL}, c AS (SELECT image_id, x, sum(v) AS e FROM pixel GROUP BY 1, 2 HAVING sum(v) > 0), r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image_id) AS n, avg(e) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM c WINDOW w AS (PARTITION BY image_id ORDER BY x))
SELECT p.image_id, p.x, p.y, round(p.v * coalesce(CASE WHEN i > 7 AND i <= n - 7 THEN m / e ELSE 1 END, 1), 6) AS v FROM pixel p LEFT JOIN r USING (image_id, x)""")
def int_shadow(spark, sf):
    return intensity.shadow_compensate(views.pixel(spark, sf), 15).select("image_id", "x", "y", *r6("v"))


# ---- regions of interest ----------------------------------------------------


@query(f"""WITH {INTERP}, s AS (SELECT a.image_id, a.bscan, a.layer || '_' || b.layer AS pair, a.x, a.y AS y_top, b.y AS y_bot FROM interp a JOIN interp b USING (image_id, bscan, x) WHERE (a.layer, b.layer) IN (('ILM','RNFL'), ('RNFL','ELM'), ('ELM','BM'), ('ILM','BM'), ('ILM','ELM'))),
p AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sqrt(((x - lag(x) OVER w) * CAST(11.49 AS DOUBLE))**2 + ((y_top - lag(y_top) OVER w) * CAST(3.87 AS DOUBLE))**2), 0) AS step FROM s WINDOW w AS (PARTITION BY image_id, bscan, pair ORDER BY x)),
c AS (SELECT *, sum(step) OVER (PARTITION BY image_id, bscan, pair ORDER BY i) AS c FROM p), r AS (SELECT image_id, bscan, pair, min_by(i, ((x - 32)**2 + (y_top - 100)**2, i)) AS ref FROM c GROUP BY 1, 2, 3),
rc AS (SELECT r.*, max(CASE WHEN i = ref THEN c END) AS cr, max(CASE WHEN i = ref - 1 THEN c END) AS cl FROM r JOIN c USING (image_id, bscan, pair) GROUP BY 1, 2, 3, 4),
f AS (SELECT image_id, bscan, pair, ref, k, min(CASE WHEN i > ref AND c - cr >= 11 * k THEN i END) - ref - 1 AS a, ref - 2 - max(CASE WHEN i < ref - 1 AND cl - c >= 11 * k THEN i END) AS b FROM c JOIN rc USING (image_id, bscan, pair), (SELECT unnest(range(18)) AS k) GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT DISTINCT image_id, bscan, pair, 17 - k AS sample, ref - coalesce(b, 0) AS i FROM f UNION SELECT image_id, bscan, pair, 17 + k, ref + coalesce(a, 0) FROM f),
t AS (SELECT n.*, x, abs(y_bot - y_top) * CAST(3.87 AS DOUBLE) AS t FROM n JOIN c USING (image_id, bscan, pair, i)),
m AS (SELECT image_id, bscan, pair, trunc(round(avg(t), 9)) AS thickness, trunc(round(avg(CASE WHEN sample BETWEEN 14 AND 18 THEN t END), 9)) AS subfoveal_thickness, max(CASE WHEN sample = 0 THEN x END) AS xl, max(CASE WHEN sample = 34 THEN x END) AS xr FROM t GROUP BY 1, 2, 3),
ar AS (SELECT image_id, bscan, pair, round_even(sum(y_bot - y_top + 1) * CAST(11.49 AS DOUBLE) * CAST(3.87 AS DOUBLE) * CAST(1e-6 AS DOUBLE), 6) AS area FROM s JOIN m USING (image_id, bscan, pair) WHERE x >= xl AND x < xr AND y_bot >= y_top GROUP BY 1, 2, 3)
SELECT image_id, bscan, pair, thickness, subfoveal_thickness, coalesce(area, 0) AS area, CAST(NULL AS VARCHAR) AS reason FROM m LEFT JOIN ar USING (image_id, bscan, pair)""")
def roi_linescan(spark, sf):
    t = views.trace(spark, sf)
    fovea = t.select("image_id", "bscan").distinct().selectExpr("image_id", "bscan", "32 AS px", "100 AS py")
    return roi.linescan_measure(t, fovea, 200).select("image_id", "bscan", "pair", *r6("thickness", "subfoveal_thickness", "area"), "reason")


@query(f"""WITH {SLAB}, q AS (SELECT * FROM slab WHERE pair = 'ILM_RNFL' AND x >= 10 AND x <= 50), px AS (SELECT image_id, bscan, pair, x, unnest(range(y_top, y_bot + 1)) AS y FROM q WHERE x < 50),
a AS (SELECT image_id, bscan, pair, count(*) AS n, count(CASE WHEN (x * 7 + y - 1) % 3 = 0 THEN 1 END) AS v FROM px GROUP BY 1, 2, 3)
SELECT image_id, bscan, n AS pixels, round_even(n * CAST(11.49 AS DOUBLE) * CAST(3.87 AS DOUBLE) * 1e-6, 6) AS area, round_even(v / n, 5) AS vascular_index, round_even(v * (CAST(11.49 AS DOUBLE) * 3.87 * 1e-6), 6) AS vessel_area FROM a""")
def roi_area_and_index(spark, sf):
    s = slab(spark, sf).filter("pair = 'ILM_RNFL'")
    quad = s.select("image_id", "bscan", "pair").distinct().selectExpr("*", "10 AS left_x1", "0 AS left_y1", "10 AS left_x2", "500 AS left_y2", "50 AS right_x1", "0 AS right_y1", "50 AS right_x2", "500 AS right_y2")
    px = roi.enclosed_pixels(s, quad)
    lattice = s.select("image_id", "bscan", "x", F.explode(F.sequence(F.col("y_top") - 1, F.col("y_bot"))).alias("y")).filter("(x * 7 + y) % 3 = 0").withColumn("p", F.lit(1.0))
    area, index = roi.enclosed_area(px), roi.vascular_index(px, lattice)
    return area.join(index, roi.SLAB).select("image_id", "bscan", "pixels", "area", "vascular_index", "vessel_area")


# ---- incremental selection --------------------------------------------------


@query("""WITH f AS (SELECT doc_id AS image_id FROM documents), d AS (SELECT doc_id AS image_id FROM labels), a AS (SELECT doc_id AS image_id FROM labels WHERE quality = 0)
SELECT image_id FROM f ANTI JOIN d USING (image_id) UNION ALL SELECT image_id FROM f WHERE image_id IN (SELECT image_id FROM d) AND image_id IN (SELECT image_id FROM a)""")
def src_pending(spark, sf):
    f = views.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    lab = views.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), "quality")
    return files.pending(f, lab, lab.filter("quality = 0"))


@query("""SELECT image_id, path FROM (SELECT page_id AS image_id, url AS path FROM pages) ANTI JOIN (SELECT page_id AS image_id, url AS path FROM pages WHERE page_id % 3 = 0) USING (image_id, path)""")
def src_fresh_annotations(spark, sf):
    p = views.table(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("path"))
    return files.fresh_annotations(p, p.filter("image_id % 3 = 0"))


# ---- further operators ------------------------------------------------------


@query(f"""WITH {views.TRACE}, s AS (SELECT * FROM trace WHERE layer = 'ILM' AND y IS NOT NULL), g AS (SELECT *, coalesce(lag(x, 15) OVER w, first(x) OVER q) AS bx, coalesce(lag(y, 15) OVER w, first(y) OVER q) AS by_, coalesce(lead(x, 15) OVER w, last(x) OVER q) AS ax, coalesce(lead(y, 15) OVER w, last(y) OVER q) AS ay
 FROM s WINDOW w AS (PARTITION BY image_id, bscan ORDER BY x), q AS (PARTITION BY image_id, bscan ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT image_id, bscan, x, round((ay - by_) / (ax - bx), 6) AS slope, round(by_ - (ay - by_) / (ax - bx) * bx, 5) AS intercept FROM g""")
def trc_tangents(spark, sf):
    t = trace.tangent_points(views.trace(spark, sf).filter("layer = 'ILM' and y is not null"))
    slope, intercept = trace.line(F.col("before.x"), F.col("before.y"), F.col("after.x"), F.col("after.y"))
    return t.select("image_id", "bscan", "x", F.round(slope, 6).alias("slope"), F.round(intercept, 5).alias("intercept"))


@query(f"""WITH RECURSIVE {LABELS}, s AS (SELECT image_id, root, count(*) AS n FROM roots GROUP BY 1, 2), b AS (SELECT image_id, root FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, root) AS r FROM s) WHERE r = 1)
SELECT image_id, 'vessel' AS mask, CAST(id % 1000 AS INT) AS x, CAST(min(id // 1000) AS INT) AS y_top, CAST(max(id // 1000) AS INT) AS y_bot FROM roots JOIN b USING (image_id, root) GROUP BY image_id, id % 1000""")
def trc_largest_region_bounds(spark, sf):
    return trace.extract_bounds(trace.largest_component(views.mask_pixel(spark, sf)))


@query(f"""WITH RECURSIVE {LABELS}, n AS (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM roots)
SELECT image_id, CAST(id % 1000 AS INT) AS x, CAST(id // 1000 AS INT) AS y, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS label FROM n WHERE n >= 4""")
def msk_drop_short(spark, sf):
    return mask.drop_short(views.mask_pixel(spark, sf), 4).select("image_id", "x", "y", "label")


@query(f"""WITH RECURSIVE {LABELS}, f AS (SELECT image_id, min(root) AS root FROM roots GROUP BY 1), l AS (SELECT image_id, id % 1000 AS x, id // 1000 AS y FROM roots JOIN f USING (image_id, root)),
m AS (SELECT image_id, var_pop(x) + CAST(1 AS DOUBLE)/12 AS vx, var_pop(y) + CAST(1 AS DOUBLE)/12 AS vy, covar_pop(x, y) AS vxy FROM l GROUP BY 1), e AS (SELECT *, sqrt((vx - vy)**2 + 4 * vxy**2) AS rt FROM m)
SELECT image_id, CAST(trunc((4 * sqrt(greatest(0, (vx + vy - rt) / 2)) + 4 * sqrt((vx + vy + rt) / 2)) / 4) AS INT) AS radius FROM e""")
def msk_disc_radius(spark, sf):
    return mask.disc_radius(views.mask_pixel(spark, sf)).select("image_id", "radius")


@query(f"""WITH {views.MASK}, {views.LABEL} SELECT image_id, x, y FROM mask_pixel SEMI JOIN (SELECT image_id, x, y FROM label_pixel WHERE gray = 191) USING (image_id, x, y)""")
def msk_clip_to_region(spark, sf):
    region = mask.decode_labels(views.label_pixel(spark, sf)).filter("mask = 'artery'")
    return mask.clip_to_region(views.mask_pixel(spark, sf), region).select("image_id", "x", "y")


@query(f"""WITH {views.MASK}, d AS (SELECT DISTINCT image_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM mask_pixel, {OFFS}) SELECT 'dilate' AS op, * FROM d
UNION ALL SELECT 'erode', a.image_id, a.x, a.y FROM mask_pixel a JOIN mask_pixel b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY 2, 3, 4 HAVING count(*) = 5""")
def msk_morphology(spark, sf):
    m = views.mask_pixel(spark, sf)
    parts = {"dilate": mask.dilate(m, mask.disk(1)), "erode": mask.erode(m, mask.disk(1))}
    return shape.union_results([df.select(F.lit(k).alias("op"), "image_id", "x", "y") for k, df in parts.items()])


def thick_rows(spark, sf) -> DataFrame:
    t = trace.stack_thickness(slab(spark, sf).filter("pair = 'ILM_BM'"), 64)
    return t.select("image_id", F.col("pair").alias("map"), "bscan", "x", F.col("thickness").alias("value"))


ROWS = f"""{SLAB}, th AS (SELECT image_id, bscan, CAST(l.x AS INT) AS x, coalesce((y_bot - y_top) * CAST(3.87 AS DOUBLE), -1) AS value FROM (SELECT image_id, bscan, unnest(range(64)) AS x FROM (SELECT DISTINCT image_id, bscan FROM slab WHERE pair = 'ILM_BM')) l LEFT JOIN (SELECT * FROM slab WHERE pair = 'ILM_BM') USING (image_id, bscan, x)),
mv AS (SELECT image_id, bscan, x + 40 - 32 AS x, value FROM th), lt AS (SELECT image_id, bscan, unnest(range(80)) AS x FROM (SELECT DISTINCT image_id, bscan FROM mv)), j AS (SELECT image_id, bscan, CAST(lt.x AS INT) AS x, value, CASE WHEN value <> -1 THEN value END AS k FROM lt LEFT JOIN mv USING (image_id, bscan, x)),
placed AS (SELECT image_id, bscan, x, coalesce(value, -1) AS value, coalesce(last_value(k IGNORE NULLS) OVER b, first_value(k IGNORE NULLS) OVER f) AS edge FROM j WINDOW b AS (PARTITION BY image_id, bscan ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY image_id, bscan ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {ROWS} SELECT image_id, bscan, x, round(value, 6) AS value, round(edge, 6) AS edge FROM placed")
def map_place_rows(spark, sf):
    centre = thick_rows(spark, sf).select("image_id").distinct().selectExpr("image_id", "40 AS cx", "64 AS n_x")
    return maps.place_rows(thick_rows(spark, sf), centre, 80).select("image_id", "bscan", "x", *r6("value", "edge"))


@query(f"""WITH {ROWS}, t AS (SELECT image_id, last, y, y * last / CAST(8 AS DOUBLE) AS at_ FROM (SELECT image_id, max(bscan) AS last, unnest(range(9)) AS y FROM placed GROUP BY 1)),
w AS (SELECT image_id, y, CAST(floor(at_) AS INT) + k AS bscan, CASE WHEN k = 0 THEN 1 - (at_ - floor(at_)) ELSE at_ - floor(at_) END AS w FROM t, (VALUES (0), (1)) q(k))
SELECT image_id, p.x, CAST(y AS INT) AS y, round(sum(edge * w) / sum(w), 6) AS value FROM w JOIN placed p USING (image_id, bscan) WHERE w > 0 GROUP BY 1, 2, 3""")
def map_resample_rows(spark, sf):
    centre = thick_rows(spark, sf).select("image_id").distinct().selectExpr("image_id", "40 AS cx", "64 AS n_x")
    rows = maps.place_rows(thick_rows(spark, sf), centre, 80)
    return maps.resample_rows(rows.select("image_id", "map", "bscan", "x", F.col("edge").alias("value")), 9).select("image_id", "x", "y", *r6("value"))


@query(f"""WITH {ACQ} SELECT image_id, bscan, CAST(trunc(start_x + (end_x - start_x) * coalesce(CASE WHEN bscan % 2 = 0 THEN (image_id % 700) / CAST(767 AS DOUBLE) END, 0.5)) AS BIGINT) AS slo_x,
 CAST(trunc(start_y + (end_y - start_y) * coalesce(CASE WHEN bscan % 2 = 0 THEN (image_id % 700) / CAST(767 AS DOUBLE) END, 0.5)) AS BIGINT) AS slo_y FROM acq""")
def map_fovea_on_localiser(spark, sf):
    acq = meta.acquisition_px(views.bscan_meta(spark, sf), views.scan(spark, sf)).withColumn("n_x", F.lit(768))
    fovea = acq.filter("bscan % 2 = 0").select("image_id", "bscan", (F.col("image_id") % 700).alias("fovea_x"))
    return maps.fovea_on_localiser(acq, fovea)


@query(f"""WITH {views.SCAN} SELECT image_id, fovea_x - h >= 0 AND fovea_x + h <= 768 AND fovea_y - h >= 0 AND fovea_y + h <= 768 AS grid_fits FROM (SELECT *, 7000 / scale_x / 2 AS h FROM scan)""")
def map_grid_fits(spark, sf):
    s = views.scan(spark, sf).withColumnsRenamed({"fovea_x": "cx", "fovea_y": "cy", "scale_x": "slo_scale"})
    return maps.grid_fits(s, 768).select("image_id", "grid_fits")


@query(f"""WITH {views.PATH}, {views.MASK}, n AS (SELECT a.image_id, a.x, a.y FROM mask_pixel a LEFT JOIN mask_pixel b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3 HAVING count(b.x) < 4),
p AS (SELECT DISTINCT image_id, CAST(col * 5 AS DOUBLE) AS px, CAST(row % 64 AS DOUBLE) AS py FROM path), d AS (SELECT p.*, n.x, n.y, sqrt((n.x - px)**2 + (n.y - py)**2) AS d FROM p JOIN n USING (image_id))
SELECT image_id, px, py, min_by(x, (d, y, x)) AS tx, min_by(y, (d, y, x)) AS ty, round(min(d), 6) AS distance FROM d GROUP BY 1, 2, 3""")
def ves_snap(spark, sf):
    p = views.path(spark, sf).select("image_id", (F.col("col") * 5).cast("double").alias("px"), (F.col("row") % 64).cast("double").alias("py"))
    return vessel.snap(p, views.mask_pixel(spark, sf)).select("image_id", "px", "py", "tx", "ty", *r6("distance"))


def vessel_rows(spark, sf) -> DataFrame:
    e = views.table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("binary"), F.lit("artery"), F.lit("vein")), (F.col("user_id") % 3 + 1).cast("int"))
    zone = F.element_at(F.array(F.lit("B"), F.lit("C"), F.lit("whole")), (F.col("event_id") % 3 + 1).cast("int"))
    long = e.groupBy((F.col("user_id") % 7).alias("image_id"), kind.alias("vessel_map"), zone.alias("zone")).agg(F.round(F.avg("value"), 6).alias("vessel_density"), F.round(F.max("value"), 6).alias("tortuosity_density"))
    return long.unpivot(["image_id", "vessel_map", "zone"], ["vessel_density", "tortuosity_density"], "feature", "value")


VROWS = """vm AS (SELECT user_id % 7 AS image_id, ['binary','artery','vein'][CAST(user_id % 3 AS INT) + 1] AS vessel_map, ['B','C','whole'][CAST(event_id % 3 AS INT) + 1] AS zone,
 unnest(['vessel_density','tortuosity_density']) AS feature, unnest([round(avg(value), 6), round(max(value), 6)]) AS value FROM events GROUP BY 1, 2, 3),
nz AS (SELECT image_id, vessel_map, zone, feature, CASE WHEN feature = 'vessel_density' AND zone IN ('B','C') THEN CAST(-1 AS DOUBLE) ELSE value END AS value FROM vm)"""


@query(f"""WITH {VROWS} SELECT * FROM nz UNION ALL SELECT image_id, 'artery-vein', zone, f, CASE WHEN f = 'AVR' THEN image_id / CAST(10 AS DOUBLE) ELSE -1 END FROM (SELECT DISTINCT image_id, zone FROM vm), (VALUES ('AVR'), ('vessel_density'), ('tortuosity_density')) q(f)""")
def ves_result_rows(spark, sf):
    m = vessel.null_zone_features(vessel_rows(spark, sf))
    ratio = m.select("image_id", "zone").distinct().withColumn("AVR", F.col("image_id") / 10)
    return vessel.append_avr(m, ratio, ["vessel_density", "tortuosity_density"])


@query(f"""WITH {VROWS} SELECT image_id, max(CASE WHEN vessel_map = 'artery' AND zone = 'whole' AND feature = 'vessel_density' THEN value END) AS vessel_density_artery_whole, max(CASE WHEN vessel_map = 'vein' AND zone = 'B' AND feature = 'tortuosity_density' THEN value END) AS tortuosity_density_vein_B,
 max(CASE WHEN vessel_map = 'vein' AND zone = 'B' AND feature = 'vessel_density' AND value <> -1 THEN value END) AS vessel_density_vein_B FROM nz GROUP BY 1""")
def shp_wide_vessel(spark, sf):
    wide = shape.wide_vessel(vessel.null_zone_features(vessel_rows(spark, sf)), ["vessel_density", "tortuosity_density", "tortuosity_distance"], ["B", "C", "whole"])
    return wide.select("image_id", "vessel_density_artery_whole", "tortuosity_density_vein_B", "vessel_density_vein_B")


@query(f"""WITH {ETDRS}, s AS (SELECT image_id, subfield, CAST(trunc(avg(value)) AS DOUBLE) AS mean, round_even(sum(value) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3) AS volume FROM sub WHERE subfield IS NOT NULL GROUP BY 1, 2)
SELECT image_id, max(CASE WHEN subfield = 'central' THEN mean END) AS "central_retina_[um]", max(CASE WHEN subfield = 'inner_nasal' THEN mean END) AS "inner_nasal_retina_[um]", round(max(CASE WHEN subfield = 'central' THEN volume END), 6) AS "central_retina_[mm3]", round(max(CASE WHEN subfield = 'inner_nasal' THEN volume END), 6) AS "inner_nasal_retina_[mm3]" FROM s GROUP BY 1""")
def shp_wide_grid(spark, sf):
    stats = maps.subfield_stats(maps.etdrs_subfield(cells(spark, sf), grid_scan(spark, sf)), 110.0, fill=False)
    long = stats.select("image_id", "map", "subfield", "mean", "volume").unpivot(["image_id", "map", "subfield"], ["mean", "volume"], "feature", "value")
    wide = shape.wide_grid(long.filter("subfield in ('central', 'inner_nasal')"), ["retina"], ["central", "inner_nasal"])
    return wide.select("image_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns[1:]])


@query(f"""WITH {views.PIXEL} SELECT image_id, x, y, round((v / 255 - lo) / (hi - lo), 6) AS v FROM (SELECT *, min(v / 255) OVER (PARTITION BY image_id) AS lo, max(v / 255) OVER (PARTITION BY image_id) AS hi FROM pixel)""")
def int_normalise(spark, sf):
    return intensity.normalise(intensity.scale_255(views.pixel(spark, sf))).select("image_id", "x", "y", *r6("v"))


@query(f"""WITH {views.SCAN} SELECT image_id, filename, round(scale_x * 1000, 6) AS scale_x_um, round(scale_z * 1000, 6) AS scale_z_um, pattern FROM scan""")
def meta_scan_projection(spark, sf):
    return meta.scan_projection(views.scan(spark, sf)).select("image_id", "filename", *r6("scale_x_um", "scale_z_um"), "pattern")


@query("""SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice / 100 END AS v, CASE WHEN o_orderkey % 50 = 0 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 50 = 0 THEN 'ValueError: no layers in ' || o_orderkey END AS error FROM orders""")
def ops_quarantine(spark, sf):
    from pyspark.sql import types as T

    from ..operators import batch

    def measure(row):
        if row["image_id"] % 50 == 0:
            raise ValueError(f"no layers in {int(row['image_id'])}")
        return {"v": row["o_totalprice"] / 100}

    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), "o_totalprice")
    return batch.safe_apply(o, measure, T.StructType([T.StructField("v", T.DoubleType())]))


@query(f"""WITH {views.LABEL}, m AS (SELECT image_id, CASE gray WHEN 191 THEN 'artery' WHEN 127 THEN 'vein' ELSE 'disc' END AS mask, x, y FROM label_pixel), e AS (SELECT image_id, mask, x + 1 AS x, y FROM m WHERE image_id % 3 = 0 AND mask = 'disc')
SELECT * FROM m ANTI JOIN e USING (image_id, mask) UNION ALL SELECT * FROM e""")
def ops_apply_edits(spark, sf):
    from ..operators import batch

    m = mask.decode_labels(views.label_pixel(spark, sf)).filter("mask <> 'any'")
    edits = m.filter("image_id % 3 = 0 and mask = 'disc'").withColumn("x", F.col("x") + 1)
    return batch.apply_edits(m, edits)[0]


@query(f"""WITH {views.PROFILE}, p AS (SELECT image_id, x, coalesce(value, 0) AS value FROM profile) SELECT image_id, CAST(CASE WHEN image_id % 2 = 0 THEN (x - image_id % 64 + 32 + 128) % 64 ELSE (image_id % 64 - x + 32 + 128) % 64 END AS INT) AS x, value FROM p""")
def ppl_circular_shift(spark, sf):
    p = views.profile(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))
    ids = p.select("image_id").distinct()
    eye = ids.select("image_id", F.when(F.col("image_id") % 2 == 0, "Right").otherwise("Left").alias("eye"))
    return disc.circular_shift(p, ids.select("image_id", (F.col("image_id") % 64).cast("int").alias("temporal_index")), 64, eye)


def vessel_geometry(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths of thirty users to an image, once more as binary ones; masks one pixel about them; the disc."""
    p = views.path(spark, sf).withColumn("image_id", F.expr("path_id div 30"))
    p = p.unionByName(p.withColumn("vessel_map", F.lit("binary")))
    m = mask.dilate(p.select("image_id", F.col("vessel_map").alias("mask"), F.col("col").alias("x"), F.col("row").alias("y")), mask.disk(1)).filter("x >= 0 and y >= 0")
    return p, m, p.select("image_id").distinct().selectExpr("image_id", "5 AS disc_x", "40 AS disc_y", "10 AS disc_radius")


IN_ZONES = "(SELECT unnest([{{'z': 'whole', 'lo': -1, 'hi': 100000}}, {{'z': 'B', 'lo': 20, 'hi': 30}}, {{'z': 'C', 'lo': 30, 'hi': 50}}]) AS zz)".replace("{{", "{").replace("}}", "}")
VESSELS = f"""{views.PATH}, p0 AS (SELECT path_id // 30 AS image_id, vessel_map, path_id, seq, row, col FROM path), p1 AS (SELECT * FROM p0 UNION ALL SELECT image_id, 'binary', path_id, seq, row, col FROM p0),
mk AS (SELECT DISTINCT image_id, vessel_map, col + dx AS x, row + dy AS y FROM p1, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx, dy) WHERE col + dx >= 0 AND row + dy >= 0),
zm AS (SELECT image_id, vessel_map, zz.z AS zone, x, y FROM mk, {IN_ZONES} WHERE sqrt((x - 5)**2 + (y - 40)**2) > zz.lo AND sqrt((x - 5)**2 + (y - 40)**2) <= zz.hi),
zp AS (SELECT * FROM (SELECT p1.*, zz.z AS zone, count(*) OVER (PARTITION BY image_id, vessel_map, path_id, zz.z) AS n FROM p1, {IN_ZONES} WHERE sqrt((col - 5)**2 + (row - 40)**2) > zz.lo AND sqrt((col - 5)**2 + (row - 40)**2) <= zz.hi) WHERE zone = 'whole' OR n >= 10),
box AS (SELECT image_id, vessel_map, zone, unnest(range(greatest(0, min(x) - 1), least(127, max(x) + 1) + 1)) AS x, greatest(0, min(y) - 1) AS y0, least(127, max(y) + 1) AS y1 FROM zm GROUP BY 1, 2, 3),
bg AS (SELECT * FROM (SELECT image_id, vessel_map, zone, x, unnest(range(y0, y1 + 1)) AS y FROM box) ANTI JOIN zm USING (image_id, vessel_map, zone, x, y)),
ds AS (SELECT a.image_id, a.vessel_map, a.zone, a.x, a.y, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM zm a JOIN bg b ON a.image_id = b.image_id AND a.vessel_map = b.vessel_map AND a.zone = b.zone GROUP BY 1, 2, 3, 4, 5),
sm AS (SELECT image_id, vessel_map, zone, path_id, seq, CAST(trunc(avg(row) OVER w) AS INT) AS row, CAST(trunc(avg(col) OVER w) AS INT) AS col FROM zp WINDOW w AS (PARTITION BY image_id, vessel_map, zone, path_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
gr AS (SELECT sm.*, coalesce(d, 0) + 2 AS d, coalesce((lead(row) OVER w - lag(row) OVER w) / 2, lead(row) OVER w - row, row - lag(row) OVER w) AS gr, coalesce((lead(col) OVER w - lag(col) OVER w) / 2, lead(col) OVER w - col, col - lag(col) OVER w) AS gc
 FROM sm LEFT JOIN ds ON ds.image_id = sm.image_id AND ds.vessel_map = sm.vessel_map AND ds.zone = sm.zone AND ds.x = sm.col AND ds.y = sm.row WINDOW w AS (PARTITION BY sm.image_id, sm.vessel_map, sm.zone, sm.path_id ORDER BY seq)),
ed AS (SELECT image_id, vessel_map, zone, path_id, seq, s, round(row + s * d * cos(atan2(gc, gr) + pi() / 2), 6) AS py, round(col + s * d * sin(atan2(gc, gr) + pi() / 2), 6) AS px FROM gr, (VALUES (1), (-1)) q(s)),
bd AS (SELECT a.image_id, a.vessel_map, a.zone, a.x, a.y FROM zm a LEFT JOIN zm b ON a.image_id = b.image_id AND a.vessel_map = b.vessel_map AND a.zone = b.zone AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3, 4, 5 HAVING count(b.x) < 4),
pt AS (SELECT DISTINCT image_id, vessel_map, zone, px, py FROM ed),
sn AS (SELECT pt.image_id, pt.vessel_map, pt.zone, px, py, min_by([x, y], (sqrt((x - px) * (x - px) + (y - py) * (y - py)), y, x)) AS t FROM pt JOIN bd ON pt.image_id = bd.image_id AND pt.vessel_map = bd.vessel_map AND pt.zone = bd.zone GROUP BY 1, 2, 3, 4, 5),
wd AS (SELECT image_id, vessel_map, zone, path_id, avg(w) AS width FROM (SELECT ed.image_id, ed.vessel_map, ed.zone, path_id, seq, sqrt((max(CASE WHEN s = 1 THEN t[1] END) - max(CASE WHEN s = -1 THEN t[1] END))**2 + (max(CASE WHEN s = 1 THEN t[2] END) - max(CASE WHEN s = -1 THEN t[2] END))**2) AS w
 FROM ed JOIN sn ON sn.image_id = ed.image_id AND sn.vessel_map = ed.vessel_map AND sn.zone = ed.zone AND sn.px = ed.px AND sn.py = ed.py GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {VESSELS} SELECT image_id, vessel_map, zone, path_id, round(width, 6) AS width FROM wd")
def ves_widths(spark, sf):
    p, m, s = vessel_geometry(spark, sf)
    kept = vessel.zonal_paths(vessel.zones(p, s, "col", "row")).withColumn("vessel_map", F.concat_ws("|", "vessel_map", "zone")).drop("zone")
    zone_mask = vessel.zones(m, s).select("image_id", F.concat_ws("|", "mask", "zone").alias("mask"), "x", "y")
    w = vessel.zonal_widths(kept, zone_mask, 128)
    return w.select("image_id", F.substring_index("vessel_map", "|", 1).alias("vessel_map"), F.substring_index("vessel_map", "|", -1).alias("zone"), "path_id", *r6("width"))


@query(f"""WITH {VESSELS}, st AS (SELECT *, sqrt((row - lag(row) OVER w)**2 + (col - lag(col) OVER w)**2) AS step, coalesce(sign(col - lag(col) OVER w) <> sign(lead(col) OVER w - col), false) AS turn FROM zp WINDOW w AS (PARTITION BY image_id, vessel_map, zone, path_id ORDER BY seq)),
sg AS (SELECT *, sum(CAST(turn AS INT)) OVER (PARTITION BY image_id, vessel_map, zone, path_id ORDER BY seq) AS seg, sum(CAST(turn AS INT)) OVER (PARTITION BY image_id, vessel_map, zone, path_id) AS turns FROM st),
ss AS (SELECT *, CASE WHEN lag(seg) OVER (PARTITION BY image_id, vessel_map, zone, path_id ORDER BY seq) = seg THEN step END AS inner_ FROM sg),
pr AS (SELECT image_id, vessel_map, zone, path_id, seg, max(turns) AS n, coalesce(sum(inner_), 0) AS curve, coalesce(sum(step), 0) AS part, sqrt((max_by(row, seq) - min_by(row, seq))**2 + (max_by(col, seq) - min_by(col, seq))**2) AS ch FROM ss GROUP BY 1, 2, 3, 4, 5),
pp AS (SELECT image_id, vessel_map, zone, path_id, max(n) AS n, sum(part) AS length, sum(CASE WHEN seg < n AND ch > 0 THEN curve / ch - 1 ELSE 0 END) AS ex FROM pr GROUP BY 1, 2, 3, 4),
ln_ AS (SELECT image_id, vessel_map, zone, path_id, sqrt((max_by(row, seq) - min_by(row, seq))**2 + (max_by(col, seq) - min_by(col, seq))**2) AS chord FROM zp GROUP BY 1, 2, 3, 4),
bx AS (SELECT image_id, vessel_map, s AS size, x // s AS bx, y // s AS by_, count(*) AS n FROM mk, (SELECT unnest([128, 64, 32, 16, 8, 4]) AS s) GROUP BY 1, 2, 3, 4, 5), bc AS (SELECT image_id, vessel_map, size, count(*) AS boxes FROM bx WHERE n < size * size GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, vessel_map, zone ORDER BY width DESC, path_id) AS r FROM wd WHERE zone <> 'whole' AND vessel_map <> 'binary'), tp AS (SELECT image_id, vessel_map, zone, CASE vessel_map WHEN 'artery' THEN CAST(0.88 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS c, list(width ORDER BY width) AS v FROM rk WHERE r <= 6 GROUP BY 1, 2, 3),
k1 AS (SELECT *, list_sort([c*sqrt(v[1]**2+v[6]**2), c*sqrt(v[2]**2+v[5]**2), c*sqrt(v[3]**2+v[4]**2)]) AS f FROM tp), k2 AS (SELECT *, list_sort([c*sqrt(f[1]**2+f[3]**2), f[2]]) AS g FROM k1), eq AS (SELECT image_id, vessel_map, zone, CASE WHEN len(v) = 6 THEN c*sqrt(g[1]**2+g[2]**2) * CAST(11.49 AS DOUBLE) ELSE -1 END AS e FROM k2),
me AS (SELECT image_id, vessel_map, zone, 'tortuosity_density' AS feature, avg(CASE WHEN n = 0 THEN 0 ELSE (n - 1) / n + ex / nullif(length, 0) END) AS value FROM pp GROUP BY 1, 2, 3
 UNION ALL SELECT image_id, vessel_map, zone, 'tortuosity_distance', avg(length / nullif(chord, 0)) FROM pp JOIN ln_ USING (image_id, vessel_map, zone, path_id) GROUP BY 1, 2, 3
 UNION ALL SELECT image_id, vessel_map, zone, 'average_local_calibre', avg(width) * CAST(11.49 AS DOUBLE) FROM wd GROUP BY 1, 2, 3
 UNION ALL SELECT image_id, vessel_map, 'whole', 'fractal_dimension', -regr_slope(ln(boxes), ln(size)) FROM bc GROUP BY 1, 2
 UNION ALL SELECT image_id, vessel_map, 'whole', 'vessel_density', count(*) / CAST(16384 AS DOUBLE) FROM mk GROUP BY 1, 2
 UNION ALL SELECT image_id, vessel_map, 'whole', 'average_global_calibre', v / s * CAST(11.49 AS DOUBLE) FROM (SELECT image_id, vessel_map, count(*) AS v FROM mk GROUP BY 1, 2) JOIN (SELECT image_id, vessel_map, count(*) AS s FROM (SELECT DISTINCT image_id, vessel_map, row, col FROM p1) GROUP BY 1, 2) USING (image_id, vessel_map)
 UNION ALL SELECT image_id, vessel_map, zone, CASE vessel_map WHEN 'artery' THEN 'CRAE_Knudtson' ELSE 'CRVE_Knudtson' END, e FROM eq),
fl AS (SELECT image_id, vessel_map, zone, feature FROM (SELECT DISTINCT image_id, vessel_map FROM p1), (SELECT unnest(['B','C','whole']) AS zone), (SELECT unnest(['fractal_dimension','vessel_density','average_global_calibre','average_local_calibre','tortuosity_density','tortuosity_distance','CRAE_Knudtson','CRVE_Knudtson']) AS feature)),
av AS (SELECT image_id, zone, max(CASE WHEN vessel_map = 'artery' THEN e END) AS a, max(CASE WHEN vessel_map = 'vein' THEN e END) AS v FROM eq GROUP BY 1, 2)
SELECT image_id, vessel_map, zone, feature, round(CASE WHEN zone IN ('B','C') AND feature IN ('fractal_dimension','vessel_density','average_global_calibre') THEN -1 WHEN feature LIKE '%Knudtson' THEN coalesce(value, -1) ELSE value END, 6) AS value FROM fl LEFT JOIN me USING (image_id, vessel_map, zone, feature)
UNION ALL SELECT image_id, 'artery-vein', zone, feature, round(CASE WHEN feature = 'AVR' AND coalesce(a, -1) <> -1 AND coalesce(v, -1) <> -1 THEN a / v ELSE -1 END, 6) FROM (SELECT DISTINCT image_id, zone, feature FROM fl UNION SELECT DISTINCT image_id, zone, 'AVR' FROM fl) LEFT JOIN av USING (image_id, zone)""")
def ves_measure(spark, sf):
    p, m, s = vessel_geometry(spark, sf)
    skeleton = p.select("image_id", F.col("vessel_map").alias("mask"), F.col("col").alias("x"), F.col("row").alias("y")).distinct()
    return vessel.vessel_measure(p, m, skeleton, s, 128, 11.49).select("image_id", "vessel_map", "zone", "feature", *r6("value"))
