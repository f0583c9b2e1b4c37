"""Further registered queries: sources and sinks, maps, masks and paths that no query of `registry` runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import batch, disc, maps, mask, meta, roi, shape, trace, vessel
from ..sources import files, views
from ..sources.shared import discard, fresh_path, materialise
from ..streaming import ingest
from .registry import CELLS, ETDRS, FILLED, FOOT, INTERP, KERNEL, LABELS, NEAREST, ORACLE_SQL, ROWS, SLAB, VROWS, cells, grid_scan, measured, query, r6, slab, thick_rows, vessel_rows

# ---- sources and sinks ------------------------------------------------------


@query()
def src_catalogue(spark, sf):
    """The tables' own files; SQL has no folder to look into."""
    return files.catalogue(spark, sf, "*.parquet").select("image_id", "size")


COLLATED = f"""{views.MEASUREMENT}, {views.SCAN}, good AS (SELECT image_id, CASE layer WHEN 'ILM_BM' THEN 'retina' WHEN 'ILM_ELM' THEN 'inner_retina' WHEN 'ELM_BM' THEN 'outer_retina' ELSE layer END AS layer, feature, value, pattern,
 CASE WHEN pattern IN ('H-line','V-line','AV-line') THEN 'linescan' WHEN pattern = 'Radial' THEN 'radial' WHEN pattern = 'Peripapillary' THEN 'peripapillary' ELSE 'ppole_etdrs' END AS kind
 FROM measurement JOIN scan USING (image_id) WHERE NOT failed AND (image_id, layer) IN (SELECT (image_id, layer) FROM measurement GROUP BY image_id, layer HAVING bool_or(value <> -1)))"""


def collated(spark, sf):
    return shape.routed(views.scan(spark, sf), views.measurement(spark, sf)).select("image_id", "pattern", "kind", "layer", "feature", "value")


@query(f"WITH {COLLATED} SELECT image_id, pattern, kind, layer, feature, CASE WHEN image_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM good WHERE pattern IN ('H-line', 'Radial')")
def src_result_store(spark, sf):
    """Written as the store's partitions, twice; every third image measured anew in a later run; read back for two patterns.
    The rows are made once and put aside until all runs are written."""
    root, rows = fresh_path(spark, "results"), materialise(collated(spark, sf), "collated")
    for _ in range(2):
        files.write_results(rows, root, "monday")
    files.write_results(rows.filter("image_id % 3 = 0").withColumn("value", F.col("value") + 1), root, "tuesday")
    discard(rows)
    return files.load_results(spark, root, ["H-line", "Radial"]).select("image_id", "pattern", "kind", "layer", "feature", "value")


@query(f"WITH {views.MEASUREMENT} SELECT image_id, layer, feature, value FROM measurement")
def src_per_image_store(spark, sf):
    root = fresh_path(spark, "per-image")
    for _ in range(2):
        files.write_per_image(views.measurement(spark, sf), root, 16)
    return files.committed(spark, root).drop("bucket")


@query(f"WITH {VROWS} SELECT image_id, vessel_map, zone, feature, CASE WHEN zone = 'B' AND image_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM vm")
def src_replaced_zone(spark, sf):
    """Zone B of every third image is measured anew, twice with the same outcome; other zones and images stay."""
    root, rows = fresh_path(spark, "zones"), vessel_rows(spark, sf)
    files.replace_zone(rows, root)
    for _ in range(2):
        files.replace_zone(rows.filter("zone = 'B' AND image_id % 3 = 0").withColumn("value", F.col("value") + 1), root)
    return spark.read.parquet(root).select("image_id", "vessel_map", "zone", "feature", "value")


@query("""SELECT user_id || ' [' || event_type || '] ' || 'event ' || event_id AS value FROM events""")
def src_logs(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("level"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("msg"))
    root = fresh_path(spark, "logs")
    files.write_logs(e, root)
    return spark.read.text(root)


# ---- traces and regions of interest -----------------------------------------


@query(f"""WITH RECURSIVE {LABELS}, s AS (SELECT image_id, root, count(*) AS n FROM roots GROUP BY 1, 2), b AS (SELECT image_id, root FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, root) AS r FROM s) WHERE r = 1),
bd AS (SELECT image_id, id % 1000 AS x, min(id // 1000) AS t, max(id // 1000) AS u FROM roots JOIN b USING (image_id, root) GROUP BY 1, 2), ln_ AS (SELECT image_id, 'y_top' AS layer, x, CAST(t AS DOUBLE) AS y FROM bd UNION ALL SELECT image_id, 'y_bot', x, CAST(u AS DOUBLE) FROM bd),
p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image_id, layer) AS n, abs(lead(y) OVER w - y) > 1 AS jump FROM ln_ WINDOW w AS (PARTITION BY image_id, layer ORDER BY x)),
c AS (SELECT *, max(CASE WHEN jump AND i < 20 THEN i END) OVER q AS l, min(CASE WHEN jump AND i > n - 20 THEN i END) OVER q AS r FROM p WINDOW q AS (PARTITION BY image_id, layer)),
k AS (SELECT image_id, layer, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM c WHERE i > coalesce(l, 0) AND i <= coalesce(r, n) WINDOW w AS (PARTITION BY image_id, layer ORDER BY x)),
d AS (SELECT image_id, layer, pos AS x, CAST(trunc(y + (pos - x) * (y2 - y) / (x2 - x)) AS BIGINT) AS y FROM (SELECT *, unnest(range(x, x2)) AS pos FROM k WHERE x2 IS NOT NULL)),
sl AS (SELECT image_id, x, max(CASE WHEN layer = 'y_top' THEN y END) AS y_top, max(CASE WHEN layer = 'y_bot' THEN y END) AS y_bot FROM d GROUP BY 1, 2),
e AS (SELECT image_id, greatest(min(CASE WHEN y_top IS NOT NULL THEN x END), min(CASE WHEN y_bot IS NOT NULL THEN x END)) AS lo, least(max(CASE WHEN y_top IS NOT NULL THEN x END), max(CASE WHEN y_bot IS NOT NULL THEN x END)) AS hi FROM sl GROUP BY 1)
SELECT image_id, CAST(x AS INT) AS x, y_top, y_bot FROM sl JOIN e USING (image_id) WHERE x >= lo AND x < hi AND y_top IS NOT NULL AND y_bot IS NOT NULL""")
def trc_mask_to_trace(spark, sf):
    return trace.mask_to_trace(views.mask_pixel(spark, sf), 0).select("image_id", "x", "y_top", "y_bot")


@query(f"WITH {INTERP} SELECT * FROM interp")
def trc_melted(spark, sf):
    """A wide sheet with a column for each x, and back."""
    wide = trace.widen_traces(views.trace(spark, sf), 64)
    columns = [f"x_{x}" for x in range(64)]
    return trace.melt_traces(wide.select("image_id", "bscan", "layer", *[F.col("y")[x].alias(c) for x, c in enumerate(columns)]), columns)


@query(f"""WITH {SLAB}, q AS (SELECT * FROM slab WHERE pair = 'ILM_RNFL'), g AS (SELECT *, coalesce(lag(x, 15) OVER w, first(x) OVER p) AS bx, coalesce(lag(y_top, 15) OVER w, first(y_top) OVER p) AS by_, coalesce(lead(x, 15) OVER w, last(x) OVER p) AS ax, coalesce(lead(y_top, 15) OVER w, last(y_top) OVER p) AS ay
 FROM q WINDOW w AS (PARTITION BY image_id, bscan ORDER BY x), p AS (PARTITION BY image_id, bscan ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
deep AS (SELECT image_id, bscan, max(y_bot) AS deepest FROM q GROUP BY 1, 2),
w AS (SELECT *, x - (ay - by_) / (ax - bx) * (wy - y_top) AS wx FROM (SELECT g.*, unnest(range(y_top, deepest + 1)) AS wy FROM g JOIN deep USING (image_id, bscan) WHERE ax <> bx)),
m AS (SELECT w.image_id, w.bscan, w.x, w.y_top, wy, q.x AS fx, q.y_bot AS fy, sqrt((wx - q.x)**2 + (wy - q.y_bot)**2) AS d FROM w JOIN q ON w.image_id = q.image_id AND w.bscan = q.bscan AND CAST(trunc(wx) AS BIGINT) = q.x),
f AS (SELECT image_id, bscan, x, y_top, min_by(fx, (d, wy)) AS fx, min_by(fy, (d, wy)) AS fy FROM m GROUP BY 1, 2, 3, 4 HAVING min(d) <= 2), l AS (SELECT image_id, bscan, unnest(range(64)) AS x FROM (SELECT DISTINCT image_id, bscan FROM q))
SELECT image_id, bscan, CAST(l.x AS INT) AS x, round(coalesce(sqrt(((fx - l.x) * CAST(11.49 AS DOUBLE))**2 + ((fy - y_top) * CAST(3.87 AS DOUBLE))**2), -1), 6) AS thickness FROM l LEFT JOIN f USING (image_id, bscan, x)""")
def trc_perpendicular_stack(spark, sf):
    got = trace.stack_thickness(slab(spark, sf).filter("pair = 'ILM_RNFL'"), 64, how="perpendicular")
    return got.select("image_id", "bscan", "x", *r6("thickness"))


@query(f"""WITH {SLAB}, q AS (SELECT * FROM slab WHERE pair = 'ILM_BM'), s AS (SELECT image_id, bscan, x // 8 AS sample, unnest(range(x - 2, x + 3)) AS x FROM q WHERE x % 8 = 4)
SELECT image_id, bscan, CAST(sample AS INT) AS sample, round_even(avg(abs(y_bot - y_top) * CAST(3.87 AS DOUBLE)), 0) AS thickness FROM s JOIN q USING (image_id, bscan, x) GROUP BY 1, 2, 3""")
def roi_thickness_n(spark, sf):
    q = slab(spark, sf).filter("pair = 'ILM_BM'")
    sampled = q.filter("x % 8 = 4").withColumn("sample", F.expr("cast(x div 8 as int)"))
    return roi.roi_thickness_n(q, sampled).select("image_id", "bscan", "sample", "thickness")


@query(f"WITH {views.TRACE} SELECT image_id, bscan, layer, x, y AS value FROM trace WHERE y IS NOT NULL")
def shp_drop_null(spark, sf):
    return shape.drop_null(views.trace(spark, sf).withColumnRenamed("y", "value"))


# ---- masks ------------------------------------------------------------------


@query(f"""WITH RECURSIVE {LABELS}, kept AS (SELECT image_id, CAST(id % 1000 AS INT) AS x, CAST(id // 1000 AS INT) AS y FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM roots) WHERE n >= 4),
fr AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM kept GROUP BY 1), lat AS (SELECT image_id, x, unnest(range(y0, y1 + 1)) AS y, x0, x1, y0, y1 FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM fr)),
un AS (SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, x = x0 OR x = x1 OR y = y0 OR y = y1 AS edge FROM lat ANTI JOIN kept USING (image_id, x, y)),
nb AS (SELECT a.image_id, a.x, a.y, a.edge, count(b.x) AS n, min(b.x) AS bx, min(b.y) AS by_, coalesce(bool_or(b.edge), false) AS bedge FROM un a LEFT JOIN un b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3, 4),
hole AS (SELECT image_id, x, y FROM nb WHERE n = 0 AND NOT edge UNION ALL SELECT a.image_id, a.x, a.y FROM nb a JOIN nb b ON a.image_id = b.image_id AND a.bx = b.x AND a.by_ = b.y WHERE a.n = 1 AND b.n = 1 AND NOT a.edge AND NOT b.edge)
SELECT * FROM kept UNION ALL SELECT * FROM hole""")
def msk_filter_small(spark, sf):
    """Holes of one and of two pixels are what SQL finds from neighbours alone."""
    return mask.filter_small(views.mask_pixel(spark, sf), 4, 3).select("image_id", "x", "y")


@query(f"""WITH RECURSIVE {views.MASK}, d AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM mask_pixel, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx, dy)),
cl AS (SELECT image_id, x + dx AS x, y + dy AS y FROM d, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx, dy) GROUP BY 1, 2, 3 HAVING count(*) = 5),
px AS (SELECT image_id, x, y, y * 1000 + x AS id FROM cl ANTI JOIN mask_pixel USING (image_id, x, y)), adj AS (SELECT a.image_id, a.id AS a, b.id AS b FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(image_id, id, root) AS (SELECT image_id, id, id FROM px UNION SELECT r.image_id, adj.b, r.root FROM reach r JOIN adj ON adj.image_id = r.image_id AND adj.a = r.id WHERE adj.b > r.root),
roots AS (SELECT image_id, id, min(root) AS root FROM reach GROUP BY 1, 2), l AS (SELECT image_id, root, id % 1000 AS x, id // 1000 AS y FROM roots),
m AS (SELECT image_id, root, count(*) AS area, var_pop(x) + CAST(1 AS DOUBLE)/12 AS vx, var_pop(y) + CAST(1 AS DOUBLE)/12 AS vy, covar_pop(x, y) AS vxy FROM l GROUP BY 1, 2), e AS (SELECT *, sqrt((vx - vy)**2 + 4 * vxy**2) AS rt FROM m),
t AS (SELECT image_id, root FROM e WHERE area >= 2 AND sqrt(greatest(0, 1 - (vx + vy - rt) / (vx + vy + rt))) >= 0.9 AND 4 * sqrt(greatest(0, (vx + vy - rt) / 2)) <= 5)
SELECT image_id, x, y FROM mask_pixel UNION ALL SELECT image_id, CAST(x AS INT), CAST(y AS INT) FROM l SEMI JOIN t USING (image_id, root)""")
def msk_bridge_gaps(spark, sf):
    return mask.bridge_gaps(views.mask_pixel(spark, sf), 1, 2, 0.9, 5).select("image_id", "x", "y")


@query(f"""WITH {views.MASK}, b AS (SELECT a.image_id, a.x, a.y FROM mask_pixel a LEFT JOIN mask_pixel n ON a.image_id = n.image_id AND abs(a.x - n.x) + abs(a.y - n.y) = 1 GROUP BY 1, 2, 3 HAVING count(n.x) < 4),
i AS (SELECT DISTINCT image_id FROM mask_pixel), w AS (SELECT image_id, t, round(5 + CAST(55 AS DOUBLE) * t / steps) AS x, round(5 + CAST(35 AS DOUBLE) * t / steps) AS y FROM (SELECT image_id, CAST(ceil(sqrt(55*55 + 35*35)) + 1 AS BIGINT) AS steps, unnest(range(0, CAST(ceil(sqrt(55*55 + 35*35)) + 2 AS BIGINT))) AS t FROM i))
SELECT image_id, round(min_by(sqrt((x - 5)**2 + (y - 5)**2), t), 6) AS radius FROM w JOIN b USING (image_id, x, y) GROUP BY 1""")
def msk_disc_radius_line(spark, sf):
    m = views.mask_pixel(spark, sf)
    s = m.select("image_id").distinct().selectExpr("image_id", "5 AS disc_x", "5 AS disc_y", "60 AS fovea_x", "40 AS fovea_y")
    return mask.disc_radius_line(m, s).select("image_id", *r6("radius"))


# ---- maps -------------------------------------------------------------------


@query(f"WITH {views.SCAN} SELECT image_id, round(scale_z / scale_x, 6) AS line_distance, n // 2 AS above, n - 1 - n // 2 AS below FROM (SELECT *, image_id % 60 + 1 AS n FROM scan)")
def map_geometry(spark, sf):
    s = views.scan(spark, sf).withColumn("n_bscans", F.col("image_id") % 60 + 1).withColumn("centre_slice", F.expr("n_bscans div 2"))
    return maps.map_geometry(s).select("image_id", *r6("line_distance"), "above", "below")


@query(f"WITH {CELLS} SELECT image_id, map, x, CAST(7 + 64 - 1 - y AS INT) AS y, value FROM cells")
def map_place_on_localiser(spark, sf):
    return maps.place_on_localiser(cells(spark, sf), 7, 64)


@query(f"""WITH {CELLS}, t AS (SELECT image_id, x, y, round(31.5 + (x - 31.5) * cos(radians(30)) - (y - 31.5) * sin(radians(30)), 9) AS sx, round(31.5 + (x - 31.5) * sin(radians(30)) + (y - 31.5) * cos(radians(30)), 9) AS sy FROM cells),
c AS (SELECT image_id, x, y, CAST(floor(sx + 0.5) AS INT) AS nx, CAST(floor(sy + 0.5) AS INT) AS ny, CAST(floor(sx) AS INT) + i AS ux, CAST(floor(sy) AS INT) + j AS uy, (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM t, (VALUES (0,0),(1,0),(0,1),(1,1)) q(i, j)),
k AS (SELECT image_id, x AS ux, y AS uy, value FROM cells WHERE value <> -1), m AS (SELECT c.*, value FROM c LEFT JOIN k USING (image_id, ux, uy) WHERE w > 0)
SELECT image_id, x, y, round(CASE WHEN bool_or(ux = nx AND uy = ny AND value IS NOT NULL) THEN sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END) ELSE -1 END, 6) AS value FROM m GROUP BY 1, 2, 3""")
def map_rotate_bilinear(spark, sf):
    pose = views.images(spark, sf).selectExpr("image_id", "30.0D AS angle", "31.5D AS cx", "31.5D AS cy")
    return maps.rotate_map(measured(spark, sf), pose, 64, 64).select("image_id", "x", "y", *r6("value"))


@query(f"""WITH {ROWS}, t AS (SELECT image_id, y, y * last / CAST(79 AS DOUBLE) AS at_ FROM (SELECT image_id, max(bscan) AS last, unnest(range(80)) AS y FROM placed GROUP BY 1)),
w AS (SELECT image_id, y, CAST(floor(at_) AS INT) + q.k AS bscan, CASE WHEN q.k = 0 THEN 1 - (at_ - floor(at_)) ELSE at_ - floor(at_) END AS w FROM t, (VALUES (0), (1)) q(k)),
v AS (SELECT image_id, p.x, y, sum(edge * w) / sum(w) AS value FROM w JOIN placed p USING (image_id, bscan) WHERE w > 0 GROUP BY 1, 2, 3), nn AS (SELECT image_id, p.x, y, p.value AS m FROM (SELECT image_id, y, CAST(floor(at_ + 0.5) AS INT) AS bscan FROM t) JOIN placed p USING (image_id, bscan)),
c AS (SELECT image_id, x, y, CASE WHEN m = -1 OR value IS NULL THEN -1 ELSE value END AS value FROM v JOIN nn USING (image_id, x, y)), k AS {KERNEL}, km AS (SELECT * FROM c WHERE value <> -1),
a AS (SELECT image_id, y, CASE WHEN x + d < 0 THEN -1 - (x + d) WHEN x + d >= 80 THEN 159 - (x + d) ELSE x + d END AS x, sum(value * w) / sum(w) AS value FROM km, k GROUP BY 1, 2, 3),
b AS (SELECT image_id, x, CASE WHEN y + d < 0 THEN -1 - (y + d) WHEN y + d >= 80 THEN 159 - (y + d) ELSE y + d END AS y, sum(value * w) / sum(w) AS value FROM a, k GROUP BY 1, 2, 3),
f AS (SELECT c.image_id, c.x, 79 - c.y AS y, CASE WHEN c.value = -1 THEN -1 ELSE b.value END AS value FROM c LEFT JOIN b ON b.image_id = c.image_id AND b.x = c.x AND b.y = c.y)
SELECT image_id, CAST(y AS INT) AS x, CAST(79 - x AS INT) AS y, round(value, 6) AS value FROM f""")
def map_build(spark, sf):
    """Rows of B-scans to a smoothed map on the localiser, turned by a right angle."""
    rows = thick_rows(spark, sf)
    ids = views.trace_images(spark, sf)
    centre, pose = ids.selectExpr("image_id", "40 AS cx", "64 AS n_x"), ids.selectExpr("image_id", "90.0D AS angle", "39.5D AS cx", "39.5D AS cy")
    return maps.build_map(rows, centre, pose, 1.5, 80, 80).select("image_id", "x", "y", *r6("value"))


@query(f"""WITH {SLAB} SELECT image_id, bscan, x, y_top, y_bot, CASE pair WHEN 'ILM_BM' THEN 'retina' WHEN 'ILM_ELM' THEN 'inner_retina' WHEN 'ELM_BM' THEN 'outer_retina' ELSE pair END AS map FROM slab WHERE pair IN ('ILM_BM', 'ILM_ELM', 'ELM_BM', 'RNFL_ELM')""")
def map_selection(spark, sf):
    return maps.select_maps(slab(spark, sf), custom=["RNFL_ELM"]).select("image_id", "bscan", "x", "y_top", "y_bot", "map")


@query(f"""WITH {ETDRS}, s AS (SELECT * FROM sub WHERE subfield IS NOT NULL) SELECT image_id, subfield, round_even(100 * avg(CASE WHEN value = -1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS missing_percent,
 round_even(avg(value), 3) AS mean, round(round_even(sum(value) * (CAST(110 AS DOUBLE) * 1e-9), 3), 6) AS volume FROM s GROUP BY 1, 2""")
def map_subfield_parts(spark, sf):
    """Missing share, the mean as of a ratio map, and the volume as of a vessel map."""
    placed = maps.etdrs_subfield(cells(spark, sf), grid_scan(spark, sf))
    return maps.subfield_parts(placed, 110.0, ratio=True, vessel=True).select("image_id", "subfield", "missing_percent", "mean", *r6("volume"))


@query(f"""WITH {NEAREST} SELECT image_id, subfield, CAST(trunc(avg(nf.value)) AS DOUBLE) AS mean, round(round_even(sum(nf.value) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3), 6) AS volume, max(missing) AS missing_percent
 FROM nf JOIN (SELECT image_id, subfield, round_even(100 * avg(CASE WHEN value = -1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS missing FROM s GROUP BY 1, 2) USING (image_id, subfield) GROUP BY 1, 2
UNION ALL SELECT image_id, 'all', CAST(trunc(avg(value)) AS DOUBLE), round(round_even(sum(value) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3), 6), NULL FROM s GROUP BY 1
UNION ALL SELECT image_id, 'all_filled', CAST(trunc(avg(value)) AS DOUBLE), round(round_even(sum(value) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3), 6), NULL FROM nf GROUP BY 1""")
def map_filled_stats(spark, sf):
    placed = maps.etdrs_subfield(cells(spark, sf), grid_scan(spark, sf))
    return maps.subfield_stats(placed, 110.0).select("image_id", "subfield", "mean", *r6("volume"), "missing_percent")


VOLUMES = f"""{ETDRS}, e AS (SELECT list(CAST(trunc(32 - h + 2 * h * k / 8) AS BIGINT) ORDER BY k) AS ex, list(CAST(trunc(31 - h + 2 * h * k / 8) AS BIGINT) ORDER BY k) AS ey FROM (SELECT 7000 / CAST(110 AS DOUBLE) / 2 AS h, unnest(range(9)) AS k)),
sq AS (SELECT c.*, len(list_filter(ex, lambda t: t <= x)) AS cx, len(list_filter(ey, lambda t: t <= y)) AS cy FROM cells c, e), g AS MATERIALIZED (SELECT image_id, 'etdrs' AS grid, subfield, x, y, value FROM sub WHERE subfield IS NOT NULL
 UNION ALL SELECT image_id, 'square', cy || '.' || CASE WHEN image_id % 2 = 0 THEN cx ELSE 9 - cx END, x, y, value FROM sq WHERE cx BETWEEN 1 AND 8 AND cy BETWEEN 1 AND 8),
near AS (SELECT a.image_id, a.grid, a.x, a.y, min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 4096 + b.y * 64 + b.x) % 4096 AS k FROM g a JOIN g b ON a.image_id = b.image_id AND a.grid = b.grid AND a.subfield = b.subfield WHERE a.value = -1 AND b.value <> -1 GROUP BY 1, 2, 3, 4),
gf AS (SELECT g.*, coalesce(f.value, g.value) AS filled FROM g LEFT JOIN near n ON n.image_id = g.image_id AND n.grid = g.grid AND n.x = g.x AND n.y = g.y LEFT JOIN cells f ON f.image_id = n.image_id AND f.x = n.k % 64 AND f.y = n.k // 64),
part AS (SELECT image_id, grid, subfield, value AS raw, filled AS v, CASE WHEN value = -1 THEN CAST(1 AS DOUBLE) ELSE 0 END AS gone FROM gf UNION ALL SELECT image_id, grid, 'all', value, value, NULL FROM gf UNION ALL SELECT image_id, grid, 'all_filled', value, filled, NULL FROM gf),
gm AS (SELECT image_id, grid, map, subfield, CASE WHEN map = 'choroid_ratio' AND v <> -1 THEN v / 64 ELSE v END AS v, gone FROM part, (VALUES ('retina'), ('choroid_vessel'), ('choroid_ratio')) q(map))"""


@query(f"""WITH {VOLUMES} SELECT image_id, grid, map, subfield, CASE WHEN map = 'choroid_ratio' THEN round_even(avg(v), 3) ELSE CAST(trunc(avg(v)) AS DOUBLE) END AS mean,
 CASE map WHEN 'retina' THEN round(round_even(sum(v) * (CAST(110 AS DOUBLE) * 110 * 1e-9), 3), 6) WHEN 'choroid_vessel' THEN round(round_even(sum(v) * (CAST(110 AS DOUBLE) * 1e-9), 3), 6) END AS volume, round_even(100 * avg(gone), 2) AS missing_percent FROM gm GROUP BY 1, 2, 3, 4""")
def map_volume(spark, sf):
    """A thickness, a vessel-area and a ratio map on both grids, filled: ratios to three decimals and without a volume, areas scaled once."""
    c = cells(spark, sf)
    # The maps of a cell are exploded, not united, so that the cells stay dealt by image.
    named = {"retina": F.col("value"), "choroid_vessel": F.col("value"), "choroid_ratio": F.when(F.col("value") == -1, -1.0).otherwise(F.col("value") / 64)}
    each = c.withColumn("m", F.explode(F.array(*[F.struct(F.lit(name).alias("map"), value.alias("value")) for name, value in named.items()]))).select("image_id", "m.map", "x", "y", "m.value")
    return maps.volume_measure(each, grid_scan(spark, sf), 110.0).select("image_id", "grid", "map", "subfield", "mean", *r6("volume"), "missing_percent")


NORMALS = f"""{FOOT}, foot AS (SELECT image_id, bscan, x FROM m GROUP BY 1, 2, 3 HAVING min(d) <= 2),
px AS (SELECT w.image_id, w.bscan, w.x, CAST(trunc(wx) AS BIGINT) AS cx, wy FROM w SEMI JOIN foot ON w.image_id = foot.image_id AND w.bscan = foot.bscan AND w.x = foot.x),
reg AS (SELECT s.image_id, s.bscan, s.x AS cx, s.y_top AS lo, b.fy - 1 AS hi FROM s JOIN b ON s.image_id = b.image_id AND s.bscan = b.bscan AND s.x = b.fx),
hit AS (SELECT px.image_id, px.bscan, px.x, (wy BETWEEN lo AND hi) IS TRUE AS r, (wy BETWEEN lo AND hi) IS TRUE AND (cx * 7 + wy) % 3 = 0 AS v FROM px LEFT JOIN reg USING (image_id, bscan, cx)),
density AS (SELECT image_id, bscan, x, count(*) FILTER (r) AS region_px, count(*) FILTER (v) AS vessel_px FROM hit GROUP BY 1, 2, 3)"""


def normal_density(spark, sf):
    upper = slab(spark, sf).filter("pair = 'ILM_RNFL'")
    region = trace.fill_between(upper)
    return trace.column_density(region, region.filter("(x * 7 + y) % 3 = 0"), how="perpendicular", slab=upper)


@query(f"""WITH {NORMALS} SELECT image_id, bscan, x, region_px, vessel_px, round(vessel_px / nullif(region_px, 0), 6) AS density, round(vessel_px * (CAST(11.49 AS DOUBLE) * CAST(3.87 AS DOUBLE)), 6) AS vessel_area FROM density""")
def trc_normal_density(spark, sf):
    """Vessel pixels along the normals of the upper boundary."""
    return normal_density(spark, sf).select("image_id", "bscan", "x", "region_px", "vessel_px", *r6("density", "vessel_area"))


def vessel_map_sql(name: str, value: str) -> str:
    """The SQL of `map_build` with a density in the place of the thickness."""
    rows = f"SELECT image_id, bscan, CAST(l.x AS INT) AS x, coalesce({value}, -1) AS value FROM (SELECT image_id, bscan, unnest(range(64)) AS x FROM (SELECT DISTINCT image_id, bscan FROM density)) l LEFT JOIN density USING (image_id, bscan, x)"
    rest = ORACLE_SQL["map_build"].split("\nmv AS", 1)[1]
    return f"SELECT '{name}' AS map, * FROM (WITH density AS MATERIALIZED (WITH {NORMALS} SELECT * FROM density), th AS ({rows}),\nmv AS{rest})"


@query(vessel_map_sql("choroid_vessel", "vessel_px * (CAST(11.49 AS DOUBLE) * CAST(3.87 AS DOUBLE))") + "\nUNION ALL " + vessel_map_sql("choroid_ratio", "vessel_px / nullif(region_px, 0)"))
def map_build_vessel(spark, sf):
    """The area map and the ratio map of the densities along normals."""
    rows = normal_density(spark, sf)
    ids = views.trace_images(spark, sf)  # the densities aren't made again for their images
    centre, pose = ids.selectExpr("image_id", "40 AS cx", "64 AS n_x"), ids.selectExpr("image_id", "90.0D AS angle", "39.5D AS cx", "39.5D AS cy")
    return maps.build_vessel_maps(rows, 64, centre, pose, 1.5, 80, 80).select("map", "image_id", "x", "y", *r6("value"))


# ---- circular profiles, vessels, result tables ------------------------------


@query(f"""WITH RECURSIVE {LABELS}, f AS (SELECT image_id, min(root) AS root FROM roots GROUP BY 1), l AS (SELECT image_id, id % 1000 AS x, id // 1000 AS y FROM roots JOIN f USING (image_id, root)),
m AS (SELECT image_id, avg(x) AS cx, avg(y) AS cy, var_pop(x) + CAST(1 AS DOUBLE)/12 AS vx, var_pop(y) + CAST(1 AS DOUBLE)/12 AS vy, covar_pop(x, y) AS vxy FROM l GROUP BY 1), e AS (SELECT *, sqrt((vx - vy)**2 + 4 * vxy**2) AS rt FROM m)
SELECT image_id, round_even(sqrt((cx - 20)**2 + (cy - 30)**2) / trunc((4 * sqrt(greatest(0, (vx + vy - rt) / 2)) + 4 * sqrt((vx + vy + rt) / 2)) / 2), 4) AS offset_ratio FROM e""")
def ppl_disc_offset(spark, sf):
    m = views.mask_pixel(spark, sf)
    return disc.disc_offset(m, m.select("image_id").distinct().selectExpr("image_id", "20 AS circle_x", "30 AS circle_y"))


@query(f"WITH {views.SCAN} SELECT image_id, CAST(CASE WHEN eye = 'OD' THEN 384 ELSE 0 END AS INT) AS temporal_index FROM scan")
def ppl_temporal_default(spark, sf):
    return disc.temporal_default(meta.laterality(views.scan(spark, sf)), 768)


@query(f"""WITH {FILLED}, s AS (SELECT image_id, value, CASE WHEN x < 8 OR x >= 56 THEN 'nasal' WHEN x < 16 THEN 'supero_nasal' WHEN x < 24 THEN 'supero_temporal' WHEN x < 40 THEN 'temporal' WHEN x < 48 THEN 'infero_temporal' ELSE 'infero_nasal' END AS sector FROM filled),
me AS (SELECT image_id, sector, CAST(trunc(round(avg(value), 9)) AS DOUBLE) AS value FROM (SELECT image_id, sector, value FROM s UNION ALL SELECT image_id, 'All', value FROM s) GROUP BY 1, 2)
SELECT image_id, max(CASE WHEN sector = 'nasal' THEN value END) AS "RNFL_nasal", max(CASE WHEN sector = 'temporal' THEN value END) AS "RNFL_temporal", max(CASE WHEN sector = 'All' THEN value END) AS "RNFL_All" FROM me GROUP BY 1""")
def shp_wide_peripapillary(spark, sf):
    means = disc.sector_means(disc.circular_fill(views.profile(spark, sf), 64), 64)
    return shape.wide_peripapillary(means.withColumn("layer", F.lit("RNFL")), ["RNFL"], ["nasal", "temporal", "All"])


@query(f"""WITH {views.PATH}, k AS (SELECT DISTINCT image_id, vessel_map, path_id, row, row // 3 AS col FROM path), e AS (SELECT *, max(row) OVER (PARTITION BY path_id) AS last FROM k)
SELECT image_id, vessel_map, path_id, CAST(CASE WHEN image_id % 2 = 0 THEN row ELSE last - row END AS INT) AS seq, row, CAST(col AS INT) AS col FROM e""")
def ves_order_paths(spark, sf):
    """Slanted lines, walked from the end that is nearer to the image's origin."""
    skeleton = views.path(spark, sf).select("image_id", "vessel_map", "path_id", "row", F.expr("cast(row div 3 as int)").alias("col")).distinct()
    origin = skeleton.select("image_id").distinct().select("image_id", F.when(F.col("image_id") % 2 == 0, 0.0).otherwise(1e6).alias("row0"), F.lit(0.0).alias("col0"))
    return vessel.order_paths(skeleton, origin)


@query(f"""WITH {views.PATH}, g AS (SELECT *, coalesce((lead(row) OVER w - lag(row) OVER w) / 2, lead(row) OVER w - row, row - lag(row) OVER w) AS gr, coalesce((lead(col) OVER w - lag(col) OVER w) / 2, lead(col) OVER w - col, col - lag(col) OVER w) AS gc FROM path WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT image_id, path_id, seq, round(row + (1 + seq % 3) * cos(atan2(gc, gr) + pi() / 2), 6) AS row1, round(col + (1 + seq % 3) * sin(atan2(gc, gr) + pi() / 2), 6) AS col1, round(row - (1 + seq % 3) * cos(atan2(gc, gr) + pi() / 2), 6) AS row2, round(col - (1 + seq % 3) * sin(atan2(gc, gr) + pi() / 2), 6) AS col2 FROM g""")
def ves_edges(spark, sf):
    p = views.path(spark, sf).withColumn("distance", (1 + F.col("seq") % 3).cast("double"))
    return vessel.vessel_edges(p).select("image_id", "path_id", "seq", "row1", "col1", "row2", "col2")


@query(f"WITH {VROWS} SELECT zone AS \"table\", image_id, vessel_map, feature, value FROM vm")
def ves_zone_tables(spark, sf):
    parts = vessel.split_zones(vessel_rows(spark, sf))
    return shape.union_results([df.select(F.lit(z).alias("table"), "image_id", "vessel_map", "feature", "value") for z, df in parts.items()])


@query("""SELECT lower(r_name) AS "column", CAST(r_regionkey AS VARCHAR) AS description FROM region WHERE r_name IN ('ASIA', 'EUROPE')""")
def shp_describe_columns(spark, sf):
    r = views.table(spark, sf, "region")
    table = r.select(F.lit(1).alias("asia"), F.lit(2).alias("europe"), F.lit(3).alias("other"))
    return shape.describe_columns(table, r.select(F.lower("r_name").alias("column"), F.col("r_regionkey").cast("string").alias("description")))


# ---- user functions and ingestion -------------------------------------------

SCORED = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("p", T.DoubleType())])


def by_price(limit: float):
    """A stand-in for a model: loaded once per task, scores batches."""

    def load():
        return lambda pdf: pd.DataFrame({"image_id": pdf["image_id"], "p": pdf["price"] / limit})

    return load


def priced(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 2 == 0, "macula").otherwise("disc").alias("location"))


@query("SELECT o_orderkey AS image_id, o_totalprice / 500000 AS p FROM orders")
def ops_score(spark, sf):
    return batch.score(priced(spark, sf), by_price(500_000.0), SCORED)


@query("SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 500000 ELSE o_totalprice / 400000 END AS p FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 500000 > 0.5 ELSE o_totalprice / 400000 > 0.25 END")
def ops_route_scorer(spark, sf):
    models = {"macula": (by_price(500_000.0), 0.5), "disc": (by_price(400_000.0), 0.25)}
    return batch.route_scorer(priced(spark, sf), models, SCORED)


@query("SELECT event_id AS image_id, round(value * 2, 6) AS value FROM events")
def ops_ingest(spark, sf):
    """Files arrive in two lots; a third run finds nothing new."""
    events = views.table(spark, sf, "events").select("event_id", "value")
    inbox, out, seen = (fresh_path(spark, name) for name in ("inbox", "ingested", "offsets"))
    measure = lambda df: df.select(F.col("event_id").alias("image_id"), (F.col("value") * 2).alias("value"))
    for lot in ("event_id % 2 = 0", "event_id % 2 = 1", "false"):
        events.filter(lot).write.mode("append").parquet(inbox)
        ingest.stream_ingest(spark, inbox, events.schema, measure, out, seen, files_per_trigger=2)
    return spark.read.parquet(out).select("image_id", *r6("value"))


@query("SELECT event_id AS image_id, round(value * 2 + CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END, 6) AS value FROM events")
def ops_ingest_annotations(spark, sf):
    """Half of the files, then annotations of every third image (some before their file), then the other files, then nothing new."""
    events = views.table(spark, sf, "events").select(F.col("event_id").alias("image_id"), "value")
    notes = events.filter("image_id % 3 = 0").selectExpr("image_id", "cast(image_id % 7 as double) AS shift")
    inbox, marks, out, seen = (fresh_path(spark, name) for name in ("inbox", "notes", "remeasured", "offsets"))
    notes.limit(0).write.parquet(marks)

    def measure(images, of_theirs):
        return images.join(of_theirs, "image_id", "left").select("image_id", (F.col("value") * 2 + F.coalesce("shift", F.lit(0.0))).alias("value"))

    for files_of, notes_of in (("image_id % 2 = 0", "false"), ("false", "true"), ("image_id % 2 = 1", "false"), ("false", "false")):
        events.filter(files_of).write.mode("append").parquet(inbox)
        notes.filter(notes_of).write.mode("append").parquet(marks)
        ingest.stream_remeasure(spark, inbox, events.schema, marks, notes.schema, measure, out, seen, files_per_trigger=4)
    return ingest.latest(spark, out).select("image_id", *r6("value"))


@query("""WITH p AS (SELECT vec_id // 4 AS image_id, (vec_id % 4) * 64 + x AS x, CASE WHEN (vec_id * 3 + x) % 11 >= 2 THEN floor(100 + 80 * CAST(e AS DOUBLE)) END AS value FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS x FROM embeddings)),
s AS (SELECT *, CASE WHEN x < 32 OR x >= 224 THEN 'nasal' WHEN x < 64 THEN 'supero_nasal' WHEN x < 96 THEN 'supero_temporal' WHEN x < 160 THEN 'temporal' WHEN x < 192 THEN 'infero_temporal' ELSE 'infero_nasal' END AS sector FROM p),
m AS (SELECT image_id, sector, CAST(trunc(round(avg(value), 9)) AS DOUBLE) AS value FROM (SELECT image_id, sector, value FROM s UNION ALL SELECT image_id, 'All', value FROM s UNION ALL SELECT image_id, 'PMB', value FROM s WHERE x BETWEEN 126 AND 155) GROUP BY 1, 2)
SELECT image_id, sector, round(value, 6) AS value FROM m UNION ALL SELECT image_id, 'N/T', round(max(CASE WHEN sector = 'nasal' THEN value END) / nullif(max(CASE WHEN sector = 'temporal' THEN value END), 0), 6) FROM m GROUP BY 1""")
def ppl_bundle_means(spark, sf):
    """Profiles of 256 samples, so that the bundle's samples are there."""
    e = views.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    value = F.when((F.col("vec_id") * 3 + F.col("x")) % 11 >= 2, F.floor(100 + 80 * F.col("e").cast("double")).cast("double"))
    profiles = e.select(F.expr("vec_id div 4").alias("image_id"), ((F.col("vec_id") % 4) * 64 + F.col("x")).cast("int").alias("x"), value.alias("value"))
    return disc.sector_means(profiles, 256).select("image_id", "sector", *r6("value"))
