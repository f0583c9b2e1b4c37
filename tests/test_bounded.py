"""What a step holds doesn't grow with the table: plans without broadcasts or whole sorts, and the same results as plain Python."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from laminar.functions.nearest import fill_grid, fill_groups, nearest_point, nearest_targets
from laminar.operators import maps, mask, shape
from laminar.plans import coverage
from laminar.plans.registry import ORACLE_SQL, QUERIES
from laminar.sources import files

from .oracle import compare, connect


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_targets_equal_all_pairs():
    r = np.random.default_rng(5)
    for k in range(2, 60):
        x, y = r.integers(-k, k, k), r.integers(0, k, k) * (1 + k % 5)
        px, py = np.round(r.uniform(-2 * k, 3 * k, k), k % 3), np.round(r.uniform(-5 * k, 9 * k, k), k % 3)
        want = [min((np.sqrt(np.square(a - p) + np.square(b - q)), b, a) for a, b in zip(x, y, strict=True)) for p, q in zip(px, py, strict=True)]
        gx, gy, d = nearest_targets(px, py, x, y)
        assert list(zip(d, gy, gx, strict=True)) == want


def test_nearest_point_broadcasts_nothing(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (1, None, 3.0), (2, 1.0, 1.0)], "image_id long, px double, py double")
    targets = spark.createDataFrame([(1, 3, 4), (1, 4, 3), (3, 0, 0)], "image_id long, x int, y int")
    got = nearest_point(points, targets, ["image_id"])
    assert "Broadcast" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, 0.0, 4, 3, 5.0)]


def test_fill_compares_few_or_sweeps_many(monkeypatch):
    r = np.random.default_rng(3)
    y, x = (c.ravel() for c in np.mgrid[-4:20, 3:25])
    value = np.where(r.random(len(x)) < 0.2, r.integers(0, 50, len(x)), np.nan)
    few = fill_grid(x, y, value)
    monkeypatch.setattr("laminar.functions.nearest.FEW_PAIRS", 0)
    many = fill_grid(x, y, value)
    group = r.permutation(np.arange(len(x)) % 7)
    together = fill_groups(group, x, y, value)
    monkeypatch.setattr("laminar.functions.nearest.FEW_PAIRS", 1 << 17)
    assert list(fill_groups(group, x, y, value)) == list(together)
    for g in range(7):
        assert list(together[group == g]) == list(fill_grid(x[group == g], y[group == g], value[group == g]))
    known = np.flatnonzero(~np.isnan(value))
    want = [value[min(known, key=lambda k: ((x[k] - x[i]) ** 2 + (y[k] - y[i]) ** 2, y[k], x[k]))] for i in range(len(x))]
    assert list(few) == want == list(many)


@pytest.mark.parametrize("name", ["map_etdrs_subfields", "map_square_subfields", "ppl_zones", "map_rotate", "map_gaussian", "map_volume", "map_filled_stats", "map_nearest_fill", "msk_trim_map", "map_subfield_stats"])
def test_cells_are_dealt_once(spark, name):
    """Every shuffle is of table rows or images, dealt by image in a number that follows the table; cells are neither shuffled nor sorted for a join."""
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" not in text and "BroadcastExchange" not in text
    shuffles = [line for line in text.splitlines() if " Exchange " in line]
    assert any("REPARTITION_BY_NUM" in line for line in shuffles)
    assert all(re.search(r"hashpartitioning\((image_id|l_suppkey)#\d+L, (map#\d+, grid#\d+, )?\d+\)", line) for line in shuffles), shuffles


def test_parts_of_a_wide_grid_follow_the_table(spark, monkeypatch):
    """All up to the subfields' sums is one stage of as many tasks as the table asks for, whatever shuffle partitions are set; behind it only figures of subfields are shuffled."""
    monkeypatch.setattr("laminar.sources.views.PART_ROWS", 200)
    con = connect("/root/testdata/sf0.001")
    parts = -(-con.execute("SELECT count(*) FROM lineitem").fetchone()[0] // 200)
    df = QUERIES["shp_wide_grid"](spark, "/root/testdata/sf0.001")
    text = plan(df)
    assert re.search(rf"hashpartitioning\(image_id#\d+L, {parts}\), REPARTITION_BY_NUM", text) and not re.search("SortMergeJoin|Broadcast", text)
    # Nothing is shuffled between the cells' dealing and the sums of subfields.
    above = text[: text.index("ShuffledHashJoin")]
    assert "Exchange" not in above[above.index("partial_collect_list") :]
    assert compare(df, con, ORACLE_SQL["shp_wide_grid"]) is None


@pytest.mark.parametrize("name", ["ves_snap", "ves_widths", "ves_tortuosity_distance"])
def test_paths_and_masks_arent_broadcast(spark, name):
    """A written table's size is that of its compressed file: joined to it, the driver would hold many times as much."""
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"BroadcastExchange HashedRelationBroadcastMode\(List\(input\[0, bigint, \w+\], input", text)
    assert name != "ves_tortuosity_distance" or "Join" not in text


def test_marginal_peaks_tie_to_nine_decimals(spark):
    """0.3 and 0.1 + 0.2 are one score; the first position has it."""
    rows = [(30, 30, 0.3), (65, 60, 0.1), (65, 90, 0.2), (99, 99, 1e-6)]
    m = spark.createDataFrame([(1, "m", *r) for r in rows], "image_id long, mask string, x int, y int, p double")
    assert mask.marginal_peak(m, least=0.001).first()["x"] == 30


def test_feet_break_ties_as_sql_does(spark, tmp_path):
    """One of these normals has two places as far from their points but for the last digit."""
    x = [x for x in range(64) if x not in (7, 13, 19, 33, 34, 46, 50, 53, 56, 59)]
    top = [98, 92, 100, 92, 93, 76, 111, 86, 106, 95, 104, 92, 97, 100, 97, 109, 85, 99, 95, 109, 112, 99, 88, 100, 88, 103, 103, 92, 98, 112, 92, 103, 107, 101, 110, 89, 120, 99, 85, 89, 102, 98, 113, 90, 123, 110, 104, 98, 124, 103, 98, 90, 94, 103]
    bottom = [127, 115, 134, 145, 132, 121, 128, 116, 123, 127, 126, 135, 128, 150, 122, 127, 123, 108, 132, 129, 114, 128, 127, 153, 149, 138, 134, 111, 130, 123, 137, 129, 139, 130, 124, 134, 140, 148, 151, 130, 117, 146, 138, 137, 127, 125, 130, 125, 126, 122, 119, 138, 115, 130]
    rows = []
    for vec, (ys, base) in enumerate(((top, 100), (bottom, 200)), 40):
        at = dict(zip(x, ys, strict=True))
        rows.append({"vec_id": vec, "embedding": [(at[k] + 0.5 - base) / 80 if k in at else None for k in range(64)]})
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert compare(QUERIES["trc_perpendicular_foot"](spark, str(tmp_path)), con, ORACLE_SQL["trc_perpendicular_foot"]) is None


@pytest.mark.parametrize(("name", "joins", "scans"), [("msk_drop_short", 0, 1)])
def test_parts_are_made_in_one_pass(spark, name, joins, scans):
    """One pass over the cells: nothing is made again to be joined to itself."""
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert [len(re.findall(kind, text)) for kind in ("Join", "FileScan", "Window")] == [joins, scans, 0]


def test_short_regions_go_and_labels_have_no_gaps(spark):
    """A pixel given twice counts once; labels follow the regions that stay."""
    rows = [(0, 0), (0, 0), (0, 0), (5, 0), (6, 0), (5, 1), (9, 9), (0, 3), (1, 3), (1, 4)]
    m = spark.createDataFrame([(1, "m", *r) for r in rows], "image_id long, mask string, x int, y int")
    got = sorted((r["x"], r["y"], r["label"]) for r in mask.drop_short(m, 3).collect())
    assert got == [(0, 3, 2), (1, 3, 2), (1, 4, 2), (5, 0, 1), (5, 1, 1), (6, 0, 1)]


def test_blocks_of_pairs_give_the_same_fill(monkeypatch):
    r = np.random.default_rng(6)
    y, x = (c.ravel() for c in np.mgrid[-7:25, -3:29])
    value = np.where(r.random(len(x)) < 0.2, r.integers(0, 50, len(x)), np.nan)
    group = r.integers(0, 5, len(x))
    whole = fill_groups(group, x, y, value)
    monkeypatch.setattr("laminar.functions.nearest.BLOCK_PAIRS", 100)
    assert list(fill_groups(group, x, y, value)) == list(whole)


@pytest.mark.parametrize("name", ["map_rotate", "map_rotate_bilinear"])
def test_turned_maps_are_one_row_each(spark, name):
    """Unmeasured cells aren't made, sorted or sent to be turned."""
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in text and re.search(r"Sort [^\n]*\n[^\n]*Project [^\n]*some#", text)


def test_turned_maps_without_a_measured_cell(spark):
    """Such a map stays, whole and unmeasured; nulls, NaN, -1 and cells off the frame count as unmeasured."""
    rows = [(1, 0, 0, -1.0), (1, 1, 1, None), (1, 1, 0, float("nan")), (1, 9, 0, 5.0), (2, 0, 1, 7.0), (2, 2, 1, 0.0)]
    cells = spark.createDataFrame([(i, "m", *r) for i, *r in rows], "image_id long, map string, x int, y int, value double")
    pose = spark.createDataFrame([(1, 0, 1, 1), (2, 180, 1, 1)], "image_id long, angle int, cx int, cy int")
    got = {(r["image_id"], r["x"], r["y"]): r["value"] for r in maps.rotate_map(cells, pose, 3, 3).collect()}
    assert len(got) == 18 and {k: v for k, v in got.items() if v != -1} == {(2, 2, 1): 7.0, (2, 0, 1): 0.0}


def test_subfield_parts_are_made_in_one_pass(spark):
    """Cells are made once for all three figures, and a cell's subfield isn't worked out within the join."""
    text = plan(QUERIES["map_subfield_parts"](spark, "/root/testdata/sf0.001"))
    assert [len(re.findall(kind, text)) for kind in ("Join", "FileScan")] == [1, 2]
    assert not re.search(r"Join [^\n]*CASE WHEN", text)


def test_subfield_parts_are_those_of_the_single_steps(spark):
    rows = [(k % 3, "m", k % 5, k // 5, None if k % 11 == 0 else -1.0 if k % 4 == 0 else k / 7, f"s{k % 2}" if k % 6 else None) for k in range(60)]
    cells = spark.createDataFrame(rows, "image_id long, map string, x int, y int, value double, subfield string")
    keys = [*maps.MAP, "subfield"]
    for ratio, vessel in ((True, True), (False, False)):
        want = maps.missing_share(cells).join(maps.subfield_mean(cells, ratio), keys).join(maps.subfield_volume(cells, 1100.0, vessel), keys)
        got = maps.subfield_parts(cells, 1100.0, ratio, vessel)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_subfields_are_worked_out_once_a_cell(spark):
    """The angle's sine and cosine are those of an image; a cell's distance from the centre is taken once, whatever is asked of the subfield."""
    text = plan(QUERIES["shp_wide_grid"](spark, "/root/testdata/sf0.001"))
    assert text.count("HYPOT(") == 1 and not re.search(r"(COS|SIN)\([^\n]*HYPOT|HYPOT[^\n]*(COS|SIN)\(", text)


def test_maps_are_built_in_one_group(spark):
    """As by the single steps: B-scans missing or without a value, nulls, columns off the frame, a left-out image."""
    r = np.random.default_rng(8)
    rows = [(i, m, b, x, None if r.random() < 0.05 else -1.0 if r.random() < 0.2 or (i, b) == (1, 2) else float(r.integers(0, 300))) for i in (1, 2, 3) for m in "ab" for b in (0, 1, 2, 4, 5) if i != 2 or b != 4 for x in range(12)]
    thick = spark.createDataFrame(rows, "image_id long, map string, bscan int, x int, value double")
    centre = spark.createDataFrame([(1, 7, 12), (2, 1, 12)], "image_id long, cx int, n_x int")
    pose = spark.createDataFrame([(1, 20.0, 5.0, 6.0), (2, 90.0, 5.5, 5.5)], "image_id long, angle double, cx double, cy double")
    placed = maps.place_rows(thick, centre, 12)
    near = maps.resample_rows(placed.select(*maps.MAP, "bscan", "x", "value"), 12, "nearest").withColumnRenamed("value", "m")
    both = maps.resample_rows(placed.select(*maps.MAP, "bscan", "x", placed["edge"].alias("value")), 12).join(near, [*maps.MAP, "x", "y"])
    cells = both.selectExpr("image_id", "map", "x", "y", "CASE WHEN m = -1 OR value IS NULL THEN -1D ELSE value END AS value")
    want = maps.rotate_map(maps.place_on_localiser(maps.gaussian(cells, 0.8, 12, 12), 0, 12), pose, 12, 12)
    table = lambda df: {tuple(v[:4]): v[4] for v in df.collect()}
    built = maps.build_map(thick, centre, pose, 0.8, 12, 12)
    text = plan(built)
    got, want = table(built), table(want)
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 4 * 144 and len(set(got.values())) > 100
    assert "Window" not in text and len(re.findall("FlatMapGroups", text)) == 1


def test_density_rows_are_completed_in_place(spark):
    density = spark.createDataFrame([(1, 0, 1, 5.0, None), (1, 0, 7, 2.0, 0.5), (1, 3, 9, 1.0, 0.1)], "image_id long, bscan int, x int, vessel_area double, density double")
    got = maps.density_rows(density, 3)
    assert "Join" not in plan(got)
    made = {(r["map"], r["bscan"], r["x"]): r["value"] for r in got.collect()}
    assert made == {(m, b, x): -1.0 for m in ("choroid_vessel", "choroid_ratio") for b in (0, 3) for x in range(3)} | {("choroid_vessel", 0, 1): 5.0}


def test_results_are_made_once_and_stored_where_they_are(spark, monkeypatch):
    """All kinds are one pass over the table, dealt once; what the store's runs write is read from that pass and not shuffled again."""
    sf, written, commit = "/root/testdata/sf0.001", [], files.commit
    made = plan(coverage.collated(spark, sf))
    assert made.count("lineitem.parquet") == made.count("orders.parquet") == made.count("Join") == 1
    assert len([line for line in made.splitlines() if " Exchange " in line and "REPARTITION_BY_NUM" in line]) == 1 and "Union" not in made
    monkeypatch.setattr(files, "commit", lambda df, *a: (written.append(plan(df)), commit(df, *a)))
    df = QUERIES["src_result_store"](spark, sf)
    assert len(written) == 3 and not any("Exchange" in text or "lineitem" in text or "Join" in text for text in written)
    assert compare(df, connect(sf), ORACLE_SQL["src_result_store"]) is None


def test_stored_rows_are_sent_by_image_alone(spark, tmp_path):
    """Once each for the rows and for their images; the last run to finish counts, whatever its name and the pattern that it found."""
    root = str(tmp_path)
    rows = [(1, "Radial", "radial", "retina", "mean", 1.0), (2, "Radial", "radial", "retina", "mean", 2.0), (3, "Radial", "radial", "retina", "mean", None), (None, "Radial", "radial", "retina", "mean", 4.0)]
    res = spark.createDataFrame(rows, files.RESULT)
    files.write_results(res, root, "b")
    files.write_results(spark.createDataFrame([(1, "Ppole", "ppole_etdrs", "retina", "mean", 9.0), (2, "Radial", "radial", "retina", "mean", 5.0)], files.RESULT), root, "a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many images
    try:
        got = files.load_results(spark, root, ["Radial"])
        shuffles = [line for line in plan(got).splitlines() if " Exchange hashpartitioning" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(shuffles) == 2 and all(re.search(r"hashpartitioning\(image_id#\d+L, \d+\)", line) for line in shuffles), shuffles
    assert sorted((r["image_id"], r["value"]) for r in got.collect()) == [(2, 5.0), (3, None)]
    files.write_results(res, root, "b")  # finished last now
    assert sorted((r["image_id"], r["value"]) for r in files.load_results(spark, root, ["Radial", "Ppole"]).collect()) == [(1, 1.0), (2, 2.0), (3, None)]


def test_failed_groups_go_without_a_join(spark):
    """Nulls are neither failed nor measured; rows without a key go."""
    rows = [(1, "a", -1.0), (1, "a", -1.0), (1, "b", -1.0), (1, "b", 2.0), (1, "c", None), (1, "c", -1.0), (2, "a", None), (2, "b", float("nan")), (2, "b", None), (None, "a", 3.0), (3, None, 4.0)]
    m = spark.createDataFrame(rows, "image_id long, layer string, value double")
    got = shape.drop_all_sentinel(m, ["image_id", "layer"])
    assert "Join" not in plan(got)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "b", -1.0), (1, "b", 2.0), (2, "b", float("nan")), (2, "b", None)]))
