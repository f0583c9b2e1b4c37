"""From long measurements to result tables, and the collation of a cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dimensions import LAYERS, SUMMARY, VESSEL_MAPS, layer_rank


def flatten_map(nested: DataFrame, column: str = "m", levels: tuple[str, ...] = ("layer", "feature"), value: str = "value") -> DataFrame:
    """SHP-1. A map of maps to one row per innermost value, one key column per level."""
    rest = [c for c in nested.columns if c != column]
    out = nested
    for depth, level in enumerate(levels):
        into = value if depth == len(levels) - 1 else "__inner"
        out = out.select(*rest, F.explode(column).alias(level, into))
        rest, column = [*rest, level], into
    return out


def pivot_features(long: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """SHP-2. The features, which are named and not looked up in the data, become columns."""
    return long.groupBy(*keys).pivot("feature", features).agg(F.first("value"))


def wide(long: DataFrame, name: Column, columns: list[str], keys: list[str] = ("image_id",)) -> DataFrame:
    """One row per key; `name` gives each measurement's column among `columns`."""
    return long.withColumn("__column", name).groupBy(*keys).pivot("__column", columns).agg(F.first("value"))


def wide_vessel(m: DataFrame, features: list[str], zones: list[str]) -> DataFrame:
    """SHP-3. feature_vessel_zone columns, without tortuosity_distance, zones in reverse; the ratio's name is AVR_zone."""
    kept = [f for f in features if f != "tortuosity_distance"]
    columns = [f"{f}_{v}_{z}" for z in reversed(zones) for v in VESSEL_MAPS[:3] for f in kept if f != "AVR"] + [f"AVR_{z}" for z in reversed(zones)]
    name = F.when(F.col("feature") == "AVR", F.concat_ws("_", "feature", "zone")).otherwise(F.concat_ws("_", "feature", "vessel_map", "zone"))
    return wide(drop_sentinel(m), name, columns)


def drop_sentinel(long: DataFrame) -> DataFrame:
    """SHP-4. Failed measurements go before the pivot, so their column is empty."""
    return long.filter(F.col("value") != -1)


def wide_linescan(m: DataFrame, layers: list[str], features: list[str], scans: list[int]) -> DataFrame:
    """SHP-5. layer_feature_scan columns."""
    return wide(drop_null(m), F.concat_ws("_", "layer", "feature", "scan_number"), [f"{a}_{f}_{s}" for s in scans for a in layers for f in features])


def wide_peripapillary(m: DataFrame, layers: list[str], sectors: list[str]) -> DataFrame:
    """SHP-6. layer_sector columns."""
    return wide(m, F.concat_ws("_", "layer", "sector"), [f"{a}_{s}" for a in layers for s in sectors])


def wide_grid(m: DataFrame, maps: list[str], subfields: list[str]) -> DataFrame:
    """SHP-7. subfield_map_[um] for means, subfield_map_[mm3] for volumes; a ratio has no unit."""
    ratio = F.col("map").contains("ratio") | F.col("map").contains("index")
    unit = F.when(ratio, "").when(F.col("feature") == "volume", "_[mm3]").otherwise("_[um]")
    units = lambda m: [""] if "ratio" in m or "index" in m else ["_[um]", "_[mm3]"]
    return wide(drop_null(m), F.concat(F.concat_ws("_", "subfield", "map"), unit), [f"{s}_{a}{u}" for a in maps for u in units(a) for s in subfields])


def drop_null(long: DataFrame) -> DataFrame:
    """SHP-8. Missing measurements go before the pivot."""
    return long.filter("value is not null")


def without_choroid(m: DataFrame, wanted: bool = False) -> DataFrame:
    """SHP-9. Choroid rows dropped unless wanted."""
    return m if wanted else m.filter(~F.col("layer").startswith("CHOR") & ~F.col("layer").startswith("choroid"))


def route(m: DataFrame) -> DataFrame:
    """SHP-10. The result table of each row."""
    line = F.col("pattern").isin("H-line", "V-line", "AV-line")
    kind = F.when(line, "linescan").when(F.col("pattern") == "Radial", "radial").when(F.col("pattern") == "Peripapillary", "peripapillary").otherwise(F.when(F.col("grid") == "square", "ppole_square").otherwise("ppole_etdrs"))
    return m.withColumn("kind", kind)


def union_results(frames: list[DataFrame]) -> DataFrame:
    """SHP-11. Rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def failed(scan: DataFrame, flags: list[str]) -> DataFrame:
    """SHP-12. Scans with any of the flags set; flags that the table lacks don't count."""
    have = [f for f in flags if f in scan.columns]
    return scan.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in have], F.lit(False)))


def drop_all_sentinel(m: DataFrame, keys: list[str]) -> DataFrame:
    """SHP-13. Groups all of whose values are -1 go, and rows without a key. Rows that are dealt by some of the keys stay so: nothing is joined."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return m.filter(known).withColumn("__some", F.bool_or(F.col("value") != -1).over(W.partitionBy(*keys))).filter("__some").drop("__some")


def with_map_units(m: DataFrame, units: DataFrame) -> DataFrame:
    """SHP-14. Inner join of each map's unit; doubles dropped."""
    return m.join(units, "map").dropDuplicates()


def map_order(name: Column) -> Column:
    """SHP-15. Rank of a map or slab: summary, neighbouring layers by depth, custom, choroid."""
    upper = layer_rank(F.substring_index(name, "_", 1))
    lower = layer_rank(F.substring_index(name, "_", -1))
    summary = name.isin(*SUMMARY, *SUMMARY.values())
    group = F.when(summary, 0).when(name.startswith("CHOR") | name.startswith("choroid"), 3).when((upper > 0) & (lower == upper + 1), 1).otherwise(2)
    return F.struct(group.alias("group"), upper.alias("upper"), lower.alias("lower"), name.alias("name"))


def order_maps(m: DataFrame, column: str = "layer") -> DataFrame:
    """SHP-15. Rows in anatomical order."""
    return m.orderBy("image_id", map_order(F.col(column)))


def rename_layers(m: DataFrame, column: str = "layer") -> DataFrame:
    """SHP-16. Whole-depth slabs under their names."""
    return m.replace(SUMMARY, subset=[column])


def layer_keys(trace: DataFrame) -> DataFrame:
    """SHP-17. Layers in use with description, in anatomical order."""
    text = F.element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), F.col("layer"))
    return trace.filter("y is not null").select("layer").distinct().filter(layer_rank("layer") > 0).select("layer", text.alias("description"), layer_rank("layer").alias("rank")).orderBy("rank")


def describe_columns(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """SHP-18. Dictionary rows (column, description) of the columns that df has."""
    return dictionary.filter(F.col("column").isin(*df.columns))


def routed(scan: DataFrame, measurement: DataFrame) -> DataFrame:
    """SHP-20. The measurements of all kinds in one pass, each row with its pattern and the kind of its result table."""
    good = scan.filter(~F.col("failed"))
    return route(rename_layers(drop_all_sentinel(measurement, ["image_id", "layer"])).join(good.select("image_id", "pattern"), "image_id").withColumn("grid", F.lit("etdrs")))


def collate(scan: DataFrame, measurement: DataFrame, flags: list[str]) -> dict[str, DataFrame]:
    """SHP-20. Result tables of a cohort: one long table per kind, plus the failed scans.

    Each table is `routed` filtered by kind; the final pivots take their column names from
    the caller. Who wants all kinds in one table takes `routed` itself, which is one pass.
    """
    rows = routed(scan, measurement)
    kinds = ["linescan", "radial", "peripapillary", "ppole_etdrs", "ppole_square"]
    return {k: rows.filter(F.col("kind") == k) for k in kinds} | {"failed": failed(scan, ["failed", *flags])}

