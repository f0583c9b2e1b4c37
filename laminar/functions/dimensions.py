"""Fixed values of the domain: layers, scan patterns, sectors, codes and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer boundaries in anatomical order and what they bound.
LAYERS = {
    "ILM": "Inner Limiting Membrane",
    "RNFL": "Retinal Nerve Fiber Layer",
    "GCL": "Ganglion Cell Layer",
    "IPL": "Inner Plexiform Layer",
    "INL": "Inner Nuclear Layer",
    "OPL": "Outer Plexiform Layer",
    "ELM": "External Limiting Membrane",
    "PR1": "Photoreceptor Layer 1",
    "PR2": "Photoreceptor Layer 2",
    "RPE": "Retinal Pigment Epithelium",
    "BM": "Bruch's Membrane Complex",
    "CHORupper": "Bruch's Membrane - Choroid boundary",
    "CHORlower": "Choroid - Sclera boundary",
}
CHOROID = ("CHORupper", "CHORlower")
PATTERNS = ("Peripapillary", "Ppole", "Radial", "H-line", "V-line", "AV-line")
# Whole-depth slabs and their names in result tables.
SUMMARY = {"ILM_BM": "retina", "ILM_ELM": "inner_retina", "ELM_BM": "outer_retina"}
# Angular sectors of a circular scan, degrees from its start.
SECTORS = [("nasal", 0, 45), ("supero_nasal", 45, 90), ("supero_temporal", 90, 135), ("temporal", 135, 225), ("infero_temporal", 225, 270), ("infero_nasal", 270, 315), ("nasal", 315, 360)]
# Grey values of label images.
CODEBOOK = {191: "artery", 127: "vein", 255: "disc"}
# Microns between samples, and the default region of interest.
SCALE_X, SCALE_Y, ROI_UM = 11.49, 3.87, 1500
# Ring diameters of the macular grid, microns; side of the square grid.
RINGS_UM, SQUARE_UM, SQUARE_N = (1000, 3000, 6000), 7000, 8
UNITS = {"thickness": "um", "area": "mm2", "volume": "mm3", "scale": "um_per_px"}
# Order and whole-image features of vessel results.
VESSEL_MAPS = ("binary", "artery", "vein", "artery-vein")
ZONES = ("B", "C", "whole")
VESSEL_FEATURES = ("fractal_dimension", "vessel_density", "average_global_calibre", "average_local_calibre", "tortuosity_density", "tortuosity_distance", "CRAE_Knudtson", "CRVE_Knudtson")
WHOLE_ONLY = ("fractal_dimension", "vessel_density", "average_global_calibre")
KNUDTSON = {"artery": 0.88, "vein": 0.95}


def layer_rank(layer: Column | str) -> Column:
    """1 for the innermost boundary; 0 for an unknown one."""
    names = F.array(*[F.lit(x) for x in LAYERS])
    return F.array_position(names, F.col(layer) if isinstance(layer, str) else layer).cast("int")


def num(x: float) -> Column:
    return F.lit(float(x))


def truncated(x: Column) -> Column:
    """Cut off after the point, as a long."""
    return x.cast("bigint")
