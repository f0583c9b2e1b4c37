"""Connected components by min-label propagation with pointer jumping: over tables, and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise


def components(edges: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """(keys, node, label) of every node on an edge; the label is the component's smallest node.

    Nodes are compared within equal `keys`. Each round writes one table: a node's label
    falls to its smallest neighbour label, then to that label's own label, so the
    number of rounds grows with the logarithm of a path's length.
    """
    keys = list(keys)
    one = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("to"))
    both = materialise(one.union(edges.select(*keys, F.col(b).alias("node"), F.col(a).alias("to"))).distinct(), "edges")
    table = materialise(both.groupBy(*keys, "node").agg(F.min("to").alias("to")).select(*keys, "node", F.least("node", "to").alias("label")), "labels")
    while True:
        labels = table.select(*keys, "node", "label")
        near = both.join(labels.select(*keys, F.col("node").alias("to"), "label"), [*keys, "to"]).groupBy(*keys, "node").agg(F.min("label").alias("near"))
        low = labels.join(near, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(*keys, F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = low.join(jump, [*keys, "low"], "left").select(*keys, "node", F.least("low", "jump").alias("new"), "label")
        moved = materialise(moved.select(*keys, "node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        discard(table)
        table = moved
        if moved.filter("moved").isEmpty():
            discard(both)
            return moved.select(*keys, "node", "label")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n indices reaches over the edges (a, b), for edges that fit a task."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label[label] < label).any():
            label = label[label]
        if (label == before).all():
            break
    return label
