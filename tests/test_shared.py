"""Tables in the shared folder: what goes, and what stays readable."""

import os

from laminar.functions import graph
from laminar.sources import shared


def made(spark):
    return set(os.listdir(shared.shared_dir(spark)))


def test_scratch_deletes_what_was_made_within(spark):
    kept = shared.materialise(spark.range(5), "kept")
    before = made(spark)
    with shared.scratch(spark):
        shared.materialise(spark.range(7), "gone")
        assert made(spark) > before
    assert made(spark) == before and kept.count() == 5


def test_discard_deletes_one_table(spark):
    before = made(spark)
    table = shared.materialise(spark.range(5), "one")
    shared.discard(table)
    shared.discard(spark.range(3))  # not a table of ours: nothing happens
    assert made(spark) == before


def test_components_leave_one_table(spark):
    """A long path, a ring and a pair: labels of all rounds but the last are gone."""
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000 + (k + 1) % 50) for k in range(50)] + [(5000, 4000)]
    before = made(spark)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert len(made(spark) - before) == 1
    labels = {r["node"]: r["label"] for r in got.collect()}
    assert {labels[k] for k in range(201)} == {0} and {labels[1000 + k] for k in range(50)} == {1000} and labels[5000] == labels[4000] == 4000
