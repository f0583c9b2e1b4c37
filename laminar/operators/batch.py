"""Running user functions over a cohort: quarantine, batch scoring, routing, edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_apply(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType, key: str = "image_id") -> DataFrame:
    """OPS-1. fn on every row; a row that raises becomes a FAILED row with its message, and the rest goes on."""
    names = schema.names
    out = T.StructType([df.schema[key], *schema.fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    made = fn(row)
                    rows.append((row[key], *(made[c] for c in names), "OK", None))
                except Exception as e:  # noqa: BLE001
                    rows.append((row[key], *(None for _ in names), "FAILED", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=out.names)

    return df.mapInPandas(run, out)


def score(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType, batch: int = 16) -> DataFrame:
    """OPS-2. A user's model over batches of rows; `load` builds it once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                yield model(pdf.iloc[k : k + batch])

    return images.mapInPandas(run, schema)


def route_scorer(images: DataFrame, registry: dict[str, tuple[Callable, float]], schema: T.StructType, batch: int = 16) -> DataFrame:
    """OPS-3. Each location's own model and threshold: scores (with a column p) above it. One pass over the images; a task builds
    the models of the locations that it meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Callable] = {}
        for pdf in batches:
            for location, rows in pdf.groupby("location", sort=False):
                if location in registry:
                    load, threshold = registry[location]
                    model = models.setdefault(location, None) or load()
                    models[location] = model
                    for k in range(0, len(rows), batch):
                        made = model(rows.iloc[k : k + batch].reset_index(drop=True))
                        yield made[made["p"] > threshold]

    return images.mapInPandas(run, schema)


def apply_edits(mask: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OPS-4. Masks with every edited (image_id, mask) replaced as a whole, and the images to be measured anew."""
    touched = edits.select("image_id", "mask").distinct()
    kept = mask.join(touched, ["image_id", "mask"], "left_anti")
    return kept.unionByName(edits, allowMissingColumns=True), touched.select("image_id").distinct()
