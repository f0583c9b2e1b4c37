"""What the corpus operators share: Arrow plumbing and span texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.shared import fresh_path, materialise

#: Texts are handed to the per-row helpers in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows whose texts have about `most` bytes together; only a run's texts are copied at a time."""
    column = batch.column(text_col)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, size = 0, 0
    for k, n in enumerate([*sizes, most]):
        size += n
        if size >= most or k == len(sizes):
            to = min(k + 1, len(sizes))
            if to > first:
                yield batch.slice(first, to - first), utf8(column.slice(first, to - first))
            first, size = to, 0


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]


def append_in_arrow(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], compute: Callable[[list[bytes]], list], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df's `keep` columns and, behind them, `fields` as compute(texts) gives them, one list or array per field.

    A kept column named like a new field gives way to the new field.
    """
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col, slice_bytes):
                made = [pa.array(x, t) for x, t in zip(compute(texts), kinds, strict=True)]
                kept = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    cols = keep if text_col in keep else [*keep, text_col]
    return df.select(*cols).mapInArrow(run, schema)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by place, so that none is called like a column that an operator adds, and the new names by the old ones."""
    names = {c: f"c{k}" for k, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), names


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    import hashlib

    return hashlib.sha256(span_text(spans).encode()).hexdigest()


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


__all__ = ["append_in_arrow", "documents", "field", "fresh_path", "materialise", "numbered", "slices", "span_digest", "span_text", "utf8"]
