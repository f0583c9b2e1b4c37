"""Tables in the folder that driver and executors share: cut lineage, survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made for each application, oldest first, and the folder behind each materialised table.
_made: dict[str, list[str]] = {}
_behind: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a fresh folder that goes when Python ends."""
    sc = spark.sparkContext
    set_already = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_already:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_already = tempfile.mkdtemp(prefix="laminar-")
        atexit.register(shutil.rmtree, set_already, ignore_errors=True)
        sc.setCheckpointDir(set_already)
    return set_already.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _behind[table] = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete one of this application's folders."""
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    if table in _behind:
        remove(table.sparkSession, _behind[table])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables and folders that are made within are deleted at the end: what is built from them has to be written by then."""
    before = set(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        for path in [p for p in _made.get(spark.sparkContext.applicationId, []) if p not in before]:
            remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder; results that still read it are void."""
    for path in list(_made.get(spark.sparkContext.applicationId, [])):
        remove(spark, path)
