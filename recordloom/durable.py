"""Cut lineage by writing a table into the shared checkpoint folder.

Parquet is used rather than ``DataFrame.checkpoint()`` because later steps read
only some of the columns, and because written row numbers stay the same when an
executor is lost and a stage runs again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_folder: str | None = None
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that were materialised inside.

    Results must have been written or collected by then. Scopes may be nested.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="recordloom-")
    return _local_folder


def _storable(df: DataFrame) -> DataFrame:
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return df.withColumns({name: F.lit(None).cast("string") for name in void}) if void else df


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    df = _storable(df)
    path = f"{shared_folder(spark).rstrip('/')}/recordloom/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
