"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arrow batches for long texts; both can be set lower by the cluster.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _size(text: str) -> int:
    """A setting such as 512, 64m or 67108864b as a number."""
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:])
    return int(text[:-1]) << unit if unit else int(text)


def short_batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers hold small, as single texts may be long."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = _size(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def word_bytes(text: bytes) -> list[bytes]:
    """Matches of ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` cuts at exactly these six characters."""
    return text.split()


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8, nulls kept."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in text_bytes(batch, name)]


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, object]], added: T.StructType, keep: list[str]) -> DataFrame:
    """Run ``step`` over Arrow batches: the columns ``keep`` pass through, ``step`` returns the added ones.

    Columns that are neither kept nor needed should be dropped before. A kept
    column with the name of an added one is replaced by it.
    """
    short_batches(df.sparkSession)
    taken = {name.lower() for name in added.fieldNames()}
    keep = [name for name in keep if name.lower() not in taken]
    schema = T.StructType([df.schema[name] for name in keep] + added.fields)
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for batch in batches:
            new = step(batch)
            arrays = [batch.column(name) for name in keep]
            arrays += [pa.array(new[name], kind) for name, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def lowest(df: DataFrame, draw: Column, most: int, rows: int) -> DataFrame:
    """The ``most`` rows of ``df`` with the smallest hash ``draw``, given that it has ``rows`` rows.

    Only rows below a bound that about four times as many pass are looked at, so
    that tasks do not each send ``most`` rows; few rows are never cut.
    """
    return df.withColumn("_draw", draw).where(F.col("_draw") <= F.lit(hash_bound(most, rows))).orderBy("_draw").limit(most).drop("_draw")


def hash_bound(most: int, rows: int) -> int:
    """A bound of 64-bit hashes that about four times ``most`` of ``rows`` pass, all of few rows."""
    return -(1 << 63) + min((1 << 64) - 1, (4 * most << 64) // max(1, rows))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
