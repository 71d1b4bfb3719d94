"""Pieces of text files in file order, for formats whose records cannot be told apart line by line.

A file is read in parts by several tasks. What a piece means depends on all
pieces before it, through a sum or a bit. Such a prefix is computed within each
part, which is one window; the parts, one row each, are put in order; and what
came before a part is added to its pieces.

Where pieces are many and short, a row for each is more place and bracket than
text. ``bundles`` puts the pieces that a task reads in a row together again, so
that what is shuffled is one short row for a bundle, and no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("_path", "_block")
# Bytes of pieces that are put together.
BUNDLE = 1 << 18
# Settings for tables of bundles: bytes that Python gets at once, and rows that are read at once from a written table.
FEW_BYTES, FEW_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}, {"parquet.block.row.count.limit": "32"}
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def within(*also: str) -> WindowSpec:
    """Pieces of a part in order."""
    return Window.partitionBy(*KEYS, *also).orderBy("_place")


def along(*also: str) -> WindowSpec:
    """Parts of a file in order."""
    return Window.partitionBy("_path", *also).orderBy("_block")


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """What runs inside has these settings; later ones are as before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, _path, _block, _place: what stands between separators; _place orders the pieces of a part."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))


def bundles(
    spark: SparkSession, path: str, separator: str, about: Callable[[bytes], dict[str, object]], kinds: str, size: int = BUNDLE,
    carry: Callable[[dict[str, object] | None, dict[str, object]], dict[str, object]] | None = None,
) -> DataFrame:
    """text, _path, _block and what ``about`` says of a text, as columns of ``kinds``.

    A text is a run of pieces of one part, of about ``size`` bytes or one piece.
    ``_block`` orders the bundles of a file: the start of the part and the
    pieces before, each of which is a byte at least.

    With ``carry`` the columns are what it makes of those of the bundle before
    (None for the first of a part) and of what ``about`` says; ``_part``, the
    start of the part, is added.
    """
    found = pieces(spark, path, separator).select("value", *KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, earlier = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, paths, blocks = batch.column("value"), batch.column("_path"), batch.column("_block").to_numpy()
            ends = np.cumsum(pc.binary_length(values).to_numpy() + 1)
            new = np.diff(blocks) != 0
            new |= pc.not_equal(paths.slice(1), paths.slice(0, len(paths) - 1)).to_numpy(zero_copy_only=False)
            new |= np.diff((ends - ends[0]) // size) != 0
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values.cast(pa.binary()))
            texts = pc.binary_join(lists, separator.encode())
            rows = []
            for text, a, b in zip(texts.to_pylist(), cuts[:-1], cuts[1:], strict=True):
                key = paths[a].as_py(), int(blocks[a])
                before, earlier = (before, earlier) if key == last else (0, None)
                said = about(text)
                if carry:
                    said = earlier = carry(earlier, said) | {"_part": key[1]}
                rows.append({"_path": key[0], "_block": key[1] + before, **said})
                last, before = key, before + b - a
            made = pa.RecordBatch.from_pylist(rows)
            columns = [texts.cast(pa.string()), *(pa.array(made.column(name).to_pylist(), kind) for name, kind in schema[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in schema])

    simple = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    told = f"text string, _path string, _block long, {'_part long, ' if carry else ''}{kinds}"
    schema = [(name, simple[kind]) for name, kind in (field.split() for field in told.split(", "))]
    return found.mapInArrow(run, told)


def place() -> Column:
    return F.struct("_block", "_place")


def with_owner(placed: DataFrame) -> DataFrame:
    """Add ``_owner``, the part and number of the start that a piece belongs to; ``_no`` counts starts within the part.

    Pieces ahead of the first start of their part belong to the last start of
    the parts before it.
    """
    begun = placed.groupBy(*KEYS).agg(F.max("_no").alias("n"))
    earlier = F.last(F.when(F.col("n") > 0, F.struct("_block", "n")), ignorenulls=True).over(along().rowsBetween(*BEFORE))
    begun = begun.withColumn("_earlier", earlier).drop("n")
    owner = F.when(F.col("_no") > 0, F.struct("_block", F.col("_no").alias("n"))).otherwise(F.col("_earlier"))
    return placed.join(begun, list(KEYS)).withColumn("_owner", owner).drop("_earlier")


def joined(placed: DataFrame, separator: str, *others: Column) -> DataFrame:
    """text, _path, _owner, _block, _place of the pieces of each owner, put together again."""
    own = F.array_sort(F.collect_list(F.struct("_block", "_place", "value")))
    groups = placed.groupBy("_path", "_owner").agg(own.alias("own"), *others)
    text = F.array_join(F.transform("own", lambda piece: piece["value"]), separator)
    return groups.withColumns({"text": text, "_block": F.col("own")[0]["_block"], "_place": F.col("own")[0]["_place"]}).drop("own")
