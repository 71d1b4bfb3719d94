"""Row order: stable positions and gap-free numbering without a one-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.functions.cells import quoted

ORD = "_ord"
# monotonically_increasing_id() keeps the row within its partition in the low 33 bits.
ROW_BITS = 33


def with_order(df: DataFrame) -> DataFrame:
    """Add ``_ord``, the position of the row in its source, and write the table once.

    Tables read from files keep the order of the files: by path, then by place
    in the file, however Spark deals files and parts of files out to tasks. Any
    other table has the order in which Spark hands over its rows at that moment;
    give such tables an ``_ord`` of their own where that is not enough.
    """
    place = {"_place": F.monotonically_increasing_id()}
    if "_metadata" not in df._jdf.queryExecution().analyzed().metadataOutput().mkString(","):
        return materialise(df.withColumns(place), "ordered").withColumnRenamed("_place", ORD)
    path = F.col("_metadata.file_path")
    tagged = df.withColumns({"_file": F.xxhash64(path), "_path": path, "_block": F.col("_metadata.file_block_start"), **place})
    written = materialise(tagged, "ordered")
    # One row for each part of a file that a task has read.
    blocks = written.groupBy("_file", "_path", "_block").agg(F.min("_place").alias("_first_place"))
    number = F.row_number().over(Window.orderBy("_path", "_block")).cast("long") - 1
    blocks = blocks.select("_file", "_block", "_first_place", number.alias("_number"))
    position = F.shiftleft("_number", ROW_BITS) + F.col("_place") - F.col("_first_place")
    return written.join(blocks, ["_file", "_block"]).select(*[F.col(quoted(n)) for n in df.columns], position.alias(ORD))


def settle_order(df: DataFrame, order: list[Column], label: str = "ordered") -> DataFrame:
    """Sort by ``order`` across the cluster and replace ``_ord`` by the position.

    The sort is range-partitioned, so positions come from the partition number
    and the row within it. They are written down at once: a second evaluation
    could draw other range bounds.
    """
    return materialise(df.orderBy(*order).withColumn(ORD, F.monotonically_increasing_id()), label)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 1, 2, 3, ... in ``order``.

    Only the row count of each sort partition reaches the driver, one number per
    partition and never more than ``spark.sql.shuffle.partitions`` of them.
    """
    spark = df.sparkSession
    placed = materialise(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", ROW_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    within = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    if len(offsets) <= 1:
        return placed.withColumn(name, within + 1).drop("_place")
    table = spark.createDataFrame(offsets, "_part long, _before long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, within + F.col("_before") + 1)
        .drop("_place", "_part", "_before")
    )


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns into one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(name).alias(name) for name in rows.columns])
