"""Records of CSV files whose quoted cells may hold line breaks, found by all tasks at once.

A line of such a file can be a record, the start, a part or the end of one.
Which it is depends on all lines before it, but only through one bit: whether it
starts inside quotes. What a line does to that bit is known without it: it
keeps it, turns it round, or sets it. These steps are put together within the
part of a file that one task reads, the parts are put together in the order of
the file, one row for each, and then every line knows where it starts. Lines
that are records stay where they are; only those of longer records are brought
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.functions.cells import quoted
from recordloom.sources.file_parts import KEYS, SO_FAR, along, joined, pieces, with_owner, within

_COMMAS = "length(t) - length(replace(t, ',', ''))"


def _walk(inside: int) -> str:
    """SQL: whether a line ends inside quotes, and its commas outside of them, if it starts inside (1) or not (0).

    The pieces between quotes are gone through with m: 0 outside, 1 inside, 2
    behind a quote that closes unless another follows; f: at the start of a cell,
    where alone a quote opens.
    """
    m = "if(NOT a.q, a.m, CASE a.m WHEN 0 THEN if(a.f, 1, 0) WHEN 1 THEN 2 ELSE 1 END)"
    step = (
        f"named_struct('m', if({m} = 2 AND t <> '', 0, {m}), "
        f"'f', {m} <> 1 AND if(t <> '', endswith(t, ','), a.f AND NOT a.q), "
        f"'c', a.c + if({m} <> 1, {_COMMAS}, 0), 'q', true)"
    )
    start = f"named_struct('m', {inside}, 'f', {'false' if inside else 'true'}, 'c', 0, 'q', false)"
    return f"aggregate(split(value, '\"', -1), {start}, (a, t) -> {step}, a -> named_struct('open', a.m = 1, 'commas', a.c))"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, the place of every line, and what it does from outside (out) and from inside quotes (in)."""
    read = pieces(spark, path, "\n")
    plain = "instr(value, '\"') = 0"
    commas = "length(value) - length(replace(value, ',', ''))"
    return read.selectExpr(
        "*",
        f"if({plain}, named_struct('open', false, 'commas', {commas}), {_walk(0)}) AS out",
        f"if({plain}, named_struct('open', true, 'commas', 0), {_walk(1)}) AS in",
    )


def look(found: DataFrame) -> tuple[bool, int]:
    """Whether some line that starts outside quotes ends inside, and else the most cells of a line."""
    seen = found.agg(F.max("out.open").alias("open"), F.max(F.col("out.commas") + 1).alias("cells")).first()
    return bool(seen["open"]), seen["cells"] or 0


def _after(steps: DataFrame, window: WindowSpec) -> DataFrame:
    """Add set and turned: the bit after all rows up to here is set, if that is not null, else the one before them; then turned."""
    steps = steps.withColumn("_turns", F.sum(F.col("turn").cast("int")).over(window))
    last = F.last(F.when(F.col("put").isNotNull(), F.struct("put", "_turns")), ignorenulls=True).over(window)
    steps = steps.withColumn("_last", last)
    turned = (F.col("_turns") - F.coalesce(F.col("_last._turns"), F.lit(0))) % 2 == 1
    return steps.withColumns({"set": F.col("_last.put"), "turned": turned}).drop("_turns", "_last")


def _bit(before: Column) -> Column:
    return F.coalesce("set", before) != F.col("turned")


def records(found: DataFrame) -> DataFrame:
    """text, cells, header (first of its file), _path, _block, _place of every record of the lines; written once."""
    put = F.when(F.col("out.open") == F.col("in.open"), F.col("out.open"))
    turn = F.col("out.open") & ~F.col("in.open")
    steps = _after(found.withColumns({"put": put, "turn": turn}), within().rowsBetween(*SO_FAR)).drop("put", "turn")
    # One row for each part of a file that a task has read.
    parts = steps.groupBy(*KEYS).agg(F.max_by(F.struct("set", "turned"), "_place").alias("e"))
    parts = parts.select(*KEYS, F.when(F.col("e.set").isNotNull(), F.col("e.set") != F.col("e.turned")).alias("put"), (F.col("e.set").isNull() & F.col("e.turned")).alias("turn"))
    parts = _after(parts, along().rowsBetween(*SO_FAR)).withColumn("_end", _bit(F.lit(False)))
    ends = parts.select(*KEYS, F.coalesce(F.lag("_end").over(along()), F.lit(False)).alias("_before"), F.lead("_end").over(along()).isNull().alias("_last"))
    steps = steps.join(ends, list(KEYS)).withColumn("ends_in", _bit(F.col("_before")))
    steps = steps.withColumn("starts_in", F.coalesce(F.lag("ends_in").over(within()), F.col("_before")))
    steps = steps.withColumn("_no", F.sum((~F.col("starts_in")).cast("int")).over(within().rowsBetween(*SO_FAR)))
    commas = F.when(F.col("starts_in"), F.col("in.commas")).otherwise(F.col("out.commas"))
    placed = materialise(steps.select("value", *KEYS, "_place", "_last", "starts_in", "ends_in", "_no", commas.alias("commas")), "csv-lines")
    unclosed = placed.where("_last").groupBy("_path").agg(F.max_by("ends_in", F.struct("_block", "_place")).alias("open")).where("open").head(1)
    if unclosed:
        raise ValueError(f"{unclosed[0]['_path']}: a quoted cell is not closed")
    bare = F.regexp_replace("text", "\r$", "").alias("text")
    alone = placed.where("NOT starts_in AND NOT ends_in").withColumnRenamed("value", "text")
    alone = alone.select(bare, (F.col("commas") + 1).alias("cells"), ((F.col("_block") == 0) & (F.col("_no") == 1)).alias("header"), *KEYS, "_place")
    several = joined(with_owner(placed.where("starts_in OR ends_in")), "\n", (F.sum("commas") + 1).alias("cells"))
    several = several.select(bare, "cells", ((F.col("_owner._block") == 0) & (F.col("_owner.n") == 1)).alias("header"), *KEYS, "_place")
    return materialise(alone.where("trim(text) <> '' OR header").unionByName(several), "csv-records")


def read(spark: SparkSession, path: str, found: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the records in the order of the files, by the given schema; a record with more cells is an error."""
    all_ = records(found)
    heads = all_.where("header").select("text").distinct().limit(2).count()
    if heads > 1:
        raise ValueError(f"{path}: the files have different headers")
    wide = all_.agg(F.max("cells")).first()[0] or 0
    if wide > len(schema.fields):
        raise ValueError(f"{path}: a row has {wide} cells under {len(schema.fields)} columns")
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("text", columns, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    ordered = all_.where("NOT header").orderBy(*KEYS, "_place")
    # Written in order, as rows of a sort have no place in a file that later steps could see.
    return materialise(ordered.select(parsed.alias("row")).select("row.*"), "csv-rows")
