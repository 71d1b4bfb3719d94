"""Read CSV, JSON and XML tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.cells import INFINITY_PATTERN, NUMBER_PATTERN, col, quoted, text_sql
from recordloom.sources import csv_records, json_elements, xml_rows
from recordloom.sources.flatten import flatten

FORMATS = ("csv", "json", "xml")

# Cells of a CSV file that stand for a missing value.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
_WHOLE = r"^\s*[+-]?\d+\s*$"
_TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")
# Whole numbers up to here are exact as doubles.
_EXACT = 1 << 53


def _unique_names(header: list[str | None]) -> list[str]:
    """Header names; empty ones numbered by column, repeated ones as ``x``, ``x.1``, ``x.2``."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name if name not in (None, "") else f"Unnamed: {i}"
        copy, unique = 0, name
        while unique in names:
            copy += 1
            unique = f"{name}.{copy}"
        names.append(unique)
    return names


def _typed(rows: DataFrame) -> DataFrame:
    """Text columns as the narrowest of boolean, whole number, number, text that fits all their values.

    One aggregate looks at every column. Whole numbers with gaps become doubles
    if all of them are exact as doubles; dates stay the text they are.
    """
    checks = []
    for i, name in enumerate(rows.columns):
        x = col(name)
        number = F.trim(x).rlike(NUMBER_PATTERN) | F.trim(x).rlike(INFINITY_PATTERN)
        long = F.when(x.rlike(_WHOLE), F.expr(f"try_cast(trim({quoted(name)}) AS bigint)"))
        checks += [
            F.count(x).alias(f"n{i}"),
            F.count_if(x.isin(*_TRUTH)).alias(f"b{i}"),
            F.count(long).alias(f"w{i}"),
            F.coalesce(F.max(F.abs(long)), F.lit(0)).alias(f"m{i}"),
            F.count_if(number).alias(f"f{i}"),
            F.count_if(x.rlike(_WHOLE)).alias(f"d{i}"),
        ]
    found = rows.agg(F.count("*").alias("rows"), *checks).first()
    cells = []
    for i, name in enumerate(rows.columns):
        n, x = found[f"n{i}"], quoted(name)
        whole = found[f"w{i}"]
        if not n:
            kind = None
        elif found[f"b{i}"] == n == found["rows"]:
            kind = "boolean"
        elif whole == n:
            kind = "double" if n < found["rows"] and found[f"m{i}"] <= _EXACT else "bigint"
        elif found[f"f{i}"] == n and found[f"d{i}"] == whole:  # no whole number is too long for its type
            kind = "double"
        else:
            kind = None
        cells.append(f"try_cast(trim({x}) AS {kind}) AS {x}" if kind else x)
    return rows.selectExpr(*cells)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, line_breaks: bool | None = None
) -> DataFrame:
    """Header row, missing-value markers, and types that fit whole columns.

    Files are split over tasks, also where quoted cells hold line breaks: one
    look at the lines says whether any do, and then their records are put
    together by ``csv_records``. ``line_breaks=False`` leaves the look out. A row
    with more cells than the header is an error, a shorter one is filled up with
    missing values. The files of a folder must have the same header.
    """
    breaks, cells = bool(line_breaks), 0
    found = csv_records.lines(spark, path)
    if line_breaks is None:
        breaks, cells = csv_records.look(found)
    reader = spark.read.option("escape", '"')
    head = reader.option("multiLine", breaks).option("header", False).csv(path).head(1)
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    if schema is not None:
        schema = spark.createDataFrame([], schema).schema
    header = [*head[0][:-1], head[0][-1].removesuffix("\r") if head[0][-1] else head[0][-1]]
    names = _unique_names(header) if schema is None else schema.names
    if cells > len(names) and not breaks:
        raise ValueError(f"{path}: a row has {cells} cells under {len(names)} columns")
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if breaks:
        rows = csv_records.read(spark, path, found, text if schema is None else schema)
    else:
        # Names made here are not in the file, so only a header without them can be checked against it.
        reader = reader.option("header", True).option("enforceSchema", schema is not None or names != header)
        rows = reader.schema(text if schema is None else schema).csv(path)
    if schema is not None:
        return rows
    marks = ", ".join(f"'{m}'" for m in NULL_MARKERS)
    return _typed(rows.selectExpr(*[f"if({quoted(n)} IN ({marks}), NULL, {quoted(n)}) AS {quoted(n)}" for n in names]))


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of JSON documents.

    A top-level array gives its elements; an object gives the elements of its
    first list, or itself if it has none. Every document of a folder is looked
    at by itself; plain values of a top-level array are the column ``0``. Files
    are split over tasks, see ``json_elements``; ``lines`` reads one record per
    line, as the JSON sink writes them. ``schema`` is the schema of the rows.
    """
    folder = path if lines else json_elements.lines(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return flatten(reader.json(folder))


def read_documents(texts: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON documents, each in a row of the column ``value``; see ``read_json``."""
    spark = texts.sparkSession
    fields = spark.createDataFrame([], schema).schema
    if not fields.fields:
        return spark.createDataFrame([], fields)
    lists = [f for f in fields.fields if isinstance(f.dataType, T.ArrayType)]
    documents = texts.select(
        F.from_json("value", T.ArrayType(fields)).alias("rows"),
        F.when(F.ltrim("value").startswith("{"), F.json_object_keys("value")).alias("keys"),
    )
    item = F.element_at("rows", 1)
    held = F.array_compact(F.array(*[F.when(item[f.name].isNotNull(), F.lit(f.name)) for f in lists]))
    first = F.try_element_at(F.array_intersect("keys", held), F.lit(1)) if lists else F.lit(None).cast("string")
    documents = documents.withColumn("first", first)
    parts = [documents.where("first IS NULL").select(F.explode("rows").alias("row")).select("row.*")]
    for f in lists:
        own = documents.where(F.col("first") == f.name).select(F.explode(item[f.name]).alias("value"))
        parts.append(own.select("value.*") if isinstance(f.dataType.elementType, T.StructType) else own)
    used = {r["first"] for r in documents.select("first").distinct().collect()}  # names of columns
    chosen = [part for part, name in zip(parts, [None, *[f.name for f in lists]], strict=True) if name in used]
    if not chosen:
        return spark.createDataFrame([], fields)
    return reduce(_stacked, [flatten(part) for part in chosen])


def _stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column of different types becomes text."""
    kinds = {f.name: f.dataType for f in a.schema.fields}
    differ = {f.name for f in b.schema.fields if kinds.get(f.name, f.dataType) != f.dataType}

    def as_text(df: DataFrame) -> DataFrame:
        cells: list[Column] = []
        for f in df.schema.fields:
            x = F.expr(text_sql(quoted(f.name), f.dataType)) if f.name in differ else col(f.name)
            cells.append(x.alias(f.name))
        return df.select(*cells)

    return as_text(a).unionByName(as_text(b), allowMissingColumns=True)


def row_element(spark: SparkSession, path: str) -> str:
    """The element that is a row: the first, depth first, that stands more than once under one parent, else the root."""
    names = sorted(r["name"] for r in xml_rows.row_elements(spark, path).select("name").distinct().collect())  # names of elements
    if len(names) != 1:
        raise ValueError(f"{path}: rows are named {names}; state row_tag")
    return names[0]


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Elements named ``row_tag`` as rows of text; attributes ``@x``, mixed text ``#text``.

    Without ``row_tag`` the first repeated element is the row, see ``row_element``.
    """
    rows = (
        spark.read.format("xml")
        .option("rowTag", row_tag or row_element(spark, path))
        .option("attributePrefix", "@")
        .option("valueTag", "#text")
        .option("inferSchema", False)
        .load(path)
    )
    return flatten(rows)


def read_table(
    spark: SparkSession, path: str, row_tag: str | None = None, on_empty: str = "error", **options: object
) -> DataFrame | None:
    """Read by file ending. An empty table is an error, or None with ``on_empty="skip"``."""
    if on_empty not in ("error", "skip"):
        raise ValueError("on_empty must be 'error' or 'skip'")
    ending = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ending == "csv":
        df = read_csv(spark, path, **options)
    elif ending == "json":
        df = read_json(spark, path, **options)
    elif ending == "xml":
        df = read_xml(spark, path, row_tag)
    else:
        raise ValueError(f"Unsupported file format: {path}")
    if not df.columns or df.isEmpty():
        if on_empty == "skip":
            return None
        raise ValueError(f"The file {path} contains no data rows")
    return df
