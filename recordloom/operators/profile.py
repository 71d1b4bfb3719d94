"""Column profiles, data catalogue, insights, recommendations, duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.functions.cells import col, fill, float_sql, is_floating, is_missing, quoted, round_even, text_of, text_sql, to_number, type_of
from recordloom.functions.rows import ORD, side_by_side

# Descriptions of well-known columns.
DESCRIPTIONS = {
    "customer_id": "Unique identifier for customer",
    "customer_name": "Full name of the customer",
    "phone_number": "Contact number of customer",
    "phone_service": "Indicates if the customer has phone service",
    "revenue": "Monetary value associated with customer",
    "address": "Physical location or address",
    "email_address": "Email contact information",
    "date_of_birth": "Birth date of the customer",
    "city": "City of residence",
    "ticket": "Support ticket identifier or details",
    "account_balance": "Current balance in the account",
}

# The wording of insights and recommendations.
UNIQUE_RECORDS = "✓ {} unique records identified"
DUPLICATES_MERGED = "✓ {} duplicate records merged"
MISSING_VALUES = "✓ Missing values detected: {}"
LINKED_ENTITIES = "✓ Number of linked entities: {}"
CROSS_FILE = "✓ Number of cross-file relationships: {}"
UNMATCHED_ENTITIES = "✓ Number of unmatched entities: {}"
REVENUE_AVAILABLE = "✓ Revenue column available"
AVERAGE_REVENUE = "✓ Average revenue: {}"
MOST_COMMON = "✓ Most common {}: {}"
PHONE_IS_KEY = "Phone number is a strong entity key"
ID_IS_KEY = "Customer ID should be primary key"
REVENUE_SUITABLE = "Revenue column suitable for analytics"
STANDARDIZE_CITIES = "Consider standardizing city names"
ALL_CLEAN = "Data is clean and ready for analysis"

PLACE_COLUMNS = ("city", "location", "address")
SAMPLES = 3
# Rows in which samples are looked for first.
FRONT_ROWS = 1000
NOT_PROFILED = (ORD, "entity_id", "entity_no")


def describe(name: str) -> str:
    return DESCRIPTIONS.get(name, "Data column representing " + name.replace("_", " "))


def describe_column(name: Column) -> Column:
    """The same for a column of names."""
    known = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return F.coalesce(known[name], F.concat(F.lit("Data column representing "), F.replace(name, F.lit("_"), F.lit(" "))))


def profiled_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in NOT_PROFILED]


# Texts up to this length are compared as they are, longer ones by their SHA-256.
COMPARED_LENGTH = 64


def comparison_key(df: DataFrame, name: str) -> Column:
    """What values are compared by. Long texts are not shuffled, their digests are."""
    dtype, x = type_of(df, name), quoted(name)
    if isinstance(dtype, T.StringType):
        return F.expr(f"if(length({x}) <= {COMPARED_LENGTH}, concat('t', {x}), concat('h', sha2({x}, 256)))")
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return F.expr(f"sha2(to_json({x}), 256)")
    return F.expr(f"nanvl({x}, NULL)") if is_floating(dtype) else col(name)


def _type_name(dtype: T.DataType, has_nulls: Column) -> Column:
    """Type as a data frame of such values reports it; whole numbers with gaps are floats."""
    if isinstance(dtype, T.IntegralType):
        return F.when(has_nulls, "float64").otherwise("int64")
    if isinstance(dtype, T.NumericType):
        return F.lit("float64")
    if isinstance(dtype, T.BooleanType):
        return F.when(has_nulls, "object").otherwise("bool")
    return F.lit("object")


def column_stats(df: DataFrame, distinct: str | None = "exact") -> DataFrame:
    """One row per column: rows, nulls, null percentage, distinct values.

    One pass over the table. Exact distinct counting turns rows into narrow
    (column, value) pairs, counts equal pairs where they are read, and then pairs
    per column; ``distinct="approximate"`` needs one aggregate of one row, and
    ``None`` counts no distinct values.
    """
    names = profiled_columns(df)
    if distinct == "exact":
        return _exact_stats(df, names)
    aggregates = [F.count("*").alias("rows")]
    for i, name in enumerate(names):
        aggregates.append(F.count_if(~is_missing(df, name)).alias(f"n{i}"))
        if distinct == "approximate":
            aggregates.append(F.approx_count_distinct(comparison_key(df, name)).alias(f"d{i}"))
    cells = []
    for i, name in enumerate(names):
        nulls = F.col("rows") - F.col(f"n{i}")
        cells.append(
            F.struct(
                F.lit(i).alias("column_no"),
                F.lit(name).alias("column_name"),
                _type_name(type_of(df, name), nulls > 0).alias("data_type"),
                F.col("rows"),
                nulls.alias("nulls"),
                round_even(nulls / F.col("rows") * 100, 2).alias("null_percentage"),
                (F.col(f"d{i}") if distinct else F.lit(None).cast("long")).alias("unique_values"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def _pair_text(df: DataFrame, name: str) -> Column:
    """The comparison key of a value as text; null if the value is missing."""
    dtype, key = type_of(df, name), comparison_key(df, name)
    if is_floating(dtype):
        key = key + F.lit(0.0)  # no negative zero
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        key = F.to_json(col(name))
    return key.cast("string")


def _exact_stats(df: DataFrame, names: list[str]) -> DataFrame:
    spark = df.sparkSession
    row = F.struct(F.lit(-1).alias("no"), F.lit("").alias("key"))
    pairs = [F.struct(F.lit(i).alias("no"), _pair_text(df, name).alias("key")) for i, name in enumerate(names)]
    equal = df.select(F.explode(F.array(row, *pairs)).alias("p")).where("p.key IS NOT NULL").groupBy("p.no", "p.key").agg(F.count("*").alias("n"))
    found = equal.groupBy("no").agg(F.sum("n").alias("present"), F.count("*").alias("distinct"))
    known = spark.createDataFrame([(-1, "", ""), *[(i, name, _kind(type_of(df, name))) for i, name in enumerate(names)]], "no int, column_name string, kind string")
    # One row for each column from here on.
    rows = F.coalesce(F.max(F.when(F.col("no") == -1, F.col("present"))).over(Window.partitionBy()), F.lit(0))
    counted = known.join(F.broadcast(found), "no", "left").withColumns({"rows": rows, "present": F.coalesce("present", F.lit(0))})
    nulls = F.col("rows") - F.col("present")
    gaps = nulls > 0
    name_of = F.when(F.col("kind") == "whole", F.when(gaps, "float64").otherwise("int64")).when(F.col("kind") == "truth", F.when(gaps, "object").otherwise("bool"))
    return counted.where("no >= 0").select(
        F.col("no").alias("column_no"),
        "column_name",
        F.coalesce(name_of, F.col("kind")).alias("data_type"),
        "rows",
        nulls.alias("nulls"),
        round_even(nulls / F.col("rows") * 100, 2).alias("null_percentage"),
        F.coalesce("distinct", F.lit(0)).alias("unique_values"),
    )


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "whole"
    if isinstance(dtype, T.BooleanType):
        return "truth"
    return "float64" if isinstance(dtype, T.NumericType) else "object"


def _first_values(df: DataFrame, names: list[str], order: str, n: int) -> DataFrame:
    """column_name, at, value, as_float of the first ``n`` values of the columns."""
    cells = []
    for name in names:
        dtype = type_of(df, name)
        text = text_of(df, name)
        as_float = F.expr(float_sql(quoted(name))) if isinstance(dtype, T.IntegralType) else text
        here = F.struct(F.lit(name).alias("column_name"), col(order).alias("at"), text.alias("value"), as_float.alias("as_float"))
        cells.append(F.when(~is_missing(df, name), here))
    rows = df.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").select("c.*")
    # Spark keeps n rows of each column in every task before they are dealt out.
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("column_name").orderBy("at"))).where(F.col("_n") <= n).drop("_n")


def samples(df: DataFrame, order: str = ORD, n: int = SAMPLES, stats: DataFrame | None = None) -> DataFrame:
    """Per column the text of its first ``n`` values; whole numbers with gaps as the floats they count as.

    Most columns have their first values within the first rows, which one pass
    finds. Only the columns that do not are looked for in the whole table.
    """
    names = [n_ for n_ in profiled_columns(df) if n_ != order]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, sample_values array<string>")
    front = materialise(_first_values(df.orderBy(col(order)).limit(FRONT_ROWS), names, order, n), "samples")
    full = {r["column_name"] for r in front.groupBy("column_name").count().where(F.col("count") >= n).collect()}
    short = [name for name in names if name not in full]
    found = front.where(F.col("column_name").isin(*full)) if full else front.limit(0)
    if short:
        found = found.unionByName(_first_values(df, short, order, n))
    stats = column_stats(df, None) if stats is None else stats
    # At most n rows per column get here.
    lists = found.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("at", "value", "as_float"))).alias("first"))
    return lists.join(F.broadcast(stats.select("column_name", "nulls")), "column_name").select(
        "column_name",
        F.when(F.col("nulls") > 0, F.transform("first", lambda s: s["as_float"])).otherwise(F.transform("first", lambda s: s["value"])).alias("sample_values"),
    )


def data_catalog(df: DataFrame, order: str = ORD, distinct: str = "exact", drop_empty: bool = False) -> DataFrame:
    """One row per column: type, samples, null percentage, distinct values, description.

    ``drop_empty`` leaves out columns without any value, which resolved records do not have.
    """
    stats = materialise(column_stats(df if order == ORD else df.drop(order), distinct), "column_stats")
    if drop_empty:
        stats = stats.filter(F.col("nulls") < F.col("rows"))
    return stats.join(F.broadcast(samples(df, order, stats=stats)), "column_name", "left").select(
        "column_no",
        "column_name",
        "data_type",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "null_percentage",
        "unique_values",
        describe_column(F.col("column_name")).alias("description"),
    )


def average_revenue(df: DataFrame, name: str = "revenue") -> DataFrame:
    """One row: mean of the numbers and the text shown for it."""
    return df.agg(F.avg(to_number(df, name)).alias("average"), shown_average(df, name).alias("shown"))


def shown_average(df: DataFrame, name: str = "revenue") -> Column:
    return F.concat(F.lit("₹"), F.format_number(F.avg(to_number(df, name)), 2))


def most_common_place(df: DataFrame, order: str = ORD) -> DataFrame:
    """The most frequent value of the first place column; ties go to the one seen first."""
    name = next((n for n in df.columns if n in PLACE_COLUMNS), None)
    if name is None:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    counted = df.filter(~is_missing(df, name)).groupBy(col(name).alias("v")).agg(
        F.count("*").alias("n"), F.min(col(order)).alias("at")
    )
    text = F.expr(text_sql("v", type_of(df, name)))
    return (
        counted.orderBy(F.desc("n"), F.asc("at")).limit(1).select(F.lit(name).alias("column_name"), text.alias("value"), "n")
    )


def insights(
    df: DataFrame, report: DataFrame, trust: DataFrame, stats: DataFrame | None = None, order: str = ORD
) -> DataFrame:
    """``(seq, insight)``: sentences about the resolved records, in a fixed order."""
    has_revenue = "revenue" in df.columns
    shown = [shown_average(df).alias("shown")] if has_revenue else []
    facts = [
        df.agg(F.count("*").alias("unique_records"), *shown),
        report.select("duplicates_merged"),
        trust.select("missing_values"),
    ]
    none = F.lit(None).cast("string")
    links = unmatched = average = place = none
    if stats is not None:
        facts.append(stats.select("linked_entities", "unmatched_entities"))
        links = F.when(F.col("linked_entities") > 0, F.col("linked_entities").cast("string"))
        unmatched = F.when(F.col("unmatched_entities") > 0, F.col("unmatched_entities").cast("string"))
    if has_revenue:
        average = F.col("shown")
    place_name = next((n for n in df.columns if n in PLACE_COLUMNS), None)
    if place_name:
        facts.append(most_common_place(df, order).select(F.col("value").alias("place")))
        place = F.col("place")
    lines = [
        fill(UNIQUE_RECORDS, F.col("unique_records")),
        fill(DUPLICATES_MERGED, F.col("duplicates_merged")),
        fill(MISSING_VALUES, F.col("missing_values")),
        fill(LINKED_ENTITIES, links),
        fill(CROSS_FILE, links),
        fill(UNMATCHED_ENTITIES, unmatched),
        F.lit(REVENUE_AVAILABLE) if has_revenue else none,
        fill(AVERAGE_REVENUE, average),
        fill(MOST_COMMON, F.lit(place_name), place),
    ]
    return _numbered(side_by_side(*facts), lines, "insight")


def _numbered(row: DataFrame, lines: list[Column], name: str) -> DataFrame:
    """The non-null lines of a one-row frame as numbered rows."""
    kept = F.filter(F.array(*lines), lambda line: line.isNotNull())
    return row.select(F.posexplode(kept).alias("seq", name)).withColumn("seq", F.col("seq") + 1)


def recommendations(df: DataFrame) -> DataFrame:
    """``(seq, recommendation)`` for the columns that are there."""
    has_phone = "phone_number" in df.columns
    aggregates = [F.count("*").alias("rows")]
    if has_phone:
        aggregates.append(F.count_distinct(F.when(~is_missing(df, "phone_number"), col("phone_number"))).alias("phones"))
    none = F.lit(None).cast("string")
    lines = [
        F.when(F.col("phones") > F.col("rows") * 0.8, PHONE_IS_KEY) if has_phone else none,
        F.lit(ID_IS_KEY) if "customer_id" in df.columns else none,
        F.lit(REVENUE_SUITABLE) if "revenue" in df.columns else none,
        F.lit(STANDARDIZE_CITIES) if "city" in df.columns else none,
    ]
    clean = F.when(F.coalesce(*lines).isNull(), ALL_CLEAN)
    return _numbered(df.agg(*aggregates), [*lines, clean], "recommendation")


def revenue_column(df: DataFrame) -> str | None:
    return next((n for n in df.columns if "rev" in n.lower() or "amount" in n.lower()), None)


def revenue_total(df: DataFrame) -> DataFrame:
    """One row: the first revenue-like column and the sum of its numbers."""
    name = revenue_column(df)
    if name is None:
        return df.sparkSession.createDataFrame([], "column_name string, total double")
    number = to_number(df, name)
    exact = F.when(~F.isnan(number), number.try_cast("decimal(28,8)"))
    # Decimals sum to the same total in any order of rows; doubles are the way out for very large values.
    total = F.when(F.count(exact) == F.count(number), F.sum(exact).cast("double")).otherwise(F.sum(number))
    total = F.coalesce(total, F.lit(0.0))
    return df.agg(round_even(total, 2).alias("total")).select(F.lit(name).alias("column_name"), "total")


def _compared(df: DataFrame, exclude: tuple[str, ...]) -> list[str]:
    return [n for n in df.columns if n not in exclude and n != ORD]


# Bits that say which digests may be those of copied rows; 8 MB for any number of rows, in maps of 4 kB.
MARK_BITS, MAP_BITS = 1 << 26, 1 << 15


def _row_digest(df: DataFrame, exclude: tuple[str, ...]) -> tuple[Column, Column]:
    """The compared values of a row as 128 bits; missing values are told from one another by their place."""
    keys = [comparison_key(df, name) for name in _compared(df, exclude)]
    unknown = F.concat(F.lit(""), *[F.when(key.isNull(), "1").otherwise("0") for key in keys])
    return F.xxhash64(F.lit(1), unknown, *keys), F.xxhash64(F.lit(2), unknown, *keys)


def _copied(df: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """Digests that several rows have, and how many; only digests are moved."""
    first, second = _row_digest(df, exclude)
    return df.select(first.alias("_g1"), second.alias("_g2")).groupBy("_g1", "_g2").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)


def duplicate_rows_count(df: DataFrame, exclude: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """One row: how many rows are copies of another, each copy counted."""
    return _copied(df, exclude).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_rows"))


def duplicate_rows(df: DataFrame, exclude: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """All rows whose tuple occurs more than once.

    Rows are first held against a map of bits, of a size that does not depend on
    the data, so that hardly any row is moved that is not in the result.
    """
    copied = materialise(_copied(df, exclude).select("_g1", "_g2"), "copied-rows")
    place = F.pmod("_g1", F.lit(MARK_BITS))
    maps = copied.select(F.floor(place / MAP_BITS).cast("int").alias("_map"), F.pmod(place, F.lit(MAP_BITS)).alias("_bit"))
    maps = maps.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    first, second = _row_digest(df, exclude)
    own = F.pmod("_h1", F.lit(MARK_BITS))
    # The row travels as one value, so its column names cannot clash.
    rows = df.select(F.struct(*[col(name) for name in df.columns]).alias("_row"), first.alias("_h1"), second.alias("_h2")).withColumns({"_own": F.floor(own / MAP_BITS).cast("int"), "_at": F.pmod(own, F.lit(MAP_BITS)).cast("int")})
    rows = rows.join(F.broadcast(maps), F.col("_own") == F.col("_map"))
    marked = F.expr("shiftright(cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) AS int), _at % 8) & 1 = 1")
    found = rows.where(marked).join(copied, (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")), "left_semi")
    return found.select("_row.*")
