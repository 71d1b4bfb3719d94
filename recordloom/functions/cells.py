"""Cell-level expressions: names, text form, blank test, numbers, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Python's str.strip() removes.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"


def quoted(name: str) -> str:
    """A column name as it stands in SQL; flattened names contain dots."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


# The expressions below are given as SQL text, which one call turns into a column.


def strip_sql(x: str) -> str:
    return f"btrim({x}, '{WHITESPACE}')"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def missing_sql(x: str, dtype: T.DataType) -> str:
    return f"({x} IS NULL OR isnan({x}))" if is_floating(dtype) else f"({x} IS NULL)"


def blank_sql(x: str, dtype: T.DataType) -> str:
    return f"({x} IS NULL OR {strip_sql(x)} = '')" if isinstance(dtype, T.StringType) else missing_sql(x, dtype)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    return F.expr(missing_sql(quoted(name), type_of(df, name)))


def is_blank(df: DataFrame, name: str) -> Column:
    """Missing, or text that is empty once stripped."""
    return F.expr(blank_sql(quoted(name), type_of(df, name)))


def is_truthy(df: DataFrame, name: str) -> Column:
    """Whether a key counts as given: null, "", 0 and False do not."""
    dtype, x = type_of(df, name), quoted(name)
    if isinstance(dtype, T.StringType):
        return F.expr(f"{x} IS NOT NULL AND {x} <> ''")
    if isinstance(dtype, T.BooleanType):
        return F.expr(f"{x} IS NOT NULL AND {x}")
    if isinstance(dtype, T.NumericType):
        return F.expr(f"NOT {missing_sql(x, dtype)} AND {x} <> 0")
    if isinstance(dtype, T.ArrayType):
        return F.expr(f"{x} IS NOT NULL AND size({x}) > 0")
    return F.expr(f"{x} IS NOT NULL")


def float_sql(x: str) -> str:
    """Shortest decimal text of a double, plain from 1e-4 up to 1e16.

    Spark's own cast serves for most values. It switches to ``1.5E7`` at 1e7 and
    below 1e-3, and Java before 19 may print a digit too many, then 16 or more.
    """
    x = f"cast({x} AS double)"
    raw = exact = f"cast({x} AS string)"
    for digits in (16, 15):
        rounded = f"format_string('%.{digits - 1}e', {x})"
        exact = f"CASE WHEN try_cast({rounded} AS double) = {x} THEN upper({rounded}) ELSE {exact} END"
    plain = f"regexp_replace(cast(try_cast({exact} AS decimal(38,22)) AS string), '0+$', '')"
    power = f"replace(regexp_replace({exact}, r'\\.?0*E\\+?', 'e+'), '+-', '-')"
    return f"""
        CASE WHEN isnan({x}) THEN 'nan'
             WHEN abs({x}) = double('inf') THEN if({x} > 0, 'inf', '-inf')
             WHEN length({raw}) < 17 AND NOT contains({raw}, 'E') THEN {raw}
             WHEN abs({x}) >= 1e-4D AND abs({x}) < 1e16D THEN regexp_replace({plain}, r'\\.$', '.0')
             ELSE regexp_replace({power}, r'(e[+-])(\\d)$', '$10$2') END
    """


def text_sql(x: str, dtype: T.DataType) -> str:
    """Text of a value as the result tables print it; null stays null."""
    if isinstance(dtype, T.StringType):
        return x
    if is_floating(dtype):
        return float_sql(x)
    if isinstance(dtype, T.BooleanType):
        return f"initcap(cast({x} AS string))"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_sql(x)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({x})"
    return f"cast({x} AS string)"


def number_sql(x: str, dtype: T.DataType) -> str:
    """Text of a number that is the same in every numeric type: plain digits, no empty decimals.

    Whole numbers keep all their digits; doubles go through their shortest
    decimal form, so neighbouring long numbers never meet.
    """
    if isinstance(dtype, T.IntegralType):
        return f"cast({x} AS string)"
    if isinstance(dtype, T.DecimalType):
        plain = f"cast({x} AS string)"
        return f"CASE WHEN contains({plain}, '.') THEN regexp_replace({plain}, r'\\.?0+$', '') ELSE {plain} END"
    whole = f"{x} = floor({x}) AND abs({x}) < 1e38D"
    return f"CASE WHEN {whole} THEN cast(try_cast(cast({x} AS double) AS decimal(38,0)) AS string) ELSE {float_sql(x)} END"


def text_of(df: DataFrame, name: str) -> Column:
    return F.expr(text_sql(quoted(name), type_of(df, name)))


def iso_sql(x: str) -> str:
    return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")"


def to_number(df: DataFrame, name: str) -> Column:
    """Coerce to double; anything that is not a number becomes null.

    ``try_cast`` alone would take "1.5d" and "1f", so the text is checked first.
    """
    dtype, x = type_of(df, name), quoted(name)
    if isinstance(dtype, T.StringType):
        text = strip_sql(x)
        number = f"{text} RLIKE r'{NUMBER_PATTERN}' OR {text} RLIKE r'{INFINITY_PATTERN}'"
        return F.expr(f"CASE WHEN {number} THEN try_cast({text} AS double) END")
    if is_floating(dtype):
        return F.expr(f"CASE WHEN NOT isnan({x}) THEN cast({x} AS double) END")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.expr(f"cast({x} AS double)")
    return F.lit(None).cast("double")


def round_even(c: Column, places: int) -> Column:
    """Half-even rounding on the scaled double, as array libraries round."""
    scale = float(10**places)
    return F.rint(c * scale) / scale


def fill(template: str, *cells: Column) -> Column:
    """Text with a cell in place of each ``{}``; null if a cell is."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for cell, piece in zip(cells, pieces[1:], strict=True):
        parts += [cell.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def display_name(name: str) -> str:
    return name.replace("_", " ").title()


def same_text(x: str, other: str, dtype: T.DataType) -> str:
    """SQL for equality of the stripped text forms; plain equality where that is the same."""
    if isinstance(dtype, T.StringType):
        return f"({strip_sql(x)} = {strip_sql(other)})"
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return f"(to_json({x}) = to_json({other}))"
    return f"({x} = {other})"


def safe_file_name(c: Column) -> Column:
    """Letters, digits, space, ``-`` and ``_`` only; "report" when nothing is left."""
    kept = F.rtrim(F.regexp_replace(c, r"[^\p{L}\p{Nd}\p{No} _-]", ""))
    return F.when(F.coalesce(kept, F.lit("")) == "", "report").otherwise(kept)
