"""Nested records to dotted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from recordloom.functions.cells import col, is_floating, iso_sql, quoted


def _leaves(c: Column, dtype: T.DataType, name: str) -> list[tuple[str, Column]]:
    if not isinstance(dtype, T.StructType):
        return [(name, c)]
    out = []
    for field in dtype.fields:
        out += _leaves(c.getField(field.name), field.dataType, f"{name}.{field.name}" if name else field.name)
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become columns named ``outer.inner``; lists stay lists."""
    cells = []
    for field in df.schema.fields:
        cells += _leaves(col(field.name), field.dataType, field.name)
    return df.select(*[c.alias(name) for name, c in cells])


def normalise(df: DataFrame, decimals: int = 10) -> DataFrame:
    """Values as the result files hold them.

    Infinite and NaN become null, doubles keep ten decimals, and timestamps
    become ISO text.
    """
    out = []
    for field in df.schema.fields:
        x = quoted(field.name)
        if is_floating(field.dataType):
            x = f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('inf') THEN round({x}, {decimals}) END"
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            x = iso_sql(x)
        elif isinstance(field.dataType, T.DateType):
            x = f"concat(cast({x} AS string), 'T00:00:00.000')"
        out.append(f"{x} AS {quoted(field.name)}")
    return df.selectExpr(*out)
