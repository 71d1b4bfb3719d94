"""Search, filters, sorting, paging, counts and top-N."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.functions.cells import col, is_blank, text_of, to_number, type_of
from recordloom.functions.rows import ORD


# A page is cut out of at most about this many rows in one task.
SLICE_ROWS = 4096
# Keys drawn to find a slice that holds the page, and the fewest that are enough to try.
DRAWN = 20_000
BOUNDS = 64

REGEX_CHARACTERS = set("\\.^$*+?{}[]|()")
NUMBER_CHARACTERS = set("0123456789+-.einfa")


def _cell_hit(df: DataFrame, name: str, lowered: str) -> Column:
    text = F.lower(text_of(df, name))
    if REGEX_CHARACTERS & set(lowered):
        # Classes such as \\w and \\b take in all letters.
        return text.rlike("(?U)" + lowered)
    if isinstance(type_of(df, name), T.NumericType) and set(lowered) - NUMBER_CHARACTERS:
        return F.lit(False)
    return text.contains(lowered)


def search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows in which the lower-cased regex occurs in the text of any column.

    A pattern without regex characters is looked up as plain text, and not at
    all in number columns if it holds characters that numbers do not.
    """
    if not pattern:
        return df
    lowered = pattern.lower()
    hits = [F.coalesce(_cell_hit(df, name, lowered), F.lit(False)) for name in df.columns if name != ORD]
    return df.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))


def equals(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal all the given values."""
    return df.filter(reduce(lambda a, b: a & b, [col(k) == F.lit(v) for k, v in values.items()], F.lit(True)))


def greater_than(df: DataFrame, name: str, bound: float) -> DataFrame:
    return df.filter(to_number(df, name) > bound)


def has_value(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose column equals ``value``, letter case aside."""
    return df.filter(F.lower(text_of(df, name)) == value.lower())


def with_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any of the columns is null or blank."""
    names = columns or [name for name in df.columns if name != ORD]
    return df.filter(reduce(lambda a, b: a | b, [is_blank(df, name) for name in names]))


def sort_keys(df: DataFrame, by: str | None, order: str = "asc", ties: list[str] | None = None) -> list[Column]:
    """Sort columns: nulls last either way; an unknown column is no sort at all."""
    keys = []
    if by and by in df.columns:
        keys.append(col(by).asc_nulls_last() if order == "asc" else col(by).desc_nulls_last())
    return keys + [col(name).asc_nulls_last() for name in (ties or ([ORD] if ORD in df.columns else []))]


def sort_rows(df: DataFrame, by: str | None, order: str = "asc", ties: list[str] | None = None) -> DataFrame:
    keys = sort_keys(df, by, order, ties)
    return df.orderBy(*keys) if keys else df


def page(
    df: DataFrame,
    number: int = 1,
    limit: int = 100,
    by: str | None = None,
    order: str = "asc",
    ties: list[str] | None = None,
) -> DataFrame:
    """One page of the sorted rows, at any depth.

    Rows are put into one total order: by the sort column, then by ``ties``
    (the row position, or all columns where there is none). A scan of the keys
    counts the rows and draws some places, between two of which the page must
    lie but for bad luck; a second scan writes the slice between them and
    counts what comes before. Further cuts read only slices, until one is short
    enough to sort. Only drawn keys reach the driver, never whole rows.
    """
    first = (number - 1) * limit
    if not by or by not in df.columns:
        if not ties and ORD not in df.columns:
            return df.offset(first).limit(limit)
        by = None
    if not ties and ORD not in df.columns:
        ties = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys, tie_names = sort_keys(df, by, order, ties), ties or [ORD]
    rows, skipped, used, wide = df, first, 1, 1
    while skipped + limit > SLICE_ROWS:
        # Bounds are places as far as the first ties; more of them are looked at where those are all the same.
        place = _place(by, tie_names[:used])
        drawn, total = _drawn(rows, place, order)
        if total <= max(SLICE_ROWS, skipped) or len(drawn) < BOUNDS:
            break
        share, slack = len(drawn) / total, wide * 2 * len(drawn) ** 0.5 + 1
        low, high = int(skipped * share - slack), int((skipped + limit) * share + slack) + 1
        part, before, held = _slice(rows, place, order, drawn[low] if low >= 0 else None, drawn[high] if high < len(drawn) else None)
        if held == total:
            if used >= len(tie_names):
                break
            used += 1
        elif before > skipped or before + held < min(skipped + limit, total):
            wide *= 2  # bad luck with the places drawn
        else:
            rows, skipped, wide = part, skipped - before, 1
    return rows.orderBy(*keys).offset(skipped).limit(limit)


def _place(by: str | None, ties: list[str]) -> Column:
    """Where a row stands: unknown key, key, and ties, each behind its missing mark."""
    return F.struct(
        (col(by).isNull() if by else F.lit(False)).alias("n"),
        (col(by) if by else F.lit(0)).alias("k"),
        F.struct(*[c.alias(f"t{i}") for i, c in enumerate(x for name in ties for x in (col(name).isNull(), col(name)))]).alias("t"),
    )


def _drawn(rows: DataFrame, place: Column, order: str) -> tuple[list, int]:
    """Places of about ``DRAWN`` rows in order, and the number of rows; one scan of the keys."""
    seen = Observation()
    keyed = rows.select(place.alias("p")).observe(seen, F.count(F.lit(1)).alias("n"))
    # The least of random numbers are a sample, whatever the number of rows.
    drawn = keyed.withColumn("draw", F.rand(17)).orderBy("draw").limit(DRAWN).sort(*_place_order(order)).select("p").collect()
    return [r["p"] for r in drawn], seen.get["n"]


def _slice(rows: DataFrame, place: Column, order: str, low: object, high: object) -> tuple[DataFrame, int, int]:
    """The rows from ``low`` to ``high``, written; how many come before, and how many it has."""
    kind, smaller = place_type(rows, place), "<" if order == "asc" else ">"

    def before(b: str, p: str) -> str:
        """SQL: the place b stands strictly before the place p."""
        return f"({b}.n < {p}.n OR ({b}.n = {p}.n AND (coalesce({b}.k {smaller} {p}.k, false) OR (({b}.k = {p}.k OR {b}.n) AND {b}.t < {p}.t))))"

    none = F.lit(None).cast(kind)
    marked = rows.withColumns({"_p": place, "_low": none if low is None else _literal(low, kind), "_high": none if high is None else _literal(high, kind)})
    marked = marked.withColumns({"_early": F.expr(f"coalesce({before('_p', '_low')}, false)"), "_late": F.expr(f"coalesce({before('_high', '_p')}, false)")})
    seen = Observation()
    marked = marked.observe(seen, F.count_if("_early").alias("before"), F.count_if(~F.col("_early") & ~F.col("_late")).alias("held"))
    part = materialise(marked.where("NOT _early AND NOT _late").drop("_p", "_low", "_high", "_early", "_late"), "slice")
    return part, seen.get["before"], seen.get["held"]


def _place_order(order: str) -> list[Column]:
    key = F.col("p.k").asc() if order == "asc" else F.col("p.k").desc()
    return [F.col("p.n").asc(), key, F.col("p.t").asc()]


def place_type(df: DataFrame, place: Column) -> T.DataType:
    return df.select(place.alias("p")).schema["p"].dataType


def _literal(value: object, dtype: T.DataType) -> Column:
    """A collected value as a literal of its type."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.array(*[_literal(v, dtype.elementType) for v in value]).cast(dtype) if value is not None else F.lit(None).cast(dtype)
    return F.lit(value).cast(dtype)


def page_count(df: DataFrame, limit: int = 100) -> DataFrame:
    """One row: matching rows and the number of pages, at least one."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(limit))).cast("long").alias("pages")
    )


def count_by(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(col(name)).agg(F.count("*").alias("n"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def top_n(df: DataFrame, name: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """The ``n`` rows with the highest number in a column."""
    value = to_number(df, name)
    return df.orderBy(value.desc_nulls_last(), *sort_keys(df, None, ties=ties)).limit(n)
