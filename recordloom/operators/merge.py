"""Merge tables on their shared key columns.

Tables carry ``_ord``, the row position. A merged table carries a struct there
that sorts like the merged result: by key, then by left and right position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.functions.cells import col, number_sql, quoted, text_sql
from recordloom.functions.rows import ORD, settle_order, side_by_side, with_order

# The columns that link tables.
LINK_KEYS = ("customer_id", "phone_number", "email_address", "account_id", "policy_id", "id")

_MASK_BITS = 62


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    return [k for k in LINK_KEYS if k in left.columns and k in right.columns]


def _alike(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds both; text when they have nothing in common."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def _key_alike(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type in which keys of both types can be compared without losing a digit.

    Whole numbers meet as long, decimals in one wide enough, any other mix of
    numbers as their plain text.
    """
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else T.StringType()
    shared = _alike(a, b)
    return T.StringType() if isinstance(shared, T.DoubleType) and a != b else shared


def _key_as(x: str, have: T.DataType, want: T.DataType) -> str:
    """SQL for a key brought to the type it is compared in."""
    if isinstance(want, T.StringType) and isinstance(have, T.NumericType):
        return number_sql(x, have)
    return _as(x, have, want)


def _as(x: str, have: T.DataType, want: T.DataType) -> str:
    """SQL for a value brought to another type."""
    if have == want:
        return x
    return text_sql(x, have) if isinstance(want, T.StringType) else f"cast({x} AS {want.simpleString()})"


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe full outer join; shared other columns take the left value, else the right.

    It is put together from an inner join and two anti joins, as Spark can split
    a hot key in those but not in a full outer join. The anti joins look only at
    distinct keys, so a hot key is one row on their far side.
    """
    left_types = {f.name: f.dataType for f in left.schema.fields}
    right_types = {f.name: f.dataType for f in right.schema.fields}
    key_types = {k: _key_alike(left_types[k], right_types[k]) for k in keys}

    def prepared(df: DataFrame, types: dict[str, T.DataType], mark: str) -> DataFrame:
        return df.selectExpr(
            *[f"{_key_as(quoted(n), t, key_types.get(n, t))} AS {mark}{i}" for i, (n, t) in enumerate(types.items())]
        )

    a, b = prepared(left, left_types, "l"), prepared(right, right_types, "r")
    at_left = {n: f"l{i}" for i, n in enumerate(left_types)}
    at_right = {n: f"r{i}" for i, n in enumerate(right_types)}

    def on(x: DataFrame, y: DataFrame) -> Column:
        return reduce(lambda p, q: p & q, [x[at_left[k]].eqNullSafe(y[at_right[k]]) for k in keys])

    left_keys = a.select(*[at_left[k] for k in keys]).distinct()
    right_keys = b.select(*[at_right[k] for k in keys]).distinct()
    both = a.join(b, on(a, b), "inner")
    only_left = a.join(right_keys, on(a, right_keys), "left_anti")
    only_right = b.join(left_keys, on(left_keys, b), "left_anti")
    rows = both.unionByName(only_left, allowMissingColumns=True).unionByName(only_right, allowMissingColumns=True)

    out = []
    for name, dtype in left_types.items():
        if name == ORD:
            continue
        x = at_left[name]
        if name in keys:
            x = f"coalesce({x}, {at_right[name]})"
        elif name in right_types:
            want = _alike(dtype, right_types[name])
            x = f"coalesce({_as(x, dtype, want)}, {_as(at_right[name], right_types[name], want)})"
        out.append(f"{x} AS {quoted(name)}")
    out += [f"{at_right[n]} AS {quoted(n)}" for n in right_types if n not in left_types]
    parts = []
    for i, k in enumerate(keys):
        key = f"coalesce({at_left[k]}, {at_right[k]})"
        parts.append(f"'n{i}', {key} IS NULL")
        if isinstance(key_types[k], T.StringType) and isinstance(left_types[k], T.NumericType):
            parts.append(f"'d{i}', try_cast({key} AS double)")  # numbers as text still sort as numbers
        parts.append(f"'k{i}', {key}")
    position = f"named_struct({', '.join(parts)}, 'l', {at_left[ORD]}, 'r', {at_right[ORD]})"
    return rows.selectExpr(*out, f"{position} AS {ORD}")


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables, columns lined up by name, missing ones null."""
    lt, rt = left.schema[ORD].dataType, right.schema[ORD].dataType
    types = {f.name: f.dataType for f in left.schema.fields if f.name != ORD}
    for f in right.schema.fields:
        if f.name != ORD:
            types[f.name] = _alike(types.get(f.name, f.dataType), f.dataType)

    def lined_up(df: DataFrame, position: Column) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        cells = [
            (F.expr(_as(quoted(n), have[n], t)) if n in have else F.lit(None).cast(t)).alias(n) for n, t in types.items()
        ]
        return df.select(*cells, position.alias(ORD))

    first = F.struct(F.lit(0).alias("s"), col(ORD).alias("l"), F.lit(None).cast(rt).alias("r"))
    second = F.struct(F.lit(1).alias("s"), F.lit(None).cast(lt).alias("l"), col(ORD).alias("r"))
    return lined_up(left, first).unionByName(lined_up(right, second))


def key_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``key, left_rows, right_rows, merged_rows`` of every key value, null ones included, without joining any row.

    ``key`` is a struct of the key columns in the types they are compared in.
    """
    left_types = {f.name: f.dataType for f in left.schema.fields}
    right_types = {f.name: f.dataType for f in right.schema.fields}
    kinds = {k: _key_alike(left_types[k], right_types[k]) for k in keys}

    def counted(df: DataFrame, types: dict[str, T.DataType], mark: str) -> DataFrame:
        cells = [F.expr(_key_as(quoted(k), types[k], kinds[k])).alias(k) for k in keys]
        return df.select(F.struct(*cells).alias("key"), F.lit(mark).alias("side"))

    sides = counted(left, left_types, "l").unionByName(counted(right, right_types, "r"))
    sizes = sides.groupBy("key").agg(F.count_if(F.col("side") == "l").alias("left_rows"), F.count_if(F.col("side") == "r").alias("right_rows"))
    exact = "decimal(38,0)"
    both = F.col("left_rows").cast(exact) * F.col("right_rows").cast(exact)
    one = (F.col("left_rows") + F.col("right_rows")).cast(exact)
    return sizes.withColumn("merged_rows", F.when(both > 0, both).otherwise(one).cast(exact))


def merge_size(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: how many rows a merge gives, how many of them for null keys, and for the largest key.

    The number is exact: keys with n and m rows give n * m, keys of one side
    their own rows; without a shared key the tables are appended.
    """
    keys = shared_keys(left, right) if keys is None else keys
    if not keys:
        total = left.select(F.lit(1)).unionByName(right.select(F.lit(1))).agg(F.count("*").alias("merged_rows"))
        return total.select("merged_rows", F.lit(0).cast("long").alias("null_key_rows"), F.lit(0).cast("long").alias("largest_key_rows"))
    sizes = key_sizes(left, right, keys)
    unknown = reduce(lambda a, b: a | b, [F.col("key")[k].isNull() for k in keys])
    zero = F.lit(0).cast("decimal(38,0)")
    return sizes.agg(
        F.coalesce(F.sum("merged_rows"), zero).cast("long").alias("merged_rows"),
        F.coalesce(F.sum(F.when(unknown, F.col("merged_rows"))), zero).cast("long").alias("null_key_rows"),
        F.coalesce(F.max("merged_rows"), zero).cast("long").alias("largest_key_rows"),
    )


def hot_keys(left: DataFrame, right: DataFrame, n: int = 10, keys: list[str] | None = None) -> DataFrame:
    """The ``n`` key values that give most rows."""
    keys = shared_keys(left, right) if keys is None else keys
    return key_sizes(left, right, keys).orderBy(F.desc("merged_rows"), "key").limit(n)


def merge(tables: list[DataFrame], most_rows: int | None = None) -> DataFrame:
    """Left fold over the tables; ``_ord`` of the result is a sortable struct.

    Two tables give one lazy plan. With more, the table merged so far is written
    before it is joined again: a join reads it three times, and plans that held
    all earlier joins three times over would grow out of hand.

    With ``most_rows`` the size of every merge is worked out before it is run,
    and a merge that would give more rows is refused, naming its largest keys.
    """
    parts = [df if ORD in df.columns else with_order(df) for df in tables]
    merged, joined = parts[0], False
    for part in parts[1:]:
        keys = shared_keys(merged, part)
        merged = materialise(merged, "merging") if keys and joined else merged
        if most_rows is not None:
            rows = merge_size(merged, part, keys).first()["merged_rows"]
            if rows > most_rows:
                worst = [f"{tuple(r['key'])}: {r['merged_rows']}" for r in hot_keys(merged, part, 5, keys).collect()] if keys else []
                raise ValueError(f"merging on {keys} gives {rows} rows, more than {most_rows}; largest keys {'; '.join(worst)}")
        merged = full_outer(merged, part, keys) if keys else append(merged, part)
        joined = joined or bool(keys)
    return merged


def merge_in_order(tables: list[DataFrame]) -> DataFrame:
    """The merged table, written down with a plain row position in ``_ord``."""
    return settle_order(merge(tables), [F.col(ORD)], "merged")


def linked_keys(tables: list[DataFrame]) -> DataFrame:
    """Per key column: values that link a table to the ones before it.

    Merging a table keeps every key value of those before it, so a value found
    in m tables is counted m - 1 times, and no merge has to be run for it.
    """
    types: dict[str, T.DataType] = {}
    holders: dict[str, int] = {}
    for df in tables:
        for f in df.schema.fields:
            if f.name in LINK_KEYS:
                types[f.name] = _key_alike(types.get(f.name, f.dataType), f.dataType)
                holders[f.name] = holders.get(f.name, 0) + 1
    keys = [k for k in LINK_KEYS if holders.get(k, 0) > 1]
    spark = tables[0].sparkSession
    if not keys:
        return spark.createDataFrame([], "key_column string, linked long")
    found = []
    for number, df in enumerate(tables):
        have = {f.name: f.dataType for f in df.schema.fields}
        cells = [
            F.struct(
                F.lit(k).alias("key_column"),
                F.expr(text_sql(_key_as(quoted(k), have[k], types[k]), types[k])).alias("value"),
            )
            for k in keys
            if k in have
        ]
        if cells:
            found.append(
                df.select(F.explode(F.array(*cells)).alias("c"))
                .select("c.key_column", "c.value", F.lit(number).alias("source"))
                .filter(F.col("value").isNotNull())
            )
    chunks = range(len(tables) // _MASK_BITS + 1)
    masks = [
        F.bit_or(
            F.when(F.floor(F.col("source") / _MASK_BITS) == i, F.expr(f"shiftleft(1L, source - {i * _MASK_BITS})"))
        ).alias(f"m{i}")
        for i in chunks
    ]
    values = reduce(DataFrame.unionByName, found).groupBy("key_column", "value").agg(*masks)
    hits = reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(f"m{i}"), F.lit(0)) for i in chunks])
    return values.groupBy("key_column").agg(F.sum(hits - 1).cast("long").alias("linked"))


def multi_file_stats(tables: list[DataFrame], merged: DataFrame) -> DataFrame:
    """One row: cross-file matches, linked entities, unmatched entities."""
    linked = linked_keys(tables).agg(F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"))
    total = merged.agg(F.count("*").alias("rows"))
    return side_by_side(total, linked).select(
        F.col("linked").alias("cross_file_matches"),
        F.col("linked").alias("linked_entities"),
        F.greatest(F.lit(0), F.col("rows") - F.col("linked")).alias("unmatched_entities"),
    )


def cross_file_graph(stats: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Placeholder nodes and edges, at most ``limit`` of them, none without links."""
    numbers = stats.filter(F.col("linked_entities") > 0).select(
        F.explode(F.sequence(F.lit(0), F.least(F.lit(limit), F.col("linked_entities")).cast("int") - 1)).alias("j")
    )
    name = F.concat(F.lit("entity_"), F.col("j").cast("string"))
    nodes = numbers.select(name.alias("id"), F.lit("Linked Profile").alias("label"))
    edges = numbers.select(name.alias("source"), F.lit("cross_file_link").alias("target"))
    return nodes, edges
