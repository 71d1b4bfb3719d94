"""Entity resolution: which rows describe the same entity, and what they say together.

The rule reads rows in order and keeps, for each of three keys, the entity that
last used a value. A row takes the entity found by its first key that has been
seen, else it starts a new one. Written without the loop, every row points at
one earlier row:

* by the leading key at the first row with that value, because all rows that
  share the value end up in one entity;
* else by the second key at the last earlier row with that value, and by the
  third key likewise.

An entity is a tree of such pointers, so it is found with three passes over
rows grouped by a key plus pointer jumping, all on narrow tables. No group of
rows is ever handed to one Python call.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.functions.cells import blank_sql, col, is_truthy, quoted, same_text, type_of
from recordloom.functions.rows import ORD, number_rows, side_by_side

ENTITY_KEYS = ("customer_id", "phone_number", "customer_name")

# A value held by more rows than this is split over several tasks.
GROUP_ROWS = 1 << 20
# Rows of a split value go together if their positions share the upper bits.
CHUNK_BITS = 20


@dataclass
class Resolution:
    assignments: DataFrame
    """``_ord`` of each row with ``entity_no``."""
    records: DataFrame
    """One row per entity."""
    report: DataFrame
    """One row: records before and after, merged duplicates, conflicts."""


def hot_values(df: DataFrame, names: list[str], group_rows: int = GROUP_ROWS) -> dict[str, DataFrame | None]:
    """Per column the table of values that fill more than ``group_rows`` rows, None if there are none.

    Such a table has at most rows / ``group_rows`` values; it stays a table.
    """
    out: dict[str, DataFrame | None] = dict.fromkeys(names)
    if df.count() > group_rows:
        for name in names:
            counts = df.where(col(name).isNotNull()).groupBy(name).count().where(F.col("count") > group_rows)
            table = materialise(counts.select(name, F.lit(True).alias("_hot")), "hot-values")
            out[name] = None if table.isEmpty() else table
    return out


def _scan(df: DataFrame, key: str, hot: DataFrame | None, chunk_bits: int) -> DataFrame:
    """Per row: ``_first``, the first position with the same key value, and
    ``_carry``, the last target known in that group at or before the row.

    A hot value is worked on in chunks of positions. The chunk totals, few per
    value, are then put in order to give each chunk what came before it.
    """
    marked = df.withColumn("_hot", F.lit(None).cast("boolean")) if hot is None else df.join(hot, key, "left")
    split = col(key).isNull() | F.col("_hot").isNotNull()
    chunked = marked.withColumn("_chunk", F.when(split, F.shiftright(ORD, chunk_bits)).otherwise(F.lit(-1).cast("long")))
    window = Window.partitionBy(key, "_chunk").orderBy(ORD)
    scanned = chunked.withColumns(
        {"_first": F.first(ORD).over(window), "_carry": F.last("target", ignorenulls=True).over(window)}
    )
    if hot is None:
        return scanned.drop("_chunk", "_hot")
    known = F.when(F.col("target").isNotNull(), F.col(ORD))
    totals = (
        chunked.filter("_hot")
        .groupBy(key, "_chunk")
        .agg(F.min(ORD).alias("f"), F.max_by("target", known).alias("t"))
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    incoming = totals.select(
        key, "_chunk", F.min("f").over(before).alias("_f"), F.last("t", ignorenulls=True).over(before).alias("_t")
    )
    return (
        scanned.join(incoming, [key, "_chunk"], "left")
        .withColumns(
            {
                "_first": F.coalesce("_f", "_first"),
                "_carry": F.coalesce("_carry", "_t"),
            }
        )
        .drop("_chunk", "_hot", "_f", "_t")
    )


def _pointers(df: DataFrame, keys: list[str], group_rows: int, chunk_bits: int) -> DataFrame:
    """``(_ord, target, leading)``: the earlier row each row points at, null for a first row."""
    names = [f"k{i}" for i in range(len(keys))]
    cells = [F.when(is_truthy(df, k), col(k)).alias(n) for k, n in zip(keys, names)]
    rows = df.select(ORD, *cells)
    if len(keys) > 1:
        rows = materialise(rows, "entity-keys")
    hot = hot_values(rows, names, group_rows)
    rows = rows.withColumns({"target": F.lit(None).cast("long"), "leading": F.lit(False)})
    for i, name in enumerate(names):
        scanned = _scan(rows, name, hot[name], chunk_bits)
        found = F.coalesce("_carry", "_first")
        found = F.when(F.col(name).isNotNull() & (found != F.col(ORD)), found)
        cells = {"target": F.coalesce("target", found)}
        if i == 0:
            # No target is known yet here, so this is the first row of the value.
            cells["leading"] = found.isNotNull()
        rows = scanned.withColumns(cells).drop("_first", "_carry", name)
        if any(hot[n] is not None for n in names[i + 1 : i + 2]):
            rows = materialise(rows, "entity-pointers")
    return rows


def _jump(links: DataFrame, targets: DataFrame) -> DataFrame | None:
    """The ends of the chains that begin at ``targets``; null if none of those points anywhere.

    Only rows that something points at are looked up at the end, so only they
    are followed, by doubling. Of the rows that a round reads, those are kept
    that a row still on its way points at: what has been passed is spliced out,
    and a round reads at most two rows for each one still on its way.
    """
    active = materialise(links.join(targets.select(F.col("target").alias(ORD)).distinct(), ORD, "left_semi"), "entity-chains")
    if active.isEmpty():
        return None
    known, done = active, []
    while True:
        further = known.select(F.col(ORD).alias("target"), F.col("target").alias("_next"))
        step = materialise(
            active.join(further, "target", "left").select(
                ORD, F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("moved")
            ),
            "entity-jumps",
        )
        done.append(step.filter(~F.col("moved")).drop("moved"))
        active = step.filter("moved").drop("moved")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # Rows that arrived earlier may still be pointed at; the others have moved on.
        arrived = known.join(step.select(ORD), ORD, "left_anti")
        ahead = active.select(F.col("target").alias(ORD)).distinct()
        known = materialise(step.drop("moved").unionByName(arrived).join(ahead, ORD, "left_semi"), "entity-ahead")


def assign_entities(
    df: DataFrame, group_rows: int = GROUP_ROWS, chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """``(_ord, entity_no)`` for each row; ``_ord`` must be a unique whole number.

    Entities are numbered from 1 by the position of their first row.
    """
    keys = [k for k in ENTITY_KEYS if k in df.columns]
    if not keys:
        return number_rows(df.select(ORD), [F.col(ORD)], "entity_no")
    rows = materialise(_pointers(df, keys, group_rows, chunk_bits), "entity-targets")
    start = F.coalesce("target", ORD)
    chains = None
    if len(keys) > 1:
        pointing = rows.filter(F.col("target").isNotNull())
        chains = _jump(pointing.filter(~F.col("leading")).select(ORD, "target"), pointing)
    rooted = rows.select(ORD, start.alias("root"))
    if chains is not None:
        ends = chains.select(F.col(ORD).alias("root"), F.col("target").alias("_end"))
        rooted = rooted.join(ends, "root", "left").select(ORD, F.coalesce("_end", "root").alias("root"))
    numbers = number_rows(rows.filter(F.col("target").isNull()).select(F.col(ORD).alias("root")), [F.col("root")], "entity_no")
    return materialise(rooted.join(numbers, "root").select(ORD, "entity_no"), "entities")


def entity_id(number: Column) -> Column:
    return F.format_string("ENT%04d", number)


WINS = "_wins"
# What a row gives to its entity's record: nothing, all of it, or a part of it.
NOTHING, ALL, SOME = 0, 1, 2
_MASK_BITS = 62


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in (ORD, "entity_no", "entity_id", WINS)]


def assigned_rows(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """The rows with ``entity_no`` and ``_wins``, whether their values are the first of their entity; written once.

    The first known value of every column is found as a position: which cells
    are known is a few bits a row, and the smallest positions are hash
    aggregates of numbers. Values stay where they are until it is clear which
    rows hold first ones; the wide rows are moved once, to their entity.
    """
    names = data_columns(df)
    known = [f"NOT {blank_sql(quoted(n), type_of(df, n))}" for n in names]
    masks = [known[i : i + _MASK_BITS] for i in range(0, len(known), _MASK_BITS)]
    bits = [F.expr(" | ".join(f"if({k}, {1 << b}L, 0L)" for b, k in enumerate(part))).alias(f"m{m}") for m, part in enumerate(masks)]
    slim = df.select(ORD, *bits).join(assignments, ORD)
    places = [F.min(F.expr(f"if(m{i // _MASK_BITS} & {1 << i % _MASK_BITS}L <> 0, {ORD}, NULL)")).alias(f"p{i}") for i in range(len(names))]
    first = slim.groupBy("entity_no").agg(*places, F.min(ORD).alias("lead"))
    found = F.array_distinct(F.array_compact(F.array(*[F.col(f"p{i}") for i in range(len(names))], F.lit(None).cast("long"))))
    first = first.select(F.when(F.size(found) > 0, found).otherwise(F.array("lead")).alias("rows"))
    winners = first.select(F.explode("rows").alias(ORD), F.when(F.size("rows") == 1, ALL).otherwise(SOME).alias(WINS))
    roles = assignments.join(winners, ORD, "left").withColumn(WINS, F.coalesce(WINS, F.lit(NOTHING)))
    return materialise(df.join(roles, ORD), "assigned")


def merge_records(df: DataFrame, assignments: DataFrame, positions: bool = False) -> DataFrame:
    """One row per entity: in each column the first value that is not blank.

    ``positions`` adds a struct ``_first`` with the row position of each value.
    Where one row has all first values it is taken as it is; only the winning
    rows of other entities are brought together, at most one for each column.
    """
    rows = df if WINS in df.columns else assigned_rows(df, assignments)
    names = data_columns(rows)
    types = [type_of(rows, n) for n in names]
    own = [F.expr(f"if({blank_sql(quoted(n), t)}, NULL, {quoted(n)})").alias(f"c{i}") for i, (n, t) in enumerate(zip(names, types, strict=True))]
    cells = rows.select("entity_no", F.col(ORD).alias("at"), WINS, *own)
    whole = cells.where(F.col(WINS) == ALL)
    whole = whole.select("entity_no", *[F.when(F.col(f"c{i}").isNotNull(), F.struct("at", F.col(f"c{i}").alias("v"))).alias(f"w{i}") for i in range(len(names))])
    if names:
        row = F.struct("at", *[f"c{i}" for i in range(len(names))])
        gathered = cells.where(F.col(WINS) == SOME).groupBy("entity_no").agg(F.collect_list(row).alias("own"))
        gathered = gathered.withColumn("own", F.expr("array_sort(own, (a, b) -> sign(a.at - b.at)::int)"))
        chosen = [f"get(filter(own, x -> x.c{i} IS NOT NULL), 0)" for i in range(len(names))]
        parts = gathered.selectExpr("entity_no", *[f"if({c} IS NULL, NULL, named_struct('at', {c}.at, 'v', {c}.c{i})) AS w{i}" for i, c in enumerate(chosen)])
        whole = whole.unionByName(parts)
    first = [F.struct(*[F.col(f"w{i}.at").alias(f"p{i}") for i in range(len(names))]).alias("_first")] if positions else []
    values = [F.col(f"w{i}.v").alias(n) for i, n in enumerate(names)]
    return whole.select(entity_id(F.col("entity_no")).alias("entity_id"), "entity_no", *values, *first)


def _conflicts_per_row(df: DataFrame, assignments: DataFrame, records: DataFrame) -> DataFrame:
    rows = df if WINS in df.columns else assigned_rows(df, assignments)
    names = data_columns(rows)
    kept = records.select("entity_no", *[col(n).alias(f"_kept{i}") for i, n in enumerate(names)])
    differs = []
    for i, n in enumerate(names):
        x, dtype = quoted(n), type_of(rows, n)
        differs.append(f"if(NOT {blank_sql(x, dtype)} AND NOT {same_text(x, f'_kept{i}', dtype)}, 1, 0)")
    total = F.expr(" + ".join(differs) or "0")
    # A row that gives all of its entity's values differs in none of them.
    compared = rows.where(F.col(WINS) != ALL).join(kept, "entity_no").select("entity_no", total.alias("conflicts"))
    return compared.unionByName(rows.where(F.col(WINS) == ALL).select("entity_no", F.lit(0).alias("conflicts")))


def conflicts(df: DataFrame, assignments: DataFrame, records: DataFrame) -> DataFrame:
    """``(entity_no, conflicts)``: later values that differ from the one kept."""
    rows = _conflicts_per_row(df, assignments, records)
    return rows.groupBy("entity_no").agg(F.sum("conflicts").alias("conflicts"))


def resolution_report(assignments: DataFrame, conflict_counts: DataFrame) -> DataFrame:
    """One row: before, after, duplicates merged, conflicts."""
    counts = assignments.agg(
        F.count("*").alias("records_before_merge"), F.coalesce(F.max("entity_no"), F.lit(0)).alias("records_after_merge")
    )
    found = conflict_counts.agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts_detected"))
    return side_by_side(counts, found).select(
        "records_before_merge",
        "records_after_merge",
        (F.col("records_before_merge") - F.col("records_after_merge")).alias("duplicates_merged"),
        "conflicts_detected",
    )


def resolve(df: DataFrame, positions: bool = False) -> Resolution:
    """Assign entities, merge their rows and report. ``_ord`` must be a written row position."""
    if "entity_id" in df.columns:
        df = df.withColumnRenamed("entity_id", "source_entity_id")
    assignments = assign_entities(df)
    df = assigned_rows(df, assignments)
    # Written, as both the conflicts and all later steps read them.
    records = materialise(merge_records(df, assignments, positions), "records")
    # Summed without grouping, so that Spark may split the rows of a hot entity in the join.
    report = resolution_report(assignments, _conflicts_per_row(df, assignments, records))
    return Resolution(assignments, records, report)
