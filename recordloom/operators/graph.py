"""Relationship trees of resolved records, and the same as an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import display_name, is_blank, is_truthy, text_of
from recordloom.functions.rows import ORD

NOT_CHILDREN = (ORD, "_first", "entity_id", "entity_no", "customer_name", "customer_id", "phone_number")


def relationship_tree(records: DataFrame) -> DataFrame:
    """Per entity: its name and its other fields as children.

    Children stand in the order in which the fields got their values, if the
    records carry those positions in ``_first``; else in column order.
    """
    names = [n for n in records.columns if n not in (ORD, "_first", "entity_id", "entity_no")]
    positioned = "_first" in records.columns
    cells = [
        F.when(
            ~is_blank(records, n),
            F.struct(
                (F.col(f"_first.p{i}") if positioned else F.lit(0).cast("long")).alias("at"),
                F.lit(i).alias("no"),
                F.concat(F.lit(display_name(n) + ": "), text_of(records, n)).alias("name"),
                F.lit(n).alias("type"),
            ),
        )
        for i, n in enumerate(names)
        if n not in NOT_CHILDREN
    ]
    if cells:
        ordered = F.array_sort(F.filter(F.array(*cells), lambda c: c.isNotNull()))
        children = F.transform(ordered, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type")))
    else:
        children = F.array().cast("array<struct<name:string,type:string>>")
    name = F.col("entity_id")
    if "customer_name" in records.columns:
        name = F.coalesce(F.when(is_truthy(records, "customer_name"), text_of(records, "customer_name")), name)
    return records.select("entity_id", name.alias("name"), children.alias("children")).withColumn(
        "relationship_count", F.size("children")
    )


def relationship_edges(tree: DataFrame) -> DataFrame:
    """``(source, label, target)``: one row per child."""
    return tree.select(F.col("entity_id").alias("source"), F.explode("children").alias("c")).select(
        "source", F.col("c.type").alias("label"), F.col("c.name").alias("target")
    )


def sample_records(records: DataFrame, n: int = 10) -> DataFrame:
    """The first entities by number."""
    return records.orderBy("entity_no").limit(n)
