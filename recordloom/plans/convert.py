"""The main flow: several tables in, one resolved and profiled table out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.functions.cells import col
from recordloom.functions.rows import ORD, side_by_side, with_order
from recordloom.operators import graph, merge, profile, quality, resolve, schema_match
from recordloom.session import tune
from recordloom.sources.flatten import normalise


@dataclass
class Conversion:
    mappings: DataFrame
    merged: DataFrame
    stats: DataFrame
    records: DataFrame
    report: DataFrame
    tree: DataFrame
    graph_nodes: DataFrame
    graph_edges: DataFrame
    trust: DataFrame
    catalog: DataFrame
    insights: DataFrame
    recommendations: DataFrame

    def public_records(self) -> DataFrame:
        return self.records.drop("_first", "entity_no")


def convert(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    mapping: Mapping[str, str] | None = None,
    least: int = 2,
    cells: str = "present",
    decimals: int = 10,
) -> Conversion:
    """Rename, merge, resolve, score and profile.

    Column names are mapped automatically, or by ``mapping`` if given. The
    merged table is written once in its final order, and the resolved records
    once; all other results are read from those two. ``least`` is the smallest
    number of tables taken, ``decimals`` the decimals that doubles keep.
    """
    tune(spark)
    if len(tables) < least:
        raise ValueError(f"at least {least} tables are needed")
    if mapping is None:
        renamed, mappings = schema_match.rename_auto(spark, tables)
    else:
        renamed, mappings = schema_match.rename_manual(spark, tables, mapping)
    parts = [df if ORD in df.columns else with_order(df) for df in renamed.values()]
    merged = merge.settle_order(merge.merge(parts).transform(lambda df: normalise(df, decimals)), [F.col(ORD)], "merged")
    merged = gaps_as_floats(merged)
    stats = materialise(merge.multi_file_stats(parts, merged), "stats")
    found = resolve.resolve(merged, positions=True)
    records = found.records
    report = materialise(found.report, "report")
    ordered = records.drop("_first").withColumn(ORD, F.col("entity_no"))
    trust = materialise(quality.trust_report(ordered, report, cells), "trust")
    nodes, edges = merge.cross_file_graph(stats)
    return Conversion(
        mappings=mappings,
        merged=merged,
        stats=stats,
        records=records,
        report=report,
        tree=graph.relationship_tree(records),
        graph_nodes=nodes,
        graph_edges=edges,
        trust=trust,
        catalog=profile.data_catalog(ordered, drop_empty=True),
        insights=profile.insights(ordered, report, trust, stats),
        recommendations=profile.recommendations(ordered),
    )


def gaps_as_floats(df: DataFrame) -> DataFrame:
    """Whole-number columns with missing values as doubles, if all their values are exact as doubles."""
    names = [f.name for f in df.schema.fields if f.name != ORD and isinstance(f.dataType, T.IntegralType)]
    if not names:
        return df
    checks = []
    for i, n in enumerate(names):
        checks += [F.count_if(col(n).isNull()).alias(f"n{i}"), F.coalesce(F.max(F.abs(col(n).cast("decimal(20,0)"))), F.lit(0)).alias(f"m{i}")]
    found = df.agg(*checks).first()
    gaps = [n for i, n in enumerate(names) if found[f"n{i}"] and found[f"m{i}"] <= 1 << 53]
    return df.withColumns({n: col(n).cast("double") for n in gaps}) if gaps else df


def project_row(conversion: Conversion, project_id: str, user_id: str, project_name: str) -> DataFrame:
    """The row stored for a finished job: counts, score and all results as JSON.

    Lists in it have one entry per column or sentence, never one per record.
    """

    def listed(df: DataFrame, order: str, value: object, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        return df.agg(F.transform(pairs, lambda p: p["v"]).alias(name))

    def entry(*names: str) -> object:
        return F.struct(*names)

    nodes = conversion.graph_nodes.agg(F.array_sort(F.collect_list(entry("id", "label"))).alias("nodes"))
    edges = conversion.graph_edges.agg(F.array_sort(F.collect_list(entry("source", "target"))).alias("edges"))
    mapped = listed(
        conversion.mappings,
        "entry_no",
        entry("original_column", "canonical_column", "confidence_score", "match_type"),
        "mappings_applied",
    )
    catalog = listed(
        conversion.catalog,
        "column_no",
        entry("column_name", "data_type", "sample_values", "null_percentage", "unique_values", "description"),
        "data_catalog",
    )
    row = side_by_side(
        conversion.report,
        conversion.stats,
        conversion.trust.drop("duplicates_merged", "conflicts_detected"),
        nodes,
        edges,
        mapped,
        catalog,
        listed(conversion.insights, "seq", F.col("insight"), "data_insights"),
        listed(conversion.recommendations, "seq", F.col("recommendation"), "recommendations"),
    )
    results = F.to_json(
        F.struct(
            F.struct(
                "records_before_merge",
                "records_after_merge",
                "duplicates_merged",
                "conflicts_detected",
                F.struct("cross_file_matches", "linked_entities", "unmatched_entities").alias("multi_file_stats"),
            ).alias("entity_resolution_report"),
            F.struct("nodes", "edges").alias("relationship_graphs"),
            F.struct(
                "quality_score",
                F.struct("completeness_score", "consistency_score", "duplicate_score", "final_score").alias(
                    "score_breakdown"
                ),
                "missing_values",
                "duplicates_merged",
                "conflicts_detected",
            ).alias("trust_report"),
            "mappings_applied",
            "data_catalog",
            "data_insights",
            "recommendations",
            F.col("records_after_merge").alias("records_processed"),
        )
    )
    return row.select(
        F.lit(project_id).alias("project_id"),
        F.lit(user_id).alias("user_id"),
        F.lit(project_name).alias("project_name"),
        F.col("records_after_merge").cast("int").alias("total_records"),
        F.col("quality_score").cast("int").alias("quality_score"),
        results.alias("processing_results"),
        F.current_timestamp().alias("created_at"),
    )


def question_facts(project_id: str, records: DataFrame) -> DataFrame:
    """What the raw records add to the answers on a project."""
    names = records.drop(ORD, "_first", "entity_no")
    return side_by_side(
        profile.duplicate_rows_count(names),
        profile.revenue_total(names).select(
            F.col("column_name").alias("revenue_column"), F.col("total").alias("revenue_total")
        ),
    ).select(F.lit(project_id).alias("project_id"), "duplicate_rows", "revenue_column", "revenue_total")
