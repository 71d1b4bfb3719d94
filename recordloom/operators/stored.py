"""The stored JSON results of a project, parsed once into typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COUNTS = "cross_file_matches string, linked_entities string, unmatched_entities string"

# Single values are read as text, as answers and reports print them.
RESULTS = f"""
    entity_resolution_report struct<
        records_before_merge string, records_after_merge string, duplicates_merged string, conflicts_detected string,
        multi_file_stats struct<{_COUNTS}>>,
    multi_file_stats struct<{_COUNTS}>,
    trust_report struct<
        quality_score string, processing_time string, duplicates_merged string, conflicts_detected string,
        completeness_score string, consistency_score string, duplicate_score string, final_score string,
        score_breakdown struct<
            completeness_score string, consistency_score string, duplicate_score string, final_score string>>,
    relationship_graphs struct<nodes array<string>, edges array<string>>,
    mappings_applied array<string>,
    data_catalog array<string>,
    data_insights array<string>,
    insights array<string>,
    recommendations array<string>,
    records_processed string,
    processed_records string
"""


def parsed(projects: DataFrame, column: str = "_results") -> DataFrame:
    """Add the parsed results; null if the text is no JSON object."""
    return projects.withColumn(column, F.from_json("processing_results", RESULTS))


def is_object(item: Column) -> Column:
    """Whether an item of a list is an object; others are plain text."""
    return F.ltrim(item).startswith("{")


def items(listed: Column, *names: str) -> Column:
    """Items of a list as ``raw`` text and ``o``, the named fields of those that are objects; each is parsed once."""
    fields = ", ".join(f"{name} string" for name in names)
    return F.transform(listed, lambda x: F.struct(x.alias("raw"), F.when(is_object(x), F.from_json(x, fields)).alias("o")))


def field(item: Column, *names: str, default: str = "") -> Column:
    """The first of several fields that a parsed item has."""
    return F.coalesce(*[item["o"][name] for name in names], F.lit(default))


def resolution_count(field: str) -> Column:
    """A count of the resolution report, 0 if unknown; quicker than parsing everything for one or two of them."""
    text = F.get_json_object("processing_results", f"$.entity_resolution_report.{field}")
    return F.coalesce(text.try_cast("long"), F.lit(0))


def first_known(*paths: str, default: str | None = None, column: str = "_results") -> Column:
    """The first of several nested fields that is there."""
    cells = [F.col(f"{column}.{path}") for path in paths]
    return F.coalesce(*cells, *([F.lit(default)] if default is not None else []))
