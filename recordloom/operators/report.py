"""The tables of an export report, taken from stored project results."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.stored import field, first_known, is_object, items, parsed

DESCRIPTION_LENGTH = 80

# Section titles, row labels and the sentences for empty sections.
SECTIONS = ("Cover", "Executive Summary", "Trust Report", "Schema Intelligence", "Data Catalog", "Insights", "Recommendations")
COVER_ROWS = ("Project Name", "Records Processed", "Quality Score")
SUMMARY_ROWS = ("Total Records", "Records After Merge", "Duplicates Merged", "Conflicts Detected", "Processing Time")
SCORE_ROWS = ("Final Score", "Completeness Score", "Consistency Score", "Duplicate Score")
EMPTY_SECTIONS = (
    "No mappings applied.",
    "No data catalog available.",
    "No insights available.",
    "No recommendations available.",
)


def _row(key: Column | str, value: Column | str, detail: Column | str = "", note: Column | str = "") -> Column:
    cells = [c if isinstance(c, Column) else F.lit(c) for c in (key, value, detail, note)]
    return F.struct(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, ("key", "value", "detail", "note"))])


def cut_description(text: Column) -> Column:
    return F.when(
        F.length(text) > DESCRIPTION_LENGTH, F.concat(F.substring(text, 1, DESCRIPTION_LENGTH), F.lit("..."))
    ).otherwise(text)


def report_sections(projects: DataFrame) -> DataFrame:
    """``(project_id, section, seq, key, value, detail, note)`` for every stored project.

    Everything is row-local, so the report of any number of projects is one
    scan. Empty lists give the sentence the report shows instead.
    """
    merged = first_known("entity_resolution_report.duplicates_merged", "trust_report.duplicates_merged", default="0")
    found = first_known("entity_resolution_report.conflicts_detected", "trust_report.conflicts_detected", default="0")
    processed = F.coalesce(first_known("records_processed", "processed_records"), F.col("total_records").cast("string"))
    before = first_known("entity_resolution_report.records_before_merge", "records_processed", "processed_records")
    after = F.coalesce(
        first_known("entity_resolution_report.records_after_merge"),
        (before.try_cast("long") - merged.try_cast("long")).cast("string"),
        F.col("total_records").cast("string"),
    )

    def part(name: str) -> Column:
        return first_known(f"trust_report.score_breakdown.{name}", default="N/A")

    final = F.coalesce(
        first_known("trust_report.score_breakdown.final_score", "trust_report.quality_score"),
        F.col("quality_score").cast("string"),
    )
    values = (
        F.col("total_records").cast("string"), after, merged, found,
        first_known("trust_report.processing_time", default="N/A"),
    )
    score = F.concat(F.col("quality_score").cast("string"), F.lit("/100"))
    cover = F.array(*[_row(label, value) for label, value in zip(COVER_ROWS, (F.col("project_name"), processed, score))])
    executive = F.array(*[_row(label, value) for label, value in zip(SUMMARY_ROWS, values)])
    scores = (final, part("completeness_score"), part("consistency_score"), part("duplicate_score"))
    trust = F.array(*[_row(label, value) for label, value in zip(SCORE_ROWS, scores)])
    mapped = ("original_column", "source", "canonical_column", "target", "confidence_score", "confidence", "match_type")
    mapping = F.transform(
        items(F.filter(first_known("mappings_applied"), is_object), *mapped),
        lambda m: _row(
            field(m, "original_column", "source"), field(m, "canonical_column", "target"),
            field(m, "confidence_score", "confidence"), field(m, "match_type"),
        ),
    )
    described = ("column_name", "field", "name", "data_type", "type", "null_percentage", "missing_percentage", "description")
    catalog = F.transform(
        items(first_known("data_catalog"), *described),
        lambda c: F.when(
            c["o"].isNotNull(),
            _row(
                field(c, "column_name", "field", "name"), field(c, "data_type", "type"),
                field(c, "null_percentage", "missing_percentage", default="0%"), cut_description(field(c, "description")),
            ),
        ).otherwise(_row(c["raw"], "")),
    )

    def lines(name: str, *paths: str) -> Column:
        return F.transform(
            first_known(*paths), lambda s: _row("•", F.when(is_object(s), F.coalesce(F.get_json_object(s, f"$.{name}"), s)).otherwise(s))
        )

    listed = [mapping, catalog, lines("insight", "data_insights", "insights"), lines("recommendation", "recommendations")]
    filled = [
        F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, rows).otherwise(F.array(_row(sentence, "")))
        for rows, sentence in zip(listed, EMPTY_SECTIONS)
    ]
    tables = F.array(
        *[
            F.struct(F.lit(title).alias("section"), rows.alias("rows"))
            for title, rows in zip(SECTIONS, [cover, executive, trust, *filled])
        ]
    )
    return (
        parsed(projects)
        .select("project_id", F.explode(tables).alias("t"))
        .select("project_id", "t.section", F.posexplode("t.rows").alias("seq", "row"))
        .select("project_id", "section", (F.col("seq") + 1).alias("seq"), "row.*")
    )
