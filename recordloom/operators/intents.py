"""Answer the canned questions about a project from its stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import fill, float_sql, strip
from recordloom.operators.stored import first_known, parsed

UNKNOWN_VALUE = "N/A"

# Words that tell an intent, in the order in which intents are tried.
INTENT_WORDS = {
    "INSIGHTS": ("insight", "discover", "summarize", "summary", "overview", "recommendation"),
    "DUPLICATES": ("duplicate", "copy", "match"),
    "QUALITY": ("quality", "issue", "problem", "missing", "null"),
    "REVENUE": ("revenue", "sales", "amount", "total"),
    "RELATIONSHIP": ("relationship", "connect", "link"),
    "MULTI_FILE": ("multiple", "cross", "file", "unmatched", "unified"),
}

# Questions offered to the user.
SUGGESTED_QUESTIONS = (
    "What are the key insights?",
    "Summarize total revenue",
    "Find duplicate customer records",
    "Show quality issues",
    "Show relationships",
    "Which entities appear in multiple files?",
)


# The wording of the answers.
INSIGHTS = "**Key Insights (Quality Score: {}):**\n{}\n**Recommendations:**\n{}"
NO_INSIGHTS = "No specific insights were generated for this dataset."
DUPLICATES = "**Duplicate Analysis:**\n- Duplicates Merged: {}\n- Duplicate Score: {}/100\n"
DUPLICATE_ROWS = "\nFound {} duplicate rows in raw data."
QUALITY = "**Data Quality Report:**\n- Completeness Score: {}\n- Consistency Score: {}\n- Conflicts Detected: {}"
REVENUE = "**Revenue Summary:**\n- Total {}: {}"
NO_REVENUE_COLUMN = "Could not find a clear revenue column in the dataset."
NO_RAW_DATA = (
    "Revenue analysis requires the raw dataset to be loaded into memory. "
    "However, the data appears to be processed successfully."
)
RELATIONSHIP = "**Relationship Intelligence:**\nFound {} connected entities and {} relationships."
NO_RELATIONSHIP = "No relationship graphs were generated for this dataset."
MULTI_FILE = (
    "**Multi-File Intelligence:**\n- Linked Entities: {}\n- Unmatched Entities: {}\n- Cross-file Matches: {}"
)
NO_MULTI_FILE = "No multi-file intelligence statistics were found. This may be a single file upload."
SUMMARY = (
    "**Project Summary:**\nThis dataset contains {} total records. Processing achieved a Quality Score of {}. "
    "During entity resolution, {} duplicates were merged. "
    "Please ask me specific questions about insights, quality, or duplicates!"
)
NOT_FOUND = "Data not found. Project may have expired or does not exist."


def intent(question: Column) -> Column:
    """The first intent of which a word occurs anywhere in the question."""
    lowered = F.lower(question)
    label = F
    for name, words in INTENT_WORDS.items():
        label = label.when(reduce(lambda a, b: a | b, [lowered.contains(word) for word in words]), name)
    return label.otherwise("UNKNOWN")


def _bullets(path: str) -> Column:
    lines = F.transform(first_known(path), lambda s: F.concat(F.lit("- "), s, F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def answer_parts(projects: DataFrame) -> DataFrame:
    """Per project the pieces that answers are made of; the stored JSON is parsed here, once."""

    def score(name: str) -> Column:
        return first_known(f"trust_report.score_breakdown.{name}", f"trust_report.{name}", default=UNKNOWN_VALUE)

    def stat(name: str) -> Column:
        return F.when(
            first_known("entity_resolution_report.multi_file_stats", "multi_file_stats").isNotNull(),
            first_known(f"entity_resolution_report.multi_file_stats.{name}", f"multi_file_stats.{name}", default="0"),
        )

    return parsed(projects).select(
        "project_id",
        F.coalesce(F.col("total_records").cast("string"), F.lit(UNKNOWN_VALUE)).alias("_total"),
        F.coalesce(
            F.col("quality_score").cast("string"),
            first_known("trust_report.score_breakdown.final_score", "trust_report.final_score", default=UNKNOWN_VALUE),
        ).alias("_score"),
        first_known(
            "trust_report.duplicates_merged", "entity_resolution_report.duplicates_merged", default="0"
        ).alias("_merged"),
        first_known(
            "trust_report.conflicts_detected", "entity_resolution_report.conflicts_detected", default="0"
        ).alias("_conflicts"),
        score("completeness_score").alias("_completeness"),
        score("consistency_score").alias("_consistency"),
        score("duplicate_score").alias("_duplicate_score"),
        _bullets("data_insights").alias("_insights"),
        _bullets("recommendations").alias("_advice"),
        F.coalesce(F.size(first_known("relationship_graphs.nodes")), F.lit(0)).alias("_nodes"),
        F.coalesce(F.size(first_known("relationship_graphs.edges")), F.lit(0)).alias("_edges"),
        stat("linked_entities").alias("_linked"),
        stat("unmatched_entities").alias("_unmatched"),
        stat("cross_file_matches").alias("_matches"),
        F.col("_results").isNotNull().alias("_stored"),
    )


def answers(questions: DataFrame, projects: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``(project_id, question, intent, answer, confidence)`` for ``(project_id, question)``.

    ``facts`` has what the raw rows of a project give: ``project_id,
    duplicate_rows, revenue_column, revenue_total``. Questions on unknown
    projects are answered too, as not found.
    """
    rows = questions.withColumn("intent", intent(F.col("question"))).join(answer_parts(projects), "project_id", "left")
    if facts is not None:
        rows = rows.join(facts, "project_id", "left")
    else:
        rows = rows.withColumns(
            {
                "duplicate_rows": F.lit(None).cast("long"),
                "revenue_column": F.lit(None).cast("string"),
                "revenue_total": F.lit(None).cast("double"),
            }
        )
    has_facts = F.col("duplicate_rows").isNotNull()

    insights = F.when((F.col("_insights") == "") & (F.col("_advice") == ""), NO_INSIGHTS).otherwise(
        fill(INSIGHTS, F.col("_score"), F.col("_insights"), F.col("_advice"))
    )
    raw = F.when(F.col("duplicate_rows") > 0, fill(DUPLICATE_ROWS, F.col("duplicate_rows"))).otherwise("")
    duplicates = F.concat(fill(DUPLICATES, F.col("_merged"), F.col("_duplicate_score")), raw)
    quality = fill(QUALITY, F.col("_completeness"), F.col("_consistency"), F.col("_conflicts"))
    total = fill(REVENUE, F.col("revenue_column"), F.expr(float_sql("revenue_total")))
    revenue = F.when(F.col("revenue_column").isNotNull(), total).when(has_facts, NO_REVENUE_COLUMN).otherwise(NO_RAW_DATA)
    relationship = F.when(F.col("_nodes") > 0, fill(RELATIONSHIP, F.col("_nodes"), F.col("_edges"))).otherwise(
        NO_RELATIONSHIP
    )
    multi_file = F.when(
        F.col("_linked").isNotNull(), fill(MULTI_FILE, F.col("_linked"), F.col("_unmatched"), F.col("_matches"))
    ).otherwise(NO_MULTI_FILE)
    summary = fill(SUMMARY, F.col("_total"), F.col("_score"), F.col("_merged"))
    by_intent = (
        F.when(~F.coalesce("_stored", F.lit(False)) & ~has_facts, NOT_FOUND)
        .when(F.col("intent") == "INSIGHTS", insights)
        .when(F.col("intent") == "DUPLICATES", duplicates)
        .when(F.col("intent") == "QUALITY", quality)
        .when(F.col("intent") == "REVENUE", revenue)
        .when(F.col("intent") == "RELATIONSHIP", relationship)
        .when(F.col("intent") == "MULTI_FILE", multi_file)
        .otherwise(summary)
    )
    return rows.select(
        "project_id", "question", "intent", strip(by_intent).alias("answer"), F.lit(100).alias("confidence")
    )
