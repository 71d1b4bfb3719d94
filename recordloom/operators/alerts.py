"""Alert rows of finished jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.stored import resolution_count

# The trigger types a rule can name.
PROCESSING_COMPLETE = "processing_complete"
QUALITY_BELOW_THRESHOLD = "quality_below_threshold"
DUPLICATE_DETECTED = "duplicate_detected"
QUALITY_THRESHOLD = 70


def finished_jobs(projects: DataFrame) -> DataFrame:
    """What the alert conditions need of stored project rows."""
    return projects.select(
        "project_id",
        "project_name",
        "user_id",
        "quality_score",
        F.col("total_records").alias("records_processed"),
        resolution_count("duplicates_merged").alias("duplicates_merged"),
    )


def alert_conditions(jobs: DataFrame) -> DataFrame:
    """One row per job and trigger type that applies to it."""
    triggers = F.array(
        F.lit(PROCESSING_COMPLETE),
        F.when(F.col("quality_score") < QUALITY_THRESHOLD, QUALITY_BELOW_THRESHOLD),
        F.when(F.col("duplicates_merged") > 0, DUPLICATE_DETECTED),
    )
    return jobs.withColumn("trigger_type", F.explode(F.filter(triggers, lambda t: t.isNotNull())))


def alerts(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert rows: jobs joined with the rules of their user for a trigger type.

    ``jobs`` may be a stream: the conditions keep no state and the rules are
    joined as a table.
    """
    wanted = rules.select("user_id", "trigger_type", "rule_id", "rule_name", "webhook_url")
    return (
        alert_conditions(jobs)
        .join(wanted, ["user_id", "trigger_type"])
        .select(
            "rule_id",
            "rule_name",
            "webhook_url",
            "user_id",
            "trigger_type",
            "project_id",
            "project_name",
            "quality_score",
            "records_processed",
        )
    )
