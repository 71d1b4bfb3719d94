"""Summaries and listings of stored projects.

A project row holds ``project_id, user_id, project_name, total_records,
quality_score, processing_results`` (JSON text) and ``created_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.stored import resolution_count


def _known(projects: DataFrame) -> DataFrame:
    return projects.withColumns(
        {
            "_name": F.coalesce("project_name", F.lit("Unknown")),
            "_records": F.coalesce(F.col("total_records").cast("long"), F.lit(0)),
            "_score": F.coalesce(F.col("quality_score").cast("long"), F.lit(0)),
            "_duplicates": resolution_count("duplicates_merged"),
            "_conflicts": resolution_count("conflicts_detected"),
        }
    )


def dashboard_stats(projects: DataFrame) -> DataFrame:
    """Per user: totals, average score, best and worst project.

    Among equal scores the newest project counts. All aggregates combine before
    the shuffle.
    """
    newest = F.col("created_at")
    name = F.struct(F.col("_name").alias("name"), F.col("_score").alias("score"))
    best = F.max_by(name, F.struct("_score", newest.alias("at"), "project_id"))
    worst = F.max_by(name, F.struct((-F.col("_score")).alias("s"), newest.alias("at"), "project_id"))
    return (
        _known(projects)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total_projects"),
            F.sum("_records").alias("total_records"),
            F.rint(F.sum("_score") / F.count("*")).cast("long").alias("average_quality_score"),
            best.alias("best"),
            worst.alias("worst"),
            F.sum("_duplicates").alias("total_duplicates_merged"),
            F.sum("_conflicts").alias("total_conflicts_detected"),
        )
        .select(
            "user_id",
            "total_projects",
            "total_records",
            "average_quality_score",
            F.col("best.name").alias("highest_quality_project"),
            F.col("best.score").alias("highest_score"),
            F.col("worst.name").alias("lowest_quality_project"),
            F.col("worst.score").alias("lowest_score"),
            "total_duplicates_merged",
            "total_conflicts_detected",
        )
    )


def dashboard_kpis(projects: DataFrame) -> DataFrame:
    """Per user: records processed and the mean score to one decimal."""
    return (
        _known(projects)
        .groupBy("user_id")
        .agg(
            F.sum("_records").alias("records_processed"),
            # Rounded on the exact value of the mean, ties to even.
            F.regexp_replace(F.format_number(F.sum("_score") / F.count("*"), 1), ",", "").cast("double").alias("average_score"),
        )
    )


def recent_projects(projects: DataFrame, n: int = 10) -> DataFrame:
    """Per user the ``n`` newest projects, ranked.

    Spark limits each task to ``n`` rows per user before the shuffle.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("project_id"))
    return projects.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def history_list(projects: DataFrame, user_id: object | None = None) -> DataFrame:
    """Projects, newest first, without their results."""
    if user_id is not None:
        projects = projects.filter(F.col("user_id") == F.lit(user_id))
    return projects.select(
        "project_id", "project_name", "created_at", "total_records", "quality_score"
    ).orderBy(F.desc("created_at"), F.desc("project_id"))


def score_badge(score: Column, success: int = 80, warning: int = 50) -> Column:
    """Badge of a quality score; the results panel uses 90 and 70."""
    return F.when(score >= success, "success").when(score >= warning, "warning").otherwise("danger")


def shown_date(created_at: Column) -> Column:
    """Date and minutes of a timestamp text."""
    return F.coalesce(F.substring(created_at, 1, 16), F.lit("-"))
