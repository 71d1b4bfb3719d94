"""Missing values, quality scores and the trust report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import blank_sql, quoted, type_of
from recordloom.functions.rows import ORD, side_by_side


def missing_fields(df: DataFrame, cells: str = "present") -> DataFrame:
    """One row: total fields and missing values.

    A resolved record holds only the values it has, so among its ``"present"``
    cells none is missing. ``"all"`` counts every cell of the table.
    """
    if cells not in ("present", "all"):
        raise ValueError("cells must be 'present' or 'all'")
    names = [n for n in df.columns if n not in (ORD, "entity_id", "entity_no")]
    blanks = " + ".join(f"int{blank_sql(quoted(n), type_of(df, n))}" for n in names) or "0"
    per_row = df.selectExpr(f"{blanks} AS blanks")
    total, missing = F.count("*") * len(names), F.coalesce(F.sum("blanks"), F.lit(0))
    if cells == "present":
        return per_row.agg((total - missing).alias("total_fields"), F.lit(0).cast("long").alias("missing_values"))
    return per_row.agg(total.alias("total_fields"), missing.alias("missing_values"))


def missing_percentage(missing: Column, total: Column) -> Column:
    return missing / F.greatest(F.lit(1), total) * 100


def conflict_penalty(conflicts: Column) -> Column:
    return F.least(F.lit(20), conflicts * 2)


def _score(points: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), points.cast("double"))).cast("long")


def quality_scores(df: DataFrame) -> DataFrame:
    """Add the four scores to rows with ``missing_values, total_fields, conflicts_detected``."""
    missing = missing_percentage(F.col("missing_values"), F.col("total_fields"))
    conflict = conflict_penalty(F.col("conflicts_detected"))
    return df.withColumns(
        {
            "completeness_score": _score(100 - missing),
            "consistency_score": _score(100 - conflict),
            "duplicate_score": F.lit(100).cast("long"),
            "final_score": _score(100 - missing - conflict),
        }
    )


def trust_report(records: DataFrame, report: DataFrame, cells: str = "present") -> DataFrame:
    """One row: scores, missing values, duplicates and conflicts."""
    facts = side_by_side(missing_fields(records, cells), report.select("duplicates_merged", "conflicts_detected"))
    return quality_scores(facts).select(
        F.col("final_score").alias("quality_score"),
        "completeness_score",
        "consistency_score",
        "duplicate_score",
        "final_score",
        "total_fields",
        "missing_values",
        "duplicates_merged",
        "conflicts_detected",
    )
