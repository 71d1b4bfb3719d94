"""Write records and append to the stored registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.cells import col, type_of
from recordloom.functions.rows import ORD
from pyspark.sql import types as T

# Layouts of the stored tables.
PROJECTS = (
    "project_id string, user_id string, project_name string, total_records int, quality_score int, "
    "processing_results string, created_at timestamp"
)
JOBS = (
    "id string, user_id string, created_at timestamp, total_records int, quality_score int, "
    "json_file_url string, pdf_file_url string, status string"
)
TEMPLATES = (
    "template_id string, user_id string, template_name string, mapping map<string,string>, created_at timestamp"
)
RULES = "rule_id string, user_id string, rule_name string, trigger_type string, webhook_url string"


def _public(df: DataFrame) -> DataFrame:
    return df.drop(ORD, "_first", "entity_no")


def write_json(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One sparse object per line: a field without a value is left out."""
    _public(records).write.mode(mode).option("ignoreNullFields", True).json(path)


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header row, no index; lists and structs as JSON text."""
    out = _public(records)
    nested = [n for n in out.columns if isinstance(type_of(out, n), (T.ArrayType, T.MapType, T.StructType))]
    out = out.withColumns({n: F.to_json(col(n)) for n in nested}) if nested else out
    writer = out.write.mode(mode).option("header", True).option("escape", '"')
    # Spaces at the ends of a cell belong to it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_rows(rows: DataFrame, path: str, layout: str) -> None:
    """Append result rows to a registry, brought into its layout."""
    schema = rows.sparkSession.createDataFrame([], layout).schema
    cells = [
        (col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    rows.select(*cells).write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return spark.read.schema(layout).parquet(path)
