"""Alert rows as a stream: new rows of the project registry raise alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.alerts import alerts, finished_jobs
from recordloom.sources.sinks import PROJECTS


def project_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows appended to the project registry at ``path``."""
    return spark.readStream.schema(PROJECTS).parquet(path)


def start_alert_feed(
    projects: DataFrame, rules: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the alerts of each new project to ``path``.

    No state is kept between batches: the conditions are row-local and the
    rules are a table, so the feed restarts from its checkpoint alone.
    """
    writer = alerts(finished_jobs(projects), rules).writeStream.outputMode("append").format("parquet")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
