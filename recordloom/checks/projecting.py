"""Project summaries, question intents and answers, alerts, report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import table
from recordloom.operators import alerts as alerting
from recordloom.operators import intents, projects, report
from recordloom.operators.schema_match import spread


def _projects(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as projects: one stored result per order, with what the order says."""
    score = F.floor(F.col("o_totalprice") / 5000).cast("int")
    records = F.floor(F.col("o_totalprice") / 100).cast("int")
    duplicates, conflicts = F.col("o_custkey"), F.length("o_orderpriority")
    results = F.to_json(
        F.struct(
            F.struct(
                (records + duplicates).alias("records_before_merge"),
                records.alias("records_after_merge"),
                duplicates.alias("duplicates_merged"),
                conflicts.alias("conflicts_detected"),
                F.struct(
                    records.alias("cross_file_matches"), records.alias("linked_entities"), duplicates.alias("unmatched_entities")
                ).alias("multi_file_stats"),
            ).alias("entity_resolution_report"),
            F.struct(
                score.alias("quality_score"),
                F.struct(
                    F.lit(100).alias("completeness_score"),
                    score.alias("consistency_score"),
                    F.lit(100).alias("duplicate_score"),
                    score.alias("final_score"),
                ).alias("score_breakdown"),
            ).alias("trust_report"),
            F.array(
                F.struct(
                    F.lit("prio").alias("original_column"),
                    F.col("o_orderpriority").alias("canonical_column"),
                    F.lit(0.75).alias("confidence_score"),
                    F.lit("Manual").alias("match_type"),
                )
            ).alias("mappings_applied"),
            F.array(
                F.struct(
                    F.col("o_orderstatus").alias("column_name"),
                    F.lit("object").alias("data_type"),
                    F.lit(12.5).alias("null_percentage"),
                    F.repeat(F.concat("o_orderpriority", F.lit(" ")), 8).alias("description"),
                )
            ).alias("data_catalog"),
            F.when(F.col("o_orderstatus") != "P", F.array(F.concat(F.lit("Order "), "o_orderkey"), "o_orderpriority"))
            .otherwise(F.array().cast("array<string>")).alias("data_insights"),
            F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Check"))).alias("recommendations"),
        )
    )
    # A registry has many files; the given orders are one, which one task would read.
    return spread(table(spark, folder, "orders")).select(
        F.col("o_orderkey").alias("project_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("Project "), "o_orderkey").alias("project_name"),
        records.alias("total_records"),
        score.alias("quality_score"),
        results.alias("processing_results"),
        F.col("o_orderdate").alias("created_at"),
    )


_PROJECTS = """
    SELECT o_orderkey AS project_id, o_custkey AS user_id, 'Project ' || o_orderkey AS project_name,
           CAST(floor(o_totalprice / 100) AS INTEGER) AS total_records,
           CAST(floor(o_totalprice / 5000) AS INTEGER) AS quality_score,
           o_custkey AS duplicates, length(o_orderpriority) AS conflicts, o_orderstatus AS status,
           o_orderpriority AS priority, o_orderdate AS created_at
    FROM orders
"""


def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    return projects.dashboard_stats(_projects(spark, folder))


def dashboard_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return projects.dashboard_kpis(_projects(spark, folder))


def kpi_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """Means that end in a half: each project twice, with scores one apart."""
    rows = _projects(spark, folder).withColumn("user_id", F.col("project_id"))
    again = rows.withColumns({"quality_score": F.col("quality_score") + 1, "total_records": F.lit(0).cast("int")})
    return projects.dashboard_kpis(rows.unionByName(again))


def recent_projects(spark: SparkSession, folder: str) -> DataFrame:
    return projects.recent_projects(_projects(spark, folder), 5).select("user_id", "project_id", "recency")


def history_list(spark: SparkSession, folder: str) -> DataFrame:
    return projects.history_list(_projects(spark, folder), 42).withColumn(
        "created_at", projects.shown_date(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    )


def score_badges(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("quality_score")
    return _projects(spark, folder).select(
        "project_id", projects.score_badge(score).alias("badge"), projects.score_badge(score, 90, 70).alias("panel_badge")
    )


_TEXTS = [("conversations", "text"), ("benchmark", "text"), ("documents", "text"), ("part", "p_name"), ("events", "event_type")]


def intent_label(spark: SparkSession, folder: str) -> DataFrame:
    asked = [table(spark, folder, t).select(F.lit(t).alias("origin"), F.col(c).alias("question")) for t, c in _TEXTS]
    offered = reduce(DataFrame.unionByName, asked)
    return offered.groupBy("origin", intents.intent(F.col("question")).alias("intent")).agg(F.count("*").alias("n"))


_SUGGESTED = [*intents.SUGGESTED_QUESTIONS, "Total sales", "How many unmatched records?", "Hello"]


def intent_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every suggested question on every project."""
    stored = _projects(spark, folder)
    asked = stored.select("project_id", F.explode(F.array(*[F.lit(q) for q in _SUGGESTED])).alias("question"))
    return intents.answers(asked, stored)


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return alerting.finished_jobs(_projects(spark, folder))


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    trigger = (
        F.when(segment == "BUILDING", alerting.QUALITY_BELOW_THRESHOLD)
        .when(segment == "MACHINERY", alerting.DUPLICATE_DETECTED)
        .otherwise(alerting.PROCESSING_COMPLETE)
    )
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("rule_id"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("rule_name"),
        trigger.alias("trigger_type"),
        F.concat(F.lit("https://hooks.example.com/"), "c_custkey").alias("webhook_url"),
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alerting.alerts(_jobs(spark, folder), _rules(spark, folder))


def alert_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return alerting.alert_conditions(_jobs(spark, folder)).select("project_id", "trigger_type")


def report_sections(spark: SparkSession, folder: str) -> DataFrame:
    return report.report_sections(_projects(spark, folder))


def report_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """Results stored under the older field names, with objects and plain text in one list."""
    p = _projects(spark, folder)
    order = table(spark, folder, "orders").select(F.col("o_orderkey").alias("project_id"), "o_custkey", "o_orderstatus", "o_orderpriority")
    p = p.join(order, "project_id")
    older = F.to_json(
        F.struct(
            (F.col("total_records") + 1).alias("processed_records"),
            F.struct(F.col("o_custkey").alias("duplicates_merged"), F.lit("3s").alias("processing_time")).alias("trust_report"),
            F.array(F.struct(F.lit("prio").alias("source"), F.col("o_orderpriority").alias("target"), F.lit(0.5).alias("confidence"))).alias("mappings_applied"),
            F.array(F.to_json(F.struct(F.col("o_orderstatus").alias("field"), F.lit("text").alias("type"))), F.col("o_orderpriority")).alias("data_catalog"),
            F.array(F.to_json(F.struct(F.concat(F.lit("Order "), F.col("project_id").cast("string")).alias("insight"))), F.col("o_orderpriority")).alias("insights"),
            F.array(F.struct(F.lit("Check").alias("recommendation"))).alias("recommendations"),
        )
    )
    return report.report_sections(p.withColumn("processing_results", older))


QUERIES = {
    "dashboard_stats": dashboard_stats,
    "dashboard_kpis": dashboard_kpis,
    "kpi_rounding": kpi_rounding,
    "recent_projects": recent_projects,
    "history_list": history_list,
    "score_badges": score_badges,
    "intent_label": intent_label,
    "intent_answers": intent_answers,
    "alerts": alerts,
    "alert_conditions": alert_conditions,
    "report_sections": report_sections,
    "report_fallbacks": report_fallbacks,
}


def _intent_sql(text: str) -> str:
    cases = []
    for name, words in intents.INTENT_WORDS.items():
        hits = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        cases.append(f"WHEN {hits} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'UNKNOWN' END"


_QUESTION_INTENTS = {
    "What are the key insights?": "INSIGHTS",
    "Summarize total revenue": "INSIGHTS",
    "Find duplicate customer records": "DUPLICATES",
    "Show quality issues": "QUALITY",
    "Show relationships": "RELATIONSHIP",
    "Which entities appear in multiple files?": "MULTI_FILE",
    "Total sales": "REVENUE",
    "How many unmatched records?": "DUPLICATES",
    "Hello": "UNKNOWN",
}
_ANSWERS = {
    "INSIGHTS": """
        CASE WHEN status = 'P' THEN 'No specific insights were generated for this dataset.' ELSE
        rtrim('**Key Insights (Quality Score: ' || quality_score || E'):**\\n- Order ' || project_id || E'\\n- ' || priority
        || E'\\n\\n**Recommendations:**' || CASE WHEN status = 'F' THEN E'\\n- Check' ELSE '' END) END
    """,
    "DUPLICATES": """
        E'**Duplicate Analysis:**\\n- Duplicates Merged: ' || duplicates || E'\\n- Duplicate Score: 100/100'
    """,
    "QUALITY": """
        E'**Data Quality Report:**\\n- Completeness Score: 100\\n- Consistency Score: ' || quality_score
        || E'\\n- Conflicts Detected: ' || conflicts
    """,
    "REVENUE": """
        'Revenue analysis requires the raw dataset to be loaded into memory. However, the data appears to be processed successfully.'
    """,
    "RELATIONSHIP": "'No relationship graphs were generated for this dataset.'",
    "MULTI_FILE": """
        E'**Multi-File Intelligence:**\\n- Linked Entities: ' || total_records || E'\\n- Unmatched Entities: ' || duplicates
        || E'\\n- Cross-file Matches: ' || total_records
    """,
    "UNKNOWN": """
        E'**Project Summary:**\\nThis dataset contains ' || total_records
        || ' total records. Processing achieved a Quality Score of ' || quality_score || '. During entity resolution, '
        || duplicates || ' duplicates were merged. '
        || 'Please ask me specific questions about insights, quality, or duplicates!'
    """,
}
_CONDITIONS = f"""
    SELECT *, unnest(list_filter(['processing_complete',
        CASE WHEN quality_score < 70 THEN 'quality_below_threshold' END,
        CASE WHEN duplicates > 0 THEN 'duplicate_detected' END], lambda t: t IS NOT NULL)) AS trigger_type
    FROM ({_PROJECTS})
"""


def _section(name: str, seq: int, key: str, value: str, detail: str = "''", note: str = "''", where: str = "true") -> str:
    return f"""SELECT project_id, '{name}' AS section, CAST({seq} AS INTEGER) AS seq, {key} AS key, {value} AS value,
        {detail} AS detail, {note} AS note FROM p WHERE {where}"""


_DESCRIPTION = "repeat(priority || ' ', 8)"

SQL = {
    "dashboard_stats": f"""
        SELECT user_id, count(*) AS total_projects, CAST(sum(total_records) AS BIGINT) AS total_records,
               CAST(round_even(avg(quality_score), 0) AS BIGINT) AS average_quality_score,
               first(project_name ORDER BY quality_score DESC, created_at DESC, project_id DESC) AS highest_quality_project,
               CAST(max(quality_score) AS BIGINT) AS highest_score,
               first(project_name ORDER BY quality_score, created_at DESC, project_id DESC) AS lowest_quality_project,
               CAST(min(quality_score) AS BIGINT) AS lowest_score,
               CAST(sum(duplicates) AS BIGINT) AS total_duplicates_merged,
               CAST(sum(conflicts) AS BIGINT) AS total_conflicts_detected
        FROM ({_PROJECTS}) GROUP BY user_id
    """,
    "dashboard_kpis": f"""
        SELECT user_id, CAST(sum(total_records) AS BIGINT) AS records_processed,
               CAST(printf('%.1f', avg(quality_score)) AS DOUBLE) AS average_score
        FROM ({_PROJECTS}) GROUP BY user_id
    """,
    "kpi_rounding": f"""
        SELECT project_id AS user_id, CAST(total_records AS BIGINT) AS records_processed,
               CAST(printf('%.1f', (quality_score + quality_score + 1) / 2.0) AS DOUBLE) AS average_score
        FROM ({_PROJECTS})
    """,
    "recent_projects": f"""
        SELECT user_id, project_id, CAST(r AS INTEGER) AS recency FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, project_id DESC) AS r
            FROM ({_PROJECTS})) WHERE r <= 5
    """,
    "history_list": f"""
        SELECT project_id, project_name, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at, total_records, quality_score
        FROM ({_PROJECTS}) WHERE user_id = 42
    """,
    "score_badges": f"""
        SELECT project_id,
               CASE WHEN quality_score >= 80 THEN 'success' WHEN quality_score >= 50 THEN 'warning' ELSE 'danger' END AS badge,
               CASE WHEN quality_score >= 90 THEN 'success' WHEN quality_score >= 70 THEN 'warning' ELSE 'danger' END AS panel_badge
        FROM ({_PROJECTS})
    """,
    "intent_label": f"""
        SELECT origin, {_intent_sql("question")} AS intent, count(*) AS n FROM (
            {" UNION ALL ".join(f"SELECT '{t}' AS origin, {c} AS question FROM {t}" for t, c in _TEXTS)}
        ) GROUP BY ALL
    """,
    "intent_answers": f"WITH p AS ({_PROJECTS}) " + " UNION ALL ".join(
        f"""SELECT project_id, '{q}' AS question, '{i}' AS intent, {_ANSWERS[i]} AS answer, CAST(100 AS INTEGER) AS confidence
            FROM p"""
        for q, i in _QUESTION_INTENTS.items()
    ),
    "alerts": f"""
        SELECT c_custkey AS rule_id, c_name AS rule_name, 'https://hooks.example.com/' || c_custkey AS webhook_url, user_id,
               trigger_type, project_id, project_name, quality_score, total_records AS records_processed
        FROM ({_CONDITIONS}) JOIN customer ON c_custkey = user_id
         AND trigger_type = CASE c_mktsegment WHEN 'BUILDING' THEN 'quality_below_threshold'
             WHEN 'MACHINERY' THEN 'duplicate_detected' ELSE 'processing_complete' END
    """,
    "alert_conditions": f"SELECT project_id, trigger_type FROM ({_CONDITIONS})",
    "report_fallbacks": f"WITH p AS ({_PROJECTS}) " + " UNION ALL ".join([
        _section("Cover", 1, "'Project Name'", "project_name"),
        _section("Cover", 2, "'Records Processed'", "CAST(total_records + 1 AS VARCHAR)"),
        _section("Cover", 3, "'Quality Score'", "CAST(quality_score AS VARCHAR) || '/100'"),
        _section("Executive Summary", 1, "'Total Records'", "CAST(total_records AS VARCHAR)"),
        _section("Executive Summary", 2, "'Records After Merge'", "CAST(total_records + 1 - duplicates AS VARCHAR)"),
        _section("Executive Summary", 3, "'Duplicates Merged'", "CAST(duplicates AS VARCHAR)"),
        _section("Executive Summary", 4, "'Conflicts Detected'", "'0'"),
        _section("Executive Summary", 5, "'Processing Time'", "'3s'"),
        _section("Trust Report", 1, "'Final Score'", "CAST(quality_score AS VARCHAR)"),
        _section("Trust Report", 2, "'Completeness Score'", "'N/A'"),
        _section("Trust Report", 3, "'Consistency Score'", "'N/A'"),
        _section("Trust Report", 4, "'Duplicate Score'", "'N/A'"),
        _section("Schema Intelligence", 1, "'prio'", "priority", "'0.5'"),
        _section("Data Catalog", 1, "status", "'text'", "'0%'"),
        _section("Data Catalog", 2, "priority", "''"),
        _section("Insights", 1, "'•'", "'Order ' || project_id"),
        _section("Insights", 2, "'•'", "priority"),
        _section("Recommendations", 1, "'•'", "'Check'"),
    ]),
    "report_sections": f"WITH p AS ({_PROJECTS}) " + " UNION ALL ".join([
        _section("Cover", 1, "'Project Name'", "project_name"),
        _section("Cover", 2, "'Records Processed'", "CAST(total_records AS VARCHAR)"),
        _section("Cover", 3, "'Quality Score'", "CAST(quality_score AS VARCHAR) || '/100'"),
        _section("Executive Summary", 1, "'Total Records'", "CAST(total_records AS VARCHAR)"),
        _section("Executive Summary", 2, "'Records After Merge'", "CAST(total_records AS VARCHAR)"),
        _section("Executive Summary", 3, "'Duplicates Merged'", "CAST(duplicates AS VARCHAR)"),
        _section("Executive Summary", 4, "'Conflicts Detected'", "CAST(conflicts AS VARCHAR)"),
        _section("Executive Summary", 5, "'Processing Time'", "'N/A'"),
        _section("Trust Report", 1, "'Final Score'", "CAST(quality_score AS VARCHAR)"),
        _section("Trust Report", 2, "'Completeness Score'", "'100'"),
        _section("Trust Report", 3, "'Consistency Score'", "CAST(quality_score AS VARCHAR)"),
        _section("Trust Report", 4, "'Duplicate Score'", "'100'"),
        _section("Schema Intelligence", 1, "'prio'", "priority", "'0.75'", "'Manual'"),
        _section("Data Catalog", 1, "status", "'object'", "'12.5'",
                 f"CASE WHEN length({_DESCRIPTION}) > 80 THEN left({_DESCRIPTION}, 80) || '...' ELSE {_DESCRIPTION} END"),
        _section("Insights", 1, "'•'", "'Order ' || project_id", where="status <> 'P'"),
        _section("Insights", 2, "'•'", "priority", where="status <> 'P'"),
        _section("Insights", 1, "'No insights available.'", "''", where="status = 'P'"),
        _section("Recommendations", 1, "'•'", "'Check'", where="status = 'F'"),
        _section("Recommendations", 1, "'No recommendations available.'", "''", where="status <> 'F'"),
    ]),
}
