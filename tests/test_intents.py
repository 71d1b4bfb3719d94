"""Question intents, answers and the report of a stored project."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recordloom.operators import alerts, intents, report
from recordloom.sources.sinks import PROJECTS

INTENTS = [
    ("What are the key insights?", "INSIGHTS"),
    ("Summarize total revenue", "INSIGHTS"),
    ("Find duplicate customer records", "DUPLICATES"),
    ("How many unmatched records?", "DUPLICATES"),
    ("Show quality issues", "QUALITY"),
    ("Total sales", "REVENUE"),
    ("Show relationships", "RELATIONSHIP"),
    ("Which entities appear in multiple files?", "MULTI_FILE"),
    ("Hello", "UNKNOWN"),
]


def test_intents(spark):
    df = spark.createDataFrame(INTENTS, "q string, wanted string").select("wanted", intents.intent(F.col("q")).alias("got"))
    assert all(r["wanted"] == r["got"] for r in df.collect())


RESULTS = {
    "entity_resolution_report": {
        "records_before_merge": 12, "records_after_merge": 10, "duplicates_merged": 2, "conflicts_detected": 1,
        "multi_file_stats": {"cross_file_matches": 3, "linked_entities": 3, "unmatched_entities": 7},
    },
    "relationship_graphs": {"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a"}]},
    "trust_report": {"score_breakdown": {"completeness_score": 97, "consistency_score": 98, "duplicate_score": 100, "final_score": 95}},
    "data_insights": ["one", "two"],
    "recommendations": ["do it"],
    "data_catalog": [{"column_name": "c", "data_type": "object", "null_percentage": 1.5, "description": "d" * 81}],
}


@pytest.fixture(scope="module")
def projects(spark):
    made = datetime(2024, 5, 1)
    rows = [
        ("p1", "u", "Full", 10, 95, json.dumps(RESULTS), made),
        ("p2", "u", "Empty", 0, None, "{}", made),
        ("p3", "u", "Broken", 5, 60, "no json", made),
    ]
    return spark.createDataFrame(rows, PROJECTS)


def ask(spark, projects, project, question, facts=None):
    questions = spark.createDataFrame([(project, question)], "project_id string, question string")
    return intents.answers(questions, projects, facts).first()["answer"]


def test_answers_from_stored_results(spark, projects):
    assert ask(spark, projects, "p1", "insights") == (
        "**Key Insights (Quality Score: 95):**\n- one\n- two\n\n**Recommendations:**\n- do it"
    )
    assert ask(spark, projects, "p1", "quality") == (
        "**Data Quality Report:**\n- Completeness Score: 97\n- Consistency Score: 98\n- Conflicts Detected: 1"
    )
    assert ask(spark, projects, "p1", "links") == (
        "**Relationship Intelligence:**\nFound 2 connected entities and 1 relationships."
    )
    assert ask(spark, projects, "p1", "cross") == (
        "**Multi-File Intelligence:**\n- Linked Entities: 3\n- Unmatched Entities: 7\n- Cross-file Matches: 3"
    )


def test_answers_with_raw_rows(spark, projects):
    layout = "project_id string, duplicate_rows long, revenue_column string, revenue_total double"
    facts = spark.createDataFrame([("p1", 4, "revenue", 12345678.5), ("p2", 0, None, None)], layout)
    assert ask(spark, projects, "p1", "Total sales", facts) == "**Revenue Summary:**\n- Total revenue: 12345678.5"
    assert ask(spark, projects, "p1", "duplicates", facts) == (
        "**Duplicate Analysis:**\n- Duplicates Merged: 2\n- Duplicate Score: 100/100\n\nFound 4 duplicate rows in raw data."
    )
    assert ask(spark, projects, "p2", "Total sales", facts) == "Could not find a clear revenue column in the dataset."


def test_answers_where_little_is_stored(spark, projects):
    assert ask(spark, projects, "p2", "insights") == "No specific insights were generated for this dataset."
    assert ask(spark, projects, "p2", "duplicates") == (
        "**Duplicate Analysis:**\n- Duplicates Merged: 0\n- Duplicate Score: N/A/100"
    )
    assert ask(spark, projects, "p2", "hello").startswith(
        "**Project Summary:**\nThis dataset contains 0 total records. Processing achieved a Quality Score of N/A. During"
    )
    assert ask(spark, projects, "p9", "hello").startswith("Data not found.")


def test_report_tables(projects):
    rows = report.report_sections(projects.filter("project_id = 'p1'")).collect()
    tables = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        tables.setdefault(r["section"], []).append((r["key"], r["value"], r["detail"], r["note"]))
    assert tables["Executive Summary"][1] == ("Records After Merge", "10", "", "")
    assert tables["Trust Report"][0] == ("Final Score", "95", "", "")
    assert tables["Schema Intelligence"] == [("No mappings applied.", "", "", "")]
    assert tables["Data Catalog"] == [("c", "object", "1.5", "d" * 80 + "...")]
    assert tables["Insights"] == [("•", "one", "", ""), ("•", "two", "", "")]


def test_alerts(spark, projects):
    rules = spark.createDataFrame(
        [("r1", "u", "all", "processing_complete", "http://a"), ("r2", "u", "low", "quality_below_threshold", "http://b"),
         ("r3", "u", "dup", "duplicate_detected", "http://c"), ("r4", "v", "other", "processing_complete", "http://d")],
        "rule_id string, user_id string, rule_name string, trigger_type string, webhook_url string",
    )
    got = {(r["project_id"], r["rule_id"]) for r in alerts.alerts(alerts.finished_jobs(projects), rules).collect()}
    assert got == {("p1", "r1"), ("p2", "r1"), ("p3", "r1"), ("p3", "r2"), ("p1", "r3")}
