"""The whole flow on the small upload, the alert feed, and what the library must not do."""

import ast
import json
import pathlib

import pytest

from recordloom.durable import shared_folder
from recordloom.operators import intents, report
from recordloom.plans.convert import convert, project_row, question_facts
from recordloom.sources import readers, sinks
from recordloom.streaming.alert_feed import project_stream, start_alert_feed

ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def upload(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("upload")
    (folder / "data1.csv").write_text("id,name,revenue\n1,Alice,100\n2,Bob,200\n")
    (folder / "data2.json").write_text(
        '[{"id": 1, "name": "Alice", "revenue": 100}, {"id": 2, "name": "Bob", "revenue": 200}]'
    )
    return {name: readers.read_table(spark, str(folder / name)) for name in ("data1.csv", "data2.json")}


@pytest.fixture(scope="module")
def converted(spark, upload):
    return convert(spark, upload)


def test_two_small_files(converted):
    assert [(r[1], r[2]) for r in converted.mappings.collect()] == [("name", "customer_name"), ("revenue", "revenue")]
    assert converted.report.first().asDict() == {
        "records_before_merge": 2, "records_after_merge": 2, "duplicates_merged": 0, "conflicts_detected": 0,
    }
    assert converted.stats.first()["linked_entities"] == 2
    assert converted.trust.first()["quality_score"] == 100
    records = converted.public_records().orderBy("entity_id").collect()
    assert [tuple(r) for r in records] == [("ENT0001", 1, "Alice", 100), ("ENT0002", 2, "Bob", 200)]
    assert [r["insight"] for r in converted.insights.orderBy("seq").collect()] == [
        "✓ 2 unique records identified",
        "✓ 0 duplicate records merged",
        "✓ Missing values detected: 0",
        "✓ Number of linked entities: 2",
        "✓ Number of cross-file relationships: 2",
        "✓ Revenue column available",
        "✓ Average revenue: ₹150.00",
    ]
    tree = converted.tree.orderBy("entity_id").first()
    assert (tree["name"], [c["name"] for c in tree["children"]]) == ("Alice", ["Id: 1", "Revenue: 100"])


def test_manual_mapping(spark, upload):
    result = convert(spark, upload, mapping={"id": "customer_id", "name": "ignore"})
    assert result.records.drop("_first").columns == ["entity_id", "entity_no", "customer_id", "name", "revenue"]
    assert [tuple(r)[1:] for r in result.mappings.collect()] == [("id", "customer_id", 100.0, "Manual")]


def test_too_few_tables(spark, upload):
    with pytest.raises(ValueError):
        convert(spark, upload, least=3)


def test_stored_project_answers_questions(spark, converted):
    row = project_row(converted, "p1", "u1", "Project - data1.csv")
    stored = json.loads(row.first()["processing_results"])
    assert stored["entity_resolution_report"]["multi_file_stats"]["linked_entities"] == 2
    assert [c["column_name"] for c in stored["data_catalog"]] == ["id", "customer_name", "revenue"]
    asked = spark.createDataFrame([("p1", "Total sales")], "project_id string, question string")
    answer = intents.answers(asked, row, question_facts("p1", converted.records)).first()["answer"]
    assert answer == "**Revenue Summary:**\n- Total revenue: 300.0"
    assert report.report_sections(row).filter("section = 'Data Catalog'").count() == 3


def test_alert_feed_picks_up_each_project_once(spark, converted, tmp_path):
    registry, out, checkpoint = (str(tmp_path / n) for n in ("projects", "alerts", "checkpoint"))
    rules = spark.createDataFrame([("r1", "u1", "done", "processing_complete", "http://a")], sinks.RULES)
    for number in (1, 2):
        sinks.append_rows(project_row(converted, f"p{number}", "u1", "P"), registry, sinks.PROJECTS)
        feed = start_alert_feed(project_stream(spark, registry), rules, out, checkpoint, available_now=True)
        feed.awaitTermination(120)
        assert sorted(r["project_id"] for r in spark.read.parquet(out).collect()) == [f"p{i + 1}" for i in range(number)]


def test_the_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named


def test_no_cross_joins_local_checkpoints_or_rdds():
    banned = {"crossJoin", "localCheckpoint", "toPandas", "rdd", "toLocalIterator", "udf", "applyInPandas"}
    for path in (p for p in (ROOT / "recordloom").rglob("*.py") if "llm" not in p.parts):
        used = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert not used & banned, path
