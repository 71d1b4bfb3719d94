"""Readers, sinks and flattening on small files."""

import json

import pytest

from recordloom.sources import readers, sinks
from recordloom.sources.flatten import normalise


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_csv(spark, tmp_path):
    path = write(tmp_path / "data.CSV", 'id,name,revenue\n1,"Al, ""x""",100\n2,Bob,200.5\n')
    assert rows(readers.read_table(spark, path)) == [
        {"id": 1, "name": 'Al, "x"', "revenue": 100.0}, {"id": 2, "name": "Bob", "revenue": 200.5},
    ]


def test_json_array(spark, tmp_path):
    path = write(tmp_path / "test.json", '[{"A": 1, "B": 3}, {"A": 2, "B": 4}]')
    assert rows(readers.read_table(spark, path)) == [{"A": 1, "B": 3}, {"A": 2, "B": 4}]


def test_json_object_gives_its_first_list_in_document_order(spark, tmp_path):
    text = {"z": 1, "people": [{"n": {"a": 1, "b": [1, 2]}}, {"n": {"a": 2}}], "aged": [{"q": 1}]}
    got = rows(readers.read_json(spark, write(tmp_path / "o.json", json.dumps(text))))
    assert got == [{"n.a": 1, "n.b": [1, 2]}, {"n.a": 2, "n.b": None}]


def test_json_object_without_list_is_one_row(spark, tmp_path):
    got = rows(readers.read_json(spark, write(tmp_path / "o.json", '{"a": {"b": {"c": 5}}, "d": "x"}')))
    assert got == [{"a.b.c": 5, "d": "x"}]


def test_json_array_of_records_with_lists_is_not_taken_apart(spark, tmp_path):
    got = rows(readers.read_json(spark, write(tmp_path / "o.json", '[{"a": [1, 2]}, {"a": [3]}]')))
    assert got == [{"a": [1, 2]}, {"a": [3]}]


def test_xml(spark, tmp_path):
    text = '<all><row no="1"><name>Al</name><place kind="city">Pune</place></row><row no="2"><name>Bo</name></row></all>'
    got = rows(readers.read_table(spark, write(tmp_path / "d.xml", text), row_tag="row"))
    assert got == [
        {"@no": "1", "name": "Al", "place.#text": "Pune", "place.@kind": "city"},
        {"@no": "2", "name": "Bo", "place.#text": None, "place.@kind": None},
    ]


def test_xml_finds_its_row_element(spark, tmp_path):
    text = '<!-- <x/><x/> --><all kind="a>b"><head><made>now</made></head><rows><row no="1"><tag>a</tag><tag>b</tag></row><row no="2"/></rows></all>'
    path = write(tmp_path / "d.xml", text)
    assert readers.row_element(spark, path) == "row"
    assert readers.row_element(spark, write(tmp_path / "one.xml", "<one><a/><b>c</b></one>")) == "one"
    got = readers.read_table(spark, path)
    assert [r["@no"] for r in got.collect()] == ["1", "2"]


def test_csv_markers_dates_and_repeated_names(spark, tmp_path):
    text = (
        "id,phone,phone,born,flag,amount,count,long,mixed\n1,NA,5,1990-01-05,True,1.5,3,12345678901234567890,1\n"
        "2,n/a,6,2024-01-05 10:00:00,False,NULL,,2,x\n"
    )
    df = readers.read_table(spark, write(tmp_path / "m.csv", text))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("id", "bigint"), ("phone", "string"), ("phone.1", "bigint"), ("born", "string"), ("flag", "boolean"),
        ("amount", "double"), ("count", "double"), ("long", "string"), ("mixed", "string"),
    ]
    assert [tuple(r) for r in df.collect()] == [
        (1, None, 5, "1990-01-05", True, 1.5, 3.0, "12345678901234567890", "1"),
        (2, None, 6, "2024-01-05 10:00:00", False, None, None, "2", "x"),
    ]


def test_csv_files_of_a_folder_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", "id,name\n1,x\n")
    write(tmp_path / "b.csv", "id,place\n2,y\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_json_documents_of_a_folder_are_taken_apart_each_by_itself(spark, tmp_path):
    write(tmp_path / "a.json", '{"people": [{"n": 1}, {"n": 2}], "z": [3]}')
    write(tmp_path / "b.json", '{"z": [{"m": "x"}], "people": []}')
    write(tmp_path / "c.json", '[{"n": 5}]')
    write(tmp_path / "d.json", '{"n": 6}')
    df = readers.read_json(spark, str(tmp_path))
    assert sorted(r["n"] for r in df.where("n IS NOT NULL").collect()) == [1, 2, 5, 6]
    assert df.count() == 5


def test_unknown_formats_are_refused(spark, tmp_path):
    for name in ("a.txt", "a.xls", "a.xlsx", "nothing"):
        with pytest.raises(ValueError, match="Unsupported"):
            readers.read_table(spark, str(tmp_path / name))


def test_empty_tables(spark, tmp_path):
    path = write(tmp_path / "e.csv", "id,name\n")
    with pytest.raises(ValueError, match="no data rows"):
        readers.read_table(spark, path)
    assert readers.read_table(spark, path, on_empty="skip") is None


def test_normalise(spark):
    df = spark.sql(
        "SELECT double('inf') AS a, double('nan') AS b, 0.123456789012D AS c, timestamp_ntz'2024-05-06 07:08:09.123456' AS d,"
        " date'2024-05-06' AS e, 'x' AS f, 7 AS g"
    )
    assert tuple(normalise(df).first()) == (
        None, None, 0.123456789, "2024-05-06T07:08:09.123", "2024-05-06T00:00:00.000", "x", 7,
    )


def test_json_sink_is_sparse_and_keeps_letters(spark, tmp_path):
    df = spark.createDataFrame([("ENT0001", 1, "é", None)], "entity_id string, entity_no long, a string, b string")
    sinks.write_json(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"entity_id": "ENT0001", "a": "é"}
    assert "é" in text


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", [1, 2])], "t string, l array<int>")
    sinks.write_csv(df, str(tmp_path / "out.csv"))
    assert rows(readers.read_csv(spark, str(tmp_path / "out.csv"), line_breaks=True)) == [{"t": 'a,"b"\nc', "l": "[1,2]"}]


def test_registry(spark, tmp_path):
    path = str(tmp_path / "templates")
    row = spark.createDataFrame([("t1", "u1", {"a": "revenue"})], "template_id string, user_id string, mapping map<string,string>")
    sinks.append_rows(row, path, sinks.TEMPLATES)
    sinks.append_rows(row, path, sinks.TEMPLATES)
    stored = sinks.read_registry(spark, path, sinks.TEMPLATES)
    assert stored.count() == 2
    assert stored.first()["mapping"] == {"a": "revenue"}
