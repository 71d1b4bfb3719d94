"""JSON and XML files that several tasks read, against plain parsers of the whole file."""

import json
import random
import xml.etree.ElementTree as ElementTree

import pytest
from pyarrow import parquet

from recordloom.sources import file_parts, json_elements, readers, xml_rows


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.fixture
def small_parts(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "83b", "spark.sql.files.openCostInBytes": "1b"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return draw.choice(["", "a,b", 'quo"te', "[", "}]", "back\\", '\\",', '": [', "é,\n", "line"])
    if kind < 4:
        return draw.choice([1, -2.5, None, True, 10**6])
    if kind == 4:
        return [_value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {draw.choice(["k", "a,b", '"[', "z"]): _value(draw, depth + 1) for _ in range(draw.randrange(3))}


def _lines(spark, path):
    return [r["value"] for r in spark.read.text(json_elements.lines(spark, path)).collect()]


@pytest.mark.parametrize("seed", range(6))
def test_array_elements_equal_a_plain_parser(spark, tmp_path, small_parts, seed):
    draw = random.Random(seed)
    wanted = [_value(draw) for _ in range(40)]
    path = write(tmp_path / "a.json", json.dumps(wanted, indent=draw.choice([None, 1]), ensure_ascii=False))
    assert file_parts.pieces(spark, path, ",").select("_block").distinct().count() > 3
    got = [json.loads(line) for line in _lines(spark, path)]
    assert got == [x if isinstance(x, dict) else {"0": x} for x in wanted]


@pytest.mark.parametrize("seed", range(6))
def test_first_list_of_an_object_equals_a_plain_parser(spark, tmp_path, small_parts, seed):
    draw = random.Random(seed)
    document = {"before": {"inner": [1, [2]], "text": 'x": [1,2'}, "a,b\": [": 5, "more": _value(draw, 3)}
    if seed % 3:
        document["list"] = [_value(draw) for _ in range(30)]
        document |= {"after": [1, 2], "end": {"list": [3]}}
    got = [json.loads(line) for line in _lines(spark, write(tmp_path / "o.json", json.dumps(document, ensure_ascii=False)))]
    wanted = next((v for v in document.values() if isinstance(v, list)), None)
    assert got == ([document] if wanted is None else [x if isinstance(x, dict) else {"value": x} for x in wanted])


def test_plain_values_are_rows(spark, tmp_path):
    df = readers.read_json(spark, write(tmp_path / "v.json", "[1,2]"))
    assert [r.asDict() for r in df.collect()] == [{"0": 1}, {"0": 2}]


@pytest.mark.parametrize("text", ["[]", " [ ] ", '{"a": []}'])
def test_empty_lists_have_no_rows(spark, tmp_path, text):
    path = write(tmp_path / "e.json", text)
    assert readers.read_table(spark, path, on_empty="skip") is None


def test_files_of_a_folder_are_looked_at_one_by_one(spark, tmp_path, small_parts):
    (tmp_path / "d.json").mkdir()
    write(tmp_path / "d.json" / "1.json", json.dumps([{"x": i} for i in range(30)]))
    write(tmp_path / "d.json" / "2.json", json.dumps({"n": 1, "own": [{"x": 100 + i} for i in range(30)]}))
    write(tmp_path / "d.json" / "3.json", json.dumps({"x": 7}))
    got = readers.read_table(spark, str(tmp_path / "d.json"))
    assert [r["x"] for r in got.collect()] == [*range(30), *range(100, 130), 7]


def _tree(draw, depth=0):
    name = draw.choice("abcd")
    kids = [_tree(draw, depth + 1) for _ in range(draw.choice([0, 1, 1, 2, 3]) if depth < 4 else 0)]
    made = ElementTree.Element(name, {"k": draw.choice(["x", "a>b", "'", "/"])} if draw.random() < 0.5 else {})
    made.text = draw.choice([None, "text", "&lt;a>"])
    made.extend(kids)
    return made


def first_repeated(element):
    """The first element, depth first, that stands more than once under one parent."""
    for i, kid in enumerate(element):
        if [k.tag for k in element].index(kid.tag) < i:
            continue
        if sum(k.tag == kid.tag for k in element) > 1:
            return kid.tag
        if below := first_repeated(kid):
            return below
    return None


def test_row_elements_equal_a_plain_parser(spark, tmp_path, small_parts):
    (tmp_path / "all").mkdir()
    wanted = {}
    for seed in range(60):
        root = _tree(random.Random(seed))
        text = ElementTree.tostring(root, encoding="unicode")
        lead = ["", "<?xml version='1.0'?>\n", "<!-- <b><b/> -->", "<!DOCTYPE a [<!ELEMENT a ANY>]>"][seed % 4]
        text = lead + text.replace(">text<", "><![CDATA[ <a><a> ]]>text<!-- <c/>\n<c/> --><")
        wanted[f"{seed:02}.xml"] = first_repeated(root) or root.tag
        write(tmp_path / "all" / f"{seed:02}.xml", text)
    got = {r["_path"].rsplit("/", 1)[-1]: r["name"] for r in xml_rows.row_elements(spark, str(tmp_path / "all")).collect()}
    assert got == wanted


def test_row_element_of_a_file_in_many_parts(spark, tmp_path, small_parts):
    body = "".join(f"<order no='{i}'><line/><!-- one > two --></order>" for i in range(200))
    path = write(tmp_path / "o.xml", f"<all><head><made>now</made></head><orders>{body}</orders></all>")
    assert readers.row_element(spark, path) == "order"
    assert readers.read_table(spark, path).count() == 200


@pytest.mark.parametrize("size", [1, 40, 300])
def test_bundles_of_any_size_give_the_same_elements(spark, tmp_path, size):
    draw = random.Random(size)
    wanted = [_value(draw) for _ in range(60)]
    path = write(tmp_path / "a.json", json.dumps({"text": 'x": [1,2', "list": wanted, "after": [1]}, ensure_ascii=False))
    got = [json.loads(r["value"]) for r in spark.read.text(json_elements.lines(spark, path, size)).collect()]
    assert got == [x if isinstance(x, dict) else {"value": x} for x in wanted]


def test_row_elements_of_bundles_of_any_size(spark, tmp_path):
    (tmp_path / "all").mkdir()
    wanted = {}
    for seed in range(100, 130):
        root = _tree(random.Random(seed))
        text = ElementTree.tostring(root, encoding="unicode").replace(">text<", "><![CDATA[ <a><a> ]]>text<!-- <c/>\n<c/> --><")
        wanted[f"{seed}.xml"] = first_repeated(root) or root.tag
        write(tmp_path / "all" / f"{seed}.xml", text)
    for size in (1, 30, 200):
        got = {r["_path"].rsplit("/", 1)[-1]: r["name"] for r in xml_rows.row_elements(spark, str(tmp_path / "all"), size).collect()}
        assert got == wanted


def test_texts_of_elements_are_not_shuffled_by_part(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "a.json", json.dumps([{"a": i, "b": "x"} for i in range(50)]))
    seen = {}
    made = json_elements.materialise

    def kept(df, label):
        seen[label] = df._jdf.queryExecution().executedPlan().toString()
        return made(df, label)

    monkeypatch.setattr(json_elements, "materialise", kept)
    json_elements.lines(spark, path)
    assert "Exchange" not in seen["json-bundles"]
    assert "hashpartitioning" not in seen["json-inner"]


def test_texts_meet_a_row_for_each_part_and_are_read_few_at_a_time(spark, tmp_path, monkeypatch):
    wanted = [{"a": i, "b": 'x, "[y'} for i in range(400)]
    path = write(tmp_path / "a.json", json.dumps(wanted))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, files, made = spark.conf.get(key, None), {}, {}, json_elements.materialise

    def kept(df, label):
        seen[label] = spark.conf.get(key, None)
        files[label] = made(df, label)
        return files[label]

    monkeypatch.setattr(json_elements, "materialise", kept)
    got = [json.loads(r["value"]) for r in spark.read.text(json_elements.lines(spark, path, 40)).collect()]
    assert got == wanted
    assert files["json-bundles"].count() > 100
    assert files["json-parts"].count() == 1
    assert seen["json-lists"] == seen["json-inner"] == "4m"
    for label in ("json-bundles", "json-inner"):
        metas = [parquet.ParquetFile(name.removeprefix("file://")).metadata for name in files[label].inputFiles()]
        assert max(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)) <= 32
    assert spark.conf.get(key, None) == before
    assert spark.conf.get("parquet.block.row.count.limit", None) is None


@pytest.mark.parametrize("size", [1, 9, 1 << 18])
def test_lines_of_whole_and_of_cut_elements_are_alike(spark, tmp_path, size):
    text = '[ 1 ,\r\n\t{"a" :\n 2}\t,  "x,\\" y" , [3,\r\n\r\n4] ,{} ,\n {"b": [5,{"c":[]}]}\n, null\n]\n'
    path = write(tmp_path / "a.json", text)
    got = [r["value"] for r in spark.read.text(json_elements.lines(spark, path, size)).collect()]
    assert got == ['{"0": 1}', '{"a" :  2}', '{"0": "x,\\" y"}', '{"0": [3, 4]}', "{}", '{"b": [5,{"c":[]}]}', '{"0": null}']
