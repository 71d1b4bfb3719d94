"""CSV files with line breaks in quoted cells, split over tasks, against a plain parser."""

import csv
import io
import random

import pytest

from recordloom.sources import csv_records, readers


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.fixture
def small_parts(spark):
    """Files of a few hundred bytes are read by several tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _cell(draw):
    kind = draw.randrange(6)
    if kind == 0:
        return draw.choice(["", "x", 'size 5" pipe', "a b", "tail "])
    words = [draw.choice(["one", "two", '"', ",", "\n", "\n\n", '""', "\r\n", "é"]) for _ in range(draw.randrange(1, 9))]
    return "".join(words)


def _quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',\n\r') or cell.startswith('"') or '""' in cell else cell


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_a_plain_parser(spark, tmp_path, small_parts, seed):
    draw = random.Random(seed)
    wanted = [[str(i), _cell(draw), _cell(draw)] for i in range(60)]
    text = "id,a,b\n" + "\n".join(",".join(_quoted(c) for c in row) for row in wanted) + "\n"
    assert list(csv.reader(io.StringIO(text, newline="")))[1:] == wanted
    path = write(tmp_path / "x.csv", text)
    found = csv_records.lines(spark, path)
    assert found.select("_block").distinct().count() > 3
    rows = csv_records.read(spark, path, found, spark.createDataFrame([], "id string, a string, b string").schema)
    got = [[r["id"], r["a"] or "", r["b"] or ""] for r in rows.collect()]
    assert got == wanted


def test_line_breaks_need_no_option(spark, tmp_path, small_parts):
    body = "".join(f'{i},"first line of {i}\nsecond, line\n\nlast",{i}.5\n' for i in range(40))
    df = readers.read_table(spark, write(tmp_path / "x.csv", "no,note,price\n" + body))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double"]
    assert [tuple(r) for r in df.collect()] == [(i, f"first line of {i}\nsecond, line\n\nlast", i + 0.5) for i in range(40)]


def test_header_with_a_line_break_and_windows_line_ends(spark, tmp_path):
    df = readers.read_csv(spark, write(tmp_path / "x.csv", '"the\nname",b\r\n"x\r\ny",1\r\nz,2\r\n'))
    assert df.columns == ["the\nname", "b"]
    assert [tuple(r) for r in df.collect()] == [("x\r\ny", 1), ("z", 2)]


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path):
    df = readers.read_csv(spark, write(tmp_path / "x.csv", 'a,b\n5" pipe,1\n6" pipe,2\n'))
    assert [tuple(r) for r in df.collect()] == [('5" pipe', 1), ('6" pipe', 2)]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3,4,5\n", 'a,b\n"x\ny",2\n3,4,5\n', 'a,b\n"x\ny",2,"z\n"\n'])
def test_rows_longer_than_the_header_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError, match="3 cells under 2 columns"):
        readers.read_csv(spark, write(tmp_path / "x.csv", text))


def test_shorter_rows_are_filled_up(spark, tmp_path):
    df = readers.read_csv(spark, write(tmp_path / "x.csv", 'a,b,c\n"x\ny"\n1,2\n'))
    assert [tuple(r) for r in df.collect()] == [("x\ny", None, None), ("1", 2, None)]


def test_an_open_quote_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="not closed"):
        readers.read_csv(spark, write(tmp_path / "x.csv", 'a,b\n1,2\n3,"4\n5,6\n'))
