"""Profiles, scores and duplicate rows against the data-frame library."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.functions.cells import float_sql, safe_file_name, to_number
from recordloom.operators import explore, profile, quality

SCHEMA = "_ord long, customer_id long, city string, revenue string, phone_number string, flag boolean, score double"


def random_table(seed, rows=300):
    rng = random.Random(seed)

    def maybe(value, share=0.2):
        return None if rng.random() < share else value

    return [
        (i, maybe(rng.randrange(40)), maybe(rng.choice(["Pune", "Oslo", "Lima", " "])), maybe(str(rng.randrange(9) / 4)),
         maybe(f"p{rng.randrange(280)}", 0.0), rng.random() < 0.5, maybe(rng.randrange(20) / 8))
        for i in range(rows)
    ]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(random_table(3), SCHEMA)


@pytest.fixture(scope="module")
def frame():
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(random_table(3), columns=names).drop(columns="_ord").astype({"city": object, "revenue": object})


def test_catalog(table, frame):
    got = {r["column_name"]: r for r in profile.data_catalog(table).collect()}
    assert list(got) and set(got) == set(frame.columns)
    for name in frame.columns:
        column = frame[name]
        assert got[name]["null_percentage"] == round(column.isnull().mean() * 100, 2)
        assert got[name]["unique_values"] == column.nunique()
        if name != "customer_id":
            assert got[name]["sample_values"] == column.dropna().astype(str).head(3).tolist()
    kinds = {n: r["data_type"] for n, r in got.items()}
    assert kinds == {
        "customer_id": "float64", "city": "object", "revenue": "object", "phone_number": "object", "flag": "bool", "score": "float64",
    }
    assert got["city"]["description"] == "City of residence"


def test_catalog_without_empty_columns(spark):
    df = spark.createDataFrame([(0, "a", None)], "_ord long, x string, y string")
    assert [r["column_name"] for r in profile.data_catalog(df, drop_empty=True).collect()] == ["x"]


def test_most_common_place(table, frame):
    row = profile.most_common_place(table).first()
    counts = frame["city"].value_counts()
    assert (row["value"], row["n"]) == (counts.index[0], counts.iloc[0])


def test_place_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b")], "_ord long, address string")
    assert profile.most_common_place(df).first()["value"] == "b"


NUMBERS = ["1", "1.5", " 2 ", "-3e2", "+.5", "5.", "1.5d", "1f", "0x10", "1,000", "", " ", "abc", "nan", "1_0", None, "--1", "1e", "é1"]


def test_numbers_are_coerced_like_the_library_does(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NUMBERS)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(to_number(df, "n")).collect()]
    wanted = pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")
    assert got == [None if pd.isna(v) else v for v in wanted]


def test_revenue_total(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("2",), (None,)], "`Total Amount` string")
    assert tuple(profile.revenue_total(df).first()) == ("Total Amount", 3.5)
    assert profile.revenue_total(df.select(F.lit(1).alias("a"))).count() == 0


def test_duplicates(table, frame):
    small = table.select("_ord", "city", "flag", "score")
    wanted = frame[["city", "flag", "score"]].duplicated(keep=False)
    assert profile.duplicate_rows_count(small).first()[0] == int(wanted.sum())
    found = sorted(r["_ord"] for r in profile.duplicate_rows(small).collect())
    assert found == [i for i, hit in enumerate(wanted) if hit]


def test_duplicates_of_long_texts_nulls_and_lookalikes(spark):
    long = "x" * 100
    texts = [long, long, long + "y", None, None, "a", "t" + "a", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_ord long, text string")
    assert sorted(r["_ord"] for r in profile.duplicate_rows(df).collect()) == [0, 1, 3, 4]
    assert profile.duplicate_rows_count(df).first()[0] == 4


def test_entity_id_is_left_out_of_the_comparison_unless_asked_for(spark):
    df = spark.createDataFrame([("e1", 1), ("e2", 1)], "entity_id string, a int")
    assert profile.duplicate_rows_count(df).first()[0] == 2
    assert profile.duplicate_rows_count(df, exclude=()).first()[0] == 0


def test_recommendations(spark, table):
    assert [r["recommendation"] for r in profile.recommendations(table).orderBy("seq").collect()] == [
        "Customer ID should be primary key", "Revenue column suitable for analytics", "Consider standardizing city names",
    ]
    plain = spark.createDataFrame([(1,)], "a int")
    assert [r["recommendation"] for r in profile.recommendations(plain).collect()] == ["Data is clean and ready for analysis"]
    phones = spark.createDataFrame([(str(i),) for i in range(10)], "phone_number string")
    assert profile.recommendations(phones).first()["recommendation"] == "Phone number is a strong entity key"


def test_missing_cells(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "\t ", 1.0), (3, None, float("nan"))], "a int, b string, c double")
    assert tuple(quality.missing_fields(df, "all").first()) == (9, 4)
    assert tuple(quality.missing_fields(df).first()) == (5, 0)
    with pytest.raises(ValueError):
        quality.missing_fields(df, "some")


@pytest.mark.parametrize("missing,total,conflicts", [(0, 0, 0), (1, 3, 4), (5, 9, 30), (9, 9, 30), (2, 7, 1)])
def test_scores(spark, missing, total, conflicts):
    df = spark.createDataFrame([(missing, total, conflicts)], "missing_values long, total_fields long, conflicts_detected long")
    row = quality.quality_scores(df).first()
    lost, penalty = missing / max(1, total) * 100, min(20, conflicts * 2)
    assert row["completeness_score"] == int(max(0, 100 - lost))
    assert row["consistency_score"] == int(max(0, 100 - penalty))
    assert row["final_score"] == int(max(0, 100 - lost - penalty))


def test_search(spark):
    df = spark.createDataFrame([(1, "Pune", 1e7), (2, None, 2.5), (3, "a.b", 1e-5)], "id int, city string, amount double")

    def ids(pattern):
        return sorted(r["id"] for r in explore.search(df, pattern).collect())

    assert ids("PUNE") == [1]
    assert ids("") == [1, 2, 3]
    assert ids("^10000000") == [1]
    assert ids("1e-05") == [3]
    assert ids("nan|null|none") == []
    assert ids("a.b") == [3]
    # The pattern is lower-cased too, so \S turns into \s.
    assert ids(r"\S") == []


def test_sorting_and_pages(spark):
    rows = [(0, None), (1, 3), (2, 1), (3, 2)]
    df = spark.createDataFrame(rows, "_ord long, n int")

    def order(*args):
        return [r["_ord"] for r in explore.sort_rows(df, *args).collect()]

    assert order("n", "asc") == [2, 3, 1, 0]
    assert order("n", "downwards") == [1, 3, 2, 0]
    assert order("other", "asc") == [0, 1, 2, 3]
    assert [r["_ord"] for r in explore.page(df, 2, 3, "n").collect()] == [0]
    assert tuple(explore.page_count(df, 3).first()) == (4, 2)
    assert tuple(explore.page_count(df.filter("n > 9"), 3).first()) == (0, 1)


def test_deep_pages_hold_the_same_rows(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 8).select("id", (F.col("id") * 37 % 101).alias("n"))
    front = [tuple(r) for r in explore.page(df, 30, 50, "n", "desc", ties=["id"]).collect()]
    monkeypatch.setattr(explore, "SLICE_ROWS", 100)
    assert [tuple(r) for r in explore.page(df, 30, 50, "n", "desc", ties=["id"]).collect()] == front
    assert len(front) == 50


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_partition_all_rows(spark, monkeypatch, order):
    rows = [(i, None if i % 11 == 0 else i % 7) for i in range(400)] * 2
    df = spark.createDataFrame(rows, "id int, n int").repartition(4)
    monkeypatch.setattr(explore, "SLICE_ROWS", 50)
    monkeypatch.setattr(explore, "BOUNDS", 8)
    seen = [tuple(r) for number in range(1, 10) for r in explore.page(df, number, 100, "n", order).collect()]
    assert seen == sorted(rows, key=lambda r: (r[1] is None, (r[1] or 0) * (1 if order == "asc" else -1), r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_float_text(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(-8, 22) for _ in range(300)]
    values = [float(f"{v:.6g}") for v in values] + [0.0, -0.0, 1e16, 1e15, 123456789.0, 0.0001, 0.001, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(F.expr(float_sql("v"))).collect()]
    assert got == [repr(v) for v in values]


def test_file_names(spark):
    df = spark.createDataFrame([("a/b: C-é_1 ",), ("***",), (None,)], "n string")
    assert [r[0] for r in df.select(safe_file_name(F.col("n"))).collect()] == ["ab C-é_1", "report", "report"]


def test_copied_rows_are_told_by_value_and_place(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), ("x" * 100, "b", None), ("x" * 100, "b", None), ("x" * 99, "b", None), (None, None, None)]
    rows += [(str(i % 40), "c", 1.0) for i in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_ord long, a string, _bits string, _h1 double").repartition(4)
    found = profile.duplicate_rows(df)
    assert found.columns == df.columns
    assert sorted(r["_ord"] for r in found.collect()) == [1, 2, 3, 4, *range(7, 27), *range(47, 67)]
    assert profile.duplicate_rows_count(df).first()["duplicate_rows"] == 44
    assert profile.duplicate_rows(df.limit(0)).count() == 0
