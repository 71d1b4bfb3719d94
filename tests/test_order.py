"""Row order and numbers must not depend on the size of files or on the cores."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions.rows import ORD, with_order
from recordloom.plans.convert import convert, gaps_as_floats


def _files(spark, folder, sizes):
    start = 0
    for i, n in enumerate(sizes):
        spark.range(start, start + n, 1, 1).write.parquet(f"{folder}/{i}")
        start += n
    return [f"{folder}/{i}" for i in range(len(sizes))], start


@pytest.mark.parametrize("sizes", [(3, 500, 20), (400, 1, 1, 30)])
def test_order_of_files(spark, tmp_path, sizes):
    paths, total = _files(spark, tmp_path, sizes)
    try:
        for split in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            df = with_order(spark.read.parquet(*paths).select("id", (F.col("id") % 2).alias("even")))
            assert [r["id"] for r in df.orderBy(ORD).collect()] == list(range(total))
            assert df.select(ORD).distinct().count() == total
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_value_comes_from_the_first_file(spark, tmp_path):
    small, large = str(tmp_path / "t" / "part-0.csv"), str(tmp_path / "t" / "part-1.csv")
    (tmp_path / "t").mkdir()
    open(small, "w").write("customer_id,city\nC1,Pune\n")
    open(large, "w").write("customer_id,city\n" + "".join(f"C{i},Rome\n" for i in range(1, 4000)))
    from recordloom.sources.readers import read_csv

    people = read_csv(spark, str(tmp_path / "t"))
    other = spark.createDataFrame([("C1", 5.0)], "customer_id string, revenue double")
    records = convert(spark, {"people": people, "other": other}).public_records()
    assert records.where("customer_id = 'C1'").first()["city"] == "Pune"


def test_whole_numbers_with_gaps_count_as_floats(spark):
    df = spark.createDataFrame([(0, 1, 9007199254740993), (1, None, None)], "_ord long, n long, wide long")
    assert [f.dataType.simpleString() for f in gaps_as_floats(df).schema] == ["bigint", "double", "bigint"]
