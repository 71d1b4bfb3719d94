"""Entity resolution against a plain loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions.rows import number_rows
from recordloom.operators import graph, resolve

KEYS = ("customer_id", "phone_number", "customer_name")


def plain_loop(rows, columns):
    """The rule as stated: rows in order, three lookups, last writer wins."""
    seen = ({}, {}, {})
    records, assigned, conflicts = [], [], 0
    for row in rows:
        values = dict(zip(columns, row))
        keys = [values.get(k) for k in KEYS]
        entity = next((known[key] for known, key in zip(seen, keys) if key and key in known), None)
        if entity is None:
            entity = len(records)
            records.append({})
        record = records[entity]
        for name, value in values.items():
            if value is None or str(value).strip() == "":
                continue
            if name not in record:
                record[name] = value
            elif str(record[name]).strip() != str(value).strip():
                conflicts += 1
        for known, key in zip(seen, keys):
            if key:
                known[key] = entity
        assigned.append(entity + 1)
    return assigned, records, conflicts


def random_rows(seed, rows, width, blank=0.35):
    rng = random.Random(seed)

    def key(letter):
        return rng.choice([None, "", " "]) if rng.random() < blank else f"{letter}{rng.randrange(width)}"

    return [
        (key("c"), key("p"), key("n"), rng.choice([None, " ", "x", " x", "y", "z"]), rng.choice([None, 1, 2, 3]))
        for _ in range(rows)
    ]


COLUMNS = (*KEYS, "city", "age")
SCHEMA = "_ord long, customer_id string, phone_number string, customer_name string, city string, age long"


@pytest.mark.parametrize(
    "seed,rows,width,group_rows,chunk_bits",
    [(1, 60, 5, 1 << 20, 20), (2, 60, 40, 8, 2), (3, 400, 8, 20, 3), (4, 400, 300, 20, 4), (5, 300, 2, 5, 1)],
)
def test_same_entities_as_the_loop(spark, seed, rows, width, group_rows, chunk_bits):
    data = random_rows(seed, rows, width)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], SCHEMA)
    found = resolve.assign_entities(df, group_rows, chunk_bits).orderBy("_ord").collect()
    assert [r["entity_no"] for r in found] == plain_loop(data, COLUMNS)[0]


def test_long_chain_of_pointers(spark):
    """Phone and name take turns, so each row only matches the one before it."""
    rows = [(f"p{i // 2}", f"n{(i + 1) // 2}") for i in range(120)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "_ord long, phone_number string, customer_name string")
    assert {r["entity_no"] for r in resolve.assign_entities(df).collect()} == {1}


def test_one_value_on_a_third_of_the_rows(spark):
    rng = random.Random(7)
    data = [
        (None, None, "Unknown" if i % 3 == 0 else f"n{rng.randrange(500)}", None, i) if rng.random() < 0.7
        else (f"c{rng.randrange(200)}", None, "Unknown" if i % 3 == 0 else None, None, i)
        for i in range(3000)
    ]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], SCHEMA)
    hot = resolve.hot_values(df, ["customer_name"], 300)
    assert [r["customer_name"] for r in hot["customer_name"].collect()] == ["Unknown"]
    found = resolve.assign_entities(df, 300, 6).orderBy("_ord").collect()
    assert [r["entity_no"] for r in found] == plain_loop(data, COLUMNS)[0]


@pytest.mark.parametrize("seed", [11, 12])
def test_merged_records_and_conflicts(spark, seed):
    data = random_rows(seed, 200, 30)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], SCHEMA)
    assigned, records, conflicts = plain_loop(data, COLUMNS)
    found = resolve.resolve(df)
    got = [r.asDict() for r in found.records.orderBy("entity_no").collect()]
    assert [{k: v for k, v in r.items() if v is not None and k in COLUMNS} for r in got] == records
    assert [r["entity_id"] for r in got] == [f"ENT{i + 1:04d}" for i in range(len(records))]
    assert found.report.first().asDict() == {
        "records_before_merge": len(data),
        "records_after_merge": len(records),
        "duplicates_merged": len(data) - len(records),
        "conflicts_detected": conflicts,
    }
    per_entity = resolve.conflicts(df, found.assignments, found.records)
    assert per_entity.agg(F.sum("conflicts")).first()[0] == conflicts


def test_falsy_keys_never_match(spark):
    data = [(0, None), (0, None), (5, None), (5, None), (None, ""), (None, ""), (None, " "), (None, " ")]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], "_ord long, customer_id long, phone_number string")
    found = [r["entity_no"] for r in resolve.assign_entities(df).orderBy("_ord").collect()]
    assert found == [1, 2, 3, 3, 4, 5, 6, 6]


def test_without_key_columns_every_row_is_an_entity(spark):
    df = spark.range(5).select(F.col("id").alias("_ord"), F.lit("a").alias("city"))
    assert sorted(r["entity_no"] for r in resolve.assign_entities(df).collect()) == [1, 2, 3, 4, 5]


def test_a_source_column_named_entity_id_is_kept_apart(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y")], "_ord long, entity_id string")
    rows = resolve.resolve(df).records.orderBy("entity_no").collect()
    assert [(r["entity_id"], r["source_entity_id"]) for r in rows] == [("ENT0001", "x"), ("ENT0002", "y")]


def test_numbers_beyond_four_digits(spark):
    df = spark.range(1).select(resolve.entity_id(F.lit(12345)).alias("e"))
    assert df.first()["e"] == "ENT12345"


def test_numbering_has_no_gaps(spark):
    df = spark.range(0, 100_000, 1, 16).select((F.col("id") * 7919 % 100_003).alias("key"))
    numbered = number_rows(df, [F.col("key")], "no")
    row = numbered.agg(F.min("no"), F.max("no"), F.count_distinct("no")).first()
    assert tuple(row) == (1, 100_000, 100_000)
    assert numbered.orderBy("key").limit(3).select("no").collect() == [(1,), (2,), (3,)]


def test_children_stand_in_the_order_their_values_came(spark):
    rows = [(0, "c1", None, "x", 2.0), (1, "c1", "Pune", "y", None), (2, "c2", " ", None, None)]
    df = spark.createDataFrame(rows, "_ord long, customer_id string, city string, plan_type string, revenue double")
    tree = graph.relationship_tree(resolve.resolve(df, positions=True).records).orderBy("entity_id").collect()
    assert [(c["name"], c["type"]) for c in tree[0]["children"]] == [
        ("Plan Type: x", "plan_type"), ("Revenue: 2.0", "revenue"), ("City: Pune", "city"),
    ]
    assert (tree[0]["name"], tree[0]["relationship_count"]) == ("ENT0001", 3)
    assert tree[1]["children"] == []
