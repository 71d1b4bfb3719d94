"""Merging against the data-frame library the semantics come from."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.operators import merge


def plain_merge(frames, keys):
    out, linked = frames[0], 0
    for frame in frames[1:]:
        shared = [k for k in keys if k in out.columns and k in frame.columns]
        if not shared:
            out = pd.concat([out, frame], ignore_index=True)
            continue
        for k in shared:
            linked += len(set(out[k].dropna().astype(str)) & set(frame[k].dropna().astype(str)))
        both = [c for c in frame.columns if c in out.columns and c not in shared]
        out = pd.merge(out, frame.rename(columns={c: f"{c}__right" for c in both}), on=shared, how="outer")
        for c in both:
            out[c] = out[c].combine_first(out.pop(f"{c}__right"))
    return out, linked


def as_rows(frame):
    return [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]


def random_frames(seed, shapes):
    rng = random.Random(seed)
    frames = []
    for columns, rows in shapes:
        data = {
            c: pd.Series([None if rng.random() < 0.15 else f"{c[0]}{rng.randrange(6):02d}" for _ in range(rows)], dtype=object)
            for c in columns
        }
        frames.append(pd.DataFrame(data))
    return frames


SHAPES = {
    "one key": [(("customer_id", "city"), 12), (("customer_id", "revenue"), 9)],
    "overlap": [(("customer_id", "city"), 12), (("customer_id", "city", "email"), 9)],
    "two keys": [(("customer_id", "id", "a"), 15), (("id", "customer_id", "b"), 15)],
    "no key": [(("city", "a"), 5), (("a", "b"), 4)],
    "fold": [(("customer_id", "city"), 6), (("customer_id", "phone_number", "x"), 6), (("phone_number", "city"), 5)],
    "append last": [(("customer_id", "city"), 6), (("customer_id", "x"), 6), (("city", "y"), 5)],
    "append first": [(("city", "y"), 5), (("customer_id", "x"), 6), (("customer_id", "city"), 6)],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("seed", [1, 2])
def test_same_rows_in_the_same_order(spark, shape, seed):
    frames = random_frames(seed, SHAPES[shape])
    tables = [
        spark.createDataFrame(
            [(i, *row) for i, row in enumerate(as_rows(f))], "_ord long, " + ", ".join(f"{c} string" for c in f.columns)
        )
        for f in frames
    ]
    wanted, linked = plain_merge(frames, merge.LINK_KEYS)
    merged = merge.merge_in_order(tables)
    columns = [c for c in merged.columns if c != "_ord"]
    assert columns == list(wanted.columns)
    found = [tuple(r) for r in merged.orderBy("_ord").select(*columns).collect()]
    assert found == as_rows(wanted)
    assert sum(r["linked"] for r in merge.linked_keys(tables).collect()) == linked
    stats = merge.multi_file_stats(tables, merged).first()
    assert stats["unmatched_entities"] == max(0, len(wanted) - linked)


def test_keys_of_different_types_meet_as_text(spark):
    left = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "_ord long, id long, x string")
    right = spark.createDataFrame([(0, "2", "c"), (1, "z", "d")], "_ord long, id string, y string")
    rows = merge.merge([left, right]).select("id", "x", "y").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "a", None), ("2", "b", "c"), ("z", None, "d")]
    assert merge.linked_keys([left, right]).first()["linked"] == 1


def test_whole_and_fractional_keys_meet_as_numbers(spark):
    left = spark.createDataFrame([(0, 1), (1, 2)], "_ord long, id long")
    right = spark.createDataFrame([(0, 2.0)], "_ord long, id double")
    assert merge.linked_keys([left, right]).first()["linked"] == 1


def test_names_with_dots_and_a_suffix_like_join_residue(spark):
    left = spark.createDataFrame([(0, 1, "a", "p")], ["_ord", "id", "x.y", "city_dup"])
    right = spark.createDataFrame([(0, 1, "b", "q")], ["_ord", "id", "z.w", "city"])
    merged = merge.merge([left, right])
    assert merged.select("`x.y`", "city_dup", "`z.w`", "city").first() == ("a", "p", "b", "q")


def test_graph_has_at_most_five_nodes(spark):
    many = spark.createDataFrame([(9,)], "linked_entities long")
    none = spark.createDataFrame([(0,)], "linked_entities long")
    nodes, edges = merge.cross_file_graph(many)
    assert (nodes.count(), edges.count()) == (5, 5)
    assert nodes.orderBy("id").first() == ("entity_0", "Linked Profile")
    assert merge.cross_file_graph(none)[0].count() == 0


def test_a_hot_key_is_split(spark):
    """A third of the left rows share a key; the merge must not put them into one task."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 60_000, 1, 6)
        left = ids.select(
            F.col("id").alias("_ord"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("x")
        )
        right = spark.range(30_000).select(F.col("id").alias("_ord"), "id", F.lit("r").alias("y"))
        merged = merge.merge([left, right]).select("id", "x", "y")
        rows = merged.collect()
        assert len(rows) == 60_000 + 30_000 - len({1} | {i for i in range(30_000) if i % 3})
        assert "skew=true" in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_merge_size_is_the_number_of_merged_rows(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "7", "c"), (4, "7", "d"), (5, "8", "e")], "_ord long, customer_id string, x string")
    right = spark.createDataFrame([(1, None, "p"), (2, 7, "q"), (3, 7, "r"), (4, 9, "s")], "_ord long, customer_id int, y string")
    size = merge.merge_size(left, right).first().asDict()
    assert size == {"merged_rows": merge.merge([left, right]).count(), "null_key_rows": 2, "largest_key_rows": 4}
    assert [(r["key"]["customer_id"], r["merged_rows"]) for r in merge.hot_keys(left, right, 2).collect()] == [("7", 4), (None, 2)]
    assert merge.merge([left, right], most_rows=size["merged_rows"]).count() == size["merged_rows"]
    with pytest.raises(ValueError, match=r"gives 8 rows, more than 7; largest keys \('7',\): 4"):
        merge.merge([left, right], most_rows=7)
    assert merge.merge_size(left.drop("customer_id"), right).first()["merged_rows"] == 9
    none = spark.createDataFrame([], left.schema)
    assert merge.merge_size(none, none).first()["merged_rows"] == 0
