"""Entity resolution and the relationship graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import customers, table
from recordloom.functions.rows import ORD
from recordloom.operators import graph, resolve


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("revenue"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias(ORD),
    )


def resolve_single_key(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve.assign_entities(_orders(spark, folder))
    return found.select(F.col(ORD).alias("o_orderkey"), resolve.entity_id(F.col("entity_no")).alias("entity_id"))


def resolve_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A customer has one phone, and many customers share it, so the phone is the entity."""
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("customer_id"),
        F.concat(F.lit("P"), F.col("o_custkey") % 100).alias("phone_number"),
        F.col("o_orderkey").alias(ORD),
    )
    return resolve.assign_entities(rows).select(F.col(ORD).alias("o_orderkey"), "entity_no")


def resolve_three_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every key is missing on some rows, and the matches chain through one another."""
    base = table(spark, folder, "orders")
    rows = base.select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("C"), "o_custkey")).alias("customer_id"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("P"), F.floor(F.col("o_totalprice") / 100))).alias("phone_number"),
        F.concat(F.lit("D"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("customer_name"),
        F.col("o_orderkey").alias(ORD),
    )
    return resolve.assign_entities(rows).select(F.col(ORD).alias("o_orderkey"), "entity_no")


def entity_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = _orders(spark, folder)
    return resolve.merge_records(rows, resolve.assign_entities(rows)).drop("entity_no")


def entity_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _orders(spark, folder)
    assigned = resolve.assign_entities(rows)
    return resolve.conflicts(rows, assigned, resolve.merge_records(rows, assigned))


def resolution_report(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolve(_orders(spark, folder)).report


def _people(spark: SparkSession, folder: str) -> DataFrame:
    rows = customers(spark, folder).withColumn("city", F.nullif("city", F.lit("NATION_7")))
    rows = rows.withColumn("customer_id", F.concat(F.lit("C"), "customer_id"))
    return resolve.resolve(rows, positions=True).records


def relationship_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = graph.relationship_tree(_people(spark, folder))
    names = F.array_join(F.transform("children", lambda c: c["name"]), "; ")
    return tree.select("entity_id", "name", names.alias("children"), "relationship_count")


def relationship_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.relationship_edges(graph.relationship_tree(_people(spark, folder)))


def sample_records(spark: SparkSession, folder: str) -> DataFrame:
    return graph.sample_records(_people(spark, folder)).drop("_first", "entity_no")


QUERIES = {
    "resolve_single_key": resolve_single_key,
    "resolve_two_keys": resolve_two_keys,
    "resolve_three_keys": resolve_three_keys,
    "entity_merge": entity_merge,
    "entity_conflicts": entity_conflicts,
    "resolution_report": resolution_report,
    "relationship_tree": relationship_tree,
    "relationship_edges": relationship_edges,
    "sample_records": sample_records,
}

_ROWS = """
    SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS revenue,
           o_orderpriority AS priority, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root
    FROM orders
"""
_ENTITIES = f"""
    SELECT dense_rank() OVER (ORDER BY root) AS entity_no, 'C' || o_custkey AS customer_id, k, root,
           arg_min(revenue, k) FILTER (revenue IS NOT NULL) OVER (PARTITION BY root) AS kept_revenue,
           arg_min(priority, k) OVER (PARTITION BY root) AS kept_priority, revenue, priority
    FROM ({_ROWS})
"""
_TREE = """
    SELECT printf('ENT%04d', c_custkey + 1) AS entity_id, c_name AS name, nullif(n_name, 'NATION_7') AS city,
           c_acctbal AS revenue, c_mktsegment AS segment, 'C' || c_custkey AS customer_id
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
"""

SQL = {
    "resolve_single_key": f"SELECT k AS o_orderkey, printf('ENT%04d', entity_no) AS entity_id FROM ({_ENTITIES})",
    "resolve_two_keys": """
        SELECT o_orderkey, dense_rank() OVER (ORDER BY root) AS entity_no
        FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey % 100) AS root FROM orders)
    """,
    "resolve_three_keys": """
        WITH RECURSIVE k AS (
            SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS c,
                   CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice / 100) AS BIGINT) END AS p,
                   CAST(o_orderdate AS DATE) AS d
            FROM orders
        ), p AS (
            SELECT id, coalesce(
                CASE WHEN c IS NOT NULL THEN lag(id) OVER (PARTITION BY c ORDER BY id) END,
                CASE WHEN p IS NOT NULL THEN lag(id) OVER (PARTITION BY p ORDER BY id) END,
                lag(id) OVER (PARTITION BY d ORDER BY id)) AS parent
            FROM k
        ), walk AS (
            SELECT id, id AS node FROM p
            UNION ALL SELECT walk.id, p.parent FROM walk JOIN p ON p.id = walk.node WHERE p.parent IS NOT NULL
        )
        SELECT id AS o_orderkey, dense_rank() OVER (ORDER BY root) AS entity_no
        FROM (SELECT id, min(node) AS root FROM walk GROUP BY id)
    """,
    "entity_merge": f"""
        SELECT DISTINCT printf('ENT%04d', entity_no) AS entity_id, customer_id, kept_revenue AS revenue,
               kept_priority AS priority
        FROM ({_ENTITIES})
    """,
    "entity_conflicts": f"""
        SELECT entity_no, CAST(sum(coalesce((revenue <> kept_revenue)::INT, 0) + (priority <> kept_priority)::INT) AS BIGINT)
               AS conflicts
        FROM ({_ENTITIES}) GROUP BY entity_no
    """,
    "resolution_report": f"""
        SELECT count(*) AS records_before_merge, max(entity_no) AS records_after_merge,
               count(*) - max(entity_no) AS duplicates_merged,
               CAST(sum(coalesce((revenue <> kept_revenue)::INT, 0) + (priority <> kept_priority)::INT) AS BIGINT)
               AS conflicts_detected
        FROM ({_ENTITIES})
    """,
    "relationship_tree": f"""
        SELECT entity_id, name,
               concat_ws('; ', 'City: ' || city, 'Revenue: ' || revenue, 'Segment: ' || segment) AS children,
               CAST(CASE WHEN city IS NULL THEN 2 ELSE 3 END AS INTEGER) AS relationship_count
        FROM ({_TREE})
    """,
    "relationship_edges": f"""
        SELECT entity_id AS source, 'city' AS label, 'City: ' || city AS target FROM ({_TREE}) WHERE city IS NOT NULL
        UNION ALL SELECT entity_id, 'revenue', 'Revenue: ' || revenue FROM ({_TREE})
        UNION ALL SELECT entity_id, 'segment', 'Segment: ' || segment FROM ({_TREE})
    """,
    "sample_records": f"""
        SELECT entity_id, customer_id, name AS customer_name, city, revenue, segment FROM ({_TREE}) ORDER BY entity_id LIMIT 10
    """,
}
