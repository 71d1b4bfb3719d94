"""Merging on shared keys, appending, linked keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import customers, orders, table
from recordloom.functions.rows import ORD, number_rows
from recordloom.operators import merge


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("customer_id"),
        F.col("s_name").alias("supplier_name"),
        F.col("s_acctbal").alias("revenue"),
        F.col("s_suppkey").alias(ORD),
    )


def _accounts(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Two tables in which one account number each is unknown."""
    people = table(spark, folder, "customer").select(
        F.nullif("c_custkey", F.lit(5)).alias("account_id"), F.col("c_name").alias("holder"), F.col("c_custkey").alias(ORD)
    )
    firms = table(spark, folder, "supplier").select(
        F.nullif("s_suppkey", F.lit(7)).alias("account_id"), F.col("s_name").alias("firm"), F.col("s_suppkey").alias(ORD)
    )
    return [people, firms]


def merge_outer(spark: SparkSession, folder: str) -> DataFrame:
    """One shared key; null matches null."""
    return merge.merge(_accounts(spark, folder)).drop(ORD)


def _visits(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Orders and events of customers; many of both for one customer, and some of no known one."""
    bought = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("customer_id"), "o_orderkey", F.col("o_orderkey").alias(ORD)
    )
    seen = table(spark, folder, "events").select(
        F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string")).alias("customer_id"), "event_id", F.col("event_id").alias(ORD)
    )
    return [bought, seen]


def merge_size(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows a merge with many rows on both sides of a key would give."""
    return merge.merge_size(*_visits(spark, folder))


def hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that would give most of them."""
    found = merge.hot_keys(*_visits(spark, folder), 20)
    return found.select(F.col("key.customer_id").alias("customer_id"), "left_rows", "right_rows", F.col("merged_rows").cast("long").alias("merged_rows"))


def merge_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    """All shared keys must match."""
    base = table(spark, folder, "orders")
    left = base.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("revenue"),
        F.col("o_orderkey").alias(ORD),
    )
    moved = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    right = base.select(
        F.col("o_orderkey").alias("id"),
        moved.alias("customer_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias(ORD),
    )
    return merge.merge([left, right]).drop(ORD)


def merge_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """A shared column that is no key takes the left value, else the right."""
    left = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("kind"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("revenue"),
        F.col("c_custkey").alias(ORD),
    )
    right = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.lit("SUPPLIER").alias("kind"),
        F.col("s_acctbal").alias("revenue"),
        F.col("s_suppkey").alias(ORD),
    )
    return merge.merge([left, right]).drop(ORD)


def _wide(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The same long numbers as whole numbers, decimals and doubles; many differ in the last digit only."""
    base = table(spark, folder, "orders")
    number = F.lit(9007199254740992).cast("long") + F.col("o_orderkey")
    longs = base.select(number.alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias(ORD))
    decimals = base.filter("o_orderstatus <> 'O'").select(
        (number.cast("decimal(24,2)")).alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias(ORD)
    )
    doubles = base.select(number.cast("double").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias(ORD))
    return [longs, decimals, doubles.filter("id = 9007199254740992D + 2 * floor(owner / 2)")]


def merge_wide_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers of 16 digits joined with decimals and with doubles."""
    return merge.merge(_wide(spark, folder)).drop(ORD)


def linked_wide_keys(spark: SparkSession, folder: str) -> DataFrame:
    return merge.linked_keys(_wide(spark, folder)[:2])


def merge_union(spark: SparkSession, folder: str) -> DataFrame:
    """Without a shared key the rows are appended."""
    left = customers(spark, folder).select("customer_name", "revenue", "city", ORD)
    right = table(spark, folder, "supplier").select(
        F.col("s_name").alias("customer_name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("revenue"),
        F.col("s_suppkey").alias(ORD),
    )
    return merge.merge([left, right]).drop(ORD)


def _three(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [customers(spark, folder), orders(spark, folder), _suppliers(spark, folder)]


def merge_fold(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge(_three(spark, folder)).drop(ORD)


def merge_order(spark: SparkSession, folder: str) -> DataFrame:
    """Position of each merged row."""
    merged = merge.merge([orders(spark, folder), _suppliers(spark, folder)])
    return number_rows(merged.select("customer_id", "order_no", ORD), [F.col(ORD)], "position").drop(ORD)


def linked_keys(spark: SparkSession, folder: str) -> DataFrame:
    return merge.linked_keys(_three(spark, folder))


def multi_file_stats(spark: SparkSession, folder: str) -> DataFrame:
    tables = _three(spark, folder)
    return merge.multi_file_stats(tables, merge.merge(tables))


def cross_file_graph(spark: SparkSession, folder: str) -> DataFrame:
    tables = _three(spark, folder)
    nodes, edges = merge.cross_file_graph(merge.multi_file_stats(tables, merge.merge(tables)))
    return nodes.join(edges, nodes["id"] == edges["source"]).select("id", "label", "target")


_VISITS = """
    WITH l AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS k, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT CASE WHEN event_id % 50 <> 0 THEN CAST(user_id AS VARCHAR) END AS k, count(*) AS n FROM events GROUP BY 1),
    s AS (
        SELECT coalesce(l.k, r.k) AS k, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows,
               CAST(CASE WHEN l.n * r.n > 0 THEN l.n * r.n ELSE coalesce(l.n, r.n) END AS BIGINT) AS merged_rows
        FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k
    )
"""

QUERIES = {
    "merge_size": merge_size,
    "hot_keys": hot_keys,
    "merge_outer": merge_outer,
    "merge_two_keys": merge_two_keys,
    "merge_coalesce": merge_coalesce,
    "merge_wide_keys": merge_wide_keys,
    "linked_wide_keys": linked_wide_keys,
    "merge_union": merge_union,
    "merge_fold": merge_fold,
    "merge_order": merge_order,
    "linked_keys": linked_keys,
    "multi_file_stats": multi_file_stats,
    "cross_file_graph": cross_file_graph,
}

_FOLD = """
    SELECT coalesce(m.customer_id, s_suppkey) AS customer_id, customer_name, city,
           coalesce(m.revenue, s_acctbal) AS revenue, segment, order_no, status, s_name AS supplier_name
    FROM (
        SELECT coalesce(c_custkey, o_custkey) AS customer_id, c_name AS customer_name, n_name AS city,
               coalesce(c_acctbal, o_totalprice) AS revenue, c_mktsegment AS segment,
               o_orderkey AS order_no, o_orderstatus AS status
        FROM (customer LEFT JOIN nation ON n_nationkey = c_nationkey)
        FULL JOIN orders ON o_custkey = c_custkey
    ) m FULL JOIN supplier ON s_suppkey = m.customer_id
"""
_WIDE = "9007199254740992 + o_orderkey"
_LINKED = """
    (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders))
    + (SELECT count(*) FROM (
        (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) INTERSECT SELECT s_suppkey FROM supplier))
"""

SQL = {
    "merge_size": f"""
        {_VISITS} SELECT CAST(sum(merged_rows) AS BIGINT) AS merged_rows, CAST(coalesce(sum(merged_rows) FILTER (k IS NULL), 0) AS BIGINT) AS null_key_rows,
                         max(merged_rows) AS largest_key_rows FROM s
    """,
    "hot_keys": f"{_VISITS} SELECT k AS customer_id, left_rows, right_rows, merged_rows FROM s ORDER BY merged_rows DESC, k NULLS FIRST LIMIT 20",
    "merge_outer": """
        SELECT coalesce(a.account_id, b.account_id) AS account_id, holder, firm
        FROM (SELECT nullif(c_custkey, 5) AS account_id, c_name AS holder FROM customer) a
        FULL JOIN (SELECT nullif(s_suppkey, 7) AS account_id, s_name AS firm FROM supplier) b
          ON a.account_id IS NOT DISTINCT FROM b.account_id
    """,
    "merge_two_keys": """
        SELECT coalesce(a.id, b.id) AS id, coalesce(a.customer_id, b.customer_id) AS customer_id, revenue, priority
        FROM (SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS revenue FROM orders) a
        FULL JOIN (
            SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS customer_id,
                   o_orderpriority AS priority FROM orders
        ) b ON a.id = b.id AND a.customer_id = b.customer_id
    """,
    "merge_coalesce": """
        SELECT coalesce(a.id, b.id) AS id, coalesce(a.kind, b.kind) AS kind, coalesce(a.revenue, b.revenue) AS revenue
        FROM (
            SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS kind,
                   CASE WHEN c_acctbal > 0 THEN c_acctbal END AS revenue FROM customer
        ) a FULL JOIN (SELECT s_suppkey AS id, 'SUPPLIER' AS kind, s_acctbal AS revenue FROM supplier) b ON a.id = b.id
    """,
    "merge_wide_keys": f"""
        WITH a AS (SELECT CAST({_WIDE} AS VARCHAR) AS id, o_orderpriority AS priority FROM orders),
        b AS (SELECT CAST({_WIDE} AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O'),
        c AS (
            SELECT CAST(CAST(CAST({_WIDE} AS DOUBLE) AS HUGEINT) AS VARCHAR) AS id, o_custkey AS owner FROM orders
            WHERE CAST({_WIDE} AS DOUBLE) = 9007199254740992 + 2 * CAST(floor(o_custkey / 2) AS BIGINT)
        ),
        ab AS (SELECT coalesce(a.id, b.id) AS id, priority, status FROM a FULL JOIN b ON a.id = b.id)
        SELECT coalesce(ab.id, c.id) AS id, priority, status, owner FROM ab FULL JOIN c ON ab.id = c.id
    """,
    "linked_wide_keys": """
        SELECT 'id' AS key_column, count(DISTINCT o_orderkey) AS linked FROM orders WHERE o_orderstatus <> 'O'
    """,
    "merge_union": """
        SELECT c_name AS customer_name, c_acctbal AS revenue, n_name AS city, CAST(NULL AS INTEGER) AS nation
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier
    """,
    "merge_fold": _FOLD,
    "merge_order": """
        SELECT coalesce(o_custkey, s_suppkey) AS customer_id, o_orderkey AS order_no,
               row_number() OVER (ORDER BY coalesce(o_custkey, s_suppkey) NULLS LAST, o_orderkey, s_suppkey) AS position
        FROM orders FULL JOIN supplier ON s_suppkey = o_custkey
    """,
    "linked_keys": f"SELECT 'customer_id' AS key_column, CAST({_LINKED} AS BIGINT) AS linked",
    "multi_file_stats": f"""
        SELECT linked AS cross_file_matches, linked AS linked_entities, greatest(0, n - linked) AS unmatched_entities
        FROM (SELECT CAST({_LINKED} AS BIGINT) AS linked, (SELECT count(*) FROM ({_FOLD})) AS n)
    """,
    "cross_file_graph": f"""
        SELECT 'entity_' || CAST(j AS VARCHAR) AS id, 'Linked Profile' AS label, 'cross_file_link' AS target
        FROM range(0, least(5, {_LINKED})) t(j)
    """,
}
