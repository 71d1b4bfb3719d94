"""Search, filters, paging, counts, top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import CUSTOMERS, JUDGED, customers, judged_documents, table
from recordloom.functions.cells import text_of
from recordloom.functions.rows import ORD
from recordloom.operators import explore


def explore_search(spark: SparkSession, folder: str) -> DataFrame:
    return explore.search(table(spark, folder, "customer"), "BUILD|#0{6}1[0-4]|99")


def explore_search_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return explore.search(documents, r"licen[sc]e|copyright|\bund\b").select("doc_id", "lang", "source")


def explore_sort_page(spark: SparkSession, folder: str) -> DataFrame:
    return explore.page(table(spark, folder, "orders"), 3, 100, "o_totalprice", "desc", ties=["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


def explore_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page far back in the largest table, sorted by a column with many equal values, downwards."""
    lines = table(spark, folder, "lineitem")
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return explore.page(lines, 91, 500, "l_quantity", "desc", ties=ties).select("l_quantity", *ties)


def explore_page_count(spark: SparkSession, folder: str) -> DataFrame:
    return explore.page_count(explore.search(table(spark, folder, "orders"), "urgent"), 100)


def filter_revenue_gt(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("revenue")
    )
    return explore.greater_than(lines, "revenue", 90000)


def filter_value(spark: SparkSession, folder: str) -> DataFrame:
    return explore.has_value(customers(spark, folder).drop(ORD), "city", "nation_7")


def rows_missing(spark: SparkSession, folder: str) -> DataFrame:
    return explore.with_missing(judged_documents(spark, folder))


def filter_owner(spark: SparkSession, folder: str) -> DataFrame:
    return explore.equals(table(spark, folder, "orders"), o_custkey=42, o_orderstatus="F").select(
        "o_orderkey", "o_totalprice"
    )


def count_by_city(spark: SparkSession, folder: str) -> DataFrame:
    return explore.count_by(customers(spark, folder), "city")


def count_rows(spark: SparkSession, folder: str) -> DataFrame:
    return explore.count_rows(table(spark, folder, "lineitem"))


def top_n_by_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top_n(customers(spark, folder), "revenue", 5).drop(ORD)


def cell_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("scaled", F.col("l_extendedprice") * 1024)
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        text_of(lines, "scaled").alias("scaled_text"),
        text_of(lines, "l_discount").alias("discount_text"),
        text_of(lines, "l_shipdate").alias("ship_text"),
    )


QUERIES = {
    "explore_search": explore_search,
    "explore_search_text": explore_search_text,
    "explore_sort_page": explore_sort_page,
    "explore_deep_page": explore_deep_page,
    "explore_page_count": explore_page_count,
    "filter_revenue_gt": filter_revenue_gt,
    "filter_value": filter_value,
    "rows_missing": rows_missing,
    "filter_owner": filter_owner,
    "count_by_city": count_by_city,
    "count_rows": count_rows,
    "top_n_by_revenue": top_n_by_revenue,
    "cell_text": cell_text,
}

# Word boundaries are those of all letters, which this engine must be told.
_WORDS = r"licen[sc]e|copyright|(^|[^\p{L}\p{N}_])und($|[^\p{L}\p{N}_])"
_FOUND = "build|#0{6}1[0-4]|99"

SQL = {
    "explore_search": f"""
        SELECT * FROM customer
        WHERE regexp_matches(lower(CAST(c_custkey AS VARCHAR)), '{_FOUND}')
           OR regexp_matches(lower(c_name), '{_FOUND}')
           OR regexp_matches(lower(CAST(c_nationkey AS VARCHAR)), '{_FOUND}')
           OR regexp_matches(lower(CAST(c_acctbal AS VARCHAR)), '{_FOUND}')
           OR regexp_matches(lower(c_mktsegment), '{_FOUND}')
    """,
    "explore_search_text": f"""
        SELECT doc_id, lang, source FROM documents
        WHERE regexp_matches(CAST(doc_id AS VARCHAR), '{_WORDS}') OR regexp_matches(lower(text), '{_WORDS}')
           OR regexp_matches(lower(lang), '{_WORDS}') OR regexp_matches(lower(source), '{_WORDS}')
    """,
    "explore_sort_page": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
        ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200
    """,
    "explore_deep_page": """
        SELECT l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
        ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 500 OFFSET 45000
    """,
    "explore_page_count": """
        SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 100) AS BIGINT)) AS pages
        FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%'
    """,
    "filter_revenue_gt": """
        SELECT l_orderkey, l_linenumber, l_extendedprice AS revenue FROM lineitem WHERE l_extendedprice > 90000
    """,
    "filter_value": f"SELECT * FROM ({CUSTOMERS}) WHERE lower(city) = 'nation_7'",
    "rows_missing": f"""
        SELECT * FROM ({JUDGED})
        WHERE text IS NULL OR trim(text) = '' OR quality IS NULL OR toxic IS NULL OR lang IS NULL OR trim(lang) = '' OR source IS NULL
           OR trim(source) = '' OR n_chars IS NULL OR doc_id IS NULL
    """,
    "filter_owner": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'F'",
    "count_by_city": f"SELECT city, count(*) AS n FROM ({CUSTOMERS}) GROUP BY city",
    "count_rows": "SELECT count(*) AS n FROM lineitem",
    "top_n_by_revenue": f"SELECT * FROM ({CUSTOMERS}) ORDER BY revenue DESC NULLS LAST, customer_id LIMIT 5",
    "cell_text": """
        SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * 1024 AS VARCHAR) AS scaled_text,
               CAST(l_discount AS VARCHAR) AS discount_text,
               strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') AS ship_text
        FROM lineitem
    """,
}
