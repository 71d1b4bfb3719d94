"""The given tables under canonical column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.rows import ORD


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their nation as city; ``_ord`` is the customer number."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return (
        table(spark, folder, "customer")
        .join(nation, "c_nationkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            "city",
            F.col("c_acctbal").alias("revenue"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_custkey").alias(ORD),
        )
    )


CUSTOMERS = """
    SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS city,
           c_acctbal AS revenue, c_mktsegment AS segment
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
"""


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders; ``_ord`` is the order number."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_no"),
        F.col("o_totalprice").alias("revenue"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias(ORD),
    )


def judged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels, where they have any."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


JUDGED = """
    SELECT d.doc_id, text, lang, source, n_chars, quality, toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
