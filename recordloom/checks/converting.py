"""The whole flow on customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import table
from recordloom.plans.convert import Conversion, convert


def _converted(spark: SparkSession, folder: str) -> Conversion:
    """Customers with their city, and orders, under the column names of two departments."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    people = table(spark, folder, "customer").join(nation, "c_nationkey", "left").select(
        F.col("c_custkey").alias("customerID"),
        F.col("c_name").alias("Client Name"),
        "city",
        F.col("c_acctbal").alias("account_balance"),
    )
    bought = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("client id"), F.col("o_totalprice").alias("rev"), F.col("o_orderpriority").alias("priority")
    )
    return convert(spark, {"customers": people, "orders": bought})


def convert_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _converted(spark, folder).catalog.withColumn("sample_values", F.array_join("sample_values", "|"))


def convert_records(spark: SparkSession, folder: str) -> DataFrame:
    return _converted(spark, folder).public_records()


QUERIES = {"convert_catalog": convert_catalog, "convert_records": convert_records}

# Order numbers are the order of the rows in the orders table.
_RECORDS = """
    SELECT printf('ENT%04d', row_number() OVER (ORDER BY c_custkey)) AS entity_id, c_custkey AS customer_id,
           c_name AS customer_name, n_name AS city, c_acctbal AS account_balance, revenue, priority
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN (
        SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS revenue, arg_min(o_orderpriority, o_orderkey) AS priority
        FROM orders GROUP BY o_custkey
    ) ON o_custkey = c_custkey
"""
_COLUMNS = [
    ("customer_id", "int64", "Unique identifier for customer"),
    ("customer_name", "object", "Full name of the customer"),
    ("city", "object", "City of residence"),
    ("account_balance", "float64", "Current balance in the account"),
    ("revenue", "float64", "Monetary value associated with customer"),
    ("priority", "object", "Data column representing priority"),
]

SQL = {
    "convert_catalog": f"WITH f AS ({_RECORDS}) " + " UNION ALL ".join(
        f"""
        SELECT CAST({no} AS INTEGER) AS column_no, '{name}' AS column_name, '{kind}' AS data_type,
               (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY k)
                FROM (SELECT {name} AS v, customer_id AS k FROM f WHERE {name} IS NOT NULL ORDER BY k LIMIT 3)) AS sample_values,
               round(100.0 * count(*) FILTER ({name} IS NULL) / count(*), 2) AS null_percentage,
               count(DISTINCT {name}) AS unique_values, '{text}' AS description
        FROM f"""
        for no, (name, kind, text) in enumerate(_COLUMNS)
    ),
    "convert_records": _RECORDS,
}
