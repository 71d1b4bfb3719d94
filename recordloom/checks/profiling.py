"""Catalogue, quality, insights, duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks import merging
from recordloom.checks.tables import CUSTOMERS, JUDGED, customers, judged_documents, orders, table
from recordloom.functions.rows import ORD
from recordloom.operators import merge, profile, quality, resolve


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return profile.data_catalog(customers(spark, folder)).withColumn(
        "sample_values", F.array_join("sample_values", "|")
    )


def null_pct(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_stats(judged_documents(spark, folder), distinct=None).select(
        "column_name", "data_type", "nulls", "null_percentage"
    )


def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_stats(table(spark, folder, "lineitem")).select("column_name", "unique_values")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("event_id").alias(ORD),
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.nullif("user_id", F.lit(8)).alias("user_id"),
        "value",
        "props",
    )
    return profile.samples(events).withColumn("sample_values", F.array_join("sample_values", "|"))


def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    facts = quality.missing_fields(judged_documents(spark, folder), "all").withColumn("conflicts_detected", F.lit(3))
    return quality.quality_scores(facts).drop("conflicts_detected")


def _orders_with_ids(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).withColumn("customer_id", F.concat(F.lit("C"), "customer_id"))


def trust_report(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve.resolve(_orders_with_ids(spark, folder))
    return quality.trust_report(found.records, found.report)


def avg_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return profile.average_revenue(customers(spark, folder)).select(F.round("average", 4).alias("average"), "shown")


def most_common_place(spark: SparkSession, folder: str) -> DataFrame:
    return profile.most_common_place(customers(spark, folder))


def insights(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve.resolve(_orders_with_ids(spark, folder))
    people = customers(spark, folder)
    tables = merging._three(spark, folder)
    stats = merge.multi_file_stats(tables, merge.merge(tables))
    return profile.insights(people, found.report, quality.missing_fields(judged_documents(spark, folder), "all"), stats)


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    phones = customers(spark, folder).withColumn("phone_number", F.concat(F.lit("P"), "customer_id"))
    return profile.recommendations(phones)


def revenue_total(spark: SparkSession, folder: str) -> DataFrame:
    return profile.revenue_total(table(spark, folder, "lineitem").withColumnRenamed("l_extendedprice", "Revenue"))


def duplicate_rows_count(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_rows_count(table(spark, folder, "documents").select("text", "lang"))


def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return profile.duplicate_rows(documents, exclude=("doc_id",)).select("doc_id", "lang", F.length("text").alias("length"))


def duplicate_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return profile.duplicate_rows(lines, exclude=("l_orderkey",)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


QUERIES = {
    "catalog": catalog,
    "null_pct": null_pct,
    "distinct_counts": distinct_counts,
    "samples": samples,
    "quality_score": quality_score,
    "trust_report": trust_report,
    "avg_revenue": avg_revenue,
    "most_common_place": most_common_place,
    "insights": insights,
    "recommendations": recommendations,
    "revenue_total": revenue_total,
    "duplicate_rows_count": duplicate_rows_count,
    "duplicate_rows": duplicate_rows,
    "duplicate_lines": duplicate_lines,
}


def _catalog_sql() -> str:
    columns = [
        ("customer_id", "int64", "Unique identifier for customer"),
        ("customer_name", "object", "Full name of the customer"),
        ("city", "object", "City of residence"),
        ("revenue", "float64", "Monetary value associated with customer"),
        ("segment", "object", "Data column representing segment"),
    ]
    parts = [
        f"""
        SELECT {no} AS column_no, '{name}' AS column_name, '{kind}' AS data_type,
               (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY k)
                FROM (SELECT {name} AS v, customer_id AS k FROM c WHERE {name} IS NOT NULL ORDER BY k LIMIT 3)) AS sample_values,
               round(100.0 * count(*) FILTER ({name} IS NULL) / count(*), 2) AS null_percentage,
               count(DISTINCT {name}) AS unique_values, '{text}' AS description
        FROM c"""
        for no, (name, kind, text) in enumerate(columns)
    ]
    return f"WITH c AS ({CUSTOMERS}) " + " UNION ALL ".join(parts)


def _null_sql() -> str:
    kinds = {"doc_id": "int64", "text": "object", "lang": "object", "source": "object", "n_chars": "int64", "quality": "int64", "toxic": "int64"}
    parts = []
    for name, kind in kinds.items():
        shown = f"CASE WHEN count(*) > count({name}) THEN 'float64' ELSE 'int64' END" if kind == "int64" else "'object'"
        parts.append(
            f"""SELECT '{name}' AS column_name, {shown} AS data_type, count(*) - count({name}) AS nulls,
                round(100.0 * (count(*) - count({name})) / count(*), 2) AS null_percentage FROM j"""
        )
    return f"WITH j AS ({JUDGED}) " + " UNION ALL ".join(parts)


_MISSING = f"""
    SELECT count(*) * 7 AS total_fields,
           CAST(sum((quality IS NULL)::INT + (toxic IS NULL)::INT + (coalesce(trim(lang), '') = '')::INT
               + (coalesce(trim(text), '') = '')::INT
               + (coalesce(trim(source), '') = '')::INT + (n_chars IS NULL)::INT) AS BIGINT) AS missing_values
    FROM ({JUDGED})
"""
_FIRSTS = """
    SELECT *, first_value(o_totalprice) OVER w AS p0, first_value(o_orderstatus) OVER w AS s0, first_value(o_orderkey) OVER w AS k0
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
"""
_CONFLICTS = f"""
    (SELECT sum((o_totalprice <> p0)::INT + (o_orderstatus <> s0)::INT + (o_orderkey <> k0)::INT) FROM ({_FIRSTS}))
"""

SQL = {
    "catalog": _catalog_sql(),
    "null_pct": _null_sql(),
    "distinct_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(DISTINCT {n}) AS unique_values FROM lineitem"
        for n in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate",
        )
    ),
    "samples": " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY event_id) FROM (
                SELECT event_id, {cell} AS v FROM events WHERE {cell} IS NOT NULL ORDER BY event_id LIMIT 3)) AS sample_values"""
        for name, cell in (
            ("event_type", "nullif(event_type, 'error')"), ("user_id", "CAST(nullif(user_id, 8) AS DOUBLE)"), ("value", "value"), ("props", "props"),
        )
    ),
    "quality_score": f"""
        SELECT total_fields, missing_values,
               CAST(floor(greatest(0, 100 - 100.0 * missing_values / total_fields)) AS BIGINT) AS completeness_score,
               CAST(94 AS BIGINT) AS consistency_score, CAST(100 AS BIGINT) AS duplicate_score,
               CAST(floor(greatest(0, 100 - 100.0 * missing_values / total_fields - 6)) AS BIGINT) AS final_score
        FROM ({_MISSING})
    """,
    "trust_report": f"""
        SELECT 100 - least(20, 2 * c) AS quality_score, CAST(100 AS BIGINT) AS completeness_score,
               100 - least(20, 2 * c) AS consistency_score, CAST(100 AS BIGINT) AS duplicate_score,
               100 - least(20, 2 * c) AS final_score, 4 * e AS total_fields, CAST(0 AS BIGINT) AS missing_values,
               n - e AS duplicates_merged, c AS conflicts_detected
        FROM (SELECT CAST({_CONFLICTS} AS BIGINT) AS c, count(*) AS n, count(DISTINCT o_custkey) AS e FROM orders)
    """,
    "avg_revenue": """
        SELECT round(avg(c_acctbal), 4) AS average, format('₹{:,.2f}', avg(c_acctbal)) AS shown FROM customer
    """,
    "most_common_place": f"""
        SELECT 'city' AS column_name, city AS value, count(*) AS n FROM ({CUSTOMERS})
        GROUP BY city ORDER BY n DESC, min(customer_id) LIMIT 1
    """,
    "insights": f"""
        WITH linked AS (SELECT * FROM ({merging.SQL["multi_file_stats"]}))
        SELECT CAST(1 AS INTEGER) AS seq, '✓ ' || count(*) || ' unique records identified' AS insight FROM customer
        UNION ALL SELECT 2, '✓ ' || (count(*) - count(DISTINCT o_custkey)) || ' duplicate records merged' FROM orders
        UNION ALL SELECT 3, '✓ Missing values detected: ' || missing_values FROM ({_MISSING})
        UNION ALL SELECT 4, '✓ Number of linked entities: ' || linked_entities FROM linked
        UNION ALL SELECT 5, '✓ Number of cross-file relationships: ' || linked_entities FROM linked
        UNION ALL SELECT 6, '✓ Number of unmatched entities: ' || unmatched_entities FROM linked
        UNION ALL SELECT 7, '✓ Revenue column available'
        UNION ALL SELECT 8, '✓ Average revenue: ' || format('₹{{:,.2f}}', avg(c_acctbal)) FROM customer
        UNION ALL SELECT 9, '✓ Most common city: ' || (
            SELECT city FROM ({CUSTOMERS}) GROUP BY city ORDER BY count(*) DESC, min(customer_id) LIMIT 1)
    """,
    "recommendations": """
        SELECT CAST(seq AS INTEGER) AS seq, recommendation FROM (VALUES
            (1, 'Phone number is a strong entity key'), (2, 'Customer ID should be primary key'),
            (3, 'Revenue column suitable for analytics'), (4, 'Consider standardizing city names')
        ) v(seq, recommendation) WHERE (SELECT count(*) FROM customer) > 0
    """,
    "revenue_total": """
        SELECT 'Revenue' AS column_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM lineitem
    """,
    "duplicate_rows_count": """
        SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows
        FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1)
    """,
    "duplicate_rows": """
        SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS length
        FROM (SELECT *, count(*) OVER (PARTITION BY text, lang) AS n FROM documents) WHERE n > 1
    """,
    "duplicate_lines": """
        SELECT l_returnflag, count(*) AS n FROM (
            SELECT l_returnflag, count(*) OVER (PARTITION BY l_linenumber, l_quantity, l_returnflag) AS n FROM lineitem
        ) WHERE n > 1 GROUP BY l_returnflag
    """,
}
