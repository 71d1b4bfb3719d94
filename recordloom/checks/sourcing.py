"""Sources, sinks and flattening: write whole tables, read them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import table
from recordloom.durable import shared_folder
from recordloom.functions.cells import safe_file_name
from recordloom.sources import readers, sinks
from recordloom.sources.flatten import flatten, normalise


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/recordloom/{name}-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def roundtrip_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "orders") + ".csv"
    written = _orders(spark, folder)
    sinks.write_csv(written, path)
    return readers.read_csv(spark, path, written.schema)


def roundtrip_json(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "orders") + ".json"
    sinks.write_json(normalise(_orders(spark, folder)), path)
    return readers.read_table(spark, path, lines=True)


def _xml_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders nested as attribute, element with attribute and text, and plain elements."""
    return normalise(_orders(spark, folder)).select(
        F.col("o_orderkey").alias("@key"),
        F.struct(F.col("o_custkey").alias("@no"), F.col("o_orderstatus").alias("#text")).alias("customer"),
        F.col("o_totalprice").cast("decimal(20,2)").alias("price"),
        F.col("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )


def _xml_texts(df: DataFrame) -> DataFrame:
    names = {"@key": "order_key", "customer.@no": "customer_no", "customer.#text": "status", "price": "price", "day": "day", "priority": "priority"}
    return df.select(*[F.col(f"`{n}`").alias(to) for n, to in names.items()])


def roundtrip_xml(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "orders") + ".xml"
    writer = _xml_orders(spark, folder).write.format("xml").option("rowTag", "order").option("attributePrefix", "@").option("valueTag", "#text")
    writer.save(path)
    return _xml_texts(readers.read_table(spark, path, row_tag="order"))


def _typed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with days, and with markers in place of some cells."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 7 == 0, "N/A").otherwise(F.col("o_custkey").cast("string")).alias("owner"),
        F.when(F.col("o_orderkey") % 5 == 0, "NULL").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.col("o_orderstatus") == "F").alias("final"),
        "o_orderpriority",
    )


def read_csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Markers become missing values, days stay text, types fit whole columns."""
    path = _fresh(spark, "orders") + ".csv"
    sinks.write_csv(_typed_orders(spark, folder), path)
    return readers.read_table(spark, path)


def csv_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with their line breaks, as cells; read as any CSV file is."""
    path = _fresh(spark, "documents") + ".csv"
    sinks.write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return readers.read_table(spark, path)


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each customer's orders and one for each supplier, with lists of different names."""
    path = _fresh(spark, "documents") + ".json"
    bought = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("bought"))
    made = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("no"), F.array(F.struct("s_suppkey", "s_name"), F.struct("s_suppkey", F.lower("s_name").alias("s_name"))).alias("names")
    )
    wanted = bought.select(F.to_json(F.struct("o_custkey", "bought")).alias("value")).unionByName(made.select(F.to_json(F.struct("no", "names")).alias("value")))
    wanted.write.text(path)
    return readers.read_documents(spark.read.text(path), spark.read.json(path).schema)


def json_array(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as one array in each file, read without stating a schema."""
    path = _fresh(spark, "arrays") + ".json"

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = []
            for text in batch.column("value").to_pylist():
                lines.append(mark + text)
                mark = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]" if mark == "[" else "]"], pa.string())})

    rows = normalise(_orders(spark, folder))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(bracketed, "value string").write.text(path)
    return readers.read_json(spark, path)


def xml_detected(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "orders") + ".xml"
    writer = _xml_orders(spark, folder).write.format("xml").option("rowTag", "order").option("attributePrefix", "@").option("valueTag", "#text")
    writer.save(path)
    return _xml_texts(readers.read_table(spark, path))


def input_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What reading says to files of given endings and to an empty one."""
    base = _fresh(spark, "checks")
    rows = table(spark, folder, "lineitem")
    sinks.write_csv(rows, f"{base}/full.csv")
    sinks.write_csv(rows.limit(0), f"{base}/empty.csv")
    said = []
    for name in ("full.csv", "empty.csv", "other.xls", "other.txt"):
        try:
            said.append((name, f"{readers.read_table(spark, f'{base}/{name}').count()} rows"))
        except ValueError as error:
            said.append((name, str(error).replace(f"{base}/", "")))
    return spark.createDataFrame(said, "file string, said string")


def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", F.from_json("props", "k bigint").alias("props"))
    return normalise(flatten(events))


def value_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios, some of them infinite or undefined, become plain values."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("nan"))
        .otherwise(F.col("l_extendedprice")).alias("ratio"),
        "l_shipdate",
    )
    return normalise(lines)


def registry_append(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "projects")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("project_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("project_name"),
        F.col("o_orderkey").alias("total_records"),
        "o_orderstatus",
    )
    sinks.append_rows(rows.filter("o_orderstatus = 'F'"), path, sinks.PROJECTS)
    sinks.append_rows(rows.filter("o_orderstatus <> 'F'"), path, sinks.PROJECTS)
    return sinks.read_registry(spark, path, sinks.PROJECTS).select(
        "project_id", "user_id", "project_name", "total_records", "quality_score"
    )


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select("page_id", safe_file_name(F.col("url")).alias("file_name"))


QUERIES = {
    "roundtrip_csv": roundtrip_csv,
    "roundtrip_json": roundtrip_json,
    "roundtrip_xml": roundtrip_xml,
    "read_csv_inferred": read_csv_inferred,
    "csv_line_breaks": csv_line_breaks,
    "json_documents": json_documents,
    "json_array": json_array,
    "xml_detected": xml_detected,
    "input_checks": input_checks,
    "json_flatten": json_flatten,
    "value_normalise": value_normalise,
    "registry_append": registry_append,
    "file_names": file_names,
}

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_DAY = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g')"
_JSON_ORDERS = f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_DAY} AS o_orderdate, o_orderpriority FROM orders"
_XML_ORDERS = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS customer_no, o_orderstatus AS status,
           CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) AS price, {_DAY} AS day, o_orderpriority AS priority
    FROM orders
"""
_MARKS = ", ".join(f"'{m}'" for m in readers.NULL_MARKERS)

SQL = {
    "roundtrip_csv": _ORDERS,
    "roundtrip_json": _JSON_ORDERS,
    "roundtrip_xml": _XML_ORDERS,
    "read_csv_inferred": """
        SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS owner,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day,
               o_orderstatus = 'F' AS final, o_orderpriority
        FROM orders
    """,
    "csv_line_breaks": f"""
        SELECT doc_id, {', '.join(f"CASE WHEN {c} NOT IN ({_MARKS}) THEN {c} END AS {c}" for c in ('text', 'lang', 'source'))}, n_chars FROM documents
    """,
    "json_documents": """
        SELECT o_orderkey, o_totalprice, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name FROM orders
        UNION ALL SELECT NULL, NULL, s_suppkey, s_name FROM supplier
        UNION ALL SELECT NULL, NULL, s_suppkey, lower(s_name) FROM supplier
    """,
    "json_array": _JSON_ORDERS,
    "xml_detected": _XML_ORDERS,
    "input_checks": """
        SELECT 'full.csv' AS file, CAST(count(*) AS VARCHAR) || ' rows' AS said FROM lineitem
        UNION ALL VALUES ('empty.csv', 'The file empty.csv contains no data rows'),
        ('other.xls', 'Unsupported file format: other.xls'), ('other.txt', 'Unsupported file format: other.txt')
    """,
    "json_flatten": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts, CAST(props->>'k' AS BIGINT) AS "props.k" FROM events
    """,
    "value_normalise": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN l_extendedprice END AS ratio,
               strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') AS l_shipdate
        FROM lineitem
    """,
    "registry_append": """
        SELECT CAST(o_orderkey AS VARCHAR) AS project_id, CAST(o_custkey AS VARCHAR) AS user_id,
               o_orderpriority AS project_name, CAST(o_orderkey AS INTEGER) AS total_records,
               CAST(NULL AS INTEGER) AS quality_score
        FROM orders
    """,
    "file_names": r"""
        SELECT page_id, CASE WHEN n = '' THEN 'report' ELSE n END AS file_name
        FROM (SELECT page_id, rtrim(regexp_replace(url, '[^\p{L}\p{N} _-]', '', 'g')) AS n FROM pages)
    """,
}
