"""Column-name matching on names found in the tables, renaming, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.checks.tables import table
from recordloom.operators import profile, schema_match


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct value that could stand as a column name."""
    sources = [
        ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment"),
        ("supplier", "s_name"), ("nation", "n_name"), ("orders", "o_orderpriority"), ("events", "event_type"),
        ("events", "props"), ("conversations", "role"), ("documents", "source"), ("pages", "url"),
    ]
    values = [table(spark, folder, t).select(F.col(c).alias("original_column")) for t, c in sources]
    return reduce(DataFrame.unionByName, values).distinct()


_NAMES = " UNION ".join(
    f"SELECT {c} AS original_column FROM {t}"
    for t, c in [
        ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment"),
        ("supplier", "s_name"), ("nation", "n_name"), ("orders", "o_orderpriority"), ("events", "event_type"),
        ("events", "props"), ("conversations", "role"), ("documents", "source"), ("pages", "url"),
    ]
)


def name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    tokens = schema_match.name_tokens(F.col("original_column"))
    return names.select(
        "original_column",
        F.array_join(tokens, "|").alias("tokens"),
        F.array_join(schema_match.expand_synonyms(tokens), "|").alias("expanded"),
    )


def schema_report(spark: SparkSession, folder: str) -> DataFrame:
    return schema_match.schema_report(_names(spark, folder)).withColumn("confidence", F.round("confidence", 6))


def match_words(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct word of all documents as a column name; how many map where."""
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("original_column"))
    matched = schema_match.match_names(schema_match.spread(words.distinct()))
    return matched.groupBy("match_type", F.when(F.col("match_type") != "Unmapped", F.col("canonical_column")).alias("target")).agg(
        F.count("*").alias("n"), F.round(F.max("confidence_score"), 6).alias("highest")
    )


def rename_auto(spark: SparkSession, folder: str) -> DataFrame:
    source = table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "ClientID", "c_acctbal": "rev"})
    renamed, _ = schema_match.rename_auto(spark, {"customer": source})
    return renamed["customer"]


def rename_manual(spark: SparkSession, folder: str) -> DataFrame:
    mapping = {"o_custkey": "customer_id", "o_totalprice": "revenue", "o_orderdate": "ignore", "o_orderstatus": ""}
    renamed, _ = schema_match.rename_manual(spark, {"orders": table(spark, folder, "orders")}, mapping)
    return renamed["orders"]


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("template_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("T"), "o_orderkey").alias("template_name"),
        F.create_map("o_orderstatus", F.lit("status"), "o_orderpriority", F.lit("priority")).alias("mapping"),
        F.col("o_orderdate").alias("created_at"),
    )


_COLUMNS = ["F", "O", "1-URGENT", "5-LOW", "other"]


def template_match(spark: SparkSession, folder: str) -> DataFrame:
    return schema_match.best_template(_templates(spark, folder), _COLUMNS).drop("mapping")


def template_list(spark: SparkSession, folder: str) -> DataFrame:
    return schema_match.template_list(_templates(spark, folder)).select(
        "template_id", "user_id", "template_name", "mappings_count"
    )


def describe_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    return names.select("original_column", profile.describe_column(F.col("original_column")).alias("description"))


QUERIES = {
    "name_tokens": name_tokens,
    "schema_report": schema_report,
    "match_words": match_words,
    "rename_auto": rename_auto,
    "rename_manual": rename_manual,
    "template_match": template_match,
    "template_list": template_list,
    "describe_columns": describe_columns,
}

_SNAKE = r"""
    trim(lower(regexp_replace(regexp_replace(original_column, '([a-z])([A-Z])', '\1_\2', 'g'), '[^\p{L}\p{N}_]+', '_', 'g')), '_')
"""
_SYNONYM_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in schema_match.SYNONYMS.items())
_TEMPLATE_SCORE = """
    CAST(floor(((o_orderstatus IN ('F', 'O'))::INT + (o_orderpriority IN ('1-URGENT', '5-LOW'))::INT) / 5.0 * 100) AS BIGINT)
"""

_ALIAS_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in schema_match.ALIASES.items())
_TARGETS = ", ".join(f"'{t}'" for t in sorted(set(schema_match.ALIASES.values())))
_CANONICAL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(schema_match.CANONICAL))

# The matching blocks of two names: the longest common piece, then the same to its left and right.
_ANSWERS = f"""
    WITH RECURSIVE tokens AS (
        SELECT original_column, snake, regexp_replace(lower(original_column), '[\\s_]+', '', 'g') AS key,
               list_transform(string_split(snake, '_'), lambda t: CASE t {_SYNONYM_CASE} ELSE t END) AS words
        FROM (SELECT original_column, {_SNAKE} AS snake FROM (NAMES))
    ), named AS (
        SELECT *, array_to_string(words, '_') AS name,
               coalesce(CASE key {_ALIAS_CASE} END, CASE WHEN snake IN ({_TARGETS}) OR key IN ({_TARGETS}) THEN snake END) AS known
        FROM tokens
    ), walk AS (
        SELECT DISTINCT name, target, name AS a, target AS b, 0 AS size
        FROM named, (VALUES {_CANONICAL}) c(no, target) WHERE known IS NULL
        UNION ALL
        SELECT name, target, piece.a, piece.b, piece.size FROM (
            SELECT name, target, unnest([
                {{'a': left(a, i - 1), 'b': left(b, instr(b, substr(a, i, s)) - 1), 'size': s}},
                {{'a': substr(a, i + s), 'b': substr(b, instr(b, substr(a, i, s)) + s), 'size': 0}}]) AS piece
            FROM (
                SELECT name, target, a, b, best.s AS s, -best.i AS i FROM (
                    SELECT name, target, a, b, list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i:
                        list_transform(range(1, least(length(a) - i + 1, length(b)) + 1), lambda s: {{'s': s, 'i': -i}}))),
                        lambda c: contains(b, substr(a, -c.i, c.s)))) AS best
                    FROM walk WHERE a <> '' AND b <> ''
                ) WHERE best IS NOT NULL
            )
        )
    ), ratios AS (
        SELECT name, target, 2.0 * sum(size) / (length(name) + length(target)) AS ratio FROM walk GROUP BY name, target
    ), scored AS (
        SELECT original_column, snake, known, target, no,
               CAST(ratio AS DOUBLE) + CASE WHEN shared > 0 THEN shared / greatest(length(words), length(parts)) * 0.3 ELSE 0 END AS score
        FROM (
            SELECT n.*, r.target, r.ratio, c.no, string_split(r.target, '_') AS parts,
                   length(list_intersect(list_distinct(n.words), string_split(r.target, '_'))) AS shared
            FROM named n JOIN ratios r ON r.name = n.name JOIN (VALUES {_CANONICAL}) c(no, target) ON c.target = r.target
            WHERE n.known IS NULL
        )
    ), best AS (
        SELECT original_column, snake, arg_min(target, (-score, no)) AS target, least(0.99, max(score)) AS score
        FROM scored GROUP BY original_column, snake
    ), answers AS (
        SELECT original_column, CASE WHEN score >= 0.55 THEN target ELSE 'ignore' END AS suggested,
               CASE WHEN score >= 0.55 THEN score ELSE greatest(0.1, score - 0.2) END AS confidence,
               CASE WHEN score >= 0.55 THEN 'AI Suggested' ELSE 'Unmapped' END AS match_type
        FROM best
        UNION ALL SELECT original_column, known, 1.0, 'Dictionary Match' FROM named WHERE known IS NOT NULL
    )
"""
_REPORT = _ANSWERS.replace("NAMES", _NAMES) + """
    SELECT original_column, suggested, round(CAST(confidence AS DOUBLE), 6) AS confidence, match_type,
           CASE WHEN confidence >= 0.8 THEN 'success' WHEN confidence >= 0.5 THEN 'warning' ELSE 'danger' END AS badge
    FROM answers
"""

_WORDS = "SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS original_column FROM documents"

SQL = {
    "schema_report": _REPORT,
    "match_words": _ANSWERS.replace("NAMES", _WORDS) + """
        SELECT match_type, CASE WHEN match_type <> 'Unmapped' THEN suggested END AS target, count(*) AS n,
               round(CAST(max(confidence) AS DOUBLE), 6) AS highest
        FROM answers GROUP BY ALL
    """,
    "name_tokens": f"""
        SELECT original_column, replace(snake, '_', '|') AS tokens,
               array_to_string(list_transform(string_split(snake, '_'), lambda t: CASE t {_SYNONYM_CASE} ELSE t END), '|') AS expanded
        FROM (SELECT original_column, {_SNAKE} AS snake FROM ({_NAMES}))
    """,
    "rename_auto": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey, c_acctbal AS revenue, c_mktsegment FROM customer
    """,
    "rename_manual": """
        SELECT o_orderkey, o_custkey AS customer_id, o_orderstatus, o_totalprice AS revenue, o_orderdate, o_orderpriority FROM orders
    """,
    "template_match": f"""
        SELECT user_id, template_id, template_name, match_score FROM (
            SELECT o_custkey AS user_id, o_orderkey AS template_id, 'T' || o_orderkey AS template_name,
                   {_TEMPLATE_SCORE} AS match_score,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY {_TEMPLATE_SCORE} DESC, o_orderdate, o_orderkey) AS r
            FROM orders
        ) WHERE r = 1 AND match_score >= 30
    """,
    "template_list": """
        SELECT o_orderkey AS template_id, o_custkey AS user_id, 'T' || o_orderkey AS template_name,
               CAST(2 AS INTEGER) AS mappings_count FROM orders
    """,
    "describe_columns": f"""
        SELECT original_column, 'Data column representing ' || replace(original_column, '_', ' ') AS description FROM ({_NAMES})
    """,
}
