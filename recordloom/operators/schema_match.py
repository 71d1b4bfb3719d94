"""Map column names to the canonical schema, and rename tables accordingly."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.cells import col, quoted, text_sql
from recordloom.functions.rows import ORD

# Known spellings of a column name, without spaces and underscores.
ALIASES = {
    "customerid": "customer_id",
    "clientid": "customer_id",
    "custname": "customer_name",
    "clientname": "customer_name",
    "phone": "phone_number",
    "mobile": "phone_number",
    "contact": "phone_number",
    "phoneservice": "phone_service",
    "monthlycharge": "revenue",
}

# The canonical schema, in the order in which ties are decided.
CANONICAL = (
    "customer_id",
    "customer_name",
    "phone_number",
    "phone_service",
    "revenue",
    "address",
    "email_address",
    "date_of_birth",
)

# Words that mean the same in column names.
SYNONYMS = {
    "cust": "customer",
    "client": "customer",
    "usr": "user",
    "no": "number",
    "num": "number",
    "ref": "id",
    "identifier": "id",
    "mobile": "phone",
    "cell": "phone",
    "contact": "phone",
    "addr": "address",
    "loc": "address",
    "mail": "email",
    "dob": "date_of_birth",
    "rev": "revenue",
    "charge": "revenue",
    "amt": "amount",
}

# Weights and limits of the similarity rule.
OVERLAP_WEIGHT = 0.3
HIGHEST_SUGGESTED = 0.99
ACCEPTED = 0.55
UNMAPPED_DISCOUNT = 0.2
LOWEST = 0.1
TEMPLATE_MINIMUM = 30

DICTIONARY, SUGGESTED, UNMAPPED, MANUAL = "Dictionary Match", "AI Suggested", "Unmapped", "Manual"
IGNORE = "ignore"

MAPPING_SCHEMA = "entry_no int, original_column string, canonical_column string, confidence_score double, match_type string"


def _literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def name_tokens(name: Column) -> Column:
    """Words of a column name in camelCase, snake_case or with separators."""
    parted = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "_")
    parted = F.lower(F.regexp_replace(parted, r"(?U)[\s\W]+", "_"))
    return F.split(F.btrim(parted, F.lit("_")), "_")


def expand_synonyms(tokens: Column) -> Column:
    table = _literal_map(SYNONYMS)
    return F.transform(tokens, lambda t: F.coalesce(table[t], t))


def _masks(target: str) -> np.ndarray:
    """For each ASCII character the places it has in the target, as bits; nothing for the rest."""
    masks = np.zeros(129, np.uint64)
    for place, letter in enumerate(target):
        masks[ord(letter)] |= np.uint64(1 << place)
    return masks


_MASKS = [_masks(target) for target in CANONICAL]
# Names of similar length that are compared at once.
NAMES_AT_ONCE = 4096


def common_letters(names: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each name with each canonical name.

    All names take a step per letter together: the places of the target that
    are still free are the bits of a number.
    """
    out = np.zeros((len(names), len(CANONICAL)))
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    for at in range(0, len(order), NAMES_AT_ONCE):
        rows = order[at : at + NAMES_AT_ONCE]
        width = max(1, len(names[rows[-1]]))
        letters = np.full((len(rows), width), 128, np.uint32)
        for i, row in enumerate(rows):
            letters[i, : len(names[row])] = np.frombuffer(names[row].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.minimum(letters, 128).T.copy()
        for t, (target, masks) in enumerate(zip(CANONICAL, _MASKS, strict=True)):
            free = np.full(len(rows), (1 << len(target)) - 1, np.uint64)
            for column in letters:
                hit = free & masks[column]
                free = (free + hit) | (free - hit)
            out[rows, t] = len(target) - np.bitwise_count(free & np.uint64((1 << len(target)) - 1))
    return out


def _name_scores(name: str, bounds: list[float], bonuses: list[float], matchers: list[SequenceMatcher]) -> list[float | None]:
    """Ratio plus bonus for each canonical name; None where it cannot be the best.

    Candidates are tried in the order of their bounds, and those whose bound is
    below the best so far are left out. Scores that give the lowest confidence
    anyway are not worked out.
    """
    scores: list[float | None] = [None] * len(matchers)
    best = -1.0
    for i in sorted(range(len(matchers)), key=bounds.__getitem__, reverse=True):
        if bounds[i] < best:
            break
        if bounds[i] <= LOWEST + UNMAPPED_DISCOUNT:
            scores[i] = 0.0
            break
        matchers[i].set_seq1(name)
        scores[i] = matchers[i].ratio() + bonuses[i]
        best = max(best, scores[i])
    return scores


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    matchers = [SequenceMatcher(None, "", target) for target in CANONICAL]
    sizes = np.array([len(target) for target in CANONICAL])
    for names, bonuses in batches:
        known = [n for n in names if n is not None]
        lengths = np.array([len(n) for n in known], int)[:, None] + sizes
        # The blocks that a ratio counts are a common subsequence, so it is never above this.
        ratios = 2.0 * common_letters(known) / lengths
        found = iter(ratios)
        out: list[list[float | None] | None] = []
        for name, own in zip(names, bonuses, strict=True):
            own = None if name is None else list(own)
            out.append(None if name is None else _name_scores(name, [r + b for r, b in zip(next(found).tolist(), own, strict=True)], own, matchers))
        yield pd.Series(out, dtype=object)


def match_names(names: DataFrame, column: str = "original_column") -> DataFrame:
    """Add ``canonical_column, confidence_score, match_type`` to a table of column names.

    The dictionary is tried first, then similarity to each canonical name; both
    are row-local, so a header table of any length needs no shuffle.
    """
    name = col(column)
    named = names.withColumns(
        {
            "_key": F.regexp_replace(F.lower(name), r"(?U)[\s_]+", ""),
            "_tokens": name_tokens(name),
        }
    ).withColumns({"_snake": F.concat_ws("_", "_tokens"), "_words": expand_synonyms(F.col("_tokens"))})
    targets = sorted(set(ALIASES.values()))
    known = F.coalesce(
        _literal_map(ALIASES)[F.col("_key")],
        F.when(F.col("_snake").isin(targets) | F.col("_key").isin(targets), F.col("_snake")),
    )
    bonuses = []
    for target in CANONICAL:
        words = target.split("_")
        shared = F.size(F.array_intersect("_words", F.array(*[F.lit(w) for w in words])))
        share = shared / F.greatest(F.size("_words"), F.lit(len(words)))
        bonuses.append(F.when(shared > 0, share * OVERLAP_WEIGHT).otherwise(0.0))
    scored = named.withColumn("_known", known).withColumn(
        "_scores", _scores(F.when(F.col("_known").isNull(), F.concat_ws("_", "_words")), F.array(*bonuses))
    )
    # Sorting by score, then by the negated place, lets the first canonical name win ties.
    candidates = [
        F.struct(F.get("_scores", F.lit(i)).alias("score"), F.lit(-i).alias("place"), F.lit(target).alias("target"))
        for i, target in enumerate(CANONICAL)
    ]
    best = F.array_max(F.array(*candidates))
    capped = F.least(F.lit(HIGHEST_SUGGESTED), best["score"])
    accepted = capped >= ACCEPTED
    return scored.select(
        *[col(n) for n in names.columns],
        F.when(F.col("_known").isNotNull(), F.col("_known"))
        .when(accepted, best["target"])
        .otherwise(F.col("_snake"))
        .alias("canonical_column"),
        F.when(F.col("_known").isNotNull(), 1.0)
        .when(accepted, capped)
        .otherwise(F.greatest(F.lit(LOWEST), capped - UNMAPPED_DISCOUNT))
        .alias("confidence_score"),
        F.when(F.col("_known").isNotNull(), DICTIONARY)
        .when(accepted, SUGGESTED)
        .otherwise(UNMAPPED)
        .alias("match_type"),
    )


def column_names(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_no, table_name, column_no, original_column)`` of the given tables."""
    rows = [
        (t, table, c, name)
        for t, (table, df) in enumerate(tables.items())
        for c, name in enumerate(n for n in df.columns if n != ORD)
    ]
    names = spark.createDataFrame(rows, "table_no int, table_name string, column_no int, original_column string")
    # A Python worker takes longer to start than to compare a few thousand names.
    return names.coalesce(len(rows) // 2000 + 1)


def spread(names: DataFrame) -> DataFrame:
    """Share a table of names out over all tasks.

    Names are small and comparing them is slow, so partitions of the usual size
    in bytes would leave most of the cluster idle.
    """
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def schema_report(names: DataFrame) -> DataFrame:
    """Every distinct column name with its suggestion, confidence and match type."""
    distinct = spread(names.select("original_column").distinct())
    suggested = F.when(F.col("match_type") == UNMAPPED, IGNORE).otherwise(F.col("canonical_column"))
    return match_names(distinct).select(
        "original_column",
        suggested.alias("suggested"),
        F.col("confidence_score").alias("confidence"),
        "match_type",
        confidence_badge(F.col("confidence_score")).alias("badge"),
    )


def confidence_badge(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "success").when(confidence >= 0.5, "warning").otherwise("danger")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename; columns that get the same name are coalesced from left to right."""
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(mapping.get(name, name), []).append(name)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for target, names in sources.items():
        if len({types[n].simpleString() for n in names}) == 1:
            cells = [col(n) for n in names]
        else:
            cells = [F.expr(text_sql(quoted(n), types[n])) for n in names]
        out.append((cells[0] if len(cells) == 1 else F.coalesce(*cells)).alias(target))
    return df.select(*out)


def _first_entries(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    first: dict[str, tuple] = {}
    for entry in entries:
        first.setdefault(entry[0], entry)
    return spark.createDataFrame([(no, *entry) for no, entry in enumerate(first.values(), 1)], MAPPING_SCHEMA)


def rename_auto(spark: SparkSession, tables: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rename all mapped columns; also gives the mapping report.

    The matched names are collected: column metadata, as many rows as columns.
    """
    matched = match_names(column_names(spark, tables)).filter(F.col("match_type") != UNMAPPED)
    found = matched.orderBy("table_no", "column_no").collect()
    renamed = {}
    for table, df in tables.items():
        renamed[table] = rename_columns(
            df, {r["original_column"]: r["canonical_column"] for r in found if r["table_name"] == table}
        )
    entries = [(r["original_column"], r["canonical_column"], r["confidence_score"], r["match_type"]) for r in found]
    return renamed, _first_entries(spark, entries)


def rename_manual(
    spark: SparkSession, tables: Mapping[str, DataFrame], mapping: Mapping[str, str]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rename by the user's map; "ignore" and "" leave a column as it is."""
    wanted = {k: v for k, v in mapping.items() if v not in (IGNORE, "")}
    renamed = {table: rename_columns(df, wanted) for table, df in tables.items()}
    entries = [
        (name, wanted[name], 100.0, MANUAL) for df in tables.values() for name in df.columns if name in wanted
    ]
    return renamed, _first_entries(spark, entries)


def template_scores(templates: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``match_score``: the share of the columns that a template maps, in percent."""
    names = sorted(set(columns))
    if not names:
        return templates.withColumn("match_score", F.lit(0).cast("long"))
    shared = F.size(F.array_intersect(F.map_keys("mapping"), F.array(*[F.lit(n) for n in names])))
    return templates.withColumn("match_score", F.floor(shared / F.lit(len(names)) * 100).cast("long"))


def best_template(templates: DataFrame, columns: list[str]) -> DataFrame:
    """Per user the template with the highest score of at least 30; the first on ties.

    ``max_by`` is combined on the map side, so a user with very many templates
    is no burden on one task.
    """
    scored = template_scores(templates, columns).filter(F.col("match_score") >= TEMPLATE_MINIMUM)
    row = F.struct("template_id", "template_name", "mapping", "match_score")
    first = F.struct((-F.col("match_score")).alias("s"), "created_at", "template_id")
    return scored.groupBy("user_id").agg(F.min_by(row, first).alias("t")).select("user_id", "t.*")


def template_list(templates: DataFrame, user_id: object | None = None) -> DataFrame:
    """Templates of a user, newest first, with the number of columns they map."""
    if user_id is not None:
        templates = templates.filter(F.col("user_id") == F.lit(user_id))
    return templates.withColumn("mappings_count", F.size(F.map_keys("mapping"))).orderBy(
        F.desc("created_at"), "template_id"
    )
