"""SimHash fingerprints of whole texts, linked by covering locality-sensitive hashing.

Fingerprints: words are maximal runs of other characters than space and
U+0009..U+000D, A-Z lower-cased; every shingle of three words (joined by one
space; all words if there are fewer) is hashed with XXH64, seed 42; a bit is set
if it is set in over half of the hashes. A text without words has fingerprint 0
and is linked like any other, and so is a null text.

Links: fingerprints that differ in at most ``radius`` bits. Every bit position
gets a nonzero vector of radius + 1 bits; mask v keeps the positions whose
vector has an odd product with v. At most radius differing positions cannot
span all radius + 1 dimensions, so some mask v leaves all of them out, and the
pair shares a bucket in that table: no pair within the radius is missed.

Equal fingerprints are one node of the graph, so copies are never paired. A
bucket of n nodes is dealt into k = ceil(n / BLOCK) parts, and each pair of
parts is one task's work: groups stay bounded at any bucket size and nothing is
left out. Inside a group a breadth-first search returns a spanning forest, not
all pairs.

Edge cases: null doc_ids form groups like others and come last when the
representative is chosen; repeated rows are copies; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.llm.common import map_batches, text_bytes, word_bytes

BITS = 64
BLOCK = 2048
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    found = word_bytes((text or b"").lower())  # bytes.lower() changes A-Z only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(found))
    n = len(found) - width + 1
    digest = xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 bit masks, as unsigned 64-bit numbers."""
    span = (1 << (radius + 1)) - 1
    vectors = [1 + i % span for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, span + 1)]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed long), text_hash of every row; written once."""
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        return {"fp": [_signed(fingerprint(t, shingle)) for t in text_bytes(batch)]}

    added = T.StructType([T.StructField("fp", T.LongType())])
    return materialise(map_batches(slim, step, added, ["doc_id", "text_hash"]), "simhash")


def _forest(nodes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links nodes within the radius."""
    rest = np.unique(nodes).view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                for y in rest[near].tolist():
                    yield _signed(int(x)), _signed(y)
                queue.extend(rest[near])
                rest = rest[~near]


def _edges(groups: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            lists = batch.column("nodes")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy().cumsum()
            for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if j - i == 2:
                    x, y = int(flat[i]), int(flat[i + 1])
                    if x != y and (((x ^ y) & ((1 << 64) - 1)).bit_count()) <= radius:
                        a.append(x)
                        b.append(y)
                else:
                    for x, y in _forest(flat[i:j].astype(np.int64), radius):
                        a.append(x)
                        b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "y"])

    pairs = groups.mapInArrow(run, "x long, y long")
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def links(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u > v) that connect all ``fp`` within ``radius`` bits of each other, directly or in steps."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    rows = nodes.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    sizes = materialise(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    parts = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    members = rows.join(sizes, ["t", "key"]).withColumn("k", parts).withColumn("part", part)
    pairs = F.expr("transform(sequence(0, k - 1), j -> struct(least(part, j) AS i, greatest(part, j) AS j))")
    groups = (
        members.select("t", "key", "fp", F.explode(pairs).alias("p"))
        .groupBy("t", "key", "p")
        .agg(F.collect_list("fp").alias("nodes"))
        .select("nodes")
    )
    return materialise(_edges(groups, radius), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge; root is the smallest node of its component.

    Large-star and small-star in turn, each a minimum per node and a join, so a
    node with very many neighbours is never gathered. Every round is written.
    """
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "small_star")
        stats = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        if stats["n"] == stats["nodes"]:
            inner = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
            if inner.isEmpty():
                return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                    edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
                )


def _best() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash")))


def groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fp, best: of every fingerprint the first document (doc_id, then hash of the text) of its component."""
    nodes = materialise(prints.groupBy("fp").agg(_best().alias("best")), "nodes")
    found = components(links(nodes, radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select("fp", "root").join(best, "root").select("fp", "best")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = fingerprints(docs, shingle)
    found = groups(prints, radius)
    return prints.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
    )


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component: the smallest doc_id (null last), once if it is repeated."""
    prints = fingerprints(docs, shingle)
    chosen = groups(prints, radius).select("best").distinct()
    chosen = chosen.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash"))
    # The row travels as one struct, so its column names cannot clash.
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    same = hashed["doc_id"].eqNullSafe(chosen["_id"]) & (hashed["_hash"] == chosen["_hash"])
    return hashed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "_hash"]).select("_row.*")
