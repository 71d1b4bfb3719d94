"""A Merkle manifest of a table, and a recursive query that folds every row back to the root.

H is the lowercase hex SHA-256 of its inputs one after the other. A leaf is H of
doc_id, source, lang, n_chars and text, each written as ``-`` if null, else as
UTF-8 byte count, ``:`` and value. The leaves of a language, ascending by
doc_id, are the first level of its tree; runs of ``WIDTH`` consecutive nodes
become their H until one node, the subroot, remains. The subroots, ordered by
language, are the first level of the tree above them, whose last node is the
root.

Levels are built by grouping and written down. What is stored for the way up is
one row per run: its node, the digests of its nodes in order and a link to the
node's own parent. A recursive query then starts with one row per leaf, and each
step joins the rows with the run they stand in, folds the carried digest with
its siblings and appends a row with the siblings, until a node without parent is
reached. The rows that a leaf has left behind, in order, are its proof; no step
carries what the ones before it found, only the folded digest.

Upper runs are shared by very many leaves. A run above ``BLOCK`` leaves is
stored once for each block of ``BLOCK`` leaves below it, so that no key of the
join meets more than ``BLOCK`` rows, however many rows one language has.

Positions within a language come from a range-partitioned sort: counts per
sort partition and language are summed up, so no language is one task's work.

Edge cases: null fields are ``-`` in the leaf; null languages come first and are
a tree of their own, as are empty ones; null doc_ids come first in their
language and are never tampered with; repeated rows and rows with the same
doc_id are leaves each, ordered by their digest; a single row is leaf, subroot
and root at once and has no siblings; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.functions.rows import ROW_BITS, number_rows

WIDTH = 8
# Leaves that share a stored copy of an upper run; a power of WIDTH.
BLOCK_LEVELS = 4
BLOCK = WIDTH**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The number of the tree over the subroots.
TOP = -1


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def hex_text(data: Column) -> Column:
    """Digests as the hex text that goes into the next hash; also of several digests in a row."""
    return F.lower(F.hex(data))


def written(x: Column) -> Column:
    """A field as it goes into a leaf."""
    text = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    parts = [written(text if name == "text" else F.col(name)) for name in FIELDS]
    return digest(F.concat(*parts).cast("binary"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf, seen: ``seen`` is the leaf as found after tampering with the marked rows."""
    found = docs.select(*FIELDS).withColumn("leaf", leaf_of(F.col("text")))
    seen = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(lower_ascii(F.col("text")))).otherwise(F.col("leaf"))
    return found.select("doc_id", "lang", "leaf", seen.alias("seen"))


def _placed(rows: DataFrame) -> DataFrame:
    """id, doc_id, leaf, seen with tree (number of the language), idx (position in it) and n (leaves of the language)."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    # The tie keeps many equal rows from being one sort partition.
    rows = materialise(rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    rows = materialise(rows.orderBy(*order).drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumn("_part", F.shiftright("_place", ROW_BITS))
    # One row for each sort partition and language in it.
    found = materialise(rows.groupBy("_part", "lang").agg(F.count("*").alias("m"), F.min("_place").alias("_first")), "merkle-parts")
    trees = number_rows(found.select("lang").distinct(), [F.col("lang").asc_nulls_first()], "no").select(F.col("lang").alias("_lang"), (F.col("no") - 1).cast("long").alias("tree"))
    along = Window.partitionBy("lang").orderBy("_part")
    before, all_ = F.sum("m").over(along) - F.col("m"), F.sum("m").over(Window.partitionBy("lang"))
    found = found.select(F.col("_part").alias("_of"), F.col("lang").alias("_own"), "_first", before.alias("_before"), all_.alias("n"))
    found = found.join(trees, F.col("_own").eqNullSafe(F.col("_lang"))).drop("_lang")
    same = (F.col("_part") == F.col("_of")) & F.col("lang").eqNullSafe(F.col("_own"))
    idx = F.col("_before") + F.col("_place") - F.col("_first")
    return materialise(rows.join(found, same).select(F.col("_place").alias("id"), "doc_id", "leaf", "seen", "tree", idx.alias("idx"), "n"), "merkle-placed")


def levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All runs above ``nodes`` (tree, idx, digest, n), and the last node of each tree.

    Runs are (tree, level, idx, kids, digest, n): the digests of at most
    ``WIDTH`` nodes in order, and the node made of them. ``n`` is the number of
    nodes that the tree starts with, so a level has n / ``WIDTH`` ^ level.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    below, made, ends, size, level = nodes, [], [], 1, 0
    while size < most:
        ends.append(below.where(F.col("n") <= size).select("tree", "digest"))
        kids = F.array_sort(F.collect_list(F.struct(F.pmod("idx", F.lit(WIDTH)).alias("pos"), "digest")))
        runs = below.where(F.col("n") > size).groupBy("tree", F.expr(f"idx div {WIDTH}").alias("idx"), "n").agg(kids.alias("kids"))
        runs = runs.withColumn("_hex", F.array_join(F.transform("kids", lambda kid: hex_text(kid["digest"])), ""))
        level, size = level + 1, size * WIDTH
        below = materialise(
            runs.select("tree", F.lit(level).alias("level"), "idx", F.unhex("_hex").alias("kids"), digest(F.encode("_hex", "UTF-8")).alias("digest"), "n"),
            f"merkle-level-{level}",
        )
        made.append(below)
    ends.append(below.select("tree", "digest"))
    none = nodes.sparkSession.createDataFrame([], "tree long, level int, idx long, kids binary, digest binary, n long")
    return reduce(DataFrame.unionByName, made, none), reduce(DataFrame.unionByName, ends)


def _height(n: str) -> Column:
    """Levels above n nodes, the smallest h with WIDTH ^ h >= n."""
    bits = WIDTH.bit_length() - 1
    return F.expr(f"size(filter(sequence(0, 20), h -> shiftleft(1L, h * {bits}) < {n}))")


def _share(tree: str, idx: str) -> Column:
    """The block of leaves that uses one copy of the upper runs."""
    return F.xxhash64(F.col(tree), F.expr(f"{idx} div {BLOCK}"))


def stored_runs(placed: DataFrame, own: DataFrame, top: DataFrame, trees: int) -> DataFrame:
    """Runs with the link to the parent of their node; runs above ``BLOCK`` leaves once for each block of leaves."""
    bits = WIDTH.bit_length() - 1
    above = f"n > shiftleft(1L, level * {bits})"  # the node is not the last of its tree
    linked = own.selectExpr(
        "tree", "level", "idx", "kids", "digest",
        f"if({above}, tree, {f'{TOP}L' if trees > 1 else 'CAST(NULL AS BIGINT)'}) AS up_tree",
        f"if({above}, level + 1, {1 if trees > 1 else 'CAST(NULL AS INT)'}) AS up_level",
        f"if({above}, idx, tree) div {WIDTH} AS up_idx",
        f"pmod(if({above}, idx, tree), {WIDTH}) AS up_pos",
    )
    linked = linked.unionByName(top.selectExpr(
        "tree", "level", "idx", "kids", "digest",
        f"if({above}, tree, NULL) AS up_tree", f"if({above}, level + 1, NULL) AS up_level", f"idx div {WIDTH} AS up_idx", f"pmod(idx, {WIDTH}) AS up_pos",
    ))
    shared = f"tree = {TOP} OR level > {BLOCK_LEVELS}"
    blocks = placed.groupBy("tree", "n", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.first(_share("tree", "idx")).alias("share"))
    inner = f"transform(filter(sequence(0, height), h -> h > {BLOCK_LEVELS}), h -> struct(tree AS t, h AS l, shiftright(block, (h - {BLOCK_LEVELS}) * {bits}) AS i))"
    outer = f"transform(filter(sequence(0, {len(_steps(trees))}), h -> h > 0), h -> struct({TOP}L AS t, h AS l, shiftright(tree, h * {bits}) AS i))"
    uses = blocks.withColumn("height", _height("n")).select("share", F.explode(F.expr(f"concat({inner}, {outer})")).alias("u"))
    uses = uses.select("share", F.col("u.t").alias("tree"), F.col("u.l").alias("level"), F.col("u.i").alias("idx")).distinct()
    copies = linked.where(shared).join(uses, ["tree", "level", "idx"])
    return linked.where(f"NOT ({shared})").withColumn("share", F.lit(0).cast("long")).unionByName(copies)


def _steps(n: int) -> list[int]:
    """Numbers of nodes of the levels above n nodes."""
    out = []
    while n > 1:
        n = -(-n // WIDTH)
        out.append(n)
    return out


CLIMB = f"""
    WITH RECURSIVE climb(id, step, folded, siblings, subroot, root, share, tree, level, idx, pos) AS (
        SELECT id, 0, seen, unhex(''), if(n = 1, leaf, NULL), if(up_level IS NULL, leaf, NULL), share, up_tree, up_level, up_idx, up_pos
        FROM {{leaves}}
        UNION ALL
        SELECT c.id, c.step + 1,
               unhex(sha2(lower(hex(concat(substring(r.kids, 1, 32 * c.pos), c.folded, substring(r.kids, 32 * c.pos + 33)))), 256)),
               concat(substring(r.kids, 1, 32 * c.pos), substring(r.kids, 32 * c.pos + 33)),
               if(r.tree <> {TOP} AND coalesce(r.up_tree, {TOP}) = {TOP}, r.digest, NULL),
               if(r.up_level IS NULL, r.digest, NULL),
               c.share, r.up_tree, r.up_level, r.up_idx, r.up_pos
        FROM climb c JOIN {{runs}} r
          ON c.tree = r.tree AND c.level = r.level AND c.idx = r.idx
         AND r.share = if(c.tree = {TOP} OR c.level > {BLOCK_LEVELS}, c.share, 0)
    )
    SELECT id, step, if(level IS NULL, folded, NULL) AS folded, siblings, subroot, root FROM climb
"""


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and proof of every row.

    ``proof`` holds the siblings from the leaf to the root, 32 bytes each.
    ``folded_root`` starts from the leaf as it is after ``tampered`` rows had
    the A-Z of their text lower-cased; ``verified`` says whether it is the root.
    """
    spark = docs.sparkSession
    # The rows of a step are as many as the leaves; Spark's own limit is a million.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    placed = _placed(leaves(docs, tampered))
    own, subroots = levels(placed.select("tree", "idx", F.col("leaf").alias("digest"), "n"))
    subroots = materialise(subroots, "merkle-subroots")
    trees = subroots.count()
    top, _ = levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(trees).cast("long").alias("n")))
    runs = materialise(stored_runs(placed, own, top, trees), "merkle-runs")
    alone, none = F.col("n") == 1, F.lit(None)
    start = placed.select(
        "id", "leaf", "seen", "n",
        _share("tree", "idx").alias("share"),
        F.when(~alone, F.col("tree")).otherwise(F.lit(TOP) if trees > 1 else none).cast("long").alias("up_tree"),
        F.when(~alone | F.lit(trees > 1), F.lit(1)).cast("int").alias("up_level"),
        F.expr(f"if(n = 1, tree, idx) div {WIDTH}").alias("up_idx"),
        F.expr(f"pmod(if(n = 1, tree, idx), {WIDTH})").alias("up_pos"),
    )
    steps = spark.sql(CLIMB, leaves=start, runs=runs).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "folded", "siblings", "subroot", "root"))).alias("steps"))

    def known(name: str) -> Column:
        """The one value that some step of a row has."""
        return hex_text(F.element_at(F.filter("steps", lambda s: s[name].isNotNull()), 1)[name])

    proof = F.aggregate("steps", F.unhex(F.lit("")), lambda all_, s: F.concat(all_, s["siblings"]))
    paths = steps.select("id", known("subroot").alias("subroot"), known("root").alias("root"), known("folded").alias("folded_root"), proof.alias("proof"))
    return placed.join(paths, "id").select(
        "doc_id", hex_text(F.col("leaf")).alias("leaf"), "subroot", "root", F.sha2(F.encode(hex_text(F.col("proof")), "UTF-8"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof",
    )
