"""Nearest neighbours by inner product with a hierarchical k-means tree.

Index. Equal vectors are one class; classes are what is indexed. A tree of
k-means splits (``BRANCHES`` children) is fitted on a bounded sample of classes
(``SAMPLE`` vectors, ``SAMPLE_VALUES`` numbers), on vectors with one more
component that gives all of them the same norm, so that nearness in the tree is
nearness by inner product. Every class is then sent down to its leaf.

Search. A query walks the tree best bin first: a priority queue holds nodes by
inner product of query and centre, the best is opened, leaves are visited as
they come up. How many leaves are visited is calibrated: for a bounded set of
queries the true neighbours are found by a scan of all classes, and visits are
widened until ``RECALL`` of them are reached (up to all leaves, which is exact).
A query goes on until its leaves hold enough classes.

Work is dealt by groups of neighbouring leaves. Groups with many classes or many
queries are split into parts of at most ``PART_ROWS`` and ``PART_QUERIES``, so
every task is bounded and none is left out. Equal queries are searched once.

Edge cases: rows with null id, and vectors that are null, empty, zero or hold
null or non-finite components, take no part, nor do those of another length
than the most common one; repeated rows are one candidate; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.llm.common import lowest

BRANCHES = 16
LEAF_ROWS = 256
SAMPLE = 20_000
SAMPLE_VALUES = 4_000_000
CALIBRATION = 200
RECALL = 0.96
GROUP_LEAVES = 16
PART_ROWS = 8192
PART_QUERIES = 2048


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part."""
    fine = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"
    found = df.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {fine}").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    widths = found.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return found.where(F.size("embedding") == (widths[0]["n"] if widths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Tree:
    """Nodes with centres; ``children`` of a leaf are empty, and ``leaf`` gives its number."""

    def __init__(self, sample: np.ndarray, leaf_sample: int, branches: int = BRANCHES, seed: int = 0):
        self.norm = float(np.sqrt((sample**2).sum(axis=1).max(initial=0)))
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._random = np.random.default_rng(seed)
        lifted = self.lift(sample)
        self._grow(lifted, lifted.mean(axis=0) if len(lifted) else np.zeros(1), leaf_sample, branches)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def _grow(self, x: np.ndarray, centre: np.ndarray, leaf_sample: int, branches: int) -> int:
        me = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        k = min(branches, -(-len(x) // leaf_sample))
        if k > 1:
            centres = x[self._random.choice(len(x), k, replace=False)]
            for _ in range(8):
                near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
                centres = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
            near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            parts = [i for i in range(k) if (near == i).any()]
            if len(parts) > 1:
                self.children[me] = [self._grow(x[near == i], centres[i], leaf_sample, branches) for i in parts]
        if not self.children[me]:
            self.leaf[me] = self.leaves
            self.leaves += 1
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descent to the nearest child."""
        lifted, out = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            centres = np.stack([self.centres[k] for k in kids])
            near = ((centres**2).sum(axis=1) - 2 * lifted[rows] @ centres.T).argmin(axis=1)
            todo += [(kids[i], rows[near == i]) for i in np.unique(near).tolist()]
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            for kid, score in zip(kids, (self._stacked(node) @ query).tolist(), strict=True):
                heapq.heappush(queue, (-score, kid))

    def _stacked(self, node: int) -> np.ndarray:
        made = self.__dict__.setdefault("stacks", {})
        if node not in made:
            made[node] = np.stack([self.centres[k][:-1] for k in self.children[node]])
        return made[node]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each row of scores the k best: largest score, then smallest id."""
    for i, row in enumerate(scores):
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            some = np.flatnonzero(row >= least)
        else:
            some = np.arange(len(row))
        some = some[np.lexsort((ids[some], -row[some]))][:k]
        yield i, ids[some], row[some]


def _truth(classes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> pd.DataFrame:
    """query, rep, score of the k best classes of a bounded list of queries, by a scan."""
    matrix = np.array([q for _, q in queries], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(matrix), 0), np.int64), np.zeros((len(matrix), 0))
        for batch in batches:
            own = batch.column("rep").to_numpy()
            scores = np.concatenate([scores, matrix @ _matrix(batch.column("embedding")).T], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(own, (len(matrix), len(own)))], axis=1)
            order = np.lexsort((ids, -scores), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        n = np.repeat(np.arange(len(matrix)), ids.shape[1])
        yield pa.RecordBatch.from_pydict({"query": pa.array(n, pa.int64()), "rep": pa.array(ids.ravel(), pa.int64()), "score": pa.array(scores.ravel(), pa.float64())})

    found = classes.select("rep", "embedding").mapInArrow(run, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).toPandas()  # CALIBRATION * k rows


def _part(key: str, n: str, most: int) -> tuple[Column, Column]:
    """How many parts a group of n rows gets, and the part of a row."""
    parts = F.ceil(F.col(n) / most).cast("int")
    return parts, F.pmod(F.xxhash64(key), parts).cast("int")


def search(df: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that ``is_query`` marks."""
    spark = df.sparkSession
    vectors = usable(df)
    classes = materialise(vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n")), "classes")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], f"query_id {classes.schema['rep'].dataType.simpleString()}, rank int, vec_id {classes.schema['rep'].dataType.simpleString()}, score double")
    repeated = classes.where("n > 1").select("embedding", "rep")
    # Of a class at most k + 1 members can be among k neighbours.
    smallest = Window.partitionBy("rep").orderBy("vec_id")
    members = vectors.join(repeated, "embedding").select("rep", "vec_id").distinct().withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1).select("rep", "vec_id")
    asked = vectors.where(is_query).join(repeated, "embedding", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep")).distinct()
    asked = materialise(asked, "asked")
    queries = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding")

    rows = min(SAMPLE, max(1, SAMPLE_VALUES // classes.select(F.size("embedding").alias("n")).head()["n"]))
    drawn = lowest(classes.select("embedding", "rep"), F.xxhash64("rep"), rows, total)
    sample = np.array([r["embedding"] for r in drawn.collect()], float)
    sample = sample.reshape(len(sample), -1)
    tree = Tree(sample, max(4, LEAF_ROWS * len(sample) // max(1, total)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("embedding"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("embedding"), pa.array(leaf, pa.int64())], names=["rep", "embedding", "leaf"])

    kind = classes.schema["rep"].dataType.simpleString()
    placed = materialise(classes.select("rep", "embedding").mapInArrow(assign, f"rep {kind}, embedding array<double>, leaf long"), "leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row for each leaf of the sample's tree
        held[r["leaf"]] = r["count"]

    trial = [(r["rep"], r["embedding"]) for r in lowest(queries, F.xxhash64("rep"), CALIBRATION, asked.select("rep").distinct().count()).collect()]
    visits = calibrate(tree, held, trial, _truth(classes, trial, k + 1), classes, recall) if trial else 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"rep": [], "embedding": [], "group": [], "wanted": []}
            for rep, vector in zip(batch.column("rep").to_pylist(), _matrix(batch.column("embedding")), strict=True):
                wanted: dict[int, list[int]] = {}
                for leaf in _visited(tree, held, vector, visits, k + 1):
                    wanted.setdefault(leaf // GROUP_LEAVES, []).append(leaf)
                for group, own in wanted.items():
                    for name, value in (("rep", rep), ("embedding", vector), ("group", group), ("wanted", own)):
                        out[name].append(value)
            kinds = (batch.schema.field("rep").type, pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out[name], t) for name, t in zip(out, kinds, strict=True)], names=list(out))

    routed = materialise(queries.mapInArrow(route, f"rep {kind}, embedding array<double>, group long, wanted array<long>"), "routed")
    placed = placed.withColumn("group", F.floor(F.col("leaf") / GROUP_LEAVES).cast("long"))
    sizes = placed.groupBy("group").agg(F.count("*").alias("n")).join(routed.groupBy("group").agg(F.count("*").alias("q")), "group")
    sizes = materialise(sizes, "groups")
    row_parts, row_part = _part("rep", "n", PART_ROWS)
    query_parts, query_part = _part("rep", "q", PART_QUERIES)
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    left = routed.join(sizes, "group").withColumn("query_part", query_part).withColumn("part", every(row_parts)).select("group", "part", "query_part", "rep", "embedding", "wanted")
    right = placed.join(sizes, "group").withColumn("part", row_part).withColumn("query_part", every(query_parts)).select("group", "part", "query_part", "rep", "embedding", "leaf")

    def score(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if own.empty or rows.empty:
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        asked, ids, leaf = np.stack(own["embedding"].to_numpy()), rows["rep"].to_numpy(), rows["leaf"].to_numpy()
        matrix = np.stack(rows["embedding"].to_numpy())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = own["rep"].to_numpy()
        leaves = np.unique(leaf)
        for at in range(0, len(asked), 256):
            scores = asked[at : at + 256] @ matrix.T
            open_ = np.stack([np.isin(leaves, w) for w in own["wanted"].iloc[at : at + 256]])
            scores[~open_[:, np.searchsorted(leaves, leaf)]] = -np.inf
            for i, found, value in _best(scores, ids, k + 1):
                fine = value > -np.inf
                out.append((np.full(int(fine.sum()), names[at + i]), found[fine], value[fine]))
        query, rep, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query": query, "rep": rep, "score": value})

    keys = ["group", "part", "query_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, f"query {kind}, rep {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    hits = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).select("query", "rep", "score")
    # Classes become their members; then every asking row takes the best that are not itself.
    hits = hits.join(members, "rep", "left").select("query", "score", F.coalesce("vec_id", "rep").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = materialise(hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"), "hits")
    lists = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))  # at most k + 1 each
    pairs = asked.join(lists, asked["rep"] == lists["query"]).select(F.col("vec_id").alias("query_id"), "hits")
    mine = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return pairs.select("query_id", F.posexplode(mine)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def _visited(tree: Tree, held: np.ndarray, query: np.ndarray, visits: int, least: int) -> list[int]:
    """The first ``visits`` leaves, and more until they hold ``least`` classes."""
    out, size = [], 0
    for leaf in tree.visit(query):
        out.append(leaf)
        size += held[leaf]
        if len(out) >= visits and size >= least:
            break
    return out


def calibrate(tree: Tree, held: np.ndarray, trial: list[tuple[int, list[float]]], truth: pd.DataFrame, classes: DataFrame, recall: float) -> int:
    """The fewest leaf visits that reach ``recall`` of the true neighbours of the trial queries."""
    reps = classes.sparkSession.createDataFrame([(int(r),) for r in truth["rep"].unique()], "rep long")
    rows = classes.join(F.broadcast(reps), "rep", "left_semi").select("rep", "embedding").collect()  # at most CALIBRATION * (k + 1)
    leaf_of = dict(zip([r["rep"] for r in rows], tree.assign(np.array([r["embedding"] for r in rows], float)).tolist(), strict=True))
    needed: list[int] = []
    for i, own in truth.groupby("query")["rep"]:
        wanted: dict[int, int] = {}
        for rep in own:
            wanted[leaf_of[rep]] = wanted.get(leaf_of[rep], 0) + 1
        for n, leaf in enumerate(tree.visit(np.array(trial[i][1], float)), 1):
            if leaf in wanted:
                needed += [n] * wanted.pop(leaf)
                if not wanted:
                    break
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else tree.leaves
