"""Hard negatives by exact inner-product search in cover trees.

Vectors are quantised to floor(256 * x), so scores are whole numbers. An
anchor's positives are the best rows of its own label; the negatives of a
positive are the best rows of other labels whose score lies in a window of the
positive's score, from ``LOW`` to ``HIGH`` percent of it.

Index. Every vector gets one more component that gives all of them the norm of
the longest; then a larger inner product is a smaller distance. Cells, the upper
level, have centres chosen farthest-first from a bounded sample, and the largest
distance of all their rows as covering radius. A cell is dealt into parts of
bounded size. The task that gets a part builds a cover tree of it: the children
of a node are centres further apart than half of its covering radius, at most
``CENTRES`` of them, rows go to their nearest, and every child keeps the
distance of its farthest row. Rows at distance zero from their centre, copies
among them, are one leaf whatever their number.

Search. The inner products of a query with all rows below a node lie within
|query| * radius of that with its centre. The levels are gone down with these
bounds, and nodes that miss all windows are left with all below them. The leaves
reached are opened best first, by their upper bounds, until none can improve the
best found in any window, and their rows are scored exactly. Cells are skipped by
the same bounds before a query is sent to them. Every part returns
its best rows of each window, and the best of those are the result: it is exact,
nothing is estimated.

A task reads the rows of a part and then, one by one, the queries sent to it;
rows are shuffled once for a search and queries once for each part they reach.

Edge cases: rows with null vec_id or label, and vectors that are null, empty or
hold null or non-finite components, take no part, nor do those of another length
than the most common one; zero vectors do, with score 0; a negative positive
score has an empty window, 0 only holds 0; repeated rows are one row, other rows
that share a vec_id are rows each; ties go to the smaller vec_id; a table
without usable rows gives an empty result; scores that no long can hold are an
error; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise
from recordloom.llm.common import lowest

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
CENTRES = 16
LEAF_ROWS = 128
MOST_CELLS = 1024
SAMPLE = 4096
# Rows of a part, and parts for each shuffle partition where rows are few.
PART_ROWS = 1 << 16
LEAST_PART_ROWS = 256
# A distance is off by less than this share of the norm.
_SLACK = 1e-6


def usable(df: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, x (whole numbers) of the rows that take part."""
    fine = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    rows = df.select("vec_id", label.alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    rows = rows.select("vec_id", "label", whole.alias("x"))
    widths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return rows.where(F.size("x") == (widths[0]["n"] if widths else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _numbers(x: np.ndarray, exact: bool) -> np.ndarray:
    """Doubles while they hold all scores exactly, else Python's whole numbers."""
    return x.astype(float) if exact else x.astype(object)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that all vectors have the same norm."""
    x = x.astype(float)
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def net(x: np.ndarray, most: int, apart: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres farthest-first, at least ``apart`` from each other: their rows, each row's nearest, its distance."""
    rows = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    near = np.zeros(len(x), np.int64)
    while len(rows) < most:
        row = int(far.argmax())
        if far[row] <= apart:
            break
        own = np.sqrt(((x - x[row]) ** 2).sum(axis=1))
        closer = own < far
        near[closer], far[closer] = len(rows), own[closer]
        rows.append(row)
    return np.array(rows), near, far


class CoverTree:
    """Levels of nodes with centres, covering radii and parents; the last level are leaves, whose rows lie together."""

    def __init__(self, x: np.ndarray, norm: float, exact: bool = True):
        lifted = lift(x, norm)
        self.slack = _SLACK * max(norm, 1.0)
        far = float(np.sqrt(((lifted - lifted[0]) ** 2).sum(axis=1)).max())
        level = [(0, np.arange(len(x)), far)]  # of each node its centre, rows and covering radius
        parents = [0]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            centres, radii = x[[c for c, _, _ in level]].astype(float), np.array([r for _, _, r in level]) + self.slack
            self.levels.append((centres, radii, np.array(parents)))
            if all(self._ends(rows, radius) for _, rows, radius in level):
                break
            below, parents = [], []
            for number, (centre, rows, radius) in enumerate(level):
                kids = [(centre, rows, radius)] if self._ends(rows, radius) else self._kids(lifted, rows, radius)
                below += kids
                parents += [number] * len(kids)
            level = below
        self.rows = np.concatenate([rows for _, rows, _ in level])
        self.ends = np.cumsum([len(rows) for _, rows, _ in level])
        self.x = _numbers(x[self.rows], exact)

    def _ends(self, rows: np.ndarray, radius: float) -> bool:
        return len(rows) <= LEAF_ROWS or radius <= self.slack

    @staticmethod
    def _kids(lifted: np.ndarray, rows: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, float]]:
        centres, near, far = net(lifted[rows], CENTRES, radius / 2)
        return [(int(rows[centre]), rows[near == i], float(far[near == i].max())) for i, centre in enumerate(centres) if (near == i).any()]

    def search(self, query: np.ndarray, allowed: np.ndarray, ids: np.ndarray, lows: list[float], highs: list[float], k: int) -> list[list[tuple[int, int, int]]]:
        """Of each window the k best allowed rows as (-score, id, row)."""
        least, most = np.array(lows), np.array(highs)
        best: list[list[tuple[int, int, int]]] = [[] for _ in lows]
        rough = query.astype(float)
        reach = float(np.sqrt((rough**2).sum())) * (1 + _SLACK)
        up = down = alive = np.zeros(0)
        for number, (centres, radii, parents) in enumerate(self.levels):
            nodes = np.flatnonzero(alive[parents]) if number else np.zeros(1, int)
            middle, width = centres[nodes] @ rough, reach * radii[nodes] + self.slack
            up, down = middle + width, middle - width
            hit = ((up[:, None] >= least) & (down[:, None] <= most)).any(axis=1)
            nodes, up, down = nodes[hit], up[hit], down[hit]
            alive = np.zeros(len(centres), bool)
            alive[nodes] = True
        # Leaves in the order of their upper bounds; more are opened at once the longer it takes.
        order = np.argsort(-up, kind="stable")
        nodes, up, down = nodes[order], up[order], down[order]
        at, step = 0, 1
        while at < len(nodes):
            useful = ((up[at:, None] >= least) & (down[at:, None] <= most)).any(axis=1)
            if not useful.any():
                break
            opened = nodes[at : at + step][useful[:step]]
            at, step = at + step, step * 2
            if not len(opened):
                continue
            places = np.concatenate([np.arange(self.ends[n - 1] if n else 0, self.ends[n]) for n in opened])
            places = places[allowed[places]]
            scores = self.x[places] @ query
            fine = (scores >= least.min()) & (scores <= most.max())
            places, scores = places[fine], scores[fine]
            for w in range(len(best)):
                hits = np.flatnonzero((scores >= least[w]) & (scores <= most[w]))
                if len(hits) > k:
                    hits = hits[np.lexsort((ids[places[hits]], -scores[hits]))][:k]
                if len(hits):
                    found = zip(scores[hits].tolist(), ids[places[hits]].tolist(), self.rows[places[hits]].tolist(), strict=True)
                    best[w] = sorted(best[w] + [(-int(score), i, row) for score, i, row in found])[:k]
                    if len(best[w]) == k:
                        least[w] = max(least[w], -best[w][-1][0])
        return best


class Index:
    """Rows in cells and parts, with the centres and covering radii of the cells."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        found = rows.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("x")).alias("width")).first()
        self.total, most = found["n"], found["most"] or 0.0
        if most >= 2.0**62:
            raise ValueError("inner products of these vectors do not fit into a long")
        self.norm, self.exact = float(np.sqrt(most)) * (1 + 1e-12), most < 2.0**52
        if not self.total:
            return
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part_rows = min(PART_ROWS, max(LEAST_PART_ROWS, self.total // (2 * partitions)))
        sample = lowest(rows.select("row", "x"), F.xxhash64("row"), min(SAMPLE, max(1, (SAMPLE << 8) // found["width"])), self.total)
        sample = lift(np.array([r["x"] for r in sample.orderBy("row").collect()]), self.norm)
        cells = min(MOST_CELLS, -(-self.total // part_rows))
        centres = sample[net(sample, cells, 0.0)[0]]

        def assign(batches: Iterator[pa.RecordBatch], norm: float = self.norm) -> Iterator[pa.RecordBatch]:
            square = (centres**2).sum(axis=1)
            for batch in batches:
                x = lift(_matrix(batch.column("x")), norm)
                cell = (square - 2 * x @ centres.T).argmin(axis=1)
                far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
                columns = [batch.column(name) for name in ("row", "vec_id", "label", "x")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int64()), pa.array(far)], names=["row", "vec_id", "label", "x", "cell", "far"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        self.kinds = kinds
        schema = f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, x array<long>, cell long, far double"
        self.rows = materialise(rows.select("row", "vec_id", "label", "x").mapInArrow(assign, schema), "cells")
        self.centres, self.radius, self.parts = centres, np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most MOST_CELLS
            self.radius[r["cell"]] = r["far"] + _SLACK * max(self.norm, 1.0)
            self.parts[r["cell"]] = -(-r["n"] // part_rows)

    def best(self, asked: DataFrame, k: int, same_label: bool) -> DataFrame:
        """row, key, vec_id, found (row), score, rank: the k best rows in each window of each question.

        ``asked`` has row, label, x, and the arrays keys, lows and highs. Rows
        of the asking row's label are looked at, or those of all others.
        """
        centres, radius, parts, norm, exact = self.centres, self.radius, self.parts, self.norm, self.exact

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"take": [], "cell": [], "part": []}
                lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
                x = _matrix(batch.column("x")).astype(float)
                middle = x @ centres[:, :-1].T
                width = np.sqrt((x**2).sum(axis=1))[:, None] * radius * (1 + _SLACK) + _SLACK * max(norm, 1.0)
                for i in range(batch.num_rows):
                    up, down = middle[i] + width[i], middle[i] - width[i]
                    hit = np.zeros(len(up), bool)
                    for low, high in zip(lows[i], highs[i], strict=True):
                        hit |= (up >= low) & (down <= high)
                    for cell in np.flatnonzero(hit & (parts > 0)).tolist():
                        for part in range(int(parts[cell])):
                            out["take"].append(i)
                            out["cell"].append(cell)
                            out["part"].append(part)
                sent = batch.take(pa.array(out["take"], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(out["cell"], pa.int64()), pa.array(out["part"], pa.int32()), *sent.columns], names=["cell", "part", *sent.schema.names])

        kinds = self.kinds
        columns = f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, x array<long>, keys array<long>, lows array<double>, highs array<double>"
        asked = asked.select("row", "vec_id", "label", "x", "keys", "lows", "highs")
        asked = asked.mapInArrow(route, f"cell long, part int, {columns}").withColumn("question", F.lit(1))
        sizes = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(parts.tolist())], "cell long, parts int")  # at most MOST_CELLS rows
        held = self.rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        none = F.lit(None)
        held = held.select("cell", "part", "row", "vec_id", "label", "x", none.cast("array<long>").alias("keys"), none.cast("array<double>").alias("lows"), none.cast("array<double>").alias("highs"), F.lit(0).alias("question"))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, waiting, tree, ids, labels, rows, numbers = None, [], None, None, None, None, None
            for batch in batches:
                out: dict[str, list] = {name: [] for name in ("row", "key", "vec_id", "found", "score")}
                keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "part", "question")], axis=1)
                edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                    piece, own = batch.slice(a, b - a), tuple(keys[a, :2].tolist())
                    if own != key:
                        key, waiting, tree = own, [], None
                    if not keys[a, 2]:
                        waiting.append(piece)
                        continue
                    if tree is None:
                        if not waiting:
                            continue
                        part = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                        ids, labels, rows = (part.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label", "row"))
                        tree, waiting = CoverTree(_matrix(part.column("x")), norm, exact), []
                        # In the order of the leaves, as the tree has its rows.
                        ids, labels, numbers = ids[tree.rows], labels[tree.rows], rows[tree.rows]
                    asking = _numbers(_matrix(piece.column("x")), exact)
                    for i, (row, label, names, lows, highs) in enumerate(zip(*(piece.column(n).to_pylist() for n in ("row", "label", "keys", "lows", "highs")), strict=True)):
                        allowed = (labels == label) & (numbers != row) if same_label else labels != label
                        for name, hits in zip(names, tree.search(asking[i], allowed, ids, lows, highs, k), strict=True):
                            for score, vec_id, at in hits:
                                for column, value in (("row", row), ("key", name), ("vec_id", vec_id), ("found", int(rows[at])), ("score", -score)):
                                    out[column].append(value)
                kinds_ = (pa.int64(), pa.int64(), batch.schema.field("vec_id").type, pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(out, kinds_, strict=True)], names=list(out))

        dealt = held.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "question")
        found = dealt.mapInArrow(answer, f"row long, key long, vec_id {kinds['vec_id']}, found long, score long")
        order = Window.partitionBy("row", "key").orderBy(F.desc("score"), "vec_id", "found")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(df, label)
    index = Index(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not index.total:
        return df.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    anchors = materialise(index.rows.where(is_anchor).select("row", "vec_id", "label", "x"), "anchors")
    every = {"keys": F.array(F.lit(0).cast("long")), "lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf")))}
    near = index.best(anchors.withColumns(every), positives, same_label=True)
    near = materialise(near.select("row", F.col("vec_id").alias("positive_id"), F.col("found").alias("key"), F.col("score").alias("positive_score")), "positives")
    # Scores are whole, so the window's ends are; both are exact as whole numbers. Negative scores have no window.
    window = F.struct("key", F.ceil(F.expr(f"positive_score * {LOW} / 100BD")).cast("double").alias("low"), F.floor(F.expr(f"positive_score * {HIGH} / 100BD")).cast("double").alias("high"))
    wanted = near.where("positive_score >= 0").groupBy("row").agg(F.collect_list(window).alias("w"))  # at most ``positives`` each
    asked = anchors.join(wanted, "row").select("row", "vec_id", "label", "x", F.col("w.key").alias("keys"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = index.best(asked, negatives, same_label=False)
    found = found.select("row", "key", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return found.join(named, ["row", "key"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
