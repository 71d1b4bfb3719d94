"""Quality of whole texts by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its potential comes from measures of the
line itself and of its two neighbours (shares of character classes, words and
their repetition, length, ending, whether the line came before), each put into
bins at quantiles of the training lines. Transitions are learned. The quality of
a text is the mean of the good-marginals of forward-backward, weighted by line
length; ``predicted`` is 1 from ``THRESHOLD`` on.

Training: labels of documents are the labels of their lines. The sample is
bounded by ``PER_CLASS`` documents of each label and ``RUN_LINES`` consecutive
lines of each; fitted weights use no label, language, source or id.

Edge cases: a null or empty text is one empty line and gets that line's score;
without training rows every score is 0.5; very long texts are one chain of all
their lines; repeated rows get equal results.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import fold_of, free_name, map_batches, texts
from recordloom.llm.crf import Adam, marginals

THRESHOLD = 0.3
PER_CLASS = 1000
RUN_LINES = 24
BINS = 8
ROUNDS = 80
MEASURES = 13
# Classes of characters: 0 other, 1 lower, 2 upper, 3 other letter, 4 digit, 5 space, 6 sentence mark, 7 comma or quote, 8 bar, 9 symbol
_CLASSES = 10


def class_table() -> np.ndarray:
    """Class of every code point below 65,536; made once per Python process."""
    made = getattr(sys, "_recordloom_classes", None)
    if made is None:
        made = np.zeros(1 << 16, np.uint8)
        for code in range(1 << 16):
            char = chr(code)
            kind = unicodedata.category(char)
            if char in ".?":
                made[code] = 6
            elif char in ",;:'\"()-":
                made[code] = 7
            elif char == "|":
                made[code] = 8
            elif kind[0] == "L" or kind == "Mn":
                made[code] = {"Ll": 1, "Lu": 2}.get(kind, 3)
            elif kind == "Nd":
                made[code] = 4
            elif kind[0] == "Z" or char in "\t\r\x0b\x0c":
                made[code] = 5
            elif kind[0] in "PS":
                made[code] = 9
        sys._recordloom_classes = made
    return made


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures (lines x MEASURES) and character counts of the lines of a text."""
    lines = (text or "").split("\n")
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    kinds = class_table()[np.minimum(codes, (1 << 16) - 1)]
    line = np.cumsum(codes == 10) - (codes == 10)
    counts = np.bincount(line * _CLASSES + kinds, minlength=len(lines) * _CLASSES).reshape(len(lines), _CLASSES).astype(float)
    n = np.array([len(x) for x in lines], float)
    counts[:-1, 0] -= 1  # the line breaks
    out = np.zeros((len(lines), MEASURES))
    letters = counts[:, 1] + counts[:, 2] + counts[:, 3]
    size = np.maximum(n, 1)
    out[:, 0] = letters / size
    out[:, 1] = counts[:, 2] / np.maximum(letters, 1)
    out[:, 2] = counts[:, 9] / size
    out[:, 3] = counts[:, 8] / size
    out[:, 4] = counts[:, 4] / size
    out[:, 5] = (counts[:, 6] + counts[:, 7]) / size
    out[:, 6] = counts[:, 0] / size
    seen: set[str] = set()
    for i, x in enumerate(lines):
        words = x.split()
        if words:
            out[i, 7] = np.log1p(len(words))
            out[i, 8] = (len(x) - len(words) + 1) / len(words)
            out[i, 9] = len(set(words)) / len(words)
            out[i, 10] = sum(a == b for a, b in zip(words, words[1:])) / len(words)  # noqa: B905
            out[i, 11] = words[-1][-1] in ".!?"
        out[i, 12] = x in seen
        seen.add(x)
    return out, n


class Model:
    """Bin edges of each measure, weights of the bins of a line and its neighbours, transitions."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.width = MEASURES * (BINS + 1) + 1  # the last entry stands for "no such neighbour"
        self.weights = np.zeros((3 * self.width, 2))
        self.trans = np.zeros((2, 2))

    def entries(self, lines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Weight rows of every line: its own bins, those of the line before and of the line after."""
        own = np.stack([np.searchsorted(self.edges[k], lines[:, k], "left") + k * (BINS + 1) for k in range(MEASURES)], axis=1)
        ends = np.cumsum(lengths)
        before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        before[ends - lengths] = self.width - 1
        after[ends - 1] = self.width - 1
        return np.concatenate([own, before + self.width, after + 2 * self.width], axis=1)

    def good(self, lines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        emit = self.weights[self.entries(lines, lengths)].sum(axis=1)
        return marginals(emit, lengths, self.trans)[0][:, 1]

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        lengths = np.array([len(n) for _, n in found])
        good = self.good(np.concatenate([m for m, _ in found]), lengths)
        weight = np.concatenate([n for _, n in found])
        starts = np.cumsum(lengths) - lengths
        empty = np.repeat(np.add.reduceat(weight, starts) == 0, lengths)
        weight = np.where(empty, 1.0, weight)
        mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return np.clip(mean, 0, 1).tolist()


def train(rows: list[tuple[np.ndarray, int]], rounds: int = ROUNDS, decay: float = 1e-3) -> Model:
    """Fit on the lines of labelled documents by gradient steps on the exact likelihood."""
    rows = [(np.asarray(m, float), int(label)) for m, label in rows if len(m)]
    if not rows:
        return Model(np.zeros((MEASURES, BINS)))
    lines, lengths = np.concatenate([m for m, _ in rows]), np.array([len(m) for m, _ in rows])
    model = Model(np.quantile(lines, np.linspace(0.02, 0.98, BINS), axis=0).T)
    gold = np.repeat([label for _, label in rows], lengths)
    entries = model.entries(lines, lengths)
    target = np.eye(2)[gold]
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    adam = Adam([model.weights, model.trans], 0.05)
    for _ in range(rounds):
        emit = model.weights[entries].sum(axis=1)
        out, expected = marginals(emit, lengths, model.trans, pairs=True)
        off = (out - target) / len(gold)
        spread = [np.bincount(entries.ravel(), np.repeat(off[:, k], entries.shape[1]), len(model.weights)) for k in range(2)]
        adam.step([np.stack(spread, axis=1) + decay * model.weights / len(model.weights), (expected - seen) / len(gold) + decay * model.trans])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, run_lines: int = RUN_LINES) -> Model:
    """Train on a sample of ``docs`` that ``labels`` (doc_id, quality) marks 0 or 1; its size is bounded by the parameters."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = None
    for label in (0, 1):
        some = marked.where(F.col("_quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows are broadcast

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            found = measures(text)[0]
            at = hash(doc_id) % max(1, len(found) - run_lines + 1)
            out.append(found[at : at + run_lines].ravel())
        return {"_lines": out}

    added = T.StructType([T.StructField("_lines", T.ArrayType(T.DoubleType()))])
    sample = map_batches(drawn, step, added, ["doc_id", "_quality"])
    rows = sample.groupBy("doc_id", "_quality").agg(F.first("_lines").alias("_lines")).orderBy("doc_id").collect()
    return train([(np.array(r["_lines"]).reshape(-1, MEASURES), r["_quality"]) for r in rows])


def predict(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep``, score and prediction of every row; a kept column that has one of ``names`` is replaced."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        scores = model.scores([measures(t) for t in texts(batch)])
        return {names[0]: scores, names[1]: [int(s >= threshold) for s in scores]}

    added = T.StructType([T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), step, added, keep)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], folds: int = 5, held: int = 0, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Train on labelled documents outside the held-out fold, then score all of them."""
    known = labels.where(fold_of(F.col("doc_id"), folds) != held)
    return predict(docs, fit(docs, known), keep, names=names)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good."""
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    found = classify(docs, labels, docs.columns, names=(score, predicted))
    return found.where(F.col(predicted) == 1).select(*docs.columns)
