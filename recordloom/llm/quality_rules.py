"""Quality of whole texts by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at one measure of a text and votes good, bad or abstains. What a
rule's votes are worth is not set by hand: a two-class model with independent
rules is fitted to the votes of all documents by expectation-maximisation, which
gives for each rule how often it votes good or bad on good and on bad texts, and
the share of good texts. A text is kept if its posterior probability of being
good is at least ``KEEP`` and it does not fail the base limits.

Only the counts of vote patterns leave the cluster, at most 3 ^ rules of them at
any number of documents; the fit starts from the majority of votes and is the
same in every run.

Edge cases: null and empty texts have no word and fail the base limits; very
long texts are measured whole; repeated rows get equal verdicts; an empty table
gives an empty result; other columns pass through if named.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.durable import materialise
from recordloom.llm.common import map_batches, text_bytes, word_bytes
from recordloom.llm.line_quality import class_table

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8
KEEP = 0.5
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_adjacent", "n_symbol_words"]

_MARK = bytes.maketrans(SYMBOLS, b"#" * len(SYMBOLS))

# Name, measure, good up to, bad from (between them the rule abstains); a measure of None abstains.
Rule = tuple[str, Callable[[dict[str, int]], float | None], float, float]
RULES: list[Rule] = [
    ("word_length", lambda c: abs(c["word_chars"] / c["n_words"] - 5.5) if c["n_words"] else None, 3.0, 5.0),
    ("symbols", lambda c: c["n_symbols"] / c["n_words"] if c["n_words"] else None, 0.05, 0.3),
    ("symbol_words", lambda c: c["n_symbol_words"] / c["n_words"] if c["n_words"] else None, 0.05, 0.3),
    ("duplicate_lines", lambda c: c["n_dup_lines"] / c["n_lines"] if c["n_lines"] > 2 else None, 0.2, 0.5),
    ("repeated_windows", lambda c: c["n_repeat_words"] / c["n_words"] if c["n_words"] >= 2 * WINDOW else None, 0.15, MOST_REPEATED / 100),
    ("capitals", lambda c: c["n_upper"] / (c["n_upper"] + c["n_lower"]) if c["n_upper"] + c["n_lower"] >= 20 else None, 0.25, 0.5),
    ("adjacent_words", lambda c: c["n_adjacent"] / c["n_words"] if c["n_words"] >= 10 else None, 0.1, 0.3),
    ("length", lambda c: 0.0 if c["n_words"] >= 2 * LEAST_WORDS else None, 0.5, 1.0),
]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice. ``window`` is a power of two."""
    if len(words) <= window:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    span = 1
    while span < window:  # numbers of windows twice as long, from pairs of numbers
        ids = np.unique(ids[:-span] << 32 | ids[span:], return_inverse=True)[1]
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count(text: bytes | None) -> dict[str, int]:
    """All counts of one text in UTF-8."""
    text = text or b""
    words = word_bytes(text)
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():  # bytes.isspace() knows exactly the six characters
            lines += 1
            duplicates += line in seen
            seen.add(line)
    joined = b"".join(words)
    plain = joined.decode("utf-8", "replace")
    codes = np.frombuffer(plain.encode("utf-32-le", "replace"), "<u4")
    kinds = np.bincount(class_table()[np.minimum(codes, (1 << 16) - 1)], minlength=3)
    marked = text.translate(_MARK).split() if any(c in text for c in SYMBOLS) else []
    return {
        "n_words": len(words),
        "word_chars": len(plain),
        "n_symbols": sum(text.count(bytes([c])) for c in SYMBOLS),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        "n_upper": int(kinds[2]),
        "n_lower": int(kinds[1]),
        "n_symbol_words": sum(b"#" in w for w in marked),
        "n_adjacent": sum(a == b for a, b in zip(words, words[1:])),  # noqa: B905
    }


def vote(counts: dict[str, int]) -> str:
    """One character for each rule: + good, - bad, 0 abstains."""
    out = ""
    for _, measure, good, bad in RULES:
        value = measure(counts)
        out += "0" if value is None or good < value < bad else "+" if value <= good else "-"
    return out


def fit(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of each pattern, vote rates (rule, class bad/good, vote -/0/+), share of good texts."""
    if not patterns:
        return {}, np.zeros((0, 2, 3)), 0.5
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    votes = np.array([["-0+".index(v) for v in p] for p in names])
    told = (votes == 2).sum(axis=1) - 6.0 * (votes == 0).sum(axis=1)  # a bad vote says more than a good one
    good = 1 / (1 + np.exp(-told))
    rates, share = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        share = float((weight @ good + 1) / (weight.sum() + 2))
        for j in range(votes.shape[1]):
            for k, part in enumerate((weight * (1 - good), weight * good)):
                n = np.bincount(votes[:, j], part, 3) + 0.5
                rates[j, k] = n / n.sum()
        # What a rule's silence says is left out: it depends on the text's size, not on its quality.
        spoke = votes != 1
        logs = np.log(rates[:, :, [0, 2]] / rates[:, :, [0, 2]].sum(axis=2, keepdims=True))
        each = np.zeros((len(names), 2))
        for j in range(votes.shape[1]):
            each[spoke[:, j]] += logs[j][:, votes[spoke[:, j], j] // 2].T
        odds = np.clip(each[:, 1] - each[:, 0] + np.log(share / (1 - share)), -500, 500)
        before, good = good, 1 / (1 + np.exp(-odds))
        if np.abs(good - before).max() < 1e-9:
            break
    return dict(zip(names, good.tolist(), strict=True)), rates, share


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, all counts and the votes of every row; written once."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        found = [count(t) for t in text_bytes(batch)]
        return {name: [c[name] for c in found] for name in COUNTS} | {"votes": [vote(c) for c in found]}

    fields = [T.StructField(name, T.LongType()) for name in COUNTS] + [T.StructField("votes", T.StringType())]
    return materialise(map_batches(docs.select(*dict.fromkeys([*keep, "text"])), step, T.StructType(fields), keep), "votes")


def judge(docs: DataFrame, keep: list[str], least: float = KEEP) -> DataFrame:
    """The columns ``keep``, counts, votes, posterior quality, base_failed and kept of every row."""
    found = counted(docs, keep)
    patterns = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = list(fit(patterns)[0].items())
    known = docs.sparkSession.createDataFrame(posterior, "votes string, quality double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        found.join(F.broadcast(known), "votes")  # at most 3 ^ rules rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    )
