"""Language of whole texts by a linear-chain conditional random field over words.

A word is a run of letters, lower-cased. Its features are hashed character
n-grams of one to four characters with marks at both ends (those that touch a
mark are its affixes) and, for words seen at least twice in training, the word
itself. Transitions between the languages of neighbouring words are learned, so
code-switched text gets a language word by word from forward-backward. The
language of a text is the one with the largest sum of word marginals, weighted
by letters; the score is its share.

Training: a bounded sample of lines of labelled training documents, balanced
over languages: of each language about ``PER_LANGUAGE`` different documents, at
least one, and at most ``LINES`` lines, evenly from its documents. A line is what
follows its first letter, at most ``LINE_WORDS`` words and ``LINE_CHARS``
characters; lines without a letter are left out. Lines are strung together in
threes, so that changes of language are seen.

Edge cases: null texts and texts without a letter get ``und`` with score 0; an
empty training set makes every text ``und``; very long texts are one chain of
all their words; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import fold_of, free_name, map_batches, texts
from recordloom.llm.crf import Adam, marginals

BUCKETS = 1 << 16
PER_LANGUAGE = 500
LINES = 3000
LINE_WORDS = 100
LINE_CHARS = 2000
ROUNDS = 40
UNKNOWN = "und"
LEAST_SCORE = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each position (positions x 4, -1 for none) and where the words begin."""
    codes = np.frombuffer(("\2" + "\3\2".join(words) + "\3").encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    word = np.cumsum(codes == 2)
    out = np.full((len(codes), 4), -1, np.int64)
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        k = len(codes) - n + 1
        if k <= 0:
            break
        rolling = (rolling[:k] * np.uint64(0x100000001B3)) ^ (codes[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        mixed = ((rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(48)
        out[:k, n - 1] = np.where(word[:k] == word[n - 1 :], mixed.astype(np.int64) % BUCKETS, -1)
    return out, starts


class Model:
    """Languages, n-gram weights (the last row is no n-gram), lexicon and transitions."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        self.langs, self.lexicon = langs, lexicon
        self.grams = np.zeros((BUCKETS + 1, len(langs)))
        self.known = np.zeros((len(lexicon) + 1, len(langs)))
        self.trans = np.zeros((len(langs), len(langs)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        buckets, starts = _grams(words)
        sums = self.grams[buckets[:, 0]]
        for n in range(1, 4):
            sums += self.grams[buckets[:, n]]
        entry = np.array([self.lexicon.get(w, -1) for w in words])
        return np.add.reduceat(sums, starts) + self.known[entry]

    def label(self, found: list[list[str]]) -> list[np.ndarray]:
        """Language marginals of the words of each text."""
        index: dict[str, int] = {}
        chain = np.array([index.setdefault(w, len(index)) for words in found for w in words], np.int64)
        lengths = np.array([len(words) for words in found], np.int64)
        emit = self.emissions(list(index))[chain] if len(chain) else np.zeros((0, len(self.langs)))
        out, _ = marginals(emit, lengths, self.trans)
        return np.split(out, np.cumsum(lengths)[:-1])


def train(lines: list[tuple[str, list[str]]], rounds: int = ROUNDS, decay: float = 1e-3) -> Model:
    """Fit by gradient steps on the exact likelihood of chains of three lines."""
    langs = sorted({lang for lang, words in lines if words})
    counts = Counter(w for _, words in lines for w in words)
    model = Model(langs, {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n > 1))})
    index: dict[str, int] = {}
    chain = np.array([index.setdefault(w, len(index)) for _, words in lines for w in words], np.int64)
    if not len(chain):
        return model
    gold = np.repeat([langs.index(lang) if words else 0 for lang, words in lines], [len(words) for _, words in lines])
    sizes = [len(words) for _, words in lines]
    lengths = np.array([sum(sizes[i : i + 3]) for i in range(0, len(sizes), 3)])
    lengths = lengths[lengths > 0]
    words = list(index)
    buckets, starts = _grams(words)
    owner = np.repeat(np.arange(len(words)), np.diff([*starts.tolist(), len(buckets)]))
    entry = np.array([model.lexicon.get(w, len(model.lexicon)) for w in words])
    flat = np.where(buckets < 0, BUCKETS, buckets)
    target = np.zeros((len(chain), len(langs)))
    target[np.arange(len(chain)), gold] = 1
    inner = np.ones(len(chain), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((len(langs), len(langs)))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    adam = Adam([model.grams, model.known, model.trans], 0.05)
    for _ in range(rounds):
        out, expected = marginals(model.emissions(words)[chain], lengths, model.trans, pairs=True)
        off = (out - target) / len(chain)
        by_word = np.stack([np.bincount(chain, off[:, k], len(words)) for k in range(len(langs))], axis=1)
        spread = by_word[owner]
        grams = np.stack([sum(np.bincount(flat[:, n], spread[:, k], BUCKETS + 1) for n in range(4)) for k in range(len(langs))], axis=1)
        known = np.stack([np.bincount(entry, by_word[:, k], len(model.lexicon) + 1) for k in range(len(langs))], axis=1)
        grams[-1] = known[-1] = 0
        adam.step([grams + decay * model.grams / len(words), known + decay * model.known / len(words), (expected - seen) / len(chain) + decay * model.trans])
        model.grams[-1] = model.known[-1] = 0
    return model


def sample(docs: DataFrame, lang: Column, per_language: int = PER_LANGUAGE, lines: int = LINES) -> list[tuple[str, list[str]]]:
    """Language and words of drawn lines of ``docs`` with text and ``lang``, at most ``lines`` of each language."""
    labelled = docs.select("text", lang.alias("_lang"), F.xxhash64("doc_id", "text").alias("_hash")).where("_lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    # Copies count once; the lowest hash is always drawn, so that every language has a document.
    counts = labelled.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("_n"), F.min(_share("_hash")).alias("_least"))
    drawn = labelled.join(F.broadcast(counts), "_lang").where(_share("_hash") <= F.greatest(F.lit(float(per_language)) / F.col("_n"), F.col("_least")))
    drawn = drawn.groupBy("_lang", "_hash").agg(F.first("text").alias("text"), F.first("_n").alias("_n"))
    # Of a document only as many lines are sent as its language may need of it: all of them if it is alone.
    each = F.ceil(F.lit(2.0 * lines) / F.least(F.col("_n"), F.lit(per_language))).cast("int")
    cut = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(F.xxhash64("_hash", i).alias("_draw"), F.substring(F.regexp_replace(line, "^\\P{L}+", ""), 1, LINE_CHARS).alias("line")),
    )
    cut = F.slice(F.array_sort(F.filter(cut, lambda x: x["line"] != "")), 1, F.least(each, F.lit(lines)))
    rows = drawn.select("_lang", F.posexplode(cut)).select("_lang", F.col("pos").alias("_rank"), "col._draw", F.slice(F.split("col.line", "[ \\t]+"), 1, LINE_WORDS).alias("line")).collect()
    left: Counter[str] = Counter()
    chosen = []
    for r in sorted(rows, key=lambda r: (r["_rank"], r["_draw"], r["_lang"], r["line"])):
        words = words_of(" ".join(r["line"]))
        if words and left[r["_lang"]] < lines:
            left[r["_lang"]] += 1
            chosen.append((r["_draw"], r["_lang"], words))
    return [(name, words) for _, name, words in sorted(chosen)]


def _share(hashed: str) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.col(hashed), F.lit(1 << 40)) / float(1 << 40)


def fit(docs: DataFrame, lang: Column, per_language: int = PER_LANGUAGE, lines: int = LINES) -> Model:
    """Train on a sample of ``docs`` with text and ``lang``; its size is bounded by the parameters for each language."""
    return train(sample(docs, lang, per_language, lines))


def predict(docs: DataFrame, model: Model, keep: list[str], with_words: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, language and score of every row; on demand its words with their languages.

    A kept column that has one of ``names`` is replaced.
    """

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        found = [words_of(t) if model.langs else [] for t in texts(batch)]
        lang, score, labels = [], [], []
        for words, out in zip(found, model.label(found) if model.langs else found, strict=True):
            if not words:
                lang.append(UNKNOWN)
                score.append(0.0)
                labels.append([])
                continue
            weight = np.array([len(w) for w in words], float)
            share = weight @ out / weight.sum()
            best = int(share.argmax())
            lang.append(model.langs[best])
            score.append(min(1.0, float(share[best])))
            if with_words:
                labels.append([{"word": w, "lang": model.langs[k]} for w, k in zip(words, out.argmax(axis=1).tolist(), strict=True)])
        return {names[0]: lang, names[1]: score, "word_langs": labels if with_words else None}

    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    if with_words:
        word = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType())])
        fields.append(T.StructField("word_langs", T.ArrayType(word)))
    columns = dict.fromkeys([*keep, "text"])
    return map_batches(docs.select(*columns), step, T.StructType(fields), keep)


def identify(docs: DataFrame, keep: list[str], folds: int = 4, held: int = 2, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the documents outside the held-out fold, then label all of them."""
    model = fit(docs.where(fold_of(F.col("doc_id"), folds) != held), F.col("lang"))
    return predict(docs, model, keep, names=names)


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = identify(docs, docs.columns, names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
