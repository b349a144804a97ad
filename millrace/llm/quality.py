"""Quality classifier from weak labels.

Eight heuristic labellers vote bad or good on each text, or not at all where it is too short for them: share of
symbols, of capitals, of exclamation marks, of letters and digits, words that are lone symbols or end in symbols,
words that repeat at once, variety of words. They overlap and err, so expectation-maximisation estimates the accuracy
of each (a two-class model in which labellers are independent given the class, started from "bad if any says so")
from how often each pattern of votes occurs in the whole table. A pattern's posterior is the soft label of its texts.
A logistic model over hashed features (character-class 4-grams, repetition bins, words) learns these labels on a
sample of about 0.95 of `sample_rows` rows, drawn by a hash of id and text over the whole table, and scores every row.

Rows with a score under 0.5 are rejected. Null and empty text get score 0 and are rejected. Repeated rows get equal
scores. An empty table gives no rows. Extra columns pass through; quality and keep replace columns of those names.
"""

from __future__ import annotations

import operator
from math import sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stage

SAMPLE_ROWS, SEED = 8000, 17
#: Slots of the features of characters and repetition, and of words.
DIMENSIONS, WORD_DIMENSIONS = 1024, 1024
#: The sample is bounded, and so is the number of its partitions.
SAMPLE_PARTITIONS = 16
BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ("symbols", "capitals", "exclamations", "alphanumerics", "lone_symbols", "symbol_ends", "repeats", "variety")
SPACE, LINE, LOWER, UPPER, DIGIT, PUNCTUATION, SYMBOL, MARK = range(8)


def _byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[[9, 11, 12, 13, 32]], table[10] = SPACE, LINE
    table[ord("a") : ord("z") + 1] = table[128:] = LOWER  # bytes of characters beyond ASCII count as letters
    table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = UPPER, DIGIT
    table[[ord(c) for c in ".,;:'\"-?()"]], table[ord("!")] = PUNCTUATION, MARK
    return table


_CLASS = _byte_classes().tobytes()


def _classes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode().translate(_CLASS), np.uint8)


_SLOT = ((np.arange(8**4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % DIMENSIONS


_REPEAT_BINS, _VARIETY_BINS = np.array([0.01, 0.05, 0.15, 0.4]), np.array([1.0, 2.0, 3.0, 4.5, 7.0])
_REPEAT_SLOTS = [_slot(f"repeats {k}") for k in range(len(_REPEAT_BINS) + 1)]
_VARIETY_SLOTS = [_slot(f"variety {k}") for k in range(len(_VARIETY_BINS) + 1)]


def _words(words: list[str]) -> tuple[int, float, float]:
    """Number of words, share of words equal to the next, distinct words by the root of the number."""
    n = len(words)
    return n, sum(map(operator.eq, words, words[1:])) / max(n, 1), len(set(words)) / sqrt(max(n, 1))


def votes(text: str) -> list[int]:
    """One vote of each labeller, in the order of LABELLERS."""
    kind = _classes(text)
    count = np.bincount(kind, minlength=8)
    n, repeats, variety = _words(text.split())
    solid, letters = int(count[LOWER:].sum()), int(count[LOWER] + count[UPPER])
    blank = np.concatenate(([True], kind <= LINE, [True]))
    symbol = kind == SYMBOL
    last = symbol & blank[2:]
    lone = int(np.count_nonzero(last & blank[:-2]))
    ends = int(np.count_nonzero(last)) - lone

    def vote(bad: bool, enough: bool) -> int:
        return NONE if not enough else BAD if bad else GOOD

    return [
        vote(count[SYMBOL] > 0.04 * solid, solid >= 10),
        vote(count[UPPER] > 0.4 * letters, letters >= 20),
        vote(count[MARK] > 0.2 * n, n >= 5),
        vote(letters + count[DIGIT] < 0.8 * solid, solid >= 10),
        vote(lone > 0.1 * n, n >= 5),
        vote(ends > 0.2 * n, n >= 5),
        vote(repeats > 0.15, n >= 10),
        vote(variety < 2.0, n >= 40),
    ]


_word_slot = xxhash.xxh32_intdigest


def features(text: str) -> np.ndarray:
    """Hashed features of a text that is not empty."""
    inner = _classes(text)
    kind = np.full(len(inner) + 3, LINE, np.uint16)
    kind[2:-1] = inner
    pairs = kind[:-1] * np.uint16(8) + kind[1:]
    codes = np.bincount(pairs[:-2] * np.uint16(64) + pairs[2:])
    found = np.flatnonzero(codes)
    out = np.bincount(_SLOT[found], codes[found] / len(inner), DIMENSIONS)
    words = text.split()
    n, repeats, variety = _words(words)
    out[_REPEAT_SLOTS[np.searchsorted(_REPEAT_BINS, repeats)]] += 1
    if n >= 40:
        out[_VARIETY_SLOTS[np.searchsorted(_VARIETY_BINS, variety)]] += 1
    # each word's share of the text; a word counts as often as it occurs
    slots = np.fromiter(map(_word_slot, words), np.int64, n) % WORD_DIMENSIONS
    return np.concatenate((out, np.bincount(slots, minlength=WORD_DIMENSIONS) / max(n, 1)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of votes) and their counts: P(good | pattern), P(vote | labeller, class), P(good)."""
    posterior = np.where((patterns == BAD).any(1), 0.1, 0.9)
    for _ in range(rounds):
        prior = float(np.clip((posterior * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        weight = np.stack((1 - posterior, posterior)) * counts
        table = np.stack([[(weight * (patterns[:, k] == v)).sum(1) + 1.0 for v in range(3)] for k in range(patterns.shape[1])])  # labeller, vote, class
        table /= table.sum(1, keepdims=True)
        # an abstention says nothing about the class
        table[:, NONE, :] = 1
        log = np.log([1 - prior, prior])[None, :] + sum(np.log(table[k, patterns[:, k], :]) for k in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, table, prior


def _pattern(text: Column) -> Column:
    """The votes as digits of one number in base 3."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(v * 3**k for k, v in enumerate(votes(x))) for x in texts], dtype="int32")

    return run(text)


def label_model(docs: DataFrame) -> tuple[dict[int, float], int]:
    """Posterior of each pattern that occurs (at most 3 ** 8), and the number of rows with text."""
    rows = docs.filter("length(text) > 0").groupBy(_pattern(F.col("text")).alias("pattern")).count().collect()
    if not rows:
        return {}, 0
    patterns = np.array([[r["pattern"] // 3**k % 3 for k in range(len(LABELLERS))] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    posterior, _, _ = fit_label_model(patterns, counts)
    return {r["pattern"]: float(p) for r, p in zip(rows, posterior, strict=True)}, int(counts.sum())


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the scorer."""
    posterior, n = label_model(docs)
    if not n:
        return np.zeros(DIMENSIONS + WORD_DIMENSIONS), 0.0

    @F.pandas_udf("array<double>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in texts], dtype=object)

    @F.pandas_udf("double")
    def label(patterns: pd.Series) -> pd.Series:
        return patterns.map(posterior).astype(float).clip(0.001, 0.999)

    drawn = docs.filter("length(text) > 0")
    if n > sample_rows:
        row = [c for c in ("doc_id", "text") if c in docs.columns]  # copies under other ids are drawn one by one
        drawn = drawn.filter(F.pmod(F.xxhash64(F.lit(SEED), *row), F.lit(1 << 40)) < int((1 << 40) * 0.95 * sample_rows / n))
    drawn = drawn.select("text").repartition(SAMPLE_PARTITIONS).withColumn("p", label(_pattern(F.col("text")))).select(hashed(F.col("text")).alias("x"), "p")
    drawn = stage(drawn, "sample").select(array_to_vector("x").alias("features"), "p")  # the fit reads it more than once
    # a soft label is both labels, each with its weight
    soft = drawn.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("l"))
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(soft.select("features", "l.label", "l.weight"))
    return model.coefficients.toArray(), float(model.intercept)


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with quality (0 to 1) and keep (quality of 0.5 or more)."""
    weights, intercept = train(docs, sample_rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([1 / (1 + np.exp(-np.clip(features(x) @ weights + intercept, -50, 50))) if x else 0.0 for x in texts], dtype=float)

    return docs.withColumn("quality", score(F.coalesce("text", F.lit("")))).withColumn("keep", F.col("quality") >= 0.5)
