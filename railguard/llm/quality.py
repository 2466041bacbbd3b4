"""Quality rules: base rules and boosted trees over document statistics.

Statistics of whole texts feed gradient-boosted trees fitted on the rows of ``labels``
(a sample bounded by ``LABELLED_ROWS``, a fifth of it set aside for the threshold). Symbols,
repeated lines, repeated windows and capitals can only lower a document's score, a richer
vocabulary can only raise it. Every document is scored from flat node arrays.

Cases: null or empty text has no words and fails the base rules; repeated ids in ``labels``
count once, with their mean label, and null labels not at all; without labels of both kinds
the base rules decide alone; repeated rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.common import CONTINUATION, WHITE, code_points, map_documents
from railguard.llm.trees import Forest, fit

#: Labelled documents that the trees are fitted on at most (chosen by a hash of the id).
LABELLED_ROWS = 20_000
#: Share of good labelled documents that the threshold lets pass at least.
GOOD_KEPT = 0.995
REPEAT_WORDS = 8

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Feature and direction: 1 if more can only raise the score, -1 if it can only lower it.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols": -1,
    "repeated_lines": -1,
    "repeated_words": -1,
    "capitals": -1,
    "digits": 0,
    "exclamations": -1,
    "bars": -1,
    "distinct_words": 1,
    "line_words": 0,
}


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The contract's five counts and the features of the trees."""
    if not text:
        return [0] * 5, [0.0] * len(FEATURES)
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, CONTINUATION + WHITE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated_lines = len(lines) - len(set(lines))
    repeated_words = _repeated(words)
    count = lambda letters: len(text) - len(text.translate(None, letters))
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    features = [
        float(np.log1p(n)),
        chars * per_word,
        symbols * per_char,
        repeated_lines / max(len(lines), 1),
        repeated_words * per_word,
        count(_CAPITALS) * per_char,
        count(_DIGITS) * per_char,
        text.count(b"!") * per_char,
        text.count(b"|") * per_char,
        len(set(words)) * per_word,
        n / max(len(lines), 1),
    ]
    return [n, chars, symbols, repeated_lines, repeated_words], features


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur at least twice."""
    size = REPEAT_WORDS
    windows = len(words) - size + 1
    if windows < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    grams = [joined[s:e] for s, e in zip(starts, ends[size - 1 :].tolist())]
    grams[-1] += b" "  # the last word has no space behind it
    if len(set(grams)) == windows:
        return 0
    seen = Counter(grams)
    steps = np.zeros(len(words) + 1, np.int64)
    again = np.fromiter((seen[g] > 1 for g in grams), bool, windows)
    steps[:windows] += again
    steps[size : size + windows] -= again
    return int((np.cumsum(steps)[:-1] > 0).sum())


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Trees and threshold from a bounded sample of labelled documents."""
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED_ROWS)
    )
    # At most LABELLED_ROWS rows of two numbers are broadcast.
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda texts, part: {"x": [statistics(t)[1] for t in texts]}

    rows = map_documents(labelled, ["doc_id", "label"], "x array<double>", make)
    # A copied id gives several documents; one of each keeps the sample within its bound.
    rows = rows.groupBy("row.doc_id").agg(F.max("row.label").alias("label"), F.max("x").alias("x"))
    held = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).orderBy("doc_id").collect()
    if len({r["label"] >= 0.5 for r in held}) < 2:
        return None
    x = np.array([r["x"] for r in held])
    y = np.array([r["label"] >= 0.5 for r in held], float)
    out = np.array([r["held"] for r in held])
    if len(set(y[~out])) < 2:
        out[:] = False
    forest = fit(x[~out], y[~out], list(FEATURES.values()))
    check = out if (y[out] == 1).any() else ~out
    good = np.sort(forest.probability(x[check & (y == 1)]))
    threshold = good[int((1 - GOOD_KEPT) * len(good))]
    return forest, float(min(threshold, 0.5))


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (carried columns), the five counts, base_failed, probability and kept."""
    model = spark.sparkContext.broadcast(fitted(spark, docs, labels))

    def make():
        forest, threshold = model.value or (None, 0.0)

        def step(texts, part):
            found = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(STATS))
            n, repeated = counts[:, 0], counts[:, 4]
            failed = (n < 20) | (100 * repeated > 30 * n)
            x = np.array([f for _, f in found]).reshape(-1, len(FEATURES))
            p = forest.probability(x) if forest else np.ones(len(texts))
            own = {name: pa.array(counts[:, i]) for i, name in enumerate(STATS)}
            return own | {
                "base_failed": pa.array(failed),
                "probability": pa.array(p),
                "kept": pa.array(~failed & (p >= threshold)),
            }

        return step

    counts = ", ".join(f"{s} bigint" for s in STATS)
    return map_documents(docs, carry, f"{counts}, base_failed boolean, probability double, kept boolean", make)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(spark, docs, labels, ["doc_id"]).select("row.doc_id", *STATS, "base_failed", "kept", "probability")
