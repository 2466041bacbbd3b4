"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Every text becomes a set of n-gram indicators: byte trigrams, word unigrams and bigrams,
bigrams of word shapes, and bigrams and trigrams that the text repeats, the last two kinds once for
each share of the text they reach. Class log-count ratios of the indicators are counted over
all labelled training rows; a sample bounded by ``LABELLED_ROWS`` scaled by them fits a
linear hinge-loss model by dual coordinate descent, whose margins a sigmoid fitted on a
fifth of the sample turns into probabilities. Every document is scored, whole.

Cases: null and empty texts have no indicators and get the score of the bias alone; very
long texts only have more indicators, at most ``2 ** BITS``; repeated rows are scored one by
one; repeated ids in ``labels`` count once, with their mean label (a tie of both kinds counts
as 1), null ids and labels not at all; without training labels of both kinds every score is
the smoothed share of label 1 (0.5 without labels); empty tables give no rows; further
columns are ignored, and carried ones cannot clash (they stay in the struct ``row``).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.common import fold, map_documents, map_slices, slices, utf8

#: Labelled training documents that the hinge-loss model is fitted on at most.
LABELLED_ROWS = 10_000
#: Indicators are hashed to this many bits.
BITS = 18
#: Labels are broadcast up to this many rows (about 40 bytes each), joined by exchange beyond.
BROADCAST_LABELS = 2_000_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Added to every class count of an indicator.
SMOOTHING = 1.0
#: Weight of the fitted model against the plain naive Bayes direction.
INTERPOLATION = 0.25
EPOCHS, TOLERANCE = 40, 1e-3
#: Shares 1/2, 1/4, ... of a text that a shape or a repetition reaches.
LEVELS = 7
#: Words remembered per task, with their hash and shape.
CACHE = 200_000

_CHARS, _WORDS, _PAIRS, _SHAPES, _ECHOES = (np.uint64(x) for x in range(1, 6))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER, _UPPER = frozenset(b"abcdefghijklmnopqrstuvwxyz"), frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = frozenset(b"0123456789")


def _hashed(stream: np.uint64, codes: np.ndarray) -> np.ndarray:
    mixed = ((codes.astype(np.uint64) ^ (stream << np.uint64(58))) + stream) * _SPREAD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _shape(word: bytes) -> int:
    """Flags: lower case, upper case, digit, other ASCII, two equal other ASCII in a row."""
    flags, last = 0, -1
    for b in word:
        if b in _LOWER or b >= 0x80:
            flags |= 1
        elif b in _UPPER:
            flags |= 2
        elif b in _DIGIT:
            flags |= 4
        else:
            flags |= 24 if b == last else 8
        last = b
    return flags


def _levels(stream: np.uint64, codes: np.ndarray, counts: np.ndarray, whole: int) -> np.ndarray:
    """One indicator per code and level 2^-k, k = 1..LEVELS, that its share of ``whole`` reaches."""
    first = np.clip(np.ceil(-np.log2(counts / whole)), 1, LEVELS + 1).astype(np.int64)
    level = np.arange(1, LEVELS + 1)
    row, at = np.nonzero(first[:, None] <= level[None, :])
    return _hashed(stream, codes[row] * 16 + level[at])


class _Words(dict):
    """Word -> hash (32 bits) and shape (5 bits) in one number; forgotten when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        known = self[word] = zlib.crc32(word.lower()) << 5 | _shape(word)
        return known


class Grams:
    """Indicators of a text; words and their hashes are remembered while a task runs."""

    def __init__(self) -> None:
        self._words = _Words()
        self._seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct indicator numbers below ``2 ** BITS``."""
        if not text:
            return np.empty(0, np.int64)
        seen = self._seen
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        if len(raw) > 2:
            seen[_hashed(_CHARS, raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])] = True
        words = text.split()
        known = np.array([self._words[w] for w in words], np.int64)
        ids, shapes = known >> 5, known & 31
        seen[_hashed(_WORDS, ids)] = True
        if len(ids) > 1:
            pairs = ids[:-1] << 31 ^ ids[1:]
            seen[_hashed(_PAIRS, pairs)] = True
            counts = np.bincount(shapes[:-1] << 5 | shapes[1:])
            codes = np.flatnonzero(counts)
            seen[_levels(_SHAPES, codes, counts[codes], len(pairs))] = True
            triples = pairs[:-1] * 31 ^ ids[2:]
            echo = np.array([(ids[:-1] == ids[1:]).sum(), len(triples) - len(np.unique(triples))])
            kinds = np.flatnonzero(echo)
            seen[_levels(_ECHOES, kinds, echo[kinds], len(pairs))] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found


def descend(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int
) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss.

    ``rows`` and ``values`` are sparse examples, ``y`` is +1 or -1, ``cost`` bounds each
    example's dual variable. The order is drawn from a fixed seed; the descent stops when no
    projected gradient exceeds ``TOLERANCE``.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    draw = np.random.default_rng(0)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            if not square[i]:
                continue
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1.0
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            if projected:
                worst = max(worst, abs(projected))
                moved = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                w[rows[i]] += (moved - alpha[i]) * y[i] * values[i]
                alpha[i] = moved
        if worst <= TOLERANCE:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton steps, with Platt's smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-12)
        grad = np.array([(g * margin).sum() + 1e-6 * a, g.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


@dataclass
class Model:
    """``weights`` already hold ratio times fitted weight; ``ratio`` gives the row norms."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, grams: np.ndarray) -> float:
        margin = self.bias
        if len(grams):
            r = self.ratio[grams].astype(float)
            norm = float(np.sqrt(r @ r))
            if norm:
                margin += float(self.weights[grams].astype(float).sum()) / norm
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the labelled documents outside the held-out fold."""
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.filter(fold("doc_id", FOLDS) != HELD_OUT).join(known, "doc_id")


def _counts(training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class totals (2) and per indicator and class the number of documents (2, 2^BITS)."""

    def run(batches):
        # One place more than indicators counts the documents.
        grams, counts = Grams(), np.zeros((2, (1 << BITS) + 1), np.int64)
        for part in slices(batches):
            for text, label in zip(utf8(part.column(0)), part.column(1).to_pylist()):
                counts[label][grams(text)] += 1
                counts[label][-1] += 1
        at = np.nonzero(counts.any(0))[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["gram", "n0", "n1"]
        )

    rows = training.select("text", "label").mapInArrow(run, "gram int, n0 bigint, n1 bigint")
    # At most 2^BITS rows of three numbers come back.
    summed = rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, (1 << BITS) + 1), np.int64)
    at = summed.column("gram").to_numpy()
    counts[0][at], counts[1][at] = summed.column("n0").to_numpy(), summed.column("n1").to_numpy()
    return counts[:, -1], counts[:, :-1]


def _sample(training: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of at most ``LABELLED_ROWS`` documents, chosen by a hash of the id."""
    chosen = (
        training.select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    )
    picked = training.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", "label", "text")

    def make():
        grams = Grams()

        def step(part):
            found = pa.array([grams(t).astype(np.int32) for t in utf8(part.column(2))], pa.list_(pa.int32()))
            yield {"doc_id": part.column(0), "label": part.column(1), "grams": found}

        return step

    rows = map_slices(picked, "doc_id bigint, label int, grams array<int>", make)
    # A copied id gives several documents; one of each keeps the sample within its bound.
    one = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("grams").alias("grams"))
    table = one.orderBy("doc_id").toArrow()
    flat = table.column("grams").combine_chunks()
    ends = flat.offsets.to_numpy()
    values = flat.values.to_numpy(zero_copy_only=False)
    return [values[s:e] for s, e in zip(ends, ends[1:])], table.column("label").to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model; or a constant score where the training labels are not of both kinds."""
    training = _training(docs, labels)
    totals, counts = _counts(training)
    if not totals.all():
        return float((totals[1] + 1) / (totals.sum() + 2))
    smoothed = counts + SMOOTHING
    ratio = np.log(smoothed[1] / smoothed[1].sum()) - np.log(smoothed[0] / smoothed[0].sum())
    ratio[~counts.any(0)] = 0.0
    grams, label = _sample(training)
    y = np.where(label == 1, 1.0, -1.0)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    size = 1 << BITS
    rows, values = [], []
    for g in grams:
        norm = float(np.sqrt(ratio[g] @ ratio[g])) or 1.0
        rows.append(np.append(g, size))
        values.append(np.append(ratio[g] / norm, 1.0))  # the last feature is the bias
    taken = np.nonzero(~aside)[0]
    share = (y[taken] > 0).mean() if len(taken) else 0.5
    cost = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    w = descend([rows[i] for i in taken], [values[i] for i in taken], y[taken], cost[taken], size + 1)
    bias, w = float(w[-1]), w[:-1]
    seen = counts.any(0)
    w = np.where(seen, (1 - INTERPOLATION) * np.abs(w[seen]).mean() + INTERPOLATION * w, 0.0)
    margin = np.array([bias + float(w[r[:-1]] @ v[:-1]) for r, v in zip(rows, values)])
    check = aside if aside.any() else ~aside
    slope, offset = calibrate(margin[check], y[check])
    return Model(ratio.astype(np.float32), (ratio * w).astype(np.float32), bias, slope, offset)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (carried columns) and ``score``, the probability of label 1, for every document."""
    model = spark.sparkContext.broadcast(fit(docs, labels))  # two arrays of 2^BITS numbers

    def make():
        known, grams = model.value, Grams()
        if isinstance(known, float):
            return lambda texts, part: {"score": [known] * len(texts)}
        return lambda texts, part: {"score": [known.score(grams(t)) for t in texts]}

    return map_documents(docs, carry, "score double", make)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(spark, docs, labels, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        (fold("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
