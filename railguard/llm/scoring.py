"""LM scoring: smoothed word counts, and a causal self-attention model on subword ids.

1. Tasks count the words of the training documents, Spark adds the counts up.
2. One pass splits every document into subwords, and its ids are written once, beside its base
   score: the fit and the scores read them there. Tasks count every subword of the training
   documents and what stands before it: the classes, and the shares within them.
3. The attention weights start from a sample of windows (``SAMPLE_DOCS``, ``WINDOWS_PER_DOC``)
   and are then fitted on all windows of all training documents: every task passes over its
   own ones from the same start, and the tasks' weights are averaged by what each has read.
   The deal of documents to tasks so decides the last digits of a score, not what is read.
4. One pass scores every document: overlapping windows score each subword once. For the base
   score, counts of the ``TOP_WORDS`` most frequent words come from a broadcast of that size;
   the other words of a document are joined with the count table on the word (none of them is
   frequent, so no key is hot) and added up per document.

Cases: null or empty text is the end alone; a null doc_id counts as an empty one in the
folds; repeated rows are scored one by one; without training documents all words are
unknown and the model is uniform within and over its classes; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from railguard.llm.attention import KEYS, PROFILE, SCORED, Model, averaged, continued, neighbours, places, train, windows
from railguard.llm.common import fold, map_documents, map_slices, slices, utf8
from railguard.llm.packing import default_vocabulary
from railguard.llm.tokens import LONG_PART, PartIds, load_encoding
from railguard.session import durable

FOLDS, HELD_FOLD = 10, 0
#: The end of a text as a word. White space cannot be part of any other word.
END_WORD = "\n"
#: The end of a text, and what stands before its first subword.
END_ID = 50256
#: Words whose counts are broadcast (bounded), and words that a task counts at a time.
TOP_WORDS = 1 << 17
COUNTED_WORDS = 300_000
SAMPLE_DOCS, WINDOWS_PER_DOC = 2000, 32
#: Levels in which tasks add weights up before the driver gets the sum.
SUM_DEPTH = 3
#: Windows scored at a time, and entries of a task's subword cache.
BATCH_WINDOWS = 1024
CACHE_WORDS = 200_000


@dataclass
class Words:
    """The words of some texts, as places among the distinct ones."""

    distinct: pa.Array
    names: list[str]  # the same, for Python
    which: np.ndarray  # of all texts, one after the other
    bounds: np.ndarray  # where each text begins, and the end

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        real = pc.not_equal(lists.flatten(), "")  # there are empty words at the ends of a text
        bounds = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy()]
        coded = lists.flatten().filter(real).dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        return cls(coded.dictionary, names.split(" ") if names else [], coded.indices.to_numpy(), bounds)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of its words' values."""
        texts = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return np.bincount(texts, values[self.which], len(self.bounds) - 1)

    def counted(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen words of each text, how often it has them, and where each text's begin."""
        texts = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        on = chosen[self.which]
        both, n = np.unique(texts[on] * len(chosen) + self.which[on], return_counts=True)
        begin = np.searchsorted(both, np.arange(len(self.bounds)) * len(chosen))
        return both % max(len(chosen), 1), n, begin


@lru_cache(1)
def _part_ids(vocabulary: str) -> PartIds:
    """Loaded once per Python worker, which serves many tasks."""
    return PartIds(load_encoding(vocabulary))


class WordIds(dict):
    """Subword ids of a word (with the space before it) as 16-bit numbers; bounded cache."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.parts = _part_ids(vocabulary)

    def _all(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; short ones that are new are encoded in one go and kept."""
        found = list(map(self.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        # Space of other kinds at a word's end would join the space before the next word.
        fresh = [i for i in new if len(words[i]) < LONG_PART and not words[i][-1].isspace()]
        if len(self) + len(fresh) > CACHE_WORDS:
            self.clear()
        for i, ids in zip(fresh, self.parts.together([" " + words[i] for i in fresh])):
            found[i] = self[words[i]] = ids
        return [np.array(self.parts.encode(" " + w), "<u2").tobytes() if x is None else x for w, x in zip(words, found)]

    def sequences(self, words: Words) -> list[bytes]:
        """END, the subwords of the words, END, two bytes each, for every text."""
        found = self._all(words.names)
        flat, sizes = np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2
        size = sizes[words.which]
        ends = np.cumsum(size)
        begin = (np.cumsum(sizes) - sizes)[words.which] - (ends - size)
        data = flat[np.repeat(begin, size) + np.arange(size.sum())].tobytes()
        cuts = (2 * np.concatenate(([0], ends))[words.bounds]).tolist()
        end = np.array([END_ID], "<u2").tobytes()
        return [end + data[a:b] + end for a, b in itertools.pairwise(cuts)]

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """The same of one text's words."""
        return np.frombuffer(self.sequences(Words.of(pa.array([b" ".join(words).decode()])))[0], "<u2").astype(np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) of all tokens of the training documents, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def done() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "c"],
            )
            counts.clear()
            return made

        for part in slices(batches):
            for text in utf8(part.column(0)):
                counts.update(words_of(text))
            counts[END_WORD.encode()] += part.num_rows
            if len(counts) > COUNTED_WORDS:
                yield done()
        yield done()

    partial = training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, c bigint")
    return durable(partial.groupBy("word").agg(F.sum("c").alias("c")))


def subword_counts(sequences: DataFrame) -> np.ndarray:
    """Corpus counts of every subword id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(END_ID + 1, np.int64)
        for part in slices(batches):
            total += np.bincount(np.concatenate(_sequences(part)), minlength=END_ID + 1)
            total[END_ID] -= part.num_rows  # the first id of a sequence stands before the text
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known])], names=["id", "n"])

    rows = sequences.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(END_ID + 1)
    for r in rows.collect():  # at most one row per id of the vocabulary
        out[r["id"]] = r["n"]
    return out


def sample_windows(training: DataFrame, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """At most SAMPLE_DOCS * WINDOWS_PER_DOC windows, evenly spaced over each document."""
    key = F.xxhash64("doc_id", F.length("text"))
    # The limit is taken on ids, the texts are read for those only.
    chosen = training.select(key.alias("k"), "doc_id").orderBy("k", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    picked = training.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(vocabulary)
        for part in slices(batches):
            made = [], [], []
            for doc, sequence in zip(part.column(0).to_pylist(), ids.sequences(Words.of(part.column(1)))):
                x, y, _ = windows([np.frombuffer(sequence, "<u2").astype(np.int64)], END_ID + 1)
                spread = np.unique(np.linspace(0, len(x) - 1, WINDOWS_PER_DOC).astype(int))
                made[0].extend([doc] * len(spread))
                made[1].extend(x[spread].tolist())
                made[2].extend(y[spread].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[0], pa.int64()), pa.array(made[1], pa.list_(pa.int64())), pa.array(made[2], pa.list_(pa.int64()))],
                names=["doc", "x", "y"],
            )

    rows = (
        picked.mapInArrow(run, "doc bigint, x array<bigint>, y array<bigint>")
        .orderBy("doc", "x", "y")
        .limit(SAMPLE_DOCS * WINDOWS_PER_DOC)
        .collect()
    )
    x, y = (np.array([r[c] for r in rows], np.int64) for c in ("x", "y"))
    return x.reshape(-1, KEYS), y.reshape(-1, SCORED)


def subword_sequences(training: DataFrame, vocabulary: str) -> DataFrame:
    """The subword ids of every document as 16-bit numbers, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(vocabulary)
        for part in slices(batches):
            made = ids.sequences(Words.of(part.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["ids"])

    return durable(training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "ids binary"))


def _sequences(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in part.column(0).to_pylist()]


def profiles(sequences: DataFrame, counts: np.ndarray) -> np.ndarray:
    """What stands before each id, counted over all training documents."""
    place = places(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(counts) * PROFILE, np.int64)
        for part in slices(batches):
            for x in _sequences(part):
                np.add.at(total, neighbours(x[:-1], x[1:], place), 1)
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known])], names=["k", "n"])

    # At most PROFILE rows per id of the vocabulary, whatever the corpus.
    rows = sequences.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(counts) * PROFILE, np.float32)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(-1, PROFILE)


def fitted_on_all(model: Model, sequences: DataFrame) -> Model:
    """The model after one pass over all windows of the training documents."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        blocks = (windows(_sequences(part), start.pad)[:2] for part in slices(batches))
        sums = continued(start, blocks)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    def add(a, b):
        return b if a is None else a if b is None else a + b

    rows = sequences.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"], np.float32))
    sums = rows.treeAggregate(None, add, add, SUM_DEPTH)
    return model if sums is None else averaged(model, sums)


def scored(docs: DataFrame, training: DataFrame | Column, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score.

    ``training`` are the documents to learn from: a table, or a condition on ``docs``, whose
    subwords are then those that are scored.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    within = isinstance(training, Column)
    docs = docs.select("doc_id", "text", F.coalesce(training if within else F.lit(False), F.lit(False)).alias("teaches"))
    training = docs.filter("teaches") if within else training
    counts = word_counts(training)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = {r["word"]: r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()}
    denominator = total + 0.1 * (distinct + 1)
    unknown = math.log10(0.1 / denominator)
    words = spark.sparkContext.broadcast(top)
    part = durable(_based(docs, words, vocabulary, denominator))
    sequences = part.filter("row.teaches").select("ids") if within else subword_sequences(training, vocabulary)
    known = subword_counts(sequences)
    start = _fit(sample_windows(training, vocabulary), known, profiles(sequences, known))
    model = fitted_on_all(start, sequences)
    rest = counts.select("word", F.log10((F.col("c") + 0.1) / denominator).alias("l"))
    rare = (
        part.select("rid", F.explode("rare").alias("r"))
        .select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
        .join(rest, "word")
        .groupBy("rid")
        .agg(F.sum(F.col("n") * (F.col("l") - unknown)).alias("more"), F.sum("n").alias("known"))
    )
    return _score(part, spark.sparkContext.broadcast(model)).join(rare, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("top_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("top_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _fit(sample: tuple[np.ndarray, np.ndarray], counts: np.ndarray, profile: np.ndarray) -> Model:
    ids, targets = sample
    if not len(ids):
        ids, targets = windows([np.array([END_ID, END_ID])], END_ID + 1)[:2]
    return train(ids, targets, counts, profile=profile)


def _based(docs: DataFrame, shared, vocabulary: str, denominator: float) -> DataFrame:
    """Subword ids, and the base score as if the words beyond the top were unknown."""

    def make():
        from pyspark import TaskContext

        ids = WordIds(vocabulary)
        number = itertools.count(TaskContext.get().partitionId() << 33)
        unknown = math.log10(0.1 / denominator)
        logs = {w: math.log10((c + 0.1) / denominator) for w, c in shared.value.items()}
        end = logs.get(END_WORD)

        def step(texts, part):
            words = Words.of(part.column(1))
            log = np.array([logs.get(w, math.nan) for w in words.names], np.float64)
            known = ~np.isnan(log)
            rare, n, begin = words.counted(~known)
            return {
                "rid": list(itertools.islice(number, len(texts))),
                "n_tokens": np.diff(words.bounds) + 1,
                "top_known": words.sums(known).astype(np.int64) + (end is not None),
                "top_score": words.sums(np.where(known, log, unknown)) + (unknown if end is None else end),
                "ids": ids.sequences(words),
                "rare": pa.ListArray.from_arrays(
                    pa.array(begin, pa.int32()),
                    pa.StructArray.from_arrays([words.distinct.take(pa.array(rare)), pa.array(n)], names=["word", "n"]),
                ),
            }

        return step

    own = "rid bigint, n_tokens bigint, top_known bigint, top_score double, ids binary, rare array<struct<word:string,n:bigint>>"
    return map_documents(docs, ["doc_id", "teaches"], own, make)


def _score(part: DataFrame, shared) -> DataFrame:
    """The model's score beside the columns of the base score."""
    row = F.struct("row.doc_id", "rid", "n_tokens", "top_known", "top_score").alias("row")
    chosen = part.select("ids", row)

    def make():
        model = shared.value.prepare()

        def run(part: pa.RecordBatch):
            yield {"row": part.column(1), "score": _document_scores(model, _sequences(part))}

        return run

    return map_slices(chosen, f"row {chosen.schema['row'].dataType.simpleString()}, score double", make).select("row.*", "score")


def _document_scores(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """The sum over each sequence, some windows at a time."""
    out = np.zeros(len(sequences))
    # Long documents are taken alone, so that the windows held stay bounded by one document.
    ids, targets, owner = windows(sequences, model.pad)
    for at in range(0, len(ids), BATCH_WINDOWS):
        block = slice(at, at + BATCH_WINDOWS)
        scores = model.log10_probabilities(ids[block], targets[block]).sum(1, dtype=np.float64)
        out += np.bincount(owner[block], scores, len(sequences))
    return out


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fold("doc_id", FOLDS) != HELD_FOLD).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_FOLD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
