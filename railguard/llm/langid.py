"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector, derived from its code point alone. A trigram binds
three of them: the vectors are permuted by position and multiplied. A text bundles (adds) the
vectors of its trigrams; so does a language over the texts that are learned from. A document
gets the language whose prototype has the largest cosine with its bundle.

Prototypes are sums of whole numbers, so the order of partial sums cannot change them.

Cases: null text or a text without a letter is ``und`` with score 0, as is every text when
nothing could be learned; equal cosines give the smallest language name; a null doc_id counts
as an empty one in the folds; repeated rows are judged one by one; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.common import fold, map_documents, slices, utf8

#: Components of a vector; prototypes of so many numbers per language are broadcast.
DIMENSIONS = 512
SEED = 0x5DEECE66D
#: Trigrams whose vectors are held at a time.
CHUNK = 8192
#: Learned languages: a bound on what is broadcast (a vector of DIMENSIONS numbers each).
LANGUAGES = 10_000
FOLDS, HELD_FOLD = 4, 2

_SPACE = 0x20
_BITS = np.uint64(21)
#: No letter has a code point beyond the last plane of ideographs.
_LETTERS = np.array([chr(c).isalpha() for c in range(0x33480)])


def letters(text: str) -> np.ndarray:
    """Lower-cased letters of a text as code points, all else as single spaces around them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _LETTERS[np.minimum(codes, len(_LETTERS) - 1)] & (codes < len(_LETTERS))
    if not known.any():
        return codes[:0]
    codes = np.where(known, codes, _SPACE)
    first = np.r_[True, codes[:-1] != _SPACE]
    kept = codes[known | first]
    kept = np.pad(kept, (int(kept[0] != _SPACE), int(kept[-1] != _SPACE)), constant_values=_SPACE)
    return kept.astype(np.uint64)


def trigrams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points in one number) and their counts."""
    codes = letters(text.decode()) if text else np.empty(0, np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    packed = (codes[:-2] << (_BITS + _BITS)) | (codes[1:-1] << _BITS) | codes[2:]
    return np.unique(packed, return_counts=True)


def letter_bits(codes: np.ndarray) -> np.ndarray:
    """Random bits of each code point, by mixing (code point, seed, position)."""
    with np.errstate(over="ignore"):
        x = codes[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)


def bound(packed: np.ndarray) -> np.ndarray:
    """Bipolar vectors of trigrams: letter vectors permuted by place and multiplied."""
    mask = np.uint64((1 << 21) - 1)
    places = [(packed >> np.uint64(s)) & mask for s in (42, 21, 0)]
    known, index = np.unique(np.concatenate(places), return_inverse=True)
    bits = letter_bits(known)
    a, b, c = np.split(index, 3)
    mixed = np.roll(bits, 2, axis=1)[a] ^ np.roll(bits, 1, axis=1)[b] ^ bits[c]
    return (1 - 2 * mixed.view(np.int8)).astype(np.float32)


def bundles(texts: list[bytes | None]) -> np.ndarray:
    """The bundle of every text."""
    found = [trigrams(t) for t in texts]
    known = np.unique(np.concatenate([np.empty(0, np.uint64), *(p for p, _ in found)]))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(known), CHUNK):
        part = known[at : at + CHUNK]
        vectors = bound(part)
        for row, (packed, counts) in enumerate(found):
            lo, hi = np.searchsorted(packed, (part[0], part[-1]))
            hi += hi < len(packed) and packed[hi] == part[-1]
            if lo < hi:
                out[row] += counts[lo:hi].astype(np.float32) @ vectors[np.searchsorted(part, packed[lo:hi])]
    return out


def _partial_prototypes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the summed bundle of this task's texts, in whole numbers."""
    sums: dict[str, np.ndarray] = {}
    for part in slices(batches):
        by_lang: dict[str, list] = {}
        for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
            by_lang.setdefault(lang, []).append(trigrams(text))
        for lang, found in by_lang.items():
            known, index = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            counts = np.bincount(index, np.concatenate([c for _, c in found]), len(known))
            total = sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
            for at in range(0, len(known), CHUNK):
                signs = bound(known[at : at + CHUNK]).astype(np.float64)
                total += np.rint(counts[at : at + CHUNK] @ signs).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
        names=["lang", "sums"],
    )


def prototypes(learned: DataFrame) -> tuple[list[str], np.ndarray]:
    """Unit prototype of every language of ``learned`` (lang, text), in order of name."""
    partial = learned.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(
        _partial_prototypes, "lang string, sums array<bigint>"
    )
    rows = (
        partial.select("lang", F.posexplode("sums").alias("at", "n"))
        .groupBy("lang", "at")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("v"))
        .orderBy("lang")
        .limit(LANGUAGES + 1)
        .collect()
    )
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    vectors = np.array([[x["n"] for x in r["v"]] for r in rows], np.float64).reshape(-1, DIMENSIONS)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [r["lang"] for r in rows], (vectors / np.where(norms, norms, 1)).astype(np.float32)


def identified(docs: DataFrame, learned: DataFrame, carry: list[str]) -> DataFrame:
    """``row``, lang_pred and score of every document, by the prototypes of ``learned``."""
    model = docs.sparkSession.sparkContext.broadcast(prototypes(learned))

    def make():
        names, vectors = model.value

        def step(texts, part):
            out = bundles(texts)
            norms = np.linalg.norm(out, axis=1)
            if not names:
                return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
            cosines = (out @ vectors.T) / np.where(norms, norms, 1)[:, None]
            best = cosines.argmax(1)
            score = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(np.float64)
            some = [bool(t) and len(letters(t.decode())) > 0 for t in texts]
            return {
                "lang_pred": [names[b] if s else "und" for b, s in zip(best, some)],
                "score": np.where(some, score, 0.0).tolist(),
            }

        return step

    return map_documents(docs, carry, "lang_pred string, score double", make)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold("doc_id", FOLDS) == HELD_FOLD
    learned = docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identified(docs, learned, ["doc_id"]).select(
        "row.doc_id",
        (fold("row.doc_id", FOLDS) == HELD_FOLD).alias("held_out"),
        "lang_pred",
        "score",
    )
