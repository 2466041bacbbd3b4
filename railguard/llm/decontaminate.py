"""Benchmark decontamination by a generalised suffix automaton of the test items.

Test items are normalised to words and dealt into blocks of bounded size; a task builds the
automaton of each block. Documents are streamed through the automata, one after another in
the same pass (no shuffle): the longest matching length at every word gives the words inside
windows of ``window`` item words. A document goes when hit words exceed the coverage limit;
hit spans can be cut from the text of any document.

Cases: null or empty text has no words and is never contaminated; null, empty or repeated
items add nothing new; an item with a null id marks words but is not named; repeated rows
are judged one by one; an empty benchmark marks nothing; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.automaton import WINDOW, SuffixAutomaton
from railguard.llm.common import LOWER_SQL, letter_words, map_slices, sha256_hex, utf8
from railguard.session import durable

#: Words of a block of test items: an automaton of so many words takes under 100 MB.
BLOCK_WORDS = 100_000
#: Longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 20_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _pieces(item, words: list[bytes], window: int):
    if len(words) <= PIECE_WORDS:
        yield item, words, True
        return
    for start in range(0, len(words) - window + 1, PIECE_WORDS - window + 1):
        yield item, words[start : start + PIECE_WORDS], False


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per block of test items: its automaton as bytes, written once."""
    chosen = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = chosen.select(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // (2 * block_words)) + 1  # a word has two characters at least

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"automaton": [SuffixAutomaton(window).build(block).dump()]})

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for piece in _pieces(item, letter_words(text), window):
                    if not piece[1]:
                        continue
                    if size and size + len(piece[1]) > block_words:
                        yield done()
                        block, size = [], 0
                    block.append(piece)
                    size += len(piece[1])
        if block:
            yield done()

    return durable(chosen.repartition(parts).mapInArrow(build, "automaton binary"))


def word_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None
) -> DataFrame:
    """Per row: carried columns (struct ``row``), text, n_words, hit word ranges, named items."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry or ["doc_id"]]).alias("row")
    chosen = docs.select(row, F.col("text").cast("string").alias("text")).withColumns(
        {
            "n_words": F.lit(0).cast("bigint"),
            "starts": F.array().cast("array<bigint>"),
            "ends": F.array().cast("array<bigint>"),
            "items": F.array().cast("array<string>"),
        }
    )
    blocks = automata(benchmark, window)
    # One block at a time passes the driver, on its way into a broadcast; each is bounded.
    packed = [row["automaton"] for row in blocks.toLocalIterator()]
    for data in packed or [SuffixAutomaton(window).build([]).dump()]:
        chosen = _stream(chosen, docs.sparkSession, data)
    return chosen


def _stream(docs: DataFrame, spark: SparkSession, data: bytes) -> DataFrame:
    shared = spark.sparkContext.broadcast(data)
    schema = docs.schema

    def make():
        automaton = SuffixAutomaton.load(shared.value)

        def step(part: pa.RecordBatch):
            out = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            counts, starts, ends, items = [], [], [], []
            for text, s, e, named in zip(
                utf8(out["text"]), out["starts"].to_pylist(), out["ends"].to_pylist(), out["items"].to_pylist()
            ):
                words = letter_words(text)
                spans, found = automaton.hits(words)
                spans = _merged(spans, list(zip(s, e)))
                counts.append(len(words))
                starts.append([x[0] for x in spans])
                ends.append([x[1] for x in spans])
                items.append(sorted({*named, *(x for x in found if x is not None)}))
            yield out | {"n_words": counts, "starts": starts, "ends": ends, "items": items}

        return step

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_slices(docs, kinds, make)


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not (a and b):
        return a or b
    merged: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if merged and merged[-1][1] >= start:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage_inverse: int = 20,
    carry: list[str] | None = None,
) -> DataFrame:
    """Verdict per row: ``contaminated`` when at least 1/``coverage_inverse`` of the words is hit."""
    hit = F.aggregate(
        F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return (
        word_hits(docs, benchmark, window, carry)
        .withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (coverage_inverse * F.col("n_hit") >= F.col("n_words")))
    )


def cut_spans(judged: DataFrame, longer_than: int = 0) -> DataFrame:
    """``clean_text``: the text without hit word ranges of more than ``longer_than`` words."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema)

    def make():
        def step(part: pa.RecordBatch):
            out = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            clean = []
            for text, s, e in zip(utf8(out["text"]), out["starts"].to_pylist(), out["ends"].to_pylist()):
                spans = [(a, b) for a, b in zip(s, e) if b - a > longer_than]
                if text is None or not spans:
                    clean.append(text)
                    continue
                places = [m.span() for m in _WORD.finditer(text)]
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at : places[a][0]])
                    at = places[b - 1][1]
                clean.append(b"".join([*kept, text[at:]]))
            yield out | {"clean_text": pa.array(clean, pa.binary()).cast(pa.string())}

        return step

    return map_slices(judged, f"{kinds}, clean_text string", make)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


_WORDS_SQL = rf"regexp_extract_all({LOWER_SQL.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS_SQL}, []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k,
               unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
),
found AS (SELECT doc_id, item_id, p.k, i FROM places p JOIN windows x ON p.k = x.k AND p.win = x.win),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM
  (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, k, i FROM found))
  GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
       coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
