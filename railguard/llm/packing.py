"""Mixture-controlled packing by deficit round-robin over source queues.

1. Tasks tokenise their documents and note, per source, the tokens that stand before each
   document in the same task; the ids are written once.
2. The tokens of each (task, source) are added up to where every task starts in every source
   queue, and each queue is dealt into the same number of rounds ("blocks" of about
   ``BLOCK_WINDOWS`` windows) in proportion: round b gets the tokens from
   floor(b * T / B + phase) on, so what a round owes a source is carried to the next one.
3. A task packs one round: every source queue earns its share of a window per turn, serves
   documents while its deficit lasts, and keeps the rest of the deficit for the next window.
   A window is closed when it is full; only the last window of a round can be shorter.

The target share of a source in any round and window is its share of all tokens, so a source
with a third of all rows is spread over every task.

Cases: null or empty text is the closing id alone; a very long text is cut where rounds and
windows end; a null source is a queue of its own; repeated rows and ids are documents of
their own; ties do not occur (queues are in order of task and place); an empty table gives no
pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from railguard.llm.common import map_documents, slices
from railguard.llm.tokens import PartIds, added_tokens, load_encoding
from railguard.session import durable

WINDOW_TOKENS = 1024
#: Windows of a round: what one task holds and packs (about a million tokens).
BLOCK_WINDOWS = 1024
#: A source is served at least so many tokens at a time, so that documents are not shredded.
LEAST_PIECE = 256
END_ID = 0
#: Queue starts (two numbers, a source, a task) are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
#: sequence_id = round * this + window; a round has far fewer windows.
WINDOWS_PER_ROUND_ID = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: row.doc_id, row.source, task, before (tokens of the same source earlier in
    the task), n and ids (16-bit little-endian, closed by id 0)."""

    def make():
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        parts = PartIds(load_encoding(vocabulary), added_tokens(vocabulary))
        sums: dict[str | None, int] = {}
        end = np.array([END_ID], "<u2").tobytes()

        def step(texts, part):
            ids = [x + end for x in parts.ids([(t or b"").decode() for t in texts])]
            before = []
            for source, x in zip(part.column(0).field("source").to_pylist(), ids):
                before.append(sums.get(source, 0))
                sums[source] = before[-1] + len(x) // 2
            return {"task": [task] * len(ids), "before": before, "n": [len(x) // 2 for x in ids], "ids": ids}

        return step

    return map_documents(docs, ["doc_id", "source"], "task int, before bigint, n bigint, ids binary", make)


def _phase(source: str | None) -> int:
    """A fixed start in [0, 2^32) of a source's rounding, so that small queues do not all
    give their next token to the same round."""
    return zlib.crc32((source or "").encode())


def round_start(b: int, tokens: int, rounds: int, phase: int) -> int:
    """Tokens of a queue before round ``b``: floor(b * tokens / rounds + phase / 2^32)."""
    return (b * tokens * (1 << 32) + phase * rounds) // (rounds << 32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut documents where the rounds of their queue begin."""
    for part in slices(batches):
        out: dict[str, list] = {k: [] for k in ("round", "source", "at", "doc_id", "start", "n", "ids")}
        columns = {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
        for doc_id, source, x, n, ids, tokens, rounds in zip(
            *(columns[k] for k in ("doc_id", "source", "x", "n", "ids", "tokens", "rounds"))
        ):
            phase = _phase(source)
            # The last round that begins at or before x: at most one off the exact quotient.
            b = max(0, min(rounds - 1, ((x + 1) * (rounds << 32) - phase * rounds) // (tokens << 32)))
            while b and round_start(b, tokens, rounds, phase) > x:
                b -= 1
            while b + 1 < rounds and round_start(b + 1, tokens, rounds, phase) <= x:
                b += 1
            lo = x
            while lo < x + n:
                hi = min(x + n, round_start(b + 1, tokens, rounds, phase))
                if hi > lo:
                    for key, value in zip(out, (b, source, lo, doc_id, lo - x, n, ids[2 * (lo - x) : 2 * (hi - x)])):
                        out[key].append(value)
                lo, b = max(lo, hi), b + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["round"], pa.int64()),
                pa.array(out["source"], pa.string()),
                pa.array(out["at"], pa.int64()),
                pa.array(out["doc_id"], pa.int64()),
                pa.array(out["start"], pa.int64()),
                pa.array(out["n"], pa.int64()),
                pa.array(out["ids"], pa.binary()),
            ],
            names=list(out),
        )


def pack_round(queues: dict, window: int = WINDOW_TOKENS, least: int = LEAST_PIECE) -> list[tuple]:
    """Deficit round-robin: (piece, from, length, window number, offset) for every piece.

    ``queues`` maps a source to its pieces [(piece, tokens)] in queue order. Each source earns
    its share of ``window`` tokens per turn. It serves its head piece while its deficit covers
    ``least`` tokens (or the rest of the piece), never beyond the window's room; what it could
    not serve stays in its deficit, over window ends too.
    """
    total = sum(n for pieces in queues.values() for _, n in pieces)
    waiting = {s: deque([p, 0, n] for p, n in pieces) for s, pieces in queues.items() if pieces}
    share = {s: window * sum(n for _, n in queues[s]) / total for s in waiting}
    deficit = dict.fromkeys(waiting, 0.0)
    out, number, filled = [], 0, 0
    while waiting:
        for s in list(waiting):
            queue = waiting[s]
            deficit[s] += share[s]
            while queue:
                piece, at, left = head = queue[0]
                if deficit[s] < min(least, left):
                    break
                take = min(left, window - filled, max(int(deficit[s]), 1))
                out.append((piece, at, take, number, filled))
                deficit[s] -= take
                filled += take
                if filled == window:
                    number, filled = number + 1, 0
                if take == left:
                    queue.popleft()
                else:
                    head[1:] = at + take, left - take
            if not queue:
                del waiting[s]
    return out


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, source string, ids binary"
)


def _pack(number: int, rows: pa.Table) -> pa.RecordBatch:
    columns = {name: rows.column(name).to_pylist() for name in ("doc_id", "source", "at", "start", "n", "ids")}
    order = sorted(
        range(rows.num_rows), key=lambda i: (columns["source"][i] is not None, columns["source"][i] or "", columns["at"][i])
    )
    queues: dict = {}
    for i in order:
        queues.setdefault(columns["source"][i], []).append((i, len(columns["ids"][i]) // 2))
    pieces = pack_round(queues)
    ids = [columns["ids"][i][2 * at : 2 * (at + n)] for i, at, n, _, _ in pieces]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([columns["doc_id"][p[0]] for p in pieces], pa.int64()),
            pa.array([columns["start"][p[0]] + p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], pa.int64()),
            pa.array([columns["n"][p[0]] for p in pieces], pa.int64()),
            pa.array([number * WINDOWS_PER_ROUND_ID + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
            pa.array([columns["source"][p[0]] for p in pieces], pa.string()),
            pa.array(ids, pa.binary()),
        ],
        names=[x.split()[0] for x in PIECES.split(", ")],
    )


def _pack_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by round: one round, of bounded size, is held at a time."""
    held: list[pa.Table] = []
    current = None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        at = 0
        while at < len(numbers):
            if current is not None and numbers[at] != current:
                yield _pack(current, pa.concat_tables(held))
                held = []
            current = int(numbers[at])
            upto = int(np.searchsorted(numbers, current, "right"))
            held.append(pa.Table.from_batches([batch.slice(at, upto - at)]))
            at = upto
    if held:
        yield _pack(current, pa.concat_tables(held))


def pack(docs: DataFrame, vocabulary: str | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, with their ids."""
    done = durable(tokenised(docs, vocabulary or default_vocabulary()))
    per_task = done.groupBy("task", F.col("row.source").alias("source")).agg(F.sum("n").alias("n"))
    # A queue has one row per task here, whatever the number of its documents.
    queue = Window.partitionBy("source").orderBy("task")
    placed = (
        per_task.withColumn("base", F.sum("n").over(queue) - F.col("n"))
        .withColumn("tokens", F.sum("n").over(Window.partitionBy("source")))
        .select(F.col("task").alias("t"), F.col("source").alias("s"), "base", "tokens")
    )
    # A row per task and source: broadcast while it is small, else joined by a shuffle.
    placed = durable(placed)
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    total = done.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, round(total / (block_windows * WINDOW_TOKENS)))
    joined = done.join(placed, (F.col("task") == F.col("t")) & F.col("row.source").eqNullSafe(F.col("s"))).select(
        "row.doc_id", "row.source", (F.col("base") + F.col("before")).alias("x"), "n", "ids", "tokens",
        F.lit(rounds).cast("bigint").alias("rounds"),
    )
    cut = joined.mapInArrow(
        _cut, "round bigint, source string, at bigint, doc_id bigint, start bigint, n bigint, ids binary"
    )
    return cut.repartition("round").sortWithinPartitions("round").mapInArrow(_pack_rounds, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).drop("source", "ids")
