"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed per document; each *distinct* fingerprint is compared once. Two
fingerprints within ``radius`` differing bits agree on at least ``m`` of ``radius + m``
bands, so every link is found among the fingerprints that share some choice of ``m`` bands
(no link is lost for any ``m``; ``m`` only sets how large the blocks are). Inside a block the
fingerprints stand as bit planes: a machine word holds one bit of 64 fingerprints, and a
query updates its 64 distances at once with carry-save counters. A word whose 64 distances
all exceed the radius is abandoned before the remaining planes.

A block gives a forest of its links, never all pairs. Blocks above ``HOT_ROWS``
fingerprints are split into tiles that are compared in separate tasks.

Cases: null or empty text has fingerprint zero and links like any other; repeated rows and
repeated ids are rows of their own; a null id is never a component's id unless all are null
(then it is null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.common import map_documents
from railguard.llm.graph import components
from railguard.session import durable

BITS = 64
RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints of a block that one task compares; larger blocks are compared in tiles.
HOT_ROWS = 8192
#: (query, word) combinations whose planes are held at a time.
COMBINATIONS = 1 << 17
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """SimHash of ``size``-word shingles (repeats included) of the A-Z lowered text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    values = np.fromiter(
        (hashed(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())),
        np.uint64,
        len(starts),
    )
    ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (carried columns), ``fp`` (signed 64-bit) and ``rid``, a number per row."""

    def make():
        from pyspark import TaskContext

        count = itertools.count(TaskContext.get().partitionId() << 33)

        def step(texts, part):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            return {"fp": pa.array(fps), "rid": list(itertools.islice(count, len(texts)))}

        return step

    return map_documents(docs, carry, "fp bigint, rid bigint", make)


def band_masks(radius: int, m: int) -> list[int]:
    """A mask for every choice of ``m`` of ``radius + m`` bands of the 64 bits."""
    cuts = [BITS * i // (radius + m) for i in range(radius + m + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in itertools.combinations(bands, m)]


def bands_for(distinct: int, radius: int = RADIUS) -> int:
    """The fewest agreeing bands for which evenly spread blocks stay near 64 fingerprints."""
    m = 1
    while m < 8 and distinct / 2 ** (BITS * m / (radius + m)) > 64:
        m += 1
    return m


def links_within(
    fps: np.ndarray, block: np.ndarray, other: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of linked fingerprints of the same block, a chunk at a time.

    ``block`` is sorted. ``other`` marks the fingerprints of the second side of a tile:
    there only pairs across the sides count (a block without tiles has one side, False).
    """
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    lane = np.arange(n) - np.repeat(starts, sizes)
    word = np.repeat(first_word, sizes) + lane // 64
    bit = (lane % 64).astype(np.uint64)
    start_of_word = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    one = np.uint64(1)

    def gathered(bits: np.ndarray) -> np.ndarray:
        return np.bitwise_or.reduceat(bits << bit, start_of_word)

    # Vertical layout: planes[b][w] has bit b of the 64 fingerprints of word w.
    planes = [gathered((fps >> np.uint64(b)) & one) for b in range(BITS)]
    used = gathered(np.ones(n, np.uint64))
    seconds = gathered(other.astype(np.uint64))
    tiled = np.repeat(np.bitwise_or.reduceat(seconds, first_word) != 0, words)
    # A query meets the words from its own on: its later neighbours.
    own = word - np.repeat(first_word, sizes)
    meets = np.repeat(words, sizes) - own
    ends = np.cumsum(meets)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMBINATIONS, "right")))
        count = meets[at:upto]
        query = np.repeat(np.arange(at, upto), count)
        w = word[query] + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        later = np.where(
            w == word[query],
            np.where(bit[query] == 63, np.uint64(0), _ALL << np.minimum(bit[query] + one, np.uint64(63))),
            _ALL,
        ) & used[w]
        across = np.where(other[query], np.uint64(0), seconds[w])
        later = np.where(tiled[w], later & across, later)
        over = ~later  # lanes that need no distance count as beyond the radius
        yield from _compare(fps, planes, query, w, over, start_of_word, radius)
        at = upto


def _compare(fps, planes, query, w, over, start_of_word, radius):
    counters = [np.zeros(len(w), np.uint64) for _ in range(int(radius).bit_length())]
    value = fps[query]
    for b in range(BITS):
        if b % 8 == 0:
            alive = over != _ALL
            if not alive.all():  # abandon words that are wholly beyond the radius
                query, w, over, value = query[alive], w[alive], over[alive], value[alive]
                counters = [c[alive] for c in counters]
            if not len(w):
                return
        mask = np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1))
        carry = planes[b][w] ^ mask
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry | _beyond(counters, radius)
    hit = np.flatnonzero(over != _ALL)
    for part in np.array_split(hit, max(1, len(hit) // 4096)):
        lanes = np.unpackbits((~over[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        yield query[part][row], start_of_word[w[part]][row] + lane


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, by comparing from the highest bit."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest linked index of each index, by hooking and jumping over the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _forest_rows(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, tile); runs of whole blocks are compared some at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def compare(columns) -> pa.RecordBatch:
        fps, block, other = columns[0].view(np.uint64), columns[1], columns[2]
        root = forest(len(fps), links_within(fps, block, other, radius))
        far = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_pydict({"a": columns[0][far], "b": columns[0][root[far]]})

    size = 0
    for batch in batches:
        mixed = batch.column(1).to_numpy(zero_copy_only=False)
        held.append((batch.column(0).to_numpy(), mixed, batch.column(2).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= 4 * HOT_ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(columns[1], columns[1][-1]))  # the last block may go on
            if cut:
                yield compare([c[:cut] for c in columns])
            held, size = [tuple(c[cut:] for c in columns)], len(columns[0]) - cut
    if size:
        yield compare([np.concatenate(x) for x in zip(*held)])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A forest (a, b) over the links between the distinct fingerprints ``fp``."""
    m = bands_for(distinct.count(), radius)
    masks = [F.lit(x if x < 1 << 63 else x - (1 << 64)) for x in band_masks(radius, m)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(mask)) for i, mask in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    hot = (
        keyed.groupBy("key")
        .count()
        .filter(F.col("count") > HOT_ROWS)
        .select(F.col("key").alias("hot_key"), F.ceil(2 * F.col("count") / HOT_ROWS).cast("int").alias("tiles"))
    )
    # Tiles of a hot block: its rows fall into `tiles` parts, and each pair of parts meets in
    # a task of its own, so that a row goes to `tiles` tasks.
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    tiled = (
        keyed.join(hot, F.col("key") == F.col("hot_key"), "left")
        .withColumn("part", F.when(F.col("tiles").isNotNull(), part).otherwise(0))
        .withColumn("meets", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
        .select(
            "fp",
            F.when(F.col("tiles").isNull(), F.col("key"))
            .otherwise(F.xxhash64("key", F.least("part", "meets"), F.greatest("part", "meets")))
            .alias("block"),
            (F.col("part") > F.col("meets")).alias("other"),
        )
    )
    return (
        tiled.repartition("block")
        .sortWithinPartitions("block", "other")
        .mapInArrow(lambda batches: _forest_rows(batches, radius), "a bigint, b bigint")
    )


def near_duplicates(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the component of every fingerprint of ``marked`` that has a link."""
    distinct = durable(marked.select("fp").distinct())
    return components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")


def with_components(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``marked`` (row.doc_id, fp, rid) with component_id, the smallest id reachable."""
    classes = near_duplicates(marked, radius)
    per_fp = marked.groupBy("fp").agg(F.min("row.doc_id").alias("least"))
    rooted = per_fp.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of the smallest (non-null) doc_id."""
    marked = durable(fingerprints(docs, docs.columns))
    slim = marked.select(F.struct("row.doc_id").alias("row"), "fp", "rid")
    classes = near_duplicates(slim, radius)
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("rid"))
    first = slim.groupBy("fp").agg(F.min(order).alias("first"))
    keep = (
        first.join(classes, "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.rid").alias("rid"))
    )
    return marked.join(keep, "rid", "left_semi").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = durable(fingerprints(docs, ["doc_id"]))
    return with_components(marked).select(
        "row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
