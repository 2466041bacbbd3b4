"""Prefix trie of rebuilt conversations, with count-min screening of prefix digests.

A prefix of turns is named by two 64-bit digests, exclusive sums over its turns of hashes of
position, role and text, so that long conversations can be summed in pieces. A count-min
sketch of all prefixes proves most of them singletons (an estimate of one is never too low):
the tail behind such a prefix is a chain of nodes with one member and is emitted where it
stands. Only prefixes that may be shared are exchanged and grouped exactly.

Sums over subtrees need no walk: a node is represented by its smallest member, and a member
that represents a node represents every deeper one on its path. So three numbers of each
conversation (where it starts to represent, the bytes before, whether it ends in a leaf),
summed over the members of a node, give leaves, children and saved bytes.

Cases: rows without conv_id belong to no conversation and are left out; null roles and texts
are empty; turns come in order, null first, equal ones in the order of a digest of role and
text; repeated rows are turns of their own; a conversation whose turns all fall away is a
member of the root alone; a conversation of any length is cut into pieces; an empty table has
no nodes; further columns are ignored. Two different prefixes are taken for one with odds of
about ``prefixes^2 / 2^129``; a group whose last turns differ raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from railguard.operators.layout import Keys, Trajectories
from railguard.operators.ordering import with_rank
from railguard.session import durable

#: Conversations come in families of five; heads have fewer than nine turns.
FAMILY, HEADS = 5, 9
#: Turns of one conversation that one window handles.
PIECE_TURNS = 1 << 20
#: Cells of a sketch row: four for each prefix within these bounds (2^26: 16 MB of bits in all).
LEAST_CELLS, MOST_CELLS = 1 << 10, 1 << 26
#: A key with more rows than this, and than a thousandth of all, is joined by broadcast.
HOT_ROWS, HOT_KEYS = 200, 1_000
#: Ids that lie in one range of 2^12 become one piece of text before they are hashed.
ID_BITS = 12
_BITMAP = 32_768  # bits of Spark's bitmap aggregate

NODE = ["p1", "p2", "depth"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("bigint")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key, ``count`` of which says how many rows match.

    Keys with more than a thousandth of all ``total`` rows number at most ``HOT_KEYS``: they
    are broadcast, so that no task gets all rows of one key; the rest is joined by exchange.
    """
    hot = table.filter(F.col(count) > max(HOT_ROWS, total // HOT_KEYS))
    if hot.isEmpty():
        return rows.join(table.drop(count), keys)
    cold = table.filter(F.col(count) <= max(HOT_ROWS, total // HOT_KEYS)).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot.drop(count)), keys).unionByName(rest.join(cold, keys))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, base, order columns, d1 and d2 (digests of role and text) and bytes per turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length in front keeps pairs of role and text apart.
    whole = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    c, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    return conversations.filter("conv_id IS NOT NULL").select(
        c.alias("conv_id"),
        (c - c % FAMILY).alias("base"),
        F.coalesce(turn, F.lit(-(2**63))).alias("at"),
        turn.isNotNull().cast("int").alias("dated"),
        F.xxhash64(F.lit(1), whole).alias("d1"),
        F.xxhash64(F.lit(2), whole).alias("d2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )


def rebuilt(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, length, d1, d2, bytes), and (conv_id, length) of all."""
    keys = Keys(domain="base", unit="conv_id", order=("at", "dated", "d1", "d2"))
    ordered = with_rank(Trajectories.plan(turn_digests(conversations), keys, piece_turns), "pos").frame
    ranked = durable(ordered.select("conv_id", "base", "pos", "d1", "d2", "bytes"))
    convs = ranked.groupBy("base", "conv_id").agg(F.count(F.lit(1)).alias("own"))
    donors = convs.filter("conv_id = base").select("base", F.least("own", F.lit(HEADS - 1)).alias("given"))
    first = F.col("conv_id") == F.col("base")
    cut = F.when(first, 0).otherwise(_head_turns(F.col("conv_id"))).cast("bigint")
    head = F.least("cut", F.coalesce("given", F.lit(0))).cast("bigint")
    convs = durable(
        convs.join(donors, "base", "left")
        .withColumn("cut", cut)
        .withColumn("head", head)
        .withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("cut"), F.lit(0)))
        .select("conv_id", "base", "own", "cut", "head", "length")
    )
    shape = ["conv_id", "depth", "length", "d1", "d2", "bytes"]
    own = (
        spread_join(ranked.drop("base"), convs.drop("base"), ["conv_id"], "own", ranked.count())
        .filter("pos > cut")
        .withColumn("depth", F.col("pos") - F.col("cut") + F.col("head"))
        .select(*shape)
    )
    # A base has at most 8 head turns and 8 other conversations.
    heads = ranked.filter(first & (F.col("pos") < HEADS)).drop("conv_id")
    taken = heads.join(convs.filter(~first & (F.col("head") > 0)).select("base", "conv_id", "head", "length"), "base")
    given = taken.filter("pos <= head").withColumnRenamed("pos", "depth").select(*shape)
    return own.unionByName(given), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation and depth, the root included: digests p1, p2 and bytes so far."""
    piece = (F.col("depth") / piece_turns).cast("bigint")
    turns = turns.withColumns(
        {
            "piece": piece,
            "p1": F.xxhash64(F.lit(3), "depth", "d1", "d2"),
            "p2": F.xxhash64(F.lit(4), "depth", "d1", "d2"),
        }
    )
    w = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"p1": F.bit_xor, "p2": F.bit_xor, "so_far": F.sum}
    summed = turns.withColumn("so_far", F.col("bytes")).withColumns({c: f(c).over(w) for c, f in sums.items()})
    if (convs.agg(F.max("length")).first()[0] or 0) >= piece_turns:
        # Only conversations of several pieces carry on: at most 2 * turns / piece_turns rows.
        long = convs.filter(F.col("length") >= piece_turns).select("conv_id")
        before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            turns.withColumn("so_far", F.col("bytes"))
            .join(F.broadcast(long), "conv_id", "left_semi")
            .groupBy("conv_id", "piece")
            .agg(*[f(c).alias(c) for c, f in sums.items()])
            .select("conv_id", "piece", *[F.coalesce(f(c).over(before), F.lit(0)).alias(f"{c}_") for c, f in sums.items()])
        )
        both = {c: F.col(c).bitwiseXOR(F.coalesce(f"{c}_", F.lit(0))) for c in ("p1", "p2")}
        both["so_far"] = F.col("so_far") + F.coalesce("so_far_", F.lit(0))
        summed = summed.join(F.broadcast(carried), ["conv_id", "piece"], "left").withColumns(both)
    columns = ["conv_id", "depth", "length", "p1", "p2", "d1", "d2", "bytes", "so_far"]
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", "length", *[zero.alias(c) for c in columns if c not in ("conv_id", "length")])
    return summed.select(*columns).unionByName(root.select(*columns))


def repeated_cells(rows: DataFrame, cells: int) -> bytes:
    """The count-min sketch as bits: cells of both rows that count more than one prefix.

    Cells are counted before and after an exchange; at most ``2 * MOST_CELLS / 8`` bytes come
    back. Singletons need no larger counts: an estimate is one if either cell counts one.
    """
    mask = F.lit(cells - 1).cast("bigint")
    both = F.array(F.col("p1").bitwiseAND(mask), F.col("p2").bitwiseAND(mask) + cells)
    counted = rows.filter("depth > 0").select(F.explode(both).alias("cell")).groupBy("cell").count().filter("count > 1")
    packed = counted.groupBy((F.col("cell") / _BITMAP).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.col("cell") % _BITMAP).alias("bits")
    )
    out = np.zeros(2 * max(cells, _BITMAP) // 8, np.uint8)
    for r in packed.collect():
        at = r["part"] * _BITMAP // 8
        out[at : at + _BITMAP // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - at]
    return out.tobytes()


#: Where a row belongs: to a prefix that may be shared, to the first proven singleton of its
#: conversation in a task, or to the chain behind that.
MAYBE, EDGE, TAIL = 0, 1, 2


def screened(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` with ``kind``; rows of a conversation stand in order of depth where it is whole."""
    bits = rows.sparkSession.sparkContext.broadcast(repeated_cells(rows, cells))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", kind int"

    def run(batches):
        repeated = np.frombuffer(bits.value, np.uint8)
        conv, inside, last = None, False, -1
        for batch in batches:
            ids, depth, p1, p2 = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "p1", "p2"))
            one, two = p1 & (cells - 1), (p2 & (cells - 1)) + cells
            once = (repeated[one >> 3] >> (one & 7)) & (repeated[two >> 3] >> (two & 7)) & 1 == 0
            single = once & (depth > 0)
            # Runs of rows of one conversation, each one turn longer than the one before.
            begins = np.concatenate(([len(ids) > 0], (ids[1:] != ids[:-1]) | (depth[1:] != depth[:-1] + 1)))[: len(ids)]
            carried = bool(len(ids)) and inside and ids[0] == conv and depth[0] == last + 1
            run_of = np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
            proven = np.cumsum(single)
            proven += -(proven - single)[run_of] + np.where(run_of == 0, carried, 0)
            kind = np.where(proven == 0, MAYBE, np.where(proven - single == 0, EDGE, TAIL)).astype(np.int32)
            if len(ids):
                conv, inside, last = ids[-1], kind[-1] != MAYBE, depth[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], [*batch.schema.names, "kind"])

    return rows.mapInArrow(run, schema)


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined conv_ids per node, streamed through one hash each.

    Ids of one range are joined first, at most 2^ID_BITS of them, so a node that many
    conversations end in reaches its task as few rows, in order, one batch at a time.
    """
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "range")

    def run(batches):
        names = ["p1", "p2", "depth", "ends_sha256"]
        node, state = None, None
        for batch in batches:
            done = []
            for p1, p2, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (p1, p2, depth) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (p1, p2, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], _DIGESTS)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, state.hexdigest())))], _DIGESTS)

    return ordered.mapInArrow(run, "p1 bigint, p2 bigint, depth bigint, ends_sha256 string")


_DIGESTS = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _single_columns(parent: Column) -> list[Column]:
    """The result columns of a node with one member."""
    ends = F.when(F.col("depth") == F.col("length"), F.col("conv_id").cast("string")).otherwise("")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return [
        F.col("conv_id"),
        F.col("depth"),
        parent.alias("parent_conv_id"),
        one.alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.sha2(ends.cast("binary"), 256).alias("ends_sha256"),
    ]


def conversation_trie(
    conversations: DataFrame, piece_turns: int = PIECE_TURNS, most_cells: int = MOST_CELLS
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (columns: ``COLUMNS``)."""
    turns, convs = rebuilt(conversations, piece_turns)
    rows = durable(prefixes(turns, convs, piece_turns))
    total = rows.count()
    cells = min(max(LEAST_CELLS, 1 << (4 * total).bit_length()), most_cells)
    rows = durable(screened(rows, cells))
    maybe, edges = rows.filter(F.col("kind") == MAYBE).drop("kind"), rows.filter(F.col("kind") == EDGE)

    def same(column: str) -> Column:
        return F.min(column) == F.max(column)

    nodes = maybe.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("members"),
        F.when(same("d1") & same("d2"), F.min("conv_id"))
        .otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("bigint"))
        .alias("least"),
        F.max("length").alias("reach"),
    )
    placed = durable(spread_join(maybe.drop("d1", "d2"), durable(nodes), NODE, "members", total))

    # Per conversation: where it starts to represent nodes, who represents the one before,
    # the bytes before, and whether its last node is a leaf that it represents.
    mine = F.col("least") == F.col("conv_id")
    ended = mine & (F.col("depth") == F.col("length")) & (F.col("reach") == F.col("length"))
    facts = placed.select(
        "conv_id",
        F.when(mine, F.col("depth")).alias("starts"),
        F.when(~mine, F.struct("depth", "least", "so_far")).alias("shared"),
        ended.alias("leaf"),
    ).unionByName(
        edges.select(
            "conv_id",
            F.col("depth").alias("starts"),
            F.lit(None).cast("struct<depth:bigint,least:bigint,so_far:bigint>").alias("shared"),
            F.lit(True).alias("leaf"),
        )
    )
    scalars = durable(
        facts.groupBy("conv_id").agg(
            F.min("starts").alias("starts"),
            F.max_by("shared.least", "shared.depth").alias("above"),
            F.coalesce(F.max("shared.so_far"), F.lit(0)).alias("before"),
            F.max(F.col("leaf").cast("bigint")).alias("leaf"),
            F.count(F.lit(1)).alias("turns"),
        )
    )
    parent = F.when(F.col("depth") > F.col("starts"), F.col("conv_id")).otherwise(F.col("above"))
    known = spread_join(placed, scalars, ["conv_id"], "turns", total)
    grouped = known.groupBy(*NODE).agg(
        F.min("least").alias("conv_id"),
        F.max(F.when(mine, parent)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("depth") < F.col("length")) & (F.col("starts") <= F.col("depth") + 1)).cast("bigint")).alias("kids"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(mine, 0).otherwise(F.col("before"))).alias("reached"),
        F.max(F.col("so_far") - F.col("bytes")).alias("above_bytes"),
    )
    named = grouped.join(id_digests(placed.filter("depth = length")), NODE, "left")
    shared = named.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("kids", F.lit(0)).alias("n_children"),
        "n_leaves",
        (F.col("reached") - (F.col("n_convs") - 1) * F.col("above_bytes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    # A conversation has one edge for each task that holds a part of it.
    first = edges.join(scalars.select("conv_id", "starts", "above"), "conv_id").select(*_single_columns(parent))
    tail = rows.filter(F.col("kind") == TAIL).select(*_single_columns(F.col("conv_id")))
    return shared.unionByName(first).unionByName(tail).select(*COLUMNS)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
WITH t AS (
    SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
),
own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, (4294967295 - list_reduce(
        [4294967295] || list_transform(string_split(c.conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
        lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1]))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM own) c, t
),
lent AS (
    SELECT v.conv_id, o.pos AS depth, o.role, o.text FROM convs v JOIN own o ON o.conv_id = v.base AND o.pos <= v.h
    WHERE v.conv_id <> v.base
),
lengths AS (SELECT conv_id, count(*) AS n FROM lent GROUP BY 1),
turns AS (
    SELECT * FROM lent
    UNION ALL
    SELECT v.conv_id, CASE WHEN v.conv_id = v.base THEN o.pos ELSE o.pos - v.h + coalesce(l.n, 0) END, o.role, o.text
    FROM convs v JOIN own o USING (conv_id) LEFT JOIN lengths l USING (conv_id)
    WHERE v.conv_id = v.base OR o.pos > v.h
),
paths AS (
    SELECT conv_id, depth, strlen(text) AS bytes, string_agg(md5(length(role)::VARCHAR || ':' || role || text), '')
        OVER (PARTITION BY conv_id ORDER BY depth) AS path
    FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, bool_and(last) AS childless,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
    FROM ended GROUP BY ALL
),
below AS (
    SELECT p.path, count(*) FILTER (x.depth = p.depth + 1) AS n_children, count(*) FILTER (x.childless) AS n_leaves,
        sum((x.n - 1) * x.bytes) AS saved
    FROM nodes x JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY 1
)
SELECT x.conv_id, x.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, b.n_children, b.n_leaves,
    b.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below b USING (path)
LEFT JOIN nodes up ON x.depth > 0 AND up.path = left(x.path, (32 * (x.depth - 1))::BIGINT)
"""
