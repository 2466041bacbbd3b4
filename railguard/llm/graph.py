"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from railguard.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them.

    ``large``: the larger neighbours; else the smaller ones and the node itself. The
    minimum is combined before the exchange and joined back on the node, so that a node
    with very many neighbours is split by a skewed join instead of meeting in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m")
    )
    joined = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is its smallest node.

    Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. An edge from a node to itself says nothing and goes.
    """
    current = durable(edges.filter("a <> b").distinct())
    state = _state(current)
    while True:
        current = durable(_star(_star(current, large=True), large=False))
        now = _state(current)
        if now == state:
            break
        state = now
    hung = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
