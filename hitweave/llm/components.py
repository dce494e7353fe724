"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table ``a, b`` of longs; ``root`` is the least node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones,
    under its least neighbour. Rounds grow with the logarithm of the longest
    chain; each is cut off by a checkpoint, and only a digest of its edges reaches the driver: equal digests tell that a round changed nothing.
    Neighbour lists are never gathered: each star is a minimum and a join.
    """
    links = durable(_undirected(edges).distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = _digest(links)
    while True:  # every round but the last changes an edge towards smaller ends
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = durable(small.select("e.a", "e.b").filter("a != b").distinct())
        after = _digest(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(tops)


def _digest(links: DataFrame) -> Row:
    """Number, sums and hashes of distinct edges, in any order: 128 bits of hashes besides the sums."""
    hashes = {name: F.xxhash64("a", "b", F.lit(name)) for name in ("x", "y")}
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("a", "b")]
    return links.agg(F.count("*").alias("n"), *sums, *[F.bit_xor(h).alias(name) for name, h in hashes.items()]).first()


def _undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
