"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 50
#: Edges up to which the least neighbours of all nodes (16 bytes each) are broadcast.
SMALL = 100_000


def _large_star(edges: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(near(least), F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
    low = edges.join(near(least), F.col("u") == F.col("x")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (two long columns) with a smaller node in its component.

    ``root`` is the least id of the component. Loops and nulls are dropped, repeated edges
    count once, no edge gives an empty table. Each round is written to the shared folder.
    """
    a, b = edges.columns
    now = stored(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
    seen = mark(now)
    for _ in range(ROUNDS):
        # A hot centre is split by the adaptive skew join; where all nodes are few, no edge needs to move.
        near = F.broadcast if seen[0] <= SMALL else lambda least: least
        now = stored(_small_star(_large_star(now, near), near), "edges")
        if seen == (seen := mark(now)):
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
