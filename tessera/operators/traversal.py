"""Breadth-first reach to any depth: a written frontier a round, the cheaper direction, hubs in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import knowledge
from tessera.session import work_dir

#: Nodes that may be broadcast; beyond it they are joined.
FEW = 200_000
#: Neighbours from which a node's edges are split, and into how many parts.
HUB, PARTS = 100_000, 32


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops) of all nodes within ``depth`` steps of the seeds (node), against and along ``edges`` (subject, object), with the least number of steps.

    Each round reads the edges once and writes the nodes it finds first, so that plans do not grow with the depth; it ends where nothing new is found.
    A short frontier is sent to the edges; when few nodes are left that were not reached, these are sent instead and look for a neighbour in the
    frontier; else frontier and edges are joined, the edges of a hub in ``PARTS`` parts. Seeds that no edge names have no
    neighbours; null ends are no edges.
    """
    spark = edges.sparkSession
    root = f"{work_dir(spark)}/reach-{uuid.uuid4().hex}"
    ends = edges.where(F.col("subject").isNotNull() & F.col("object").isNotNull())
    # An edge that is there twice finds the same nodes, which are made distinct; so the edges are not.
    kept = _kept(ends.select(F.col("subject").alias("a"), F.col("object").alias("b")), f"{root}/edges")
    both = kept.union(kept.select("b", "a"))
    hubs = _kept(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= HUB).select("a"), f"{root}/hubs")  # as many as edges / HUB at most
    n_hubs, nodes = hubs.count(), both.select("a").distinct().count()
    front = _kept(seeds.where(F.col("node").isNotNull()).select("node").distinct(), f"{root}/nodes-0")
    reached, size = [front.withColumn("hops", F.lit(0))], front.count()
    seen = size
    for step in range(1, depth + 1):
        if not size:
            break
        known = reached[0].select("node")
        for x in reached[1:]:
            known = known.union(x.select("node"))
        if size <= FEW:
            found = both.join(F.broadcast(front), F.col("a") == F.col("node")).select("b").distinct()
        elif nodes - seen <= FEW:
            left = both.select("a").distinct().join(known, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("b"))
            found = both.join(F.broadcast(left), "b").join(front, F.col("a") == F.col("node"), "left_semi").select("b").distinct()
        else:
            hub = F.broadcast(hubs.withColumn("hub", F.lit(True))) if n_hubs <= FEW else hubs.withColumn("hub", F.lit(True))
            part = F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(PARTS))).otherwise(0).cast("int")
            dealt = both.join(hub, "a", "left").select("a", "b", part.alias("part"))
            sent = front.join(hub, F.col("node") == F.col("a"), "left").select("node", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
            found = dealt.join(sent, (F.col("a") == F.col("node")) & (dealt["part"] == sent["part"])).select("b").distinct()
        new = found.select(F.col("b").alias("node")).join(known, "node", "left_anti")
        front = _kept(new, f"{root}/nodes-{step}")
        size = front.count()
        seen += size
        reached.append(front.withColumn("hops", F.lit(step)))
    out = reached[0]
    for x in reached[1:]:
        out = out.union(x)
    return out


DEPTH = 6


def _deep(spark: SparkSession, d: str) -> DataFrame:
    seed = spark.range(1).select(F.lit("supplier-1").alias("node"))
    return reach(knowledge.order_graph(spark, d), seed, DEPTH).select("node", F.col("hops").cast("long").alias("hops"))


QUERIES = {"graph_reach": _deep}
ORACLES = {
    "graph_reach": f"""
WITH RECURSIVE g AS ({knowledge._GRAPH}), b AS (SELECT subject AS a, object AS b FROM g UNION SELECT object, subject FROM g),
r(node, hops) AS (SELECT 'supplier-1', 0 UNION SELECT b.b, hops + 1 FROM r JOIN b ON b.a = r.node WHERE hops < {DEPTH})
SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node"""
}
