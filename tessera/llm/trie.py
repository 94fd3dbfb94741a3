"""The trie of conversation prefixes, built level by level.

At each depth the live conversations, those that still share their node with another one, are
grouped by (parent node, next turn); the group's smallest conv_id names the new node. A conversation that is alone in a node
leaves the loop: what follows is a chain of its own turns. Leaves and savings are then joined
upwards, one level at a time. Texts stand in the loop by two 64-bit hashes, compared as bytes beforehand, so the loop moves
numbers only. A node that a large part of all conversations share is counted in ``SALTS`` parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collisions, gapless, slices, stored, wide_hash

#: Conversations whose number lies between two multiples of FAMILY share up to HEADS - 1 turns of the lower multiple.
FAMILY, HEADS = 100, 6
#: Parts in which a node's members are counted and told their new node.
SALTS = 64
#: Ids joined to one string before a digest reads them, and turns of a chain that one row stands for.
PIECE = 4096
#: Rows of a level that may be broadcast (about 50 bytes each) and lie in one file; beyond it levels are joined by shuffles.
SMALL = 100_000
#: Turns in a file of a depth, about.
FILE_ROWS = 1_000_000
_TURN = ["h1", "h2", "part"]


def ordered(conversations: DataFrame, hash_of: Callable[[Column], tuple[Column, Column]] = wide_hash) -> DataFrame:
    """(c, rank, h1, h2, part, size) of every turn: its place from 0, the turn's identity and the code points of its text."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("body"))
    # The role's length keeps (role, text) apart from any other pair.
    rows = rows.where(F.col("c").isNotNull()).withColumn("text", F.concat(F.length("role").cast("string"), F.lit(":"), "role", "body"))
    h1, h2 = hash_of(F.col("text"))
    rows = rows.withColumn("h1", h1).withColumn("h2", h2)
    apart = collisions(rows.select("h1", "h2", "text"))
    rows = rows.withColumn("part", F.lit(0)) if apart is None else rows.join(apart, ["h1", "h2", "text"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    plain = rows.select("c", "turn", *_TURN, F.length("body").cast("long").alias("size"))
    # Rows of one conversation and turn, should there be any, follow by identity.
    return gapless(stored(plain, "turns"), ["c"], "turn", [F.col(x) for x in (*_TURN, "size")], "rank").drop("turn")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(c, d, turn) with depths from 1, and (c, n) of all conversations: the first h turns of c - c % family, then c's own but for its first h."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("c").agg(F.max("rank").alias("last"))
    head = turns.where((F.col("c") % family == 0) & (F.col("rank") < heads - 1)).withColumnRenamed("c", "base")
    given = head.groupBy("base").agg(F.count("*").alias("has"))
    known = sizes.select("c", (F.col("c") - F.col("c") % family).alias("base"), h.alias("h"), (F.col("last") + 1).alias("own"))
    known = known.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    known = stored(known.select("c", "base", "h", "taken", "own", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "conversations")
    # At most ``heads`` turns a conversation come from its base.
    first = known.join(head, "base").where(F.col("rank") < F.col("h")).select("c", (F.col("rank") + 1).alias("d"), *_TURN, "size")
    # A long conversation is known once for every PIECE turns, so that its turns need not meet in one task.
    pieces = known.select("c", "h", "taken", F.explode(F.expr(f"sequence(0L, cast((own - 1) div {PIECE} as long))")).alias("piece"))
    rest = turns.withColumn("piece", F.floor(F.col("rank") / PIECE)).join(pieces, ["c", "piece"]).where(F.col("rank") >= F.col("h")).select("c", (F.col("taken") + F.col("rank") - F.col("h") + 1).alias("d"), *_TURN, "size")
    return first.unionByName(rest), known.select("c", "n")


def _levels(turns: DataFrame, rows: int) -> Callable[[int], DataFrame]:
    """The turns of one depth, from a table in folders of depths: one each up to 16, then ranges that double."""
    band = F.when(F.col("d") <= 16, F.col("d")).otherwise(16 + F.ceil(F.log2(F.col("d") / 16))).cast("int")
    files = F.pmod(F.xxhash64("c", "d"), F.lit(1 + rows // FILE_ROWS))
    kept = stored(turns.withColumn("band", band).repartition(slices(turns), "band", files), "levels", by=("band",))
    low = lambda d: d if d <= 16 else 16 + (-(-d // 16) - 1).bit_length()
    return lambda d: kept.where((F.col("band") == low(d)) & (F.col("d") == d)).drop("band", "d")


def _digests(ends: DataFrame) -> DataFrame:
    """(id, d, ends): SHA-256 of each node's ascending, comma-joined members.

    A digest is sequential by its nature. Members are first joined to strings of ranges, without gathering a node; the
    strings of a node then pass through one task in order, one in memory at a time.
    """
    numbered = gapless(ends, ["id", "d"], "c", [F.col("c")], "k")
    strings = numbered.groupBy("id", "d", F.floor(F.col("k") / PIECE).alias("piece")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        done: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for to, x in zip(done, (*now, held.hexdigest()), strict=True):
                to.append(x)

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["id", "d", "ends"])
            for x in done:
                x.clear()
            return got

        for b in batches:
            for *node, _, ids in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if node != now:
                    if now is not None:
                        close()
                    now, held = node, hashlib.sha256()
                else:
                    held.update(b",")
                held.update(ids.encode())
            yield out()
        if now is not None:
            close()
            yield out()

    rows = strings.repartition(slices(strings), "id", "d").sortWithinPartitions("id", "d", "piece")
    return rows.mapInArrow(run, "id long, d long, ends string")


def _chains(alone: DataFrame) -> DataFrame:
    """All nodes of conversations that are alone from depth ``d`` on: (c, d, parent, n) to rows of the result."""
    start = alone.withColumn("from", F.explode(F.expr(f"sequence(d, n, {PIECE}L)"))).repartition(slices(alone), "c", "from")
    rows = start.withColumn("depth", F.explode(F.expr(f"sequence(`from`, least(n, `from` + {PIECE - 1}))")))
    end = F.col("depth") == F.col("n")
    return rows.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("d"), F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(end, F.col("c").cast("string")).otherwise(F.lit("")).cast("binary"), 256).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, hash_of: Callable[[Column], tuple[Column, Column]] = wide_hash) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn`` (null first), equal ones by their hashes. A null role or text is empty; empty and very
    long texts are turns like any other. Rows without a conv_id belong to no conversation and take no part; repeated rows are turns again. Remainders have
    the sign of the conv_id, as in SQL. An empty table has no root and gives an empty result. Other columns are ignored.
    ``hash_of`` may be replaced to test what happens when hashes collide.
    """
    spark = conversations.sparkSession
    turns, known = rebuilt(stored(ordered(conversations, hash_of), "ranked"), family, heads)
    known = stored(known, "known")
    size, least, rows = known.agg(F.count("*"), F.min("c"), F.sum("n")).first()
    if not size:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    level = _levels(turns, rows)
    root = spark.sql(f"SELECT {least}L AS id, 0L AS d, CAST(NULL AS long) AS parent, {size}L AS members, 0L AS size")
    if size == 1:
        return _chains(known.select("c", F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("parent"), "n"))
    nodes, live = [(root, 1)], known.withColumn("node", F.lit(least).cast("long"))
    ends, alone = [live.where("n = 0").select(F.col("node").alias("id"), F.lit(0).cast("long").alias("d"), "c")], []
    depth, by = 0, ["node", *_TURN]
    # Conversations that go on beyond this depth.
    going = live.where("n > 0").count()
    while going:
        depth += 1
        at = F.lit(depth).cast("long")
        side, narrow = _sized(going)
        step = level(depth).join(side(live.where(F.col("n") >= depth)), "c").withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int"))
        counted = lambda rows, *by: rows.groupBy(*by).agg(F.min("id").alias("id"), F.sum("members").alias("members"), F.max("size").alias("size"))
        single = step.withColumn("id", F.col("c")).withColumn("members", F.lit(1).cast("long"))
        if going <= SMALL:
            groups = stored(narrow(counted(single, *by)), "groups")
            told, keys = F.broadcast(groups.select(*by, F.col("id").alias("to"), "members")), by
        else:
            parts = stored(counted(single, *by, "salt"), "parts")
            groups = stored(counted(parts, *by), "groups")
            # A group is told to the parts it has members in, SALTS at most; a member looks it up in its own part.
            told, keys = parts.select(*by, "salt").join(groups.select(*by, F.col("id").alias("to"), "members"), by), [*by, "salt"]
        live = stored(narrow(step.drop("size").join(told, keys).select("c", "n", F.col("node").alias("parent"), F.col("to").alias("node"), "members")), "live")
        alone.append(live.where("members = 1").select("c", at.alias("d"), "parent", "n"))
        live = live.where("members > 1").select("c", "n", "node")
        shared = groups.where("members > 1").select("id", at.alias("d"), F.col("node").alias("parent"), "members", "size")
        nodes.append((shared, going))
        ends.append(live.where(F.col("n") == depth).select(F.col("node").alias("id"), at.alias("d"), "c"))
        going = live.where(F.col("n") > depth).count()
    return _rolled_up(nodes, alone, ends)


def _sized(rows: int) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """How a table of at most ``rows`` rows is joined and written: a small one is broadcast and lies in one file."""
    if rows <= SMALL:
        return F.broadcast, lambda df: df.coalesce(1)
    return lambda df: df, lambda df: df


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _rolled_up(nodes: list[tuple[DataFrame, int]], alone: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    """Leaves and savings from the deepest level to the root, a join a level; then the rows of shared nodes and of chains."""
    done: list[DataFrame] = []
    below = None
    for d in reversed(range(len(nodes))):
        chains = alone[d].select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")) if d < len(alone) else None
        children = [x for x in (below, chains) if x is not None]
        rows, most = nodes[d]
        side, narrow = _sized(most)
        saving = (F.col("members") - 1) * F.col("size")
        if children:
            sums = _union(children).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            rows = rows.join(side(sums), "id", "left")
        else:
            rows = rows.select("*", *[F.lit(None).cast("long").alias(x) for x in ("children", "leaves", "saved")])
        rows = stored(narrow(rows.select("id", "d", "parent", "members", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (saving + F.coalesce("saved", F.lit(0))).alias("saved"))), "rolled")
        below = rows.select("parent", "leaves", "saved")
        done.append(rows)
    shared = _union(done).join(_digests(_union(ends)), ["id", "d"], "left")
    out = shared.select(
        F.col("id").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    return _union([out, _chains(_union(alone))]) if alone else out


#: CRC-32 in SQL: the table of 256 remainders, then one step a byte.
_CRC = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)
"""
ORACLE = f"""
WITH {_CRC},
own AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (
  SELECT own.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda s, b: xor(s >> 8, crc.t[xor(s & 255, b) + 1]))) % 6 AS h
  FROM own, crc
),
built AS (
  SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100
),
steps AS (SELECT c, d, turns[1:d] AS path, len(turns) AS n, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].t) END AS size FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, path, min(c) AS id, count(*) AS members, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM steps GROUP BY d, path
),
linked AS (SELECT x.*, p.id AS parent FROM nodes x LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.path = x.path[1:x.d - 1]),
kids AS (SELECT parent, d - 1 AS d, count(*) AS children FROM linked WHERE d > 0 GROUP BY ALL),
-- a node's subtree: the nodes on the paths that its smallest member's prefix begins
up AS (SELECT a.d, a.id, x.d AS at, x.id AS of, x.members, x.size FROM nodes x JOIN nodes a ON a.d <= x.d AND a.path = x.path[1:a.d]),
sums AS (
  SELECT up.d, up.id, count(*) FILTER (WHERE k.children IS NULL) AS leaves, sum((up.members - 1) * up.size) AS saved
  FROM up LEFT JOIN kids k ON k.parent = up.of AND k.d = up.at GROUP BY up.d, up.id
)
SELECT l.id AS conv_id, l.d AS depth, l.parent AS parent_conv_id, l.members AS n_convs, coalesce(k.children, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, l.ends AS ends_sha256
FROM linked l JOIN sums s ON s.d = l.d AND s.id = l.id LEFT JOIN kids k ON k.parent = l.id AND k.d = l.d
"""
