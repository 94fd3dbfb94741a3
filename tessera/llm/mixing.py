"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996), in DataFrame functions only.

A source of weight w out of D owns w unit subtasks in D slots. Subtask j is released at
floor(j * D / w) and due by ceil((j + 1) * D / w). With one block placed a slot,
earliest-deadline-first meets every deadline, so in every prefix a source's count of blocks
differs from its share by less than one. The schedule repeats after D slots: the plan of one period, which depends on
the configured weights alone, places every block of every size of input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, quoted

#: Production weights. Sources that are not listed, and null, share the entry REST.
REST = ""
TARGETS: dict[str, int] = {REST: 2, "src0": 12, "src1": 6, "src2": 6, "src3": 5, "src4": 5} | {f"src{i}": 4 for i in range(5, 20)}
BLOCK = 16


def windows(weight: int, period: int) -> list[tuple[int, int]]:
    """Release and deadline of each of the ``weight`` subtasks of a period."""
    return [(j * period // weight, -(-(j + 1) * period // weight)) for j in range(weight)]


def plan(targets: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(entry, subtask, release, deadline, slot) of one period, by earliest deadline among the released."""
    period = sum(targets.values())
    arriving = sorted((r, d, name, j) for name, w in targets.items() for j, (r, d) in enumerate(windows(w, period)))
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(arriving) and arriving[at][0] <= slot:
            r, d, name, j = arriving[at]
            heapq.heappush(ready, (d, name, j, r))
            at += 1
        d, name, j, r = heapq.heappop(ready)
        out.append((name, j, r, d, slot))
    return out


def _checked(targets: dict[str, int]) -> dict[str, int]:
    if not targets or any(not isinstance(w, int) or w < 1 for w in targets.values()):
        raise ValueError("target weights are positive integers")
    return targets if REST in targets else targets | {REST: 1}


def mix(docs: DataFrame, targets: dict[str, int], block: int = BLOCK, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with entry, block, place, release, deadline and slot; no row is dropped.

    Sorting by (slot, place) gives the mixture. Rows of an entry are taken in the order of
    ``key`` (null first), ties by a hash of the whole row, and cut into blocks of ``block`` rows. When an
    entry has run out, its later slots stay empty and the others keep their ratio. A null or
    unlisted source belongs to the entry ``""``; an empty table gives an empty result. Input columns named
    like the added ones are replaced.
    """
    targets = _checked(targets)
    period = sum(targets.values())
    added = ("entry", "block", "place", "release", "deadline", "slot")
    names = [c for c in docs.columns if c.lower() not in added]
    # By place: whatever the columns are called, they do not meet those of the schedule.
    plain = docs.select(*map(quoted, names)).toDF(*[f"c{i}" for i in range(len(names))])
    own = {c.lower(): f"c{i}" for i, c in enumerate(names)}
    listed = [name for name in targets if name != REST]
    entry = F.when(F.col(own[source]).isin(listed), F.col(own[source])).otherwise(F.lit(REST))
    numbered = gapless(plain.withColumn("entry", entry), ["entry"], own[key], [F.xxhash64(*plain.columns)], "n")
    rows = plan(targets)
    # The plan has one row for each slot of a period: configured weights bound it.
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quote(n)}, {targets[n]}L, {j}L, {r}L, {d}L, {s}L)" for n, j, r, d, s in rows)
    period_plan = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(of, w, j, r, d, s)").drop("w")
    weight: Column = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("entry"))
    cut = numbered.withColumn("block", F.floor(F.col("n") / block).cast("long")).withColumn("place", (F.col("n") % block).cast("long")).withColumn("w", weight.cast("long"))
    cycle = F.floor(F.col("block") / F.col("w")).cast("long") * period
    joined = cut.join(F.broadcast(period_plan), (F.col("entry") == F.col("of")) & (F.col("block") % F.col("w") == F.col("j")))
    out = joined.select(*plain.columns, "entry", "block", "place", (cycle + F.col("r")).alias("release"), (cycle + F.col("d")).alias("deadline"), (cycle + F.col("s")).alias("slot"))
    return out.toDF(*names, *added)


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with names of their own for all columns that the schedule does not read."""
    return docs.toDF(*[c if c in ("doc_id", "source") else f"c{i}" for i, c in enumerate(docs.columns)])


def placed(docs: DataFrame, targets: dict[str, int], name: str, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with their place in the mixture as ``name``: different for every row, with gaps where slots are empty."""
    plain = _apart(docs)
    return mix(plain, targets, block).select(*plain.columns, (F.col("slot") * block + F.col("place")).alias(name)).toDF(*docs.columns, name)


def mixed(docs: DataFrame, targets: dict[str, int], block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all of them and no more columns, in the order of the mixture."""
    plain = _apart(docs)
    return mix(plain, targets, block).orderBy("slot", "place").select(*plain.columns).toDF(*docs.columns)


def oracle(targets: dict[str, int] = TARGETS, block: int = BLOCK) -> str:
    """The schedule computed in SQL, slot by slot over one period: of the released subtasks that are left, the earliest deadline runs."""
    targets = _checked(targets)
    period = sum(targets.values())
    values = ", ".join(f"('{n}', {w})" for n, w in targets.items())
    listed = ", ".join(f"'{n}'" for n in targets if n != REST)
    return f"""
WITH RECURSIVE weights(entry, w) AS (VALUES {values}),
subtasks AS (
  SELECT entry, w, j, j * {period} // w AS r, ((j + 1) * {period} + w - 1) // w AS d, row_number() OVER (ORDER BY ((j + 1) * {period} + w - 1) // w, entry, j) - 1 AS id
  FROM weights, (SELECT unnest(range({period})) AS j) WHERE j < w
),
run(slot, id, done) AS (
  SELECT -1, -1::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT run.slot + 1, pick.id, list_append(run.done, pick.id)
  FROM run, LATERAL (SELECT min(s.id) AS id FROM subtasks s WHERE s.r <= run.slot + 1 AND NOT list_contains(run.done, s.id)) pick
  WHERE run.slot + 1 < {period}
),
p AS (SELECT s.entry, s.w, s.j, s.r, s.d, run.slot AS s FROM run JOIN subtasks s ON s.id = run.id WHERE run.slot >= 0),
n AS (
  SELECT doc_id, source, entry, row_number() OVER (PARTITION BY entry ORDER BY doc_id) - 1 AS n
  FROM (SELECT doc_id, source, CASE WHEN source IN ({listed}) THEN source ELSE '{REST}' END AS entry FROM documents)
)
SELECT n.doc_id, n.source, n.entry, (n.n // {block})::BIGINT AS block, (n.n % {block})::BIGINT AS place,
       (n.n // {block} // p.w * {period} + p.r)::BIGINT AS release, (n.n // {block} // p.w * {period} + p.d)::BIGINT AS deadline,
       (n.n // {block} // p.w * {period} + p.s)::BIGINT AS slot
FROM n JOIN p ON n.entry = p.entry AND n.n // {block} % p.w = p.j
"""
