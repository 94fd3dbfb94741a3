"""Audit of how filters interact: what each removes, repeats and removes alone, in every order of application.

A document is a mask of the filters that it fails. Documents are counted by part and mask first; the cells, at most
2 ** n a part, are then unpivoted against the steps of all orders, and a running bit-or over the steps
tells what an earlier filter has removed. So the long form does not grow with the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collisions, stored, wide_hash

#: A: short, B: repetitive, C: capitals, D: symbols, E: copy of a document with a smaller id.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
#: Parts in which the copies of one text are told their first document.
SALTS = 16


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D, which need nothing but the text."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    failed = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, hash_of: Callable[[Column], tuple[Column, Column]] = wide_hash) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of ``docs`` have this id, source and mask of failed filters.

    Copies are found by two 64-bit hashes; texts with equal hashes are compared as bytes.
    """
    text = F.coalesce("text", F.lit(""))
    h1, h2 = hash_of(text)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), h1.alias("h1"), h2.alias("h2"))
    apart = collisions(base.select("h1", "h2", "text"))
    named = base.withColumn("same", F.lit(0)) if apart is None else base.join(apart.withColumnRenamed("part", "same"), ["h1", "h2", "text"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    rows = stored(named.select("doc_id", "part", text_failures(F.col("text")).alias("mask"), "h1", "h2", "same"), "masks")
    twins = rows.groupBy("h1", "h2", "same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # The first document of a text is told to each part of its copies.
    told = twins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    found = salted.join(told, ["h1", "h2", "same", "salt"], "left").withColumn("mask", F.col("mask") + copy)
    return found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): cells, with the documents that any row of ``labels`` marks as good or toxic."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("g"), F.max((F.col("toxic") == 1).cast("long")).alias("t"))
    known = counted.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    rows = known.unionByName(counted.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    marked = lambda x: F.sum(F.col("n") * F.coalesce(x, F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("g").alias("good"), marked("t").alias("toxic"))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of all ``filters`` and step, from cells (part, mask, n, good, toxic); bit i of a mask is the filter i.

    Every part that has a cell has all rows, zeros included.
    """
    orders = ",".join("".join(p) for p in permutations(filters))
    cell = cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    cell = cell.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    cell = cell.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    own = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("filter")) - 1)
    cell = cell.withColumn("own", own).withColumn("failed", F.col("mask").bitwiseAND(F.col("own")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    here = (F.col("failed") != 0) & (F.col("earlier") == 0)
    total = lambda which, what="n": F.sum(F.when(which, F.col(what)).otherwise(0)).cast("long")
    steps = cell.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("failed") == 0) & (F.col("earlier") == 0)).alias("kept"),
        total(here).alias("removed"),
        total((F.col("failed") != 0) & (F.col("earlier") != 0)).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    each = Window.partitionBy("part", "filter")
    return steps.withColumn("shapley", F.sum("removed").over(each)).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, hash_of: Callable[[Column], tuple[Column, Column]] = wide_hash) -> DataFrame:
    """The interactions of the five filters over ``docs``: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is an empty one, a null source the part "". Empty and very long texts are judged whole. A row without a doc_id
    is no copy of any, and none is a copy of it; rows that share a doc_id are rows of their own, and neither is a copy of the other for that.
    A document without a label is neither good nor toxic; of repeated labels the largest counts. An empty table has no part and gives an empty result.
    Other columns are ignored. ``hash_of`` may be replaced to test what happens when hashes collide.
    """
    return interactions(labelled(masks(docs, hash_of), labels))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
m AS (
  SELECT doc_id, part,
         (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(t))::INT
         + 8 * regexp_matches(t, '{SYMBOLS}')::INT + 16 * (coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false))::INT AS mask
  FROM d
),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
s AS (
  SELECT array_to_string(fs, '') AS filter_order, step, fs[step] AS f, 1 << (ascii(fs[step]) - 65) AS own,
         coalesce(list_sum(list_transform(fs[1:step - 1], lambda y: 1 << (ascii(y) - 65))), 0)::INT AS earlier
  FROM (SELECT fs, unnest(range(1, 6)) AS step FROM o)
),
r AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
