"""Which of many names a text holds: one automaton over all names of a shard, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table, texts

#: Names in one automaton at most, about: what a task holds and what is sent to it, however many names there are.
NAMES = 200_000


def _found(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, entities in shared.value.items():
            automaton.add_word(name, entities)
        automaton.make_automaton()
        for b in batches:
            keys, said = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                named = {e for _, entities in automaton.iter(text) for e in entities} if text else ()
                keys += [key] * len(named)
                said += named
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(said, pa.string())], names=["key", "entity"])

    return run


def forms(entity: Column) -> Column:
    """A name as it is, with blanks for underscores, and with underscores for blanks; lower case."""
    low = F.lower(entity)
    return F.array_distinct(F.array(low, F.translate(low, "_", " "), F.translate(low, " ", "_")))


def mentions_of(docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity) for each row of ``docs`` and each different name of ``entities`` (entity) that its text holds, whatever the case of letters.

    Names are dealt to shards of about NAMES by a hash; the texts are read once a shard and never shuffled. Null and empty names name nothing; a null
    text holds none. Rows that share a key are rows of their own.
    """
    spark = docs.sparkSession
    names = entities.where(F.col("entity") != "").select("entity").distinct()
    shards = 1 + names.count() // NAMES
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    arrow = pa.int64() if kind.typeName() == "long" else pa.string()
    rows = rows if arrow == pa.int64() else rows.withColumn("key", F.col("key").cast("string"))
    out = None
    for s in range(shards):
        mine = names.where(F.pmod(F.xxhash64("entity"), F.lit(shards)) == s).select("entity", F.explode(forms(F.col("entity"))).alias("form"))
        held: dict[str, list[str]] = {}
        for r in mine.toLocalIterator():
            held.setdefault(r.form, []).append(r.entity)
        if not held:
            continue
        part = rows.mapInArrow(_found(spark.sparkContext.broadcast(held), arrow), f"key {'long' if arrow == pa.int64() else 'string'}, entity string")
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.select("key", F.lit("").alias("entity")).limit(0)
    return out.select(F.col("key").cast(kind).alias(key), "entity")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Two words of each benchmark item with an underscore between them, and the names of nations and regions."""
    words = F.split("text", r"\s+")
    pairs = table(spark, d, "benchmark").select(F.array_join(F.slice(words, 3, 2), "_").alias("entity"))
    places = table(spark, d, "nation").select("n_name").union(table(spark, d, "region").select("r_name"))
    return pairs.union(places)


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    return mentions_of(texts(spark, d), _names(spark, d))


QUERIES = {"entity_mentions": _mentioned}
_ANY = "contains(lower(text), lower(entity)) OR contains(lower(text), replace(lower(entity), '_', ' ')) OR contains(lower(text), replace(lower(entity), ' ', '_'))"
ORACLES = {
    "entity_mentions": f"WITH e AS (SELECT array_to_string(string_split_regex(text, '\\s+')[3:4], '_') AS entity FROM benchmark UNION SELECT n_name FROM nation UNION SELECT r_name FROM region) SELECT doc_id, entity FROM documents, e WHERE entity <> '' AND ({_ANY})"
}
