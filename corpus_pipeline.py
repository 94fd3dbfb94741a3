"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Stages are separated by written tables.

What holds for every stage: an empty table gives an empty result. A null text is an empty one and stays null. Empty
and very long texts are processed whole. A row without a doc_id is a document of its own; rows that share a doc_id are kept or dropped as the
stage says. Further columns pass through the first four stages, whatever their names, and are ignored by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linededup, minhash, mixing, packing, toxicity
from tessera.llm.common import discard, fresh, stored, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the pattern grammar scores at 0.5 or more go.

    Null and empty texts score low and stay; repeated rows are scored each and share their fate. Without labels nothing is learned and nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only; n_chars follows the text.

    A document that held nothing else goes; one that lost nothing stays as it is, null and empty texts too. Rows that share the smallest
    doc_id all keep a line; lines found in rows without an id only stay.
    """
    read = ("doc_id", "text", "n_chars")
    plain = docs.toDF(*[c if c in read else f"c{i}" for i, c in enumerate(docs.columns)])
    out = linededup.dedup_lines(plain, min_docs=10, keep_first=True)
    spent = (F.col("n_dropped") > 0) & (F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", "") == "")
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(~spent).withColumn("n_chars", length).select(*plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Texts without words and rows without an id stay. Rows that share a doc_id are one document and stay or go together.
    """
    name = fresh(docs, "gone")
    gone = minhash.near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture. Rows without a source, or with one that has no weight, share an entry; ties of doc_id are settled by the whole row."""
    return mixing.mixed(docs, mixing.TARGETS, mixing.BLOCK)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, filled in the order of the mixture.

    A written table has no order, so the places in the mixture are derived again: they depend on the rows alone.
    """
    place = fresh(docs, "place")
    return packing.pack(mixing.placed(docs, mixing.TARGETS, place, mixing.BLOCK), order=place)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The grammar is learned, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each over what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(written(spark))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        # Only what the stage has written as its result is read again.
        discard(spark, [path for path in written(spark)[:-1] if path not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
