"""Sentence splitting and adaptive chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import texts

MOST, OVERLAP, LEAST = 512, 100, 50


def merged(parts: list[str], target: int, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Sentences packed in order up to ``target`` words, each chunk opening with the last sentences of the one before.

    A longer sentence stands alone and carries nothing over. A last chunk below ``least``
    words is appended to the one before, with the sentences it shares with it.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    size = 0
    for part in parts:
        n = len(part.split())
        if n > target:
            if held:
                out.append(" ".join(s for s, _ in held))
            out.append(part)
            held, size = [], 0
            continue
        if held and size + n > target:
            out.append(" ".join(s for s, _ in held))
            keep, carried = len(held), 0
            while keep and carried + held[keep - 1][1] <= overlap:
                keep -= 1
                carried += held[keep][1]
            held, size = held[keep:], carried
        held.append((part, n))
        size += n
    if held:
        last = " ".join(s for s, _ in held)
        if out and len(last.split()) < least:
            out[-1] += " " + last
        else:
            out.append(last)
    return out


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, chunk_index, chunk_total, chunk_id, text, token_count, technical_density).

    Splitting and density are Column expressions; only the packing is a fold over one document's sentences, in
    Arrow batches, with no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    density = T.technical_density(body)
    rows = docs.select(key, T.chunk_sentences(body).alias("s"), T.adaptive_max(density, most, least).alias("target"), F.round(density, 6).alias("density"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, len(c), t, len(t.split()), d) for k, s, n, d in zip(*[b.column(x).to_pylist() for x in range(4)], strict=True) for c in [merged(s, n, overlap, least)] for i, t in enumerate(c)]
            types = [b.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
            names = [key, "chunk_index", "chunk_total", "text", "token_count", "technical_density"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    chunks = rows.mapInArrow(run, f"{key} {kind}, chunk_index int, chunk_total int, text string, token_count int, technical_density double")
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256))


def _split_query(spark: SparkSession, d: str) -> DataFrame:
    s = T.chunk_sentences(F.col("text"))
    rows = texts(spark, d).select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


def _density_query(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.round(T.technical_density(F.col("text")), 4).alias("density"))


def _chunk_query(spark: SparkSession, d: str) -> DataFrame:
    return chunk(texts(spark, d)).select("doc_id", "chunk_index", "chunk_total", "token_count", F.sha2("text", 256).alias("sha"), "technical_density")


def _tokens_query(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, d).select("doc_id", F.size(T.bm25_tokens(t)).cast("long").alias("bm25"), F.size(T.scoring_tokens(t)).cast("long").alias("scoring"), F.size(T.terms(t)).cast("long").alias("terms"), F.sha2(t, 256).alias("hash"))


QUERIES = {"sentence_split": _split_query, "technical_density": _density_query, "chunk_documents": _chunk_query, "token_counts": _tokens_query}

_S = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n', chr(10) || chr(1) || chr(10), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
ORACLES = {
    "sentence_split": f"SELECT doc_id, len({_S})::BIGINT AS n, coalesce({_S}[1], '') AS first FROM documents",
    "technical_density": f"SELECT doc_id, round({T.technical_density_sql('text')}, 4) AS density FROM documents",
    "token_counts": f"SELECT doc_id, len({T.bm25_tokens_sql('text')})::BIGINT AS bm25, len({T.scoring_tokens_sql('text')})::BIGINT AS scoring, len({T.terms_sql('text')})::BIGINT AS terms, sha256(text) AS hash FROM documents",
}
