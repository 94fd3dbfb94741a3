"""A cache of embeddings by content: texts that were embedded once are never sent to the model again."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table, work_dir

#: Characters of a text that a model sees, texts and about how many tokens (four characters each) go to it at once.
MAX_CHARS, BATCH, TOKENS = 1200, 32, 8000
#: Folders of the cache, by the first byte of the hash.
PREFIXES = 16

Model = Callable[[list[str]], list[list[float]]]


def embedded(texts: list[str], model: Model) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A batch that the model refuses, or answers with another number of vectors, is halved; a lone text that it refuses has no vector."""
    try:
        vectors = model(texts)
        if len(vectors) == len(texts):
            return [(list(map(float, v)), None) for v in vectors]
        problem = f"{len(vectors)} vectors for {len(texts)} texts"
    except Exception as raised:  # noqa: BLE001 - any refusal of a hosted model
        problem = f"{type(raised).__name__}: {str(raised)[:200]}"
    if len(texts) == 1:
        return [(None, problem)]
    half = len(texts) // 2
    return embedded(texts[:half], model) + embedded(texts[half:], model)


def batches_of(texts: list[str], most: int = BATCH, tokens: int = TOKENS) -> Iterator[list[str]]:
    """Runs of at most ``most`` texts and about ``tokens`` tokens; a longer text is a run of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        cost = len(t) // 4 + 1
        if held and (len(held) == most or size + cost > tokens):
            yield held
            held, size = [], 0
        held.append(t)
        size += cost
    if held:
        yield held


class EmbeddingCache:
    """Vectors by the hash of the text that the model saw, in a folder for each prefix of the hash."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def table(self) -> DataFrame:
        """hash, vector, error, run, prefix."""
        schema = "hash string, vector array<double>, error string, run string, prefix int"
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    @staticmethod
    def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with what the model sees, its hash and its prefix; a null text is an empty one."""
        seen = docs.withColumn("seen", F.substring(F.coalesce(F.col(text), F.lit("")), 1, MAX_CHARS)).withColumn("hash", T.content_hash(F.col("seen")))
        return seen.withColumn("prefix", (F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") % PREFIXES))

    def fill(self, docs: DataFrame, text: str = "text", run: str | None = None) -> int:
        """Embed the texts that the cache does not hold, each different text once, and append them; how many these were.

        The misses are written before the model sees them and the vectors are appended as one job: a run that breaks off is repeated from the misses, and what
        two runs add twice counts once (``vectors``). A text that the model refuses is kept with its error and not asked again.
        """
        keyed = self.keyed(docs, text).select("prefix", "hash", "seen")
        misses = keyed.join(self.table().select("prefix", "hash"), ["prefix", "hash"], "left_anti").groupBy("prefix", "hash").agg(F.first("seen").alias("seen"))
        todo = f"{work_dir(self.spark)}/misses-{uuid.uuid4().hex}"
        misses.write.parquet(todo)
        misses = self.spark.read.schema(misses.schema).parquet(todo)
        n = misses.count()
        if n:
            model, label = self.model, run or uuid.uuid4().hex

            def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    found = [x for part in batches_of(b.column(2).to_pylist()) for x in embedded(part, model)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string()), pa.array([label] * len(found))], names=["prefix", "hash", "vector", "error", "run"])

            rows = misses.mapInArrow(embed, "prefix int, hash string, vector array<double>, error string, run string")
            rows.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.path)
        return n

    def vectors(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with vector, error and run, from the cache; all null for a text that was never filled in."""
        held = self.table().groupBy("prefix", "hash").agg(F.min_by("vector", "run").alias("vector"), F.min_by("error", "run").alias("error"), F.min("run").alias("run"))
        return self.keyed(docs, text).join(held, ["prefix", "hash"], "left").drop("prefix", "hash", "seen")


def letter_model(texts: list[str]) -> list[list[float]]:
    """Shares of five letters; it refuses batches of more than ten texts, and texts without any of the letters."""
    if len(texts) > 10:
        raise ValueError("too many texts")
    out = []
    for t in texts:
        counts = [t.count(c) for c in "aeiou"]
        if not any(counts):
            raise ValueError("no letter")
        size = math.sqrt(sum(c * c for c in counts))
        out.append([c / size for c in counts])
    return out


def hash_of(text: str) -> str:
    """The cache's name for a text."""
    return hashlib.sha256(text[:MAX_CHARS].encode()).hexdigest()


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """Every third document embedded in a first run, all in a second, and once more all in a third, which embeds nothing."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = EmbeddingCache(spark, f"{work_dir(spark)}/embeddings-{uuid.uuid4().hex}", letter_model)
    cache.fill(docs.where("doc_id % 3 = 0"), run="1")
    cache.fill(docs, run="2")
    again = cache.fill(docs, run="3")
    got = cache.vectors(docs)
    return got.select("doc_id", "run", F.round(F.col("vector")[0], 6).alias("a"), F.col("error").isNotNull().alias("refused"), F.lit(again).cast("long").alias("third_run"))


QUERIES = {"embedding_cache_runs": _cached}
_COUNT = lambda c: f"(length(s) - length(replace(s, '{c}', '')))"
_SIZE = "sqrt((" + " + ".join(f"{_COUNT(c)} * {_COUNT(c)}" for c in "aeiou") + ")::DOUBLE)"
ORACLES = {
    "embedding_cache_runs": f"""
WITH t AS (SELECT doc_id, coalesce(text, '')[1:{MAX_CHARS}] AS s FROM documents),
f AS (SELECT s, CASE WHEN bool_or(doc_id % 3 = 0) THEN '1' ELSE '2' END AS run, {_SIZE} AS size, {_COUNT('a')} AS a FROM t GROUP BY s)
SELECT doc_id, run, CASE WHEN size > 0 THEN round(a / size, 6) END AS a, size = 0 AS refused, 0::BIGINT AS third_run FROM t JOIN f USING (s)"""
}
