"""Structured Streaming: incremental ingestion, windows over events, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking
from tessera.operators.index import CorpusIndex
from tessera.session import table

LATE = "2 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; event time needs a zoned timestamp."""
    schema = table(spark, sf_dir, "events").schema
    # A file stream reads folders; the glob keeps it to this table, be it a file or a folder.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def rolling_requests(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def fresh_texts(docs: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each text once within the watermark."""
    return docs.withColumn("hash", T.content_hash(F.col("text"))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])


def ingest_stream(stream: DataFrame, chunks_path: str, checkpoint: str):
    """Append chunks of arriving (doc_id, text) documents; a batch that is tried again overwrites its own part."""

    def write(batch: DataFrame, epoch: int) -> None:
        chunking.chunk(batch).write.mode("overwrite").parquet(f"{chunks_path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(stream: DataFrame, index: CorpusIndex, checkpoint: str):
    """Append arriving (key, text) documents to an index, postings and vectors; those it holds already, by key, are left out.

    A batch that is tried again therefore adds nothing twice. What a batch left when it broke off is not listed in the index and is cleared away first.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        index.segments.reread()
        index.segments.sweep()
        fresh = lambda name: batch.join(index.table(name).select(index.key), index.key, "left_anti") if index.has(name) else batch
        index.add(fresh("texts").dropDuplicates([index.key]))
        index.embed(fresh("vectors").dropDuplicates([index.key]))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end into a table in memory: for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return df.sparkSession.table(name)


def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    return run_to_memory(daily_counts(event_stream(spark, sf_dir)), "daily_" + uuid.uuid4().hex[:8])


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rolling_requests(events).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


QUERIES = {"stream_daily_counts": daily_stream, "rolling_requests": _rolling}
ORACLES = {
    "rolling_requests": "SELECT strftime(make_timestamp((s - 10 * i) * 1000000), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT user_id, (epoch_us(ts) // 10000000) * 10 AS s FROM events), range(6) AS r(i) GROUP BY 1, 2",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"}
