"""Session construction and table access shared by every query."""

from __future__ import annotations

import os

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Rows of a piece at most, about, where a row costs much work.
PIECE_ROWS = 50_000


def build_session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on: UTC, adaptive execution, Arrow transfer.

    Everything cluster-specific (memory, executors, checkpoint folder) is left to the
    submit-time configuration; only semantics-bearing settings are pinned here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixed input tables; the path is opened by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A folder for the engine's own tables: below ``spark.checkpoint.dir``, else, on a local master only, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = getattr(spark, "_tessera_work", None) or tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_work = named
    return named.rstrip("/") + "/tessera"


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Columns of a text table for work that costs much a row. A table of fewer pieces than the session has cores (one small file), or of
    more than ``PIECE_ROWS`` short rows a piece, is dealt out first; another is read as it lies."""
    df = table(spark, sf_dir, name).select(*columns)
    least = max(spark.sparkContext.defaultParallelism, -(-df.count() // PIECE_ROWS))  # the count is in the files' footers
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
