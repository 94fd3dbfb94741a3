"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key and a shard count decide the shard; no ring table is kept, and going from
``n`` to ``n + 1`` shards moves rows only into the new shard, about ``1 / (n + 1)`` of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless

OVERHEAD = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, for all keys of a batch at once."""
    keys = keys.astype(np.uint64).copy()
    at = np.zeros(len(keys), dtype=np.int64)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            k = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
            keys[live] = k
            jump = np.floor((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            inside = jump < shards
            at[live[inside]] = jump[inside]
            live = live[inside]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """``key`` (an integer; null counts as 0) to 0 .. ``shards - 1``."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0)))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 16 (null text: 16) and ``text_crc32`` the unsigned
    CRC-32 of those bytes (null text: of none). A null key is placed as key 0. Rows with
    the same key share a shard and take successive slots; identical rows do too. An
    empty table gives an empty result; other columns are ignored. Texts, however long, never leave the
    scan: what is shuffled has a few numbers a row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    ties = [F.col("size"), F.col("text_crc32")]
    # Counts come from keys alone, so the first pass reads one column.
    out = gapless(rows, ["shard"], "doc_id", ties, "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


SHARDS = 40
