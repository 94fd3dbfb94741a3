"""Repeated-line removal with two Bloom filters.

One filter holds hashes seen once, the other hashes seen twice. Each task fills its own
pair; pairs merge as ``twice = twice | other.twice | (once & other.once)``. Only lines
whose hash is in the twice-seen filter are shuffled, for an exact count of documents and
the choice of the first occurrence; the filters only decide what needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, quoted, stored, text_batches

BLANK = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 16
PROBES = 2
#: Confirmed keys that may be broadcast (16 bytes each); beyond it they are joined.
BROADCAST_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def _keys(text: str | None, least: int) -> list[bytes]:
    """The line keys that can be removed, in order; shorter ones are empty."""
    keys = [line_key(x) for x in (text or "").encode().split(b"\n")]
    if least <= 1:
        return keys
    return [k if len(k) >= least and len(k.decode()) >= least else b"" for k in keys]


def _digests(keys: list[bytes]) -> list[bytes]:
    d = xxhash.xxh3_128_digest
    return [d(k) if k else b"" for k in keys]


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """PROBES positions of each 16-byte digest."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return np.stack([(words[:, 0] + np.uint64(i) * words[:, 1]) % np.uint64(bits) for i in range(PROBES)], axis=1)


def _local_filters(bits: int, least: int, parts: int):
    schema = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def flush(held: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        places, n = np.unique(np.concatenate(held), return_counts=True)
        segment = (places // SEGMENT).astype(np.int64)
        edges = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            once, twice = np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)
            inside = (places[at:to] % SEGMENT).astype(np.int64)
            once[inside] = 1
            twice[inside[n[at:to] > 1]] = 1
            row = [int(segment[at]), part, np.packbits(once).tobytes(), np.packbits(twice).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() % parts, [], 0
        for b in batches:
            digests = [d for text in b.column(0).to_pylist() for d in set(_digests(_keys(text, least))) if d]
            if digests:
                held.append(_places(digests, bits).ravel())
                size += held[-1].size
            if size > 2_000_000:
                yield from flush(held, part)
                held, size = [], 0
        yield from flush(held, part)

    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
    for a, b in zip(rows["once"], rows["twice"], strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "once": [once.tobytes()], "twice": [twice.tobytes()]})


def twice_seen(docs: DataFrame, bits: int, least: int, text: str = "text") -> np.ndarray:
    """The twice-seen filter over all documents as ``bits / 8`` bytes: the driver's only share."""
    parts = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    local = docs.select(text).mapInArrow(_local_filters(bits, least, parts), "segment int, part int, once binary, twice binary")
    shape = "segment int, once binary, twice binary"
    met = local.groupBy("segment", "part").applyInPandas(_merged, shape).groupBy("segment").applyInPandas(_merged, shape)
    out = np.zeros(bits // 8, np.uint8)
    for r in met.select("segment", "twice").collect():
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.twice, np.uint8)
    return out


def _suspected(digests: list[bytes], seen: np.ndarray) -> list[bytes]:
    digests = [d for d in digests if d]
    if not digests:
        return []
    p = _places(digests, len(seen) * 8)
    hit = ((seen[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
    return [digests[i] for i in np.flatnonzero(hit)]


def _suspects(filter_, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            ids, th, keys = [], [], []
            for doc, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for d in _suspected(list(set(_digests(_keys(text, least)))), seen):
                    ids.append(doc), th.append(h), keys.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "th", "key"])

    return run


def _rewritten(least: int, keep_first: bool, known):
    """known: a broadcast of {key: first document} or None where each row brings its own keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = known.value if known is not None else None
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            out, n, dropped = [], [], []
            for at, (doc, text) in enumerate(zip(columns[0], columns[1], strict=True)):
                body = (text or "").encode()
                lines = body.split(b"\n")
                gone = shared if shared is not None else {x["key"]: x["first"] for x in columns[2][at] or ()}
                kept = lines
                if gone:
                    kept, met = [], set()
                    for line, d in zip(lines, _digests(_keys(text, least)), strict=True):
                        if d and d in gone:
                            if not (keep_first and gone[d] == doc and d not in met):
                                continue
                            met.add(d)
                        kept.append(line)
                n.append(len(lines)), dropped.append(len(lines) - len(kept))
                out.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())] + [b.column(i) for i in range(3, b.num_columns)], names=["doc_id", "text", "n_lines", "n_dropped"] + b.schema.names[3:])

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated lines removed, and n_lines (before) and n_dropped.

    A line's key is the line stripped of blanks, A-Z lower-cased. Keys of at least ``least``
    code points found in at least ``min_docs`` rows lose all their lines, or all but the
    first line of the row with the smallest doc_id if ``keep_first``. A null text counts as one empty
    line and stays null; an empty line has an empty key and stays. Very long texts and lines are read whole; keys are told apart by
    digests of 128 bits. Repeated rows count as
    documents of their own; a null doc_id is a row like any other. With ``keep_first``, rows that share the smallest
    doc_id all keep the line, and a key found in rows without an id only stays in all of them. An empty table gives an empty
    result. Columns besides doc_id and text pass through, whatever their names, but for n_lines and n_dropped, which are replaced.
    """
    spark = docs.sparkSession
    text_batches(spark)
    bits = bits_for(docs.count(), 256, 1 << 18, 1 << 27)
    filter_ = spark.sparkContext.broadcast(twice_seen(docs, bits, least).tobytes())
    th = F.xxhash64("text")
    suspects = docs.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), "text").mapInArrow(_suspects(filter_, least), "doc_id long, th long, key binary")
    confirmed = stored(suspects.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_docs).drop("n"), "lines")
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_lines", "n_dropped")]
    # By place: Spark takes no names with dots into Python.
    names = ["doc_id", "text", "n_lines", "n_dropped", *rest]
    shape = ", ".join(["doc_id long", "text string", "n_lines long", "n_dropped long"] + [f"__c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(rest)])
    rest = [f"__c{i}" for i in range(len(rest))]
    if confirmed.count() <= BROADCAST_KEYS:
        known = spark.sparkContext.broadcast({bytes(r.key): r.first for r in confirmed.select("key", F.col("first").alias("first")).collect()})
        rows = own.select("doc_id", "text", F.lit(None).cast("array<struct<key:binary,first:long>>").alias("__gone"), *rest)
        return rows.mapInArrow(_rewritten(least, keep_first, known), shape).toDF(*names)
    lost = (
        suspects.join(confirmed, "key")
        .groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("__d"), F.col("th").alias("__t"))
        .agg(F.collect_set(F.struct("key", "first")).alias("__gone"))
    )
    rows = own.join(lost, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left")
    return rows.select("doc_id", "text", "__gone", *rest).mapInArrow(_rewritten(least, keep_first, None), shape).toDF(*names)


MIN_DOCS, LEAST = 10, 1

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone g ON k.key = g.key
GROUP BY k.doc_id
"""
