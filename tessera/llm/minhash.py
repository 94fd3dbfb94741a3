"""Near-duplicate classes: MinHash, banding, signature verification, exact confirmation, components.

Equal shingle sets fall into one class first, and only one row of a class goes on. In a
band bucket every member is compared with the bucket's least id, not with all others.
What such stars leave in different components is compared block by block, so no link
between different texts is lost but what banding itself misses: 32 bands of 5
minima miss a pair at similarity 0.8 with probability below 4e-6, and less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, bloom_has, bloom_words, gapless, mix64, stored, text_batches
from .components import components

BANDS, ROWS = 32, 5
#: A pair goes to exact confirmation if this share of its minima agree: six standard
#: deviations below 0.8 for 160 minima.
ESTIMATE = 0.60
REMEMBERED = 500_000

_random = np.random.default_rng(20240229)
_A = (_random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the w-word shingles of a text, with a memory of word hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII blanks
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, np.uint64(width))
        with np.errstate(over="ignore"):
            for j in range(width):
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> bytes:
    """The least value of each hash function, 16 bits of each."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            least = np.minimum(least, (_A[:, None] * shingles[None, at : at + 1024] + _B[:, None]).min(axis=1))
    return (mix64(least) >> np.uint64(48)).astype("<u2").tobytes()


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            n, d1, d2, sig, last = [], [], [], [], {}
            for text in b.column(1).to_pylist():
                if (hit := last.get(text)) is None:
                    s = shingles(text)
                    x = xxhash.xxh3_128_intdigest(s.tobytes())
                    hit = (len(s), (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63), signature(s) if len(s) else None)
                    last[text] = hit
                for to, v in zip((n, d1, d2, sig), hit, strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "d1", "d2", "sig"])

    return run


def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), "<u2").reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), "<u2").reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1) >= ESTIMATE)


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, held = Shingler(width), None, None
        for b in batches:
            out = ([], [])
            for i, j, x, y in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if last != (i, x):
                    last, held = (i, x), shingles(x)
                s = shingles(y)
                both = len(np.intersect1d(held, s, assume_unique=True))
                if both and 100 * both >= percent * (len(held) + len(s) - both):
                    out[0].append(i), out[1].append(j)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def _texts_of(ids: DataFrame, n: int, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have one of about ``n`` ids: only these texts need a shuffle. None is missed."""
    bits = bits_for(n, 16, 1 << 14, 1 << 25)
    words = docs.sparkSession.sparkContext.broadcast(bloom_words(ids.select(F.xxhash64("id").alias("h")), "h", bits))

    @F.pandas_udf("boolean")
    def wanted(h: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(words.value, h.to_numpy().view(np.uint64)))

    return docs.where(F.col("doc_id").isNotNull()).where(wanted(F.xxhash64("doc_id")))


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full sets reach the threshold."""
    agreeing = F.pandas_udf("boolean")(_agreeing)
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("s_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("s_b"))
    near = stored(
        pairs.join(right, "b")
        .join(left, "a")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(agreeing("s_a", "s_b"))
        .select("a", "b"),
        "near",
    )
    n = near.count()
    if not n:
        return near
    texts = _texts_of(near.select(F.explode(F.array("a", "b")).alias("id")), 2 * n, docs)
    rows = (
        near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), "a")
        .select("a", "b", "t_a", "t_b")
    )
    return stored(rows.mapInArrow(_confirmed(width, percent), "a long, b long"), "links")


#: Members of a block; a pair of blocks is compared in one task, in memory.
BLOCK, COLUMNS = 256, 8192


def _counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of 0/1 matrices."""
    words = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(words, flat)
        hit = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == flat)
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    out = np.zeros((len(a), len(b)), np.float32)
    if not len(words):
        return out
    (ra, ca), (rb, cb) = places(a), places(b)
    for lo in range(0, len(words), COLUMNS):
        n = min(COLUMNS, len(words) - lo)
        x, y = np.zeros((len(a), n), np.float32), np.zeros((len(b), n), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            i, j = np.searchsorted(c, [lo, lo + n])
            m[r[i:j], c[i:j] - lo] = 1
        out += x @ y.T
    return out


def _compared(width: int, percent: int):
    """One link for each two components that some pair of the two blocks links. Sizes are exact in single precision up to 2**24."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            links: set[tuple[int, int]] = set()
            for left, right in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets = [[shingles(d["text"]) for d in block] for block in (left, right)]
                root = [np.array([d["root"] for d in block]) for block in (left, right)]
                both = _counts(*sets).astype(np.float64)
                size = [np.array([len(x) for x in part], np.float64) for part in sets]
                union = size[0][:, None] + size[1][None, :] - both
                hit = (both > 0) & (100 * both >= percent * union) & (root[0][:, None] != root[1][None, :])
                i, j = hit.nonzero()
                ends = np.stack([root[0][i], root[1][j]], axis=1)
                links |= {(int(x), int(y)) for x, y in np.unique(np.sort(ends, axis=1), axis=0)}
            rows = sorted(links)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    return run


def _crowd_links(still: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that share an open bucket. ``still``: key, id, lead, root of the members of open buckets.

    Buckets that share members join to a crowd, whose members are cut into blocks, components together. Every two blocks
    with members of one bucket that hold different components meet once; their full sets are compared in memory and only links come
    out, so that no pair of documents becomes a row.
    """
    crowds = components(still.select("lead", "id").distinct())
    rows = still.select("id", "root").distinct().join(crowds.toDF("id", "crowd"), "id", "left").select("id", "root", F.coalesce("crowd", "id").alias("crowd"))
    placed = gapless(stored(rows, "crowd"), ["crowd"], "root", [F.col("id")], "n").select("crowd", F.floor(F.col("n") / BLOCK).cast("long").alias("block"), "id", "root")
    placed = stored(placed, "placed")
    texts = _texts_of(placed.select("id"), placed.count(), docs)
    listed = placed.join(texts.withColumnRenamed("doc_id", "id"), "id")
    # A block has at most BLOCK documents.
    blocks = stored(listed.groupBy("crowd", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_list(F.struct("root", "text")).alias("docs")), "blocks")
    touched = stored(still.select("key", "id").join(placed.select("id", "crowd", "block"), "id").select("key", "crowd", "block").distinct(), "touched")
    shared = touched.withColumnRenamed("block", "i").join(touched.withColumnRenamed("block", "j"), ["key", "crowd"]).where("i <= j").select("crowd", "i", "j").distinct()
    left = blocks.select("crowd", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    right = blocks.select("crowd", F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    meets = left.join(right, "crowd").where((F.col("i") <= F.col("j")) & ~((F.col("lo_i") == F.col("hi_i")) & (F.col("lo_j") == F.col("hi_j")) & (F.col("lo_i") == F.col("lo_j")))).select("crowd", "i", "j").join(shared, ["crowd", "i", "j"], "left_semi")
    meets = stored(meets, "meets")
    pairs = meets.join(blocks.select("crowd", F.col("block").alias("j"), F.col("docs").alias("docs_j")), ["crowd", "j"]).join(blocks.select("crowd", F.col("block").alias("i"), F.col("docs").alias("docs_i")), ["crowd", "i"])
    n = max(1, min(65536, meets.count()))
    return stored(pairs.select("crowd", "i", "j", "docs_i", "docs_j").repartition(n, "crowd", "i", "j").select("docs_i", "docs_j").mapInArrow(_compared(width, percent), "a long, b long").distinct(), "more")


#: Keys with more rows than this, and than the share, are joined by broadcast: the share bounds how many they are.
HOT, HOT_SHARE = 1000, 1 / 50_000


def _with_hot(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``keys`` (key, size and more), where ``size`` counts rows of the key and sums to ``total`` at most.

    The rows of a hot key stay in the tasks they are in.
    """
    hot = F.col("size") > max(HOT, total * HOT_SHARE)
    return rows.join(F.broadcast(keys.where(hot)), "key").unionByName(rows.join(keys.where(~hot), "key"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``width``-word
    shingles (fewer words: the whole sequence is one shingle). No words or a null text: an
    empty set, linked with nothing. Very long texts are read whole. component_id is the least doc_id reachable. Equal sets, and shingles within sets,
    are told by hashes of 128 and 64 bits. Rows that share a doc_id are one document and
    so linked; a null doc_id is linked with nothing, has a null component and is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(docs.mapInArrow(_sketch(width), "doc_id long, n long, d1 long, d2 long, sig binary"), "sketches")
    real = sketches.where(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
    reps = stored(real.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("r")).select(F.col("r.doc_id").alias("id"), "d1", "d2", F.col("r.n").alias("n"), F.col("r.sig").alias("sig")), "classes")
    step = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", step * i + 1, step)) for i in range(BANDS)])
    bands = reps.select("id", F.explode(keys).alias("key"))
    crowds = stored(bands.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where(F.col("size") > 1), "buckets")
    members = stored(_with_hot(bands, crowds, BANDS * reps.count()), "members")
    stars = members.where(F.col("id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = _links(stars, reps, docs, width, percent)
    roots = components(links)
    # What is left: members of one bucket in different components.
    labelled = members.where(F.col("size") > 2).join(roots, "id", "left").select("key", "id", "lead", F.coalesce("root", "id").alias("root"))
    open_ = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    still = stored(_with_hot(labelled, open_.select("key", "size"), BANDS * reps.count()).select("key", "id", "lead", "root"), "open")
    if still.limit(1).count():
        more = _crowd_links(still, docs, width, percent)
        if more.count():
            roots = components(roots.toDF("a", "b").union(more))
    # Classes to components; documents with one id in several classes join these.
    first = reps.select("d1", "d2", F.col("id").alias("least"))
    tied = real.join(first, ["d1", "d2"]).select("doc_id", "least")
    shared = tied.groupBy("doc_id").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi")
    if shared.limit(1).count():
        roots = components(roots.toDF("a", "b").union(shared.select("lo", "hi")))
    named = first.join(roots.withColumnRenamed("id", "least"), "least", "left").select("d1", "d2", F.coalesce("root", "least").alias("component"))
    rows = sketches.select("doc_id", "n", F.when(F.col("sig").isNotNull(), F.col("d1")).alias("d1"), F.when(F.col("sig").isNotNull(), F.col("d2")).alias("d2"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(named, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
