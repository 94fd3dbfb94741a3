"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A full suffix array of the corpus would hold every byte position. Here a suffix is taken up only
where it is the minimizer of a window of ``length`` bytes (Roberts et al., 2004; Schleimer et al.,
2003): equal windows choose the same suffix, so no repeat of ``length`` bytes is lost. An entry holds the bytes themselves:
``suffix`` from the anchor to the end of the last window that chose it, and ``left``, what those windows hold before
the anchor. An array is sorted by (suffix, left) as bytes and split among tasks by the first bytes of the suffix.

A new batch gets an array of its own and is merge-scanned against the levels there are: entries equal in all bytes are a
long match as a whole, and entries that share their first bytes only are compared window by window, on bytes. The array
is then kept as a level; levels of equal size merge, so that n batches have at most log2(n) + 1 levels (Bentley and
Saxe, 1980). Levels lie in a folder and may be opened again by another session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_for, bloom_has, bloom_words, discard, mix64, shared_dir, stored, text_batches, written

LENGTH, GRAM = 200, 20
#: Bytes handled at once; longer texts go on in the next segment.
SEGMENT = 1 << 17
#: Bytes of short texts handled at once: small enough for a core's own cache.
GROUP = 1 << 17
#: Suffixes whose first bytes have more different entries than this are compared by a grouped count instead of in one task.
CROWD = 2000
#: Entries met this often are joined by broadcast, if there are at most so many of them.
HOT, BROADCAST_NAMES = 1000, 100_000
#: Bytes compared at once.
VERIFIED = 4096
#: Batches in which the query takes up its table.
BATCHES = 4

_MULTIPLIER, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Minimizer anchors of byte strings, with a hash of the first bytes of their suffix."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, multiplier: int = _MULTIPLIER):
        self.length, self.gram, self.multiplier = length, min(gram, length), multiplier
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums c with hash(data[i:j]) = (c[j] - c[i]) * down[i]."""
        if len(self.up) <= len(data):
            n = max(2 * len(data), 1 << 16)
            self.up, self.down = _powers(self.multiplier, n), _powers(pow(self.multiplier, -1, 1 << 64), n)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def _least(self, x: np.ndarray, width: int) -> np.ndarray:
        n = len(x) - width + 1
        y = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        before = np.minimum.accumulate(y, axis=1).ravel()
        after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(after[:n], before[width - 1 : width - 1 + n])

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, anchor, first window, last window, hash of the first ``gram`` bytes) of each run of windows with one anchor.

        Short texts are handled together, long ones in segments; a run that a segment's end cuts is two runs.
        """
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > SEGMENT:
                for base in range(0, len(t) - self.length + 1, SEGMENT):
                    _, a, lo, hi, head = self._joined([0], [t[base : base + SEGMENT + self.length - 1]])
                    parts.append((np.full(len(a), i), a + base, lo + base, hi + base, head))
            elif len(t) >= self.length:
                held.append(i)
                size += len(t)
                if size > GROUP:
                    parts.append(self._joined(held, texts))
                    held, size = [], 0
        if held:
            parts.append(self._joined(held, texts))
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _joined(self, which: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
        length, gram = self.length, self.gram
        sizes = np.array([len(texts[i]) for i in which])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(b"".join([texts[i] for i in which]), np.uint8)
        with np.errstate(over="ignore"):
            c = self.prefix(data)
            h = mix64((c[gram:] - c[:-gram]) * self.down[: len(data) - gram + 1])
            m = self._least((h & ~_MASK) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
            # Windows that reach into the next text do not count.
            own = np.repeat(np.arange(len(which)), sizes)[: len(m)]
            inside = np.flatnonzero(np.arange(len(m)) + length <= ends[own])
            at = (m[inside] & _MASK).astype(np.int64)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            lo, hi, a = inside[first], inside[np.append(first[1:], len(at)) - 1], at[first]
        text = own[lo]
        base = starts[text]
        return np.array(which)[text], a - base, lo - base, hi - base, h[a]


def _rows(docs: DataFrame) -> DataFrame:
    """(k1, k2, text): the key of a row is its doc_id, null-safe, and a hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _opened(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return k1, k2, [(t or "").encode() for t in b.column(2).to_pylist()]


def _arrays(schema: pa.Schema, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def _heads(length: int, gram: int):
    """The hash of the first bytes of every anchor's suffix."""
    schema = pa.schema([("head", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for b in batches:
            yield _arrays(schema, [find.many(_opened(b)[2])[4]])

    return run


_ENTRY = pa.schema([*[(c, pa.int64()) for c in ("head", "n1", "n2", "k1", "k2", "lo", "size")], ("suffix", pa.binary()), ("left", pa.binary())])


def _entries(length: int, gram: int, again):
    """Anchors with their bytes and a 128-bit name of these; only those whose head may occur again, or all where ``again`` is None."""
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for b in batches:
            k1, k2, texts = _opened(b)
            i, a, lo, hi, head = find.many(texts)
            if again is not None:
                keep = bloom_has(again.value, head)
                i, a, lo, hi, head = i[keep], a[keep], lo[keep], hi[keep], head[keep]
            where = list(zip(i.tolist(), lo.tolist(), a.tolist(), (hi + length).tolist(), strict=True))
            left = [texts[t][x:y] for t, x, y, _ in where]
            suffix = [texts[t][y:z] for t, _, y, z in where]
            # The length of the left part keeps entries apart that split the same bytes elsewhere.
            names = np.frombuffer(b"".join([digest(x + y, seed=len(x)) for x, y in zip(left, suffix, strict=True)]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (head.view(np.int64), names[:, 0], names[:, 1], k1[i], k2[i], lo, hi + length - lo)], pa.array(suffix, pa.binary()), pa.array(left, pa.binary())], schema=_ENTRY)

    return run


_ENTRY_TYPES = ", ".join(f"{c} long" for c in _ENTRY.names[:7]) + ", suffix binary, left binary"


def _distinct(entries: DataFrame) -> DataFrame:
    """Entries equal in all bytes as one.

    ``n`` counts places, ``mine`` says whether the new batch has one. k1, k2 and lo name the place of an entry that has one; else they say nothing.
    """
    least = [F.min(c).alias(c) for c in ("k1", "k2", "lo", "size", "n1", "n2")]  # numbers only, so that rows are hashed, not sorted
    return entries.groupBy("head", "suffix", "left").agg(F.sum("n").alias("n"), F.max("mine").alias("mine"), *least)


def _by_head(entries: DataFrame) -> DataFrame:
    """Entries in the order of their bytes, those of a head in one task."""
    return entries.repartition("head").sortWithinPartitions("suffix", "left")


def _sorted(entries: DataFrame) -> DataFrame:
    """The array: entries in the order of head and bytes within each file. Files share them by all their bytes, so a crowded head lies in many."""
    return entries.sortWithinPartitions("head", "suffix", "left")


def _having(words) -> Column:
    """Whether a head is in a Bloom filter."""

    @F.pandas_udf("boolean")
    def has(head: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(words.value, head.to_numpy().view(np.uint64)))

    return has("head")


_LEVEL = ["head", "suffix", "left", "n", "k1", "k2", "lo", "size", "n1", "n2"]


class LogIndex:
    """Levels of sorted arrays in a folder; level i holds 2**i batches.

    The list of levels is one small file for each change, written last: what a lost driver has left
    half done is not listed. Folders of merged levels are deleted after the list no longer names them.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.path, self.length, self.gram = spark, path.rstrip("/"), length, gram
        self.version, self.levels = 0, {}
        listed = self._fs("").listStatus(self._hadoop("")) if self._fs("").exists(self._hadoop("")) else []
        names = sorted(f.getPath().getName() for f in listed if f.getPath().getName().startswith("levels-"))
        if names:
            state = json.loads("".join(r.value for r in spark.read.text(f"{self.path}/{names[-1]}").collect()))
            if (state["length"], state["gram"]) != (length, gram):
                raise ValueError(f"the index was made for strings of {state['length']} bytes and {state['gram']} first bytes")
            self.version, self.levels = state["version"], {int(k): v for k, v in state["levels"].items()}

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self, name: str):
        return self._hadoop(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self) -> None:
        self.version += 1
        state = {"version": self.version, "length": self.length, "gram": self.gram, "levels": self.levels}
        out = self._fs("").create(self._hadoop(f"levels-{self.version:08d}.json"), True)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()

    def level(self, i: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.levels[i]}")

    def entries(self) -> DataFrame | None:
        """All levels, or None where there is none."""
        out = None
        for i in self.levels:
            out = self.level(i) if out is None else out.unionByName(self.level(i))
        return out

    def keep(self, array: DataFrame) -> None:
        """Take up the array of a batch. It merges with the full levels from 0 on, all at once, into the first that is empty."""
        level, run = 0, array.select(*_LEVEL)
        gone = []
        while level in self.levels:
            run = run.unionByName(self.level(level))
            gone.append(self.levels[level])
            level += 1
        if gone:
            run = _distinct(run.withColumn("mine", F.lit(False))).select(*_LEVEL)
        name = f"level-{level}-{uuid.uuid4().hex}"
        _sorted(run).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.levels = {k: v for k, v in self.levels.items() if k > level} | {level: name}
        self._list()
        for old in gone:
            self._fs(old).delete(self._hadoop(old), True)

    def drop(self) -> None:
        """Delete the index."""
        self._fs("").delete(self._hadoop(""), True)


def _window_hashes(find: Anchors, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash) of every window of ``find.length`` bytes inside the rows that ``data`` joins."""
    ends = np.cumsum(sizes)
    if not len(sizes) or len(data) < find.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(data) - find.length + 1]
    at = np.flatnonzero(np.arange(len(row)) + find.length <= ends[row])
    with np.errstate(over="ignore"):
        c = find.prefix(data)
        return row[at], at - (ends - sizes)[row[at]], mix64((c[at + find.length] - c[at]) * find.down[at])


def _equal_windows(data: np.ndarray, at: np.ndarray, to: np.ndarray, length: int) -> bool:
    """Whether all windows of ``data`` at ``at`` equal those at ``to``, byte by byte."""
    span = np.arange(length)
    return all(np.array_equal(data[at[i : i + VERIFIED, None] + span], data[to[i : i + VERIFIED, None] + span]) for i in range(0, len(at), VERIFIED))


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bytes) of a binary column of one chunk."""
    c = column.chunk(0)
    edges = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    return edges - edges[0], np.frombuffer(c.buffers()[2], np.uint8)[edges[0] : edges[-1]]


def _spans(row: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of windows."""
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    last = np.append(first[1:], len(row)) - 1
    return row[first], at[first], at[last] + length


_FOUND = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "start", "end")])


def _scanned(length: int, gram: int):
    """The merge scan: spans of lone entries, of the new batch or of a level, covered by windows that another entry of the same head holds.

    Rows are (suffix, left, n, k1, k2, lo), sorted by their bytes, so entries of one head follow each other.
    """

    def spans(t: pa.Table, find: Anchors) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        n, k1, k2, lo = (t.column(i).to_numpy() for i in range(2, 6))
        (se, sd), (le, ld) = _binary(t.column(0)), _binary(t.column(1))
        heads = sd[se[:-1, None] + np.arange(find.gram)]
        group = np.cumsum(np.append(False, (heads[1:] != heads[:-1]).any(axis=1)))
        # Of a head without a lone entry, or with no other entry, nothing is asked.
        lone = n == 1
        open_ = (np.bincount(group, lone) > 0) & (np.bincount(group) > 1)
        pick = np.flatnonzero(open_[group])
        if not len(pick):
            return
        shift, size = np.diff(le)[pick], (np.diff(le) + np.diff(se))[pick]
        # The bytes of an entry in their order: left part, then suffix.
        ends = np.cumsum(size)
        inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
        own = np.repeat(np.arange(len(pick)), size)
        before = inner < shift[own]
        data = np.empty(ends[-1], np.uint8)
        data[before] = ld[le[pick][own[before]] + inner[before]]
        data[~before] = sd[se[pick][own[~before]] + inner[~before] - shift[own[~before]]]
        row, at, w = _window_hashes(find, size, data)
        with np.errstate(over="ignore"):
            names = mix64(w + mix64((at - shift[row]).astype(np.uint64) + group[pick][row].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        _, first, where, met = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(met[where] > 1)
        absolute = (ends - size)[row] + at
        if not _equal_windows(data, absolute[hit], absolute[first[where[hit]]], length):  # two windows share a hash
            body = data.tobytes()
            exact: dict[tuple, int] = {}
            keys = [(int(group[pick][row[i]]), int(at[i] - shift[row[i]]), body[absolute[i] : absolute[i] + length]) for i in hit]
            for key in keys:
                exact[key] = exact.get(key, 0) + 1
            hit = hit[[exact[key] > 1 for key in keys]]
        hit = hit[lone[pick][row[hit]]]
        if len(hit):
            r, start, end = _spans(row[hit], at[hit], length)
            r = pick[r]
            yield _arrays(_FOUND, [k1[r], k2[r], lo[r] + start, lo[r] + end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = Anchors(length, gram), None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last, heads = t.column(0)[-1].as_py()[: find.gram], t.column(0)
            whole = t.num_rows - 1  # the last head may go on
            while whole and heads[whole - 1].as_py()[: find.gram] == last:
                whole -= 1
            if whole:
                yield from spans(t.slice(0, whole), find)
            held = t.slice(whole)
        if held is not None:
            yield from spans(held, find)

    return run


_WINDOW = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "at", "w1", "w2", "n", "lone")])


def _windows(length: int, gram: int):
    """Every window of entries of crowded heads, by a 128-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, second = Anchors(length, gram), Anchors(length, gram, _SECOND)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            n, k1, k2, lo, head = (t.column(i).to_numpy() for i in range(2, 7))
            suffix, left = t.column(0).to_pylist(), t.column(1).to_pylist()
            shift = np.array([len(x) for x in left])
            data = np.frombuffer(b"".join([x + y for x, y in zip(left, suffix, strict=True)]), np.uint8)
            size = shift + np.array([len(x) for x in suffix])
            row, at, w1 = _window_hashes(find, size, data)
            w2 = _window_hashes(second, size, data)[2]
            with np.errstate(over="ignore"):
                w1 = mix64(w1 + mix64(head.view(np.uint64)[row] + (at - shift[row]).astype(np.uint64)))
            yield _arrays(_WINDOW, [k1[row], k2[row], lo[row] + at, w1, w2, n[row], (n == 1)[row].astype(np.int64)])

    return run


def _repeating(rows: DataFrame, length: int, gram: int):
    """A broadcast filter of the heads that occur more than once in ``rows``; the entries of others meet nothing there."""
    heads = stored(rows.mapInArrow(_heads(length, gram), "head long").groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head"), "heads")
    return rows.sparkSession.sparkContext.broadcast(bloom_words(heads, "head", bits_for(heads.count(), 16, 1 << 16, 1 << 25)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index: LogIndex | None = None, again=None, keep: bool = True) -> DataFrame:
    """(k1, k2, start, end): spans whose union is what strings of ``length`` bytes found elsewhere cover.

    Elsewhere is ``docs`` itself and, with an ``index``, every batch it has taken up. Spans lie in ``docs`` and, where a string of ``docs`` meets one
    of an earlier batch, in that batch too. ``docs`` is taken up as well, unless ``keep`` is false. Without an
    index nothing is kept. ``again``, a filter of heads, leaves out entries that meet nothing in all batches to come.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = _rows(docs)
    share = spark.sparkContext.broadcast
    gram = min(gram, length)
    # Filters only choose what is looked at and how: both ways give the same spans.
    filter_of = lambda heads, n: share(bloom_words(heads.select("head"), "head", bits_for(n, 16, 1 << 16, 1 << 25)))
    if index is None:
        again = _repeating(rows, length, gram)
    mine = stored(rows.mapInArrow(_entries(length, gram, again), _ENTRY_TYPES), "entries", "zstd")
    array = stored(_distinct(mine.withColumn("n", F.lit(1).cast("long")).withColumn("mine", F.lit(True))), "array", "zstd")
    before, own = (index.entries() if index else None), array
    places = mine.select("n1", "n2", "k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end"))
    if before is not None:
        # The merge: entries of the levels whose head the batch may have too.
        known = before.where(_having(filter_of(own, own.count()))).withColumn("mine", F.lit(False)).select(*own.columns)
        array = stored(_distinct(own.unionByName(known)), "array", "zstd")
        # The only place of an entry of a level; entries with more places were repeated before.
        places = places.union(known.where("n = 1").select("n1", "n2", "k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end")))
    # Entries met more than once are repeated as a whole, at each of their places.
    repeated = array.where(F.col("mine") & (F.col("n") > 1)).select("n1", "n2", "n")
    often = F.col("n") > HOT
    hot = repeated.where(often).select("n1", "n2")
    if 0 < hot.count() <= BROADCAST_NAMES:
        whole = places.join(F.broadcast(hot), ["n1", "n2"], "left_semi").union(places.join(repeated.where(~often).select("n1", "n2"), ["n1", "n2"], "left_semi"))
    else:
        whole = places.join(repeated.select("n1", "n2"), ["n1", "n2"], "left_semi")
    spans = whole.select("k1", "k2", "start", "end")
    by_head = array.groupBy("head").agg(F.count("*").alias("m"), F.max(F.col("n") == 1).alias("open"), F.max("mine").alias("new")).where("m > 1 AND open AND new")
    asked = stored(by_head.select("head", "m"), "asked")
    n_asked, most = asked.agg(F.count("*"), F.max("m")).first()
    if n_asked:
        asked_for = array.where(_having(filter_of(asked, n_asked))).select("suffix", "left", "n", "k1", "k2", "lo", "head")
        crowds = asked.where(F.col("m") > CROWD)
        crowded = _having(filter_of(crowds, crowds.count())) if most > CROWD else F.lit(False)
        shape = "k1 long, k2 long, start long, end long"
        spans = spans.union(_by_head(asked_for.where(~crowded)).drop("head").mapInArrow(_scanned(length, gram), shape))
        if most > CROWD:
            windows = stored(asked_for.where(crowded).mapInArrow(_windows(length, gram), ", ".join(f"{c} long" for c in _WINDOW.names)), "windows")
            twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
            lone = windows.where("lone = 1").join(twice, ["w1", "w2"], "left_semi")
            spans = spans.union(lone.select("k1", "k2", F.col("at").alias("start"), (F.col("at") + length).alias("end")))
    if index is not None:
        spans = stored(spans, "spans")  # the levels it reads may merge before the result is used
        if keep:
            index.keep(own)
    return spans


def spans_by_batches(docs: DataFrame, batches: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, start, end) of a whole table that goes through a log index of its own, batch by batch; each row is in one batch, by a hash.

    Every batch gets its array, is scanned against the levels and joins them; the last one need not join. What a batch has written
    is deleted when its spans are known, the index at the end.
    """
    spark = docs.sparkSession
    text_batches(spark)
    gram = min(gram, length)
    index = LogIndex(spark, f"{shared_dir(spark)}/tessera/index-{uuid.uuid4().hex}", length, gram)
    # No batch of this table will ever meet a suffix whose first bytes it holds once.
    again = _repeating(_rows(docs), length, gram)
    found = None
    for b in range(batches):
        kept = set(written(spark))
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == b)
        spans = repeated_spans(part, length, gram, index, again, b < batches - 1)
        discard(spark, [path for path in written(spark)[:-1] if path not in kept])
        found = spans if found is None else found.union(spans)
    index.drop()
    return found


#: A span as one long: its start, and its length in the lower bits. Spans end within two windows of their start.
PACK = 1 << 20


def _union(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of packed spans; spans that touch are one."""
    packed = np.sort(packed)
    starts, ends = packed // PACK, packed // PACK + packed % PACK
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, starts, ends, sizes, kept = [], [], [], [], []
        lists = b.column(2)
        for i, text in enumerate(b.column(1).to_pylist()):
            body = (text or "").encode()
            own = lists[i].values
            lo = hi = np.zeros(0, np.int64)
            if own is not None and len(own):
                lo, hi = _union(own.to_numpy(zero_copy_only=False))
            edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(body)]
            n.append(len(body)), starts.append(lo), ends.append(hi), sizes.append(len(lo))
            kept.append(b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (starts, ends)], ["start", "end"])
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, spans), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index: LogIndex | None = None, batches: int = 1) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs) and kept (the other bytes) for every row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this or another row, or in a batch that the
    ``index`` has taken up before; strings are judged on the input. Without an ``index`` the table is all there is; it goes through a log index of
    its own in so many ``batches``, which do not change the result. A null text is empty; texts shorter than ``length`` stay whole, very
    long ones are handled in segments. A repeated row
    is another document, so both copies lose their strings; null ids are ids like others. An empty table
    gives an empty result; other columns are ignored. ``kept`` may cut a character of several bytes.
    """
    spans = spans_by_batches(docs, batches, length, gram) if index is None and batches > 1 else repeated_spans(docs, length, gram, index)
    listed = spans.groupBy("k1", "k2").agg(F.collect_list(F.col("start") * PACK + F.col("end") - F.col("start")).alias("x"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("k1")) & (F.xxhash64("text") == F.col("k2"))
    joined = rows.join(listed, same, "left").select("doc_id", "text", "x")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
