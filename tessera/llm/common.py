"""Helpers shared by the corpus operators: durable intermediate tables, fixed-size
Bloom filters, gapless distributed numbering and 64-bit mixing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it is unset, a fresh one on a local master and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = getattr(spark, "_tessera_dir", None) or tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_dir = named
    return named.rstrip("/")


def stored(df: DataFrame, label: str, compression: str = "snappy", by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back; ``by``: columns that make folders.

    The copy survives the loss of any executor, unlike a local checkpoint or a cache.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables of this session that are still there, oldest first."""
    return [path for owner, path in _written if owner is spark]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete these intermediate tables, which nothing may read any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove((spark, path))


@atexit.register
def _sweep() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
            try:
                discard(spark, written(spark))
            except Exception:  # noqa: BLE001 - the JVM may have gone before this interpreter
                return


def quoted(name: str) -> str:
    """A column name that may hold dots, as ``select`` wants it."""
    return "`" + name.replace("`", "``") + "`"


def text_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch (one long text may exceed it), so that Python workers stay small. Batches of short rows keep their row count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(df: DataFrame) -> int:
    """Shuffle partitions of the session: the width for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bloom_words(df: DataFrame, hash_column: str, bits: int, probes: int = 3) -> np.ndarray:
    """A Bloom filter over a column of 64-bit hashes as ``bits / 64`` words.

    Built by a grouped ``bit_or`` on the executors; the driver receives at most
    ``bits / 64`` rows whatever the input, so the filter may be broadcast at any scale.
    """
    h = F.col(hash_column)
    places = F.array(*[F.expr(f"pmod(shiftrightunsigned({hash_column}, {13 * i}) , {bits})") for i in range(probes)])
    words = (
        df.where(h.isNotNull())
        .select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    got = words.toArrow()  # two numbers a word, not a Python row
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def bloom_has(words: np.ndarray, hashes: np.ndarray, probes: int = 3) -> np.ndarray:
    """Membership of unsigned 64-bit ``hashes``; no false negatives."""
    bits = np.uint64(len(words) * 64)
    found = np.ones(len(hashes), dtype=bool)
    for i in range(probes):
        p = (hashes >> np.uint64(13 * i)) % bits if i else _pmod(hashes, int(bits))
        found &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
    return found


def _pmod(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.int64) % np.int64(bits)).astype(np.uint64)


def bits_for(n: int, per_item: int = 16, low: int = 1 << 16, high: int = 1 << 26) -> int:
    """A power of two of about ``per_item`` bits an item, between fixed bounds."""
    return min(high, max(low, 1 << int(max(1, n * per_item) - 1).bit_length()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over a 64-bit word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with underscores before it as long as it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cuts(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Bounds of about ``ranges`` ranges of an integer key with about equal numbers of rows, by approximate quantiles.

    The sketches keep some numbers a range, so driver and tasks hold what ``ranges`` bounds, whatever the input.
    A key of very many rows may be a bound more than once; it counts once.
    """
    if ranges < 2:
        return []
    shares = ",".join(repr(i / ranges) for i in range(1, ranges))
    quantiles = F.percentile_approx(F.col(key).cast("long"), F.expr(f"cast(split('{shares}', ',') as array<double>)"), F.lit(max(10_000, 2 * ranges)))
    found = df.agg(quantiles.alias("q")).first().q
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` that are at most ``key``, by binary search; -1 for a null."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0).cast("long")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    listed = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)")
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= key.cast("long"), at + step).otherwise(at))
    return F.when(key.isNull(), -1).otherwise(found).cast("long")


def gapless(df: DataFrame, group: list[str], key: str, ties: list[Column], out: str, per_bucket: int = 1000, most: int = 65536) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... by ``key`` and ``ties`` without gathering a group in a task.

    Each group is cut into ranges of ``key`` at quantiles of the whole table, so neither clustered keys nor one far out
    make a range large (rows that share one key stay in one); the ranges are counted, the counts
    summed to offsets, and rows numbered inside their range only. The offsets
    hold one row per group and range. Nulls in ``group`` form a group. Rows without a ``key`` come
    first; they are cut by a hash of ``ties``, which goes before ``ties`` in their order. Columns of ``df`` may have any name but ``out``.
    """
    own = lambda name: fresh(df, f"__gapless_{name}")
    size, known = df.agg(F.count("*"), F.count(key)).first()
    n, unnamed = (max(1, min(most, x // per_bucket)) for x in (size, size - known))
    lone = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*ties), F.lit(unnamed)))
    cut = df.withColumn(own("sub"), F.coalesce(-1 - lone, range_of(F.col(key), cuts(df, key, n))))
    names = {x: own(x) for x in ("sub", "s", "before", *[f"g{i}" for i in range(len(group))])}
    counts = cut.groupBy(*group, names["sub"]).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy(names["sub"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(names[f"g{i}"]) for i, g in enumerate(group)], F.col(names["sub"]).alias(names["s"]), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(names["before"]))
    same = F.col(names["sub"]) == F.col(names["s"])
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(names[f"g{i}"]))
    inside = Window.partitionBy(*group, names["sub"]).orderBy(F.col(key).asc_nulls_first(), *ties)
    return cut.join(offsets, same).withColumn(out, (F.col(names["before"]) + F.row_number().over(inside) - 1).cast("long")).drop(*names.values())


def wide_hash(text: Column) -> tuple[Column, Column]:
    """Two 64-bit xxHash values with different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(0x5BD1E995), text)


#: Repeated hashes (16 bytes each) that may be broadcast to fetch their texts; beyond it they are joined.
BROADCAST_HASHES = 1_000_000


def collisions(texts: DataFrame) -> DataFrame | None:
    """``texts`` (h1, h2, text): the rows (h1, h2, text, part) of hashes that stand for different texts, part from 1; None where there are none.

    Texts with equal hashes are compared as bytes: partial aggregation keeps two texts a hash and task, however many copies there are.
    """
    repeated = stored(texts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated
    ends = texts.join(side, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    mixed = stored(ends.where("lo <> hi").select("h1", "h2"), "mixed")
    if mixed.isEmpty():
        return None
    parts = texts.join(mixed, ["h1", "h2"], "left_semi").distinct()
    return stored(parts.withColumn("part", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("text"))), "parts")
