"""Exact top-k search: tiled integer matrix products, partial selection, merged lists.

Vectors are packed into tiles. Every query tile meets every shard tile once, in one
matrix product; a tile pair keeps only its k best for each query, and the short
lists are merged in two levels. No pair of single vectors becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a shard tile and queries in a query tile.
TILE, QUERY_TILE = 4096, 1024
#: Below this, sums of integers are exact in doubles, in any order.
EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    """The components as doubles; null where any component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, x)


def _packed(rows: DataFrame, tile: int, scale: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows (id, v, dim) into tiles (number, dim, ids, matrix of floor(scale * v)) within each input partition.

    A double holds such an integer exactly, however large it is.
    """
    number, ids, matrix = names
    schema = pa.schema([(number, pa.int64()), ("dim", pa.int32()), (ids, pa.binary()), (matrix, pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dim: int):
            nonlocal made
            i = np.concatenate([a for a, _ in held[dim]])
            m = np.concatenate([b for _, b in held[dim]])
            held[dim] = []
            for at in range(0, len(i), tile):
                row = [(part << 32) + made, dim, i[at : at + tile].tobytes(), m[at : at + tile].tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            values, lengths = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            i = b.column(0).to_numpy(zero_copy_only=False)
            flat = np.floor(values.flatten().to_numpy(zero_copy_only=False) * float(scale))
            if not np.isfinite(flat).all():
                raise OverflowError("a scaled component leaves the range of doubles")
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for dim in np.unique(lengths):
                pick = np.flatnonzero(lengths == dim)
                m = flat[(starts[pick][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(pick), dim)
                held.setdefault(int(dim), []).append((i[pick], m))
                if sum(len(a) for a, _ in held[int(dim)]) >= tile:
                    yield from out(int(dim))
        for dim in list(held):
            if held[dim]:
                yield from out(dim)

    return rows.mapInArrow(pack, f"{number} long, dim int, {ids} binary, {matrix} binary")


def _exact(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Inner products of a vector with the rows of a matrix as Python integers."""
    a = [int(x) for x in one]
    return np.array([sum(x * int(y) for x, y in zip(a, row, strict=True)) for row in many], dtype=object)


def _products(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All inner products of rows as doubles, and which rows of ``a`` have one that a double might not hold exactly."""
    most = lambda m: np.abs(m).max(axis=1, initial=0) * max(1, m.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        large = most(a) * np.abs(c).max(initial=0) >= EXACT
        return a @ c.T, large


def _best(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("below", pa.bool_()), ("tile", pa.int64())])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, dim, qi, qm, vi, vm in zip(*[b.column(x).to_pylist() for x in ("s_tile", "dim", "q_ids", "q_matrix", "s_ids", "s_matrix")], strict=True):
                q, v = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                a = np.frombuffer(qm, np.float64).reshape(len(q), dim)
                c = np.frombuffer(vm, np.float64).reshape(len(v), dim)
                order = np.argsort(v, kind="stable")  # ties go to the smaller id
                v, c = v[order], c[order]
                scores, large = _products(a, c)
                own = q[:, None] == v[None, :] if np.intersect1d(q, v).size else None
                keep = min(k, len(v))
                ids, got, kept, under = [], [], [], []
                for r in range(len(q)):
                    s = _exact(a[r], c) if large[r] else scores[r]
                    mask = own[r] if own is not None else None
                    if mask is not None and mask.any():
                        s = s[~mask]
                        names = v[~mask]
                    else:
                        names = v
                    if not len(s):
                        continue
                    m = min(keep, len(s))
                    edge = sorted(s)[len(s) - m] if large[r] else np.partition(s, len(s) - m)[len(s) - m]
                    above = np.flatnonzero(s > edge)
                    level = np.flatnonzero(s == edge)[: m - len(above)]
                    pick = np.concatenate([above, level])
                    best = s[pick]
                    if large[r] and (best >= 1 << 63).any():  # it, or k larger ones, would be returned
                        raise OverflowError(f"a score of query {q[r]} leaves 64 bits")
                    below = (best < -(1 << 63)).astype(bool)
                    ids.append(np.full(len(pick), q[r])), got.append(names[pick]), under.append(below)
                    kept.append(np.where(below, -(1 << 63), best).astype(np.int64))
                if ids:
                    i = np.concatenate(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.concatenate(got)), pa.array(np.concatenate(kept)), pa.array(np.concatenate(under)), pa.array(np.full(len(i), n))], schema=schema)

    return select


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("below"), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best candidates of every query by integer inner product.

    ``vectors`` and ``queries`` hold ``id_column`` and ``vector``. A row never meets rows
    with its own id. Rows whose vector or id is null, or that hold a null or non-finite
    component, take no part; vectors of different lengths do not meet. Equal scores go
    to the smaller id; a repeated candidate row is a candidate again. Empty tables give
    an empty result; other columns are ignored. Scores are 64-bit integers, computed exactly whatever the components: products that doubles might
    round are summed as Python integers, and a score to be returned that 64 bits do not hold raises an error, as does a
    component whose multiple leaves the range of doubles.
    """
    prepared = [
        d.select(F.col(id_column).cast("long").alias("id"), finite(F.col(vector)).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v"))
        for d in (vectors, queries)
    ]
    shards = stored(_packed(prepared[0], TILE, scale, ("s_tile", "s_ids", "s_matrix")), "tiles")
    asked = stored(_packed(prepared[1], QUERY_TILE, scale, ("q_tile", "q_ids", "q_matrix")), "asked")
    # Tile numbers only: each shard tile is asked by each query tile of its length.
    numbers = asked.select(F.col("dim").alias("q_dim"), "q_tile")
    meets = shards.select("dim", "s_tile").join(numbers, F.col("dim") == F.col("q_dim")).drop("q_dim")
    n = max(1, min(65536, meets.count()))
    pairs = meets.join(asked.drop("dim"), "q_tile").join(shards.drop("dim"), "s_tile").repartition(n, "s_tile", "q_tile")
    lists = pairs.mapInArrow(_best(k), "query_id long, vec_id long, score long, below boolean, tile long")
    part = _top(lists.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(64))), ["query_id", "part"], k)
    held = F.when(F.col("below"), F.raise_error(F.lit("a score leaves 64 bits")).cast("long")).otherwise(F.col("score"))
    return _top(part.drop("rank"), ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", held.alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
