"""Keyword, vector and hybrid retrieval, fusion and reranking.

A keyword search needs counts of the query's own terms only: one pass gathers corpus
statistics, one scores and keeps the best in each task. Where many queries share a corpus, :class:`tessera.operators.index.CorpusIndex`
keeps postings.
"""

from __future__ import annotations

import functools
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table, texts

K1, B, EPSILON = 1.5, 0.75, 0.25
VECTOR_WEIGHT, KEYWORD_WEIGHT, RRF = 0.6, 0.4, 60


def query_tokens(query: str) -> list[str]:
    return query.lower().translate(str.maketrans("", "", string.punctuation)).split()


# --- keyword search -----------------------------------------------------------------------


def token_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, x): a row for each distinct term of a document, x = struct<term, c>, counted inside the document.

    Where the sorted tokens change, a run ends, and its length is the distance to the run before. The generator takes an expression
    over written-out columns: a filter inferred from it must not carry the tokeniser into its lambdas.
    """
    tokens = docs.select(key, F.array_sort(T.bm25_tokens(F.col(text))).alias("t"))
    last = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == F.size("t")) | (F.element_at("t", i) != F.get("t", i)))
    ends = tokens.where(F.size("t") > 0).select(key, "t", last.alias("e"))
    runs = F.transform("e", lambda e, i: F.struct(F.element_at("t", e).alias("term"), (e - F.when(i > 0, F.get("e", i - 1)).otherwise(0)).alias("c")))
    return ends.select(key, F.size("t").alias("dl"), F.explode(runs).alias("x"))


def term_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences."""
    return token_runs(docs, key, text).groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.c").cast("long").alias("cf"))


def _count(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def _mean_idf(docs: DataFrame, text: str, n: int) -> float:
    """Mean inverse document frequency over the vocabulary: the floor of common terms."""
    df = docs.select(F.explode(F.array_distinct(T.bm25_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0


def bm25(docs: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text", memo: dict | None = None) -> DataFrame:
    """(key, score) of the k best documents with a positive score; ties to the smaller key.

    ``memo`` keeps what does not depend on the query between searches of one corpus.
    """
    memo = {} if memo is None else memo
    import math

    terms = query_tokens(query)
    nothing = docs.select(key, F.lit(0.0).alias("score")).limit(0)
    if not terms:
        return nothing
    tokens = T.bm25_tokens(F.coalesce(F.col(text), F.lit("")))
    distinct = list(dict.fromkeys(terms))
    has = [F.sum(F.array_contains("t", w).cast("int")).alias(f"d{i}") for i, w in enumerate(distinct)]
    n, mean, *df = docs.select(tokens.alias("t")).agg(F.count("*"), F.avg(F.size("t")), *has).first()
    if not n or not mean:
        return nothing
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in zip(distinct, df, strict=True) if d}
    if any(v < 0 for v in idf.values()):
        if "floor" not in memo:
            memo["floor"] = EPSILON * _mean_idf(docs, text, n)
        floor = memo["floor"]
        idf = {w: floor if v < 0 else v for w, v in idf.items()}
    if not idf:
        return nothing
    rows = docs.select(key, tokens.alias("t")).withColumn("dl", F.size("t"))
    score = F.lit(0.0)
    for w in terms:
        if w in idf:
            tf = _count("t", w)
            score = score + F.lit(idf[w]) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))
    return rows.select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)


# --- vector search ------------------------------------------------------------------------


def vector_top(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the k greatest inner products. The query travels as a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, T.dot(F.col(vector), q).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def vector_of(vectors: DataFrame, value: int, key: str = "vec_id", vector: str = "embedding") -> list[float]:
    row = vectors.where(F.col(key) == value).select(vector).first()
    return list(row[0]) if row else []


def hashing_embedder(text: Column, dims: int = 64) -> Column:
    """A deterministic text vector: signed token counts in hashed dimensions, unit length."""
    tokens = T.scoring_tokens(text)
    slots = F.sequence(F.lit(0), F.lit(dims - 1))
    hashed = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).cast("int").alias("d"), F.when(F.pmod(F.xxhash64(F.lit(1), t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(slots, lambda i: F.aggregate(F.filter(hashed, lambda h: h["d"] == i), F.lit(0.0), lambda a, h: a + h["s"]))
    return T.unit(raw)


def embed_missing(chunks: DataFrame, cache: DataFrame, embedder) -> DataFrame:
    """(hash, embedding) of the texts the cache does not hold; each distinct text once."""
    fresh = chunks.select(T.content_hash(F.col("text")).alias("hash"), F.substring("text", 1, 1200).alias("text")).dropDuplicates(["hash"])
    return fresh.join(cache.select("hash"), "hash", "left_anti").select("hash", embedder(F.col("text")).alias("embedding"))


# --- fusion -------------------------------------------------------------------------------


def minmax(df: DataFrame, score: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Scores scaled to 0 .. 1; 1.0 where all are equal. The bounds come from an aggregate, not from one window over all rows.

    With ``by`` they come from a window over each group; ``[]`` makes one group of a short list, which is then read once.
    """
    if by is not None:
        w = Window.partitionBy(*by)
        lo, hi = F.min(score).over(w), F.max(score).over(w)
        return df.withColumn(out, F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))
    bounds = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def fuse_weighted(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, key: str = "doc_id", a: float = VECTOR_WEIGHT, b: float = KEYWORD_WEIGHT) -> DataFrame:
    """(key, final_score, vector_score, bm25_score): scaled lists, outer-joined; a missing score is 0."""
    v = minmax(vector_hits.select(key, "score"), "score", "vector_score", []).drop("score")
    w = minmax(keyword_hits.select(key, "score"), "score", "bm25_score", []).drop("score")
    both = v.join(w, key, "full_outer").na.fill(0.0, ["vector_score", "bm25_score"])
    return both.withColumn("final_score", a * F.col("vector_score") + b * F.col("bm25_score")).orderBy(F.col("final_score").desc(), key).limit(k)


def ranked(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """A short list of hits with its ranks from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def fuse_ranks(lists: list[DataFrame], k: int, key: str = "doc_id", c: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists."""
    every = functools.reduce(DataFrame.union, [ranked(x, key).select(key, (1.0 / (c + F.col("rank"))).alias("part")) for x in lists])
    return every.groupBy(key).agg(F.sum("part").alias("final_score")).orderBy(F.col("final_score").desc(), key).limit(k)


def rerank(hits: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """0.7 * share of the query's tokens found + 0.3 * position bonus, over a short list of hits with ``score``."""
    asked = sorted(set(query_tokens(query)))
    found = F.size(F.array_intersect(F.array_distinct(T.bm25_tokens(F.col(text))), T.strings(asked))) / F.lit(float(max(1, len(asked))))
    by = Window.orderBy(F.col("score").desc(), key)
    n = F.count("*").over(Window.partitionBy())
    bonus = 1.0 - (F.row_number().over(by) - 1) / n
    return hits.withColumn("rerank_score", 0.7 * found + 0.3 * bonus).orderBy(F.col("rerank_score").desc(), key).limit(k)


def dedup_best(hits: DataFrame, keys: list[str], modality: str = "type", score: str = "score", ties: tuple[str, ...] = ()) -> DataFrame:
    """One hit a key: images before text, then the better score."""
    by = Window.partitionBy(*keys).orderBy((F.col(modality) != "text").desc(), F.col(score).desc(), *ties)
    return hits.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def multimodal(text_hits: DataFrame, visual_hits: DataFrame, text_weight: float, visual_weight: float, k: int, keys: list[str]) -> DataFrame:
    """Scaled, weighted and merged hits; the visual branch is left out up to a weight of 0.05."""
    parts = [minmax(text_hits, "score", "scaled").withColumn("score", F.col("scaled") * text_weight).drop("scaled")]
    if visual_weight > 0.05:
        parts.append(minmax(visual_hits, "score", "scaled").withColumn("score", F.col("scaled") * visual_weight).drop("scaled"))
    every = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return dedup_best(every, keys).orderBy(F.col("score").desc(), *keys).limit(k)


def page_key(df: DataFrame) -> Column:
    """What tells passages of a document apart: page, else slide, else chunk number."""
    have = [F.col(c) for c in ("page_number", "slide_number", "chunk_index") if c in df.columns]
    return F.coalesce(*have) if have else F.lit(0)


# --- registered queries -------------------------------------------------------------------

QUESTION = "was this thing with the delay, and the that with this?"


def _docs(spark, d):
    return texts(spark, d)


def bm25_query(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    from tessera.operators import index

    return index.documents_index(spark, d).keyword(QUESTION, k)


def vector_query(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vector_top(v, vector_of(v, 7), k)


def _vector_docs(spark, d, k):
    return vector_query(spark, d, k).select(F.col("vec_id").alias("doc_id"), "score")


def hybrid_weighted(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    out = fuse_weighted(_vector_docs(spark, d, 2 * k), bm25_query(spark, d, 2 * k), k)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("final_score", "vector_score", "bm25_score")])


def hybrid_rrf(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return fuse_ranks([_vector_docs(spark, d, 2 * k), bm25_query(spark, d, 2 * k)], k).select("doc_id", F.round("final_score", 6).alias("final_score"))


def _rerank_query(spark, d):
    from tessera.operators import index

    kept = index.documents_index(spark, d)
    return rerank(kept.with_text(kept.keyword(QUESTION, 20)), QUESTION, 5).select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def _minmax_query(spark, d):
    return minmax(table(spark, d, "events").select("event_id", "value"), "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


def _dedup_query(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"), F.when(F.col("vec_id") % 7 == 0, "image").otherwise("text").alias("type"))
    return dedup_best(e, ["label"], ties=("vec_id",)).select("label", "vec_id", "type", "score")


def _multimodal_query(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("doc_id"), F.col("label").alias("page"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"), "vec_id")
    best = lambda c: e.where(c).orderBy(F.col("score").desc(), "vec_id").limit(20).drop("vec_id")
    out = multimodal(best("vec_id % 2 = 0").withColumn("type", F.lit("text")), best("vec_id % 2 = 1").withColumn("type", F.lit("image")), 0.3, 0.7, 10, ["doc_id", "page"])
    return out.select("doc_id", "page", "type", F.round("score", 6).alias("score"))


def _cosine_query(spark, d):
    v = table(spark, d, "embeddings")
    q = F.array(*[F.lit(x) for x in vector_of(v, 7)])
    return v.where(F.col("embedding").isNotNull()).select("vec_id", F.round(T.cosine(F.col("embedding"), q), 6).alias("cosine"))


def _terms_query(spark, d):
    return term_statistics(_docs(spark, d))


def _batch_query(spark, d):
    """The nearest other vector of each label's centroid: centroids are few (one a label)."""
    v = table(spark, d, "embeddings").where("label IS NOT NULL")
    flat = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    centre = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    scored = v.join(centre, "label").select("label", "vec_id", F.round(T.dot(F.col("embedding"), F.col("centre")), 6).alias("score"))
    by = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by)).where("rank <= 3")


def _rounded(f):
    return lambda spark, d: (lambda out: out.withColumn("score", F.round("score", 6)))(f(spark, d))


QUERIES = {
    "cosine_to_vector": _cosine_query,
    "bm25_terms": _terms_query,
    "bm25_topk": _rounded(bm25_query),
    "vector_topk": _rounded(vector_query),
    "vector_topk_batch": _batch_query,
    "hybrid_weighted": hybrid_weighted,
    "hybrid_rrf": hybrid_rrf,
    "simple_rerank": _rerank_query,
    "minmax_normalize": _minmax_query,
    "dedup_best": _dedup_query,
    "multimodal_topk": _multimodal_query,
}

_Q = query_tokens(QUESTION)
_TOK = f"toks AS (SELECT doc_id, {T.bm25_tokens_sql('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks)"
_IDF = f"""{_TOK},
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS w FROM toks) GROUP BY w),
raw AS (SELECT w, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st),
idf AS (SELECT w, CASE WHEN idf < 0 THEN {EPSILON}::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"""


def scores_sql(query: str) -> str:
    """SQL of (doc_id, score) for a query, over the tables of _IDF."""
    return f"""SELECT doc_id, sum(idf * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl / avgdl))) AS score
  FROM (SELECT doc_id, q.w, len(t) AS dl, len(list_filter(t, lambda x: x = q.w)) AS tf FROM toks, (SELECT unnest({T.strings_sql(query_tokens(query))}) AS w) AS q) JOIN idf USING (w), st
  GROUP BY doc_id HAVING score > 0"""


_BM25 = f"""{_IDF},
bm AS ({scores_sql(QUESTION)}),
vec AS (
  SELECT v.vec_id AS doc_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q
),
bk AS (SELECT * FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20),
vk AS (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT 20)"""

ORACLES = {
    "cosine_to_vector": "SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE v.embedding IS NOT NULL",
    "bm25_terms": f"WITH {_TOK} SELECT w AS term, count(*) AS df, sum(c)::BIGINT AS cf FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(t) AS w FROM toks) GROUP BY ALL) GROUP BY w",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bk LIMIT 10",
    "vector_topk": f"WITH {_BM25} SELECT doc_id AS vec_id, round(score, 6) AS score FROM vk LIMIT 10",
    "vector_topk_batch": "WITH f AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, round(avg(x), 6) AS m FROM f GROUP BY ALL) GROUP BY label) SELECT label, vec_id, round(list_dot_product(embedding::DOUBLE[], centre), 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(embedding::DOUBLE[], centre), 6) DESC, vec_id)::INT AS rank FROM embeddings JOIN c USING (label) QUALIFY rank <= 3",
    "hybrid_weighted": f"WITH {_BM25}, a AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0::DOUBLE ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS v FROM vk), b AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0::DOUBLE ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS w FROM bk) SELECT doc_id, round({VECTOR_WEIGHT}::DOUBLE * coalesce(v, 0) + {KEYWORD_WEIGHT}::DOUBLE * coalesce(w, 0), 6) AS final_score, round(coalesce(v, 0.0::DOUBLE), 6) AS vector_score, round(coalesce(w, 0.0::DOUBLE), 6) AS bm25_score FROM a FULL JOIN b USING (doc_id) ORDER BY final_score DESC, doc_id LIMIT 10",
    "hybrid_rrf": f"WITH {_BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM vk UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) FROM bk) SELECT doc_id, round(sum(1.0::DOUBLE / ({RRF} + k)), 6) AS final_score FROM r GROUP BY doc_id ORDER BY sum(1.0::DOUBLE / ({RRF} + k)) DESC, doc_id LIMIT 10",
    "simple_rerank": f"WITH {_BM25}, p AS (SELECT doc_id, len(list_intersect(t, {T.strings_sql(sorted(set(_Q)))}))::DOUBLE / {len(set(_Q))} AS f, 1.0::DOUBLE - (row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1)::DOUBLE / count(*) OVER () AS b FROM bk JOIN toks USING (doc_id)) SELECT doc_id, round(0.7::DOUBLE * f + 0.3::DOUBLE * b, 6) AS rerank_score FROM p ORDER BY 0.7::DOUBLE * f + 0.3::DOUBLE * b DESC, doc_id LIMIT 5",
    "minmax_normalize": "SELECT event_id, round(CASE WHEN max(value) OVER () = min(value) OVER () THEN 1.0::DOUBLE ELSE (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) END, 6) AS scaled FROM events",
    "dedup_best": "SELECT label, vec_id, CASE WHEN vec_id % 7 = 0 THEN 'image' ELSE 'text' END AS type, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id % 7 = 0 DESC, round(embedding[1]::DOUBLE, 6) DESC, vec_id) = 1",
    "multimodal_topk": "WITH e AS (SELECT vec_id % 40 AS doc_id, label AS page, round(embedding[1]::DOUBLE, 6) AS score, vec_id FROM embeddings), t AS (SELECT * FROM e WHERE vec_id % 2 = 0 ORDER BY score DESC, vec_id LIMIT 20), v AS (SELECT * FROM e WHERE vec_id % 2 = 1 ORDER BY score DESC, vec_id LIMIT 20), u AS (SELECT doc_id, page, 'text' AS type, 0.3::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM t UNION ALL SELECT doc_id, page, 'image', 0.7::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) FROM v), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY type <> 'text' DESC, score DESC) = 1) SELECT doc_id, page, type, round(score, 6) AS score FROM d ORDER BY score DESC, doc_id, page LIMIT 10",
}
