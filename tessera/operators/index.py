"""A search index kept in a folder: texts, postings, vectors and graph, written once, opened again, appended to.

Texts and postings lie in segments (``operators/segments.py``), dealt by buckets of terms and sorted by term, so a question reads the buckets of
its own words, and within them the row groups that can hold these. Nothing is collected but the figures of a question's words and its best hits.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval
from tessera.operators.segments import BUCKETS, Segments
from tessera.session import work_dir

DIMENSIONS = 64
#: Hits of many questions that may be broadcast to their texts, and keys that go to the scan of the texts as literals.
BROADCAST_HITS, LITERALS = 100_000, 1_000
#: What lies in segments.
SEGMENTED = ("texts", "postings", "terms")


class CorpusIndex:
    """An index at ``path`` over texts with a ``key`` (any type that sorts) of their own.

    ``embedder`` makes a vector of a text Column; without a model it is the hashing embedder.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", embedder: Callable[[Column], Column] | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.segments = Segments(spark, f"{self.path}/segments", key)
        self.embedder = embedder or (lambda text: retrieval.hashing_embedder(text, DIMENSIONS))

    # --- storage ---

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def has(self, name: str) -> bool:
        if name in SEGMENTED:
            return bool(self.segments.state()["segments"])
        fs, target = self._hadoop(name)
        return fs.exists(target)

    def reset(self) -> None:
        """Delete the index; the next write starts a new one."""
        fs, target = self._hadoop("")
        fs.delete(target, True)
        self.segments = Segments(self.spark, self.segments.path, self.key)

    def table(self, name: str) -> DataFrame:
        if name in SEGMENTED:
            return self.segments.table(name)
        if not self.has(name):
            raise FileNotFoundError(f"the index at {self.path} has no {name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _append(self, df: DataFrame, name: str, *by: str) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")

    # --- texts and postings ---

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Take up documents with keys that are not there yet. A null text is an empty one."""
        self.segments.add(docs.select(self.key, F.coalesce(F.col(text), F.lit("")).alias("text")))

    def whole(self) -> bool:
        """False where a write broke off: its segment is not listed, so the index goes on without it; ``rebuild`` clears it away."""
        return not self.segments.left_over()

    def rebuild(self) -> None:
        """One segment of all texts, each key once, and nothing that is not listed. Vectors and graph stay."""
        if self.has("texts"):
            self.segments.compact()
        self.segments.sweep()

    def stored_chunks(self) -> DataFrame:
        return self.table("texts")

    def term_statistics(self) -> DataFrame:
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def keyword(self, query: str, k: int) -> DataFrame:
        """(key, score) of the k best by BM25, from the postings of the query's words only; ties to the smaller key."""
        wanted = Counter(retrieval.query_tokens(query))
        n, tokens = self.segments.figures()
        postings = self.table("postings")
        nothing = self.table("texts").select(self.key, F.lit(0.0).alias("score")).limit(0)
        if not wanted or not tokens:
            return nothing
        own = F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in wanted})) & F.col("term").isin(list(wanted))
        df = {r.term: r.df for r in self.table("terms").where(own).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        floor = self.segments.floor() if any(v < 0 for v in idf.values()) else 0.0
        weight = {w: wanted[w] * (v if v >= 0 else floor) for w, v in idf.items()}
        if not weight:
            return nothing
        mean = tokens / n
        w = F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.col("term"))
        part = w * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / F.lit(float(mean))))
        hits = postings.where(own).select("term", F.explode("posts").alias("p")).select("term", "p.*").groupBy(self.key).agg(F.sum(part).alias("score")).where("score > 0")
        return hits.orderBy(F.round("score", 9).desc(), self.key).limit(k)

    def with_text(self, hits: DataFrame) -> DataFrame:
        """A few hits (key, score) with their texts: the keys go to the scan as literals."""
        rows = hits.select(self.key, "score").collect()
        texts = self.table("texts")
        scored = self.spark.createDataFrame([tuple(r) for r in rows], hits.select(self.key, "score").schema)
        return texts.where(F.col(self.key).isin([r[0] for r in rows])).join(F.broadcast(scored), self.key).select(self.key, "text", "score")

    def search(self, query: str, k: int) -> DataFrame:
        """key, text and a score scaled to 0 .. 1: the form that hops and corrective retrieval take."""
        return self.with_text(retrieval.minmax(self.keyword(query, k), "score", "scaled", []).select(self.key, F.col("scaled").alias("score")))

    # --- many questions at once ---

    def keyword_batch(self, asked: DataFrame, k: int) -> DataFrame:
        """(id, key, score) of the k best of each question of ``asked`` (id, query), as ``keyword`` finds them, from the blocks that can hold them."""
        return self.segments.best(asked, k)

    def search_batch(self, asked: DataFrame, k: int) -> DataFrame:
        """(id, key, text, score) for each question of ``asked`` (id, query), scores scaled to 0 .. 1 in each question."""
        hits = retrieval.minmax(self.keyword_batch(asked, k), "score", "scaled", ["id"]).select("id", self.key, F.col("scaled").alias("score"))
        path = f"{self.path}/hits-{uuid.uuid4().hex}"
        hits.write.parquet(path)
        hits = self.spark.read.schema(hits.schema).parquet(path)
        texts = self.table("texts")
        few = hits.select(self.key).distinct().limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:  # the keys go to the scan, which skips what cannot hold them
            texts = texts.where(F.col(self.key).isin([r[0] for r in few]))
        side = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
        return texts.join(side, self.key).select("id", self.key, "text", "score")

    def evidence_batch(self, asked: DataFrame, k: int = 6, least: int = 3) -> DataFrame:
        """(id, subject, content, hits, score, rank): the k edges that share most terms with each question.

        One pass over the edges. Edges that share the same terms with the whole batch stand alike in every question, so of these only the first k go on.
        """
        terms = asked.select("id", F.filter(T.terms(F.coalesce("query", F.lit(""))), lambda t: F.length(t) >= least).alias("terms"))
        wanted = terms.select("id", F.size("terms").alias("asked"), F.explode("terms").alias("term"))
        words = [r.term for r in wanted.select("term").distinct().limit(LITERALS + 1).collect()]
        edges = self.table("edge_terms")
        if len(words) <= LITERALS:
            shared = edges.withColumn("terms", F.array_sort(F.filter("terms", lambda t: t.isin(words)))).where(F.size("terms") > 0)
            alike = Window.partitionBy("terms").orderBy("content", "subject", "object")
            edges = shared.withColumn("at", F.row_number().over(alike)).where(F.col("at") <= k)
        each = edges.select("subject", "object", "content", F.explode("terms").alias("term"))
        found = each.join(wanted, "term").groupBy("id", "subject", "object", "content").agg(F.count("*").alias("hits"), F.max("asked").alias("asked"))
        best = Window.partitionBy("id").orderBy(F.col("hits").desc(), "content", "subject", "object")
        rows = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return rows.select("id", "subject", "content", "hits", F.least(F.lit(1.0), F.col("hits") / F.greatest(F.lit(1), F.col("asked"))).alias("score"), "rank")

    # --- vectors ---

    def add_vectors(self, vectors: DataFrame, vector: str = "embedding", name: str = "vectors") -> None:
        """Append (key, vector); all vectors of a table have one length, or nothing is written."""
        sizes = {r[0] for r in vectors.where(F.col(vector).isNotNull()).select(F.size(vector)).distinct().limit(3).collect()}
        if self.has(name):
            first = self.table(name).select(F.size("embedding")).first()
            sizes |= {first[0]} if first else set()
        if len(sizes) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
        self._append(vectors.where(F.col(vector).isNotNull()).select(self.key, F.col(vector).alias("embedding")), name)

    def embed(self, docs: DataFrame, text: str = "text") -> None:
        """Append a vector for each document, made by the embedder."""
        self.add_vectors(docs.select(self.key, self.embedder(F.coalesce(F.col(text), F.lit(""))).alias("embedding")))

    def nearest(self, vector: list[float], k: int, name: str = "vectors") -> DataFrame:
        """(key, score) of the k greatest inner products in a table of vectors."""
        stored = self.table(name)
        first = stored.select(F.size("embedding")).first()
        if first and first[0] != len(vector):
            raise ValueError(f"the query has {len(vector)} dimensions, the index {first[0]}")
        return retrieval.vector_top(stored, vector, k, self.key)

    def retrieve(self, query: str, k: int = 5) -> DataFrame:
        """A text question to its nearest texts: key, text, score; nothing for a blank question."""
        if not query.strip():
            return self.table("texts").select(self.key, "text", F.lit(0.0).alias("score")).limit(0)
        vector = self.spark.createDataFrame([(query,)], "q string").select(self.embedder(F.col("q"))).first()[0]
        return self.with_text(self.nearest(list(vector), k)).orderBy(F.col("score").desc(), self.key)

    def hybrid(self, query: str, k: int) -> DataFrame:
        """Keyword and vector hits of one text question, scaled and weighted."""
        vector = self.spark.createDataFrame([(query,)], "q string").select(self.embedder(F.col("q"))).first()[0]
        return retrieval.fuse_weighted(self.nearest(list(vector), 2 * k), self.keyword(query, 2 * k), k, self.key)

    # --- assets and graph ---

    def add_assets(self, assets: DataFrame) -> None:
        self._append(assets, "assets")

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replace the graph, and the edges with their distinct terms. Nothing is moved by term: most edges may hold the same few."""
        from tessera.operators.knowledge import edge_sentence

        nodes.write.mode("overwrite").parquet(f"{self.path}/nodes")
        edges.write.mode("overwrite").parquet(f"{self.path}/edges")
        said = self.table("edges").select("subject", "object", edge_sentence().alias("content"))
        said.withColumn("terms", T.terms(F.col("content"))).write.mode("overwrite").parquet(f"{self.path}/edge_terms")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self.table("nodes"), self.table("edges")


def carried_assets(docs: DataFrame, assets: DataFrame, order: str) -> DataFrame:
    """Assets (source, ordinal, asset) with the document they belong to: one each where a source has as many as documents, else the
    first document of the source has all."""
    numbered = docs.select("doc_id", "source", (F.row_number().over(T.in_order(["source"], order)) - 1).alias("at"))
    n_docs = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    n_assets = assets.groupBy("source").agg(F.count("*").alias("n_assets"))
    placed = assets.withColumn("at", F.row_number().over(T.in_order(["source"], "ordinal")) - 1).join(n_docs, "source").join(n_assets, "source")
    home = F.when(F.col("n_docs") == F.col("n_assets"), F.col("at")).otherwise(0)
    return placed.withColumn("at", home).join(numbered, ["source", "at"]).select("doc_id", "source", "ordinal", "asset")


_opened: dict[tuple[str, str], CorpusIndex] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> CorpusIndex:
    """The keyword index over ``documents`` of a folder, built when this session first asks for it and opened again afterwards."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _opened:
        from tessera.session import texts

        index = CorpusIndex(spark, f"{work_dir(spark)}/index-{spark.sparkContext.applicationId}-{len(_opened)}")
        index.reset()
        index.add(texts(spark, sf_dir))
        _opened[known] = CorpusIndex(spark, index.path)
    if _opened[known].spark is not spark:
        _opened[known] = CorpusIndex(spark, _opened[known].path)
    return _opened[known]


# --- registered queries -------------------------------------------------------------------

TEXT_QUESTION = "the thing that was late, and the delay of this"


def letter_embedder(text: Column) -> Column:
    """Shares of the letters a to z, unit length: an embedder that needs no model and that SQL can state."""
    low = F.lower(text)
    return T.unit(F.transform(F.array(*[F.lit(chr(97 + i)) for i in range(26)]), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double")))


def _fresh(spark: SparkSession, name: str, **options) -> CorpusIndex:
    index = CorpusIndex(spark, f"{work_dir(spark)}/{name}-{spark.sparkContext.applicationId}", **options)
    index.reset()
    return index


def _text_question(spark, d):
    """Write an index in two batches, open it again, ask it by text."""
    from tessera.session import table

    items = table(spark, d, "benchmark").select("item_id", "text")
    index = _fresh(spark, "benchmark", key="item_id", embedder=letter_embedder)
    for odd in (0, 1):
        part = items.where(F.col("item_id") % 2 == odd)
        index.add(part)
        index.embed(part)
    again = CorpusIndex(spark, index.path, "item_id", letter_embedder)
    return again.retrieve(TEXT_QUESTION, 5).select("item_id", F.round("score", 4).alias("score"))


def _restored_keyword(spark, d):
    from tessera.session import table

    items = table(spark, d, "benchmark").select("item_id", "text")
    index = _fresh(spark, "restored", key="item_id")
    for odd in (0, 1):
        index.add(items.where(F.col("item_id") % 2 == odd))
    return CorpusIndex(spark, index.path, "item_id").keyword(TEXT_QUESTION, 10).select("item_id", F.round("score", 6).alias("score"))


def _appended(spark, d):
    """All documents taken up in five appends, which merge in tiers; then the three best of each item of the benchmark, by words 3 to 6 of it."""
    from tessera.session import texts

    docs = texts(spark, d)
    index = _fresh(spark, "appended")
    for part in range(5):
        index.add(docs.where(F.col("doc_id") % 5 == part))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.array_join(F.slice(F.split("text", r"\s+"), 3, 4), " ").alias("query"))
    return CorpusIndex(spark, index.path).keyword_batch(items, 3).select("id", "doc_id", F.round("score", 6).alias("score"))


def visual_hits(index: CorpusIndex, modalities: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k nearest of the visual table; ``modalities`` (key, modality) says what is not text."""
    shown = index.table("visual").join(modalities.where(F.col("modality") != "text").select(index.key), index.key, "left_semi")
    return retrieval.vector_top(shown, vector, k, index.key)


def _visual(spark, d):
    from tessera.session import table

    v = table(spark, d, "embeddings")
    index = _fresh(spark, "visual", key="vec_id")
    index.add_vectors(v, name="visual")
    modalities = v.select("vec_id", F.when(F.col("vec_id") % 7 == 0, "image").otherwise("text").alias("modality"))
    return visual_hits(index, modalities, retrieval.vector_of(v, 7), 10).select("vec_id", F.round("score", 6).alias("score"))


def _carried(spark, d):
    """Nations as documents of their region. The assets of regions 0 to 2 are their nations, one each; those of regions 3 and 4 are
    suppliers, whose number differs, and all go to the first."""
    from tessera.session import table

    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_regionkey").cast("string").alias("source"))
    own = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_regionkey").cast("string").alias("source"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("asset"))
    many = table(spark, d, "supplier").select((F.col("s_suppkey") % 2 + 3).cast("string").alias("source"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("asset"))
    return carried_assets(docs, own.unionByName(many), "doc_id")


def _index_terms(spark, d):
    return documents_index(spark, d).term_statistics()


QUERIES = {"index_terms": _index_terms, "text_question_topk": _text_question, "restored_index_keyword": _restored_keyword, "appended_index_batch": _appended, "visual_topk": _visual, "carried_assets": _carried}

_LETTERS = lambda e: "list_transform(range(26), lambda i: (length(lower({0})) - length(replace(lower({0}), chr((97 + i)::INT), '')))::DOUBLE)".format(e)
_ALL = retrieval.query_tokens(TEXT_QUESTION)
ORACLES = {
    "index_terms": retrieval.ORACLES["bm25_terms"],
    "text_question_topk": f"WITH v AS (SELECT item_id, {_LETTERS('text')} AS x, {_LETTERS(chr(39) + TEXT_QUESTION + chr(39))} AS q FROM benchmark) SELECT item_id, round(list_dot_product(x, q) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(q, q)), 4) AS score FROM v ORDER BY list_dot_product(x, q) / sqrt(list_dot_product(x, x)) DESC, item_id LIMIT 5",
    "restored_index_keyword": f"""WITH toks AS (SELECT item_id, {T.bm25_tokens_sql('text')} AS t FROM benchmark), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS w FROM toks) GROUP BY w),
raw AS (SELECT w, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st),
idf AS (SELECT w, CASE WHEN idf < 0 THEN {retrieval.EPSILON}::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT unnest({T.strings_sql(_ALL)}) AS w)
SELECT item_id, round(sum(idf * tf * {retrieval.K1 + 1}::DOUBLE / (tf + {retrieval.K1}::DOUBLE * ({1 - retrieval.B}::DOUBLE + {retrieval.B}::DOUBLE * dl / avgdl))), 6) AS score
FROM (SELECT item_id, q.w, len(t) AS dl, len(list_filter(t, lambda x: x = q.w)) AS tf FROM toks, q) JOIN idf USING (w), st
GROUP BY item_id HAVING score > 0 ORDER BY round(sum(idf * tf * {retrieval.K1 + 1}::DOUBLE / (tf + {retrieval.K1}::DOUBLE * ({1 - retrieval.B}::DOUBLE + {retrieval.B}::DOUBLE * dl / avgdl))), 9) DESC, item_id LIMIT 10""",
    "visual_topk": "SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE v.vec_id % 7 = 0 ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 10",
    "carried_assets": "WITH d AS (SELECT n_nationkey AS doc_id, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) SELECT n_nationkey AS doc_id, n_regionkey::VARCHAR AS source, n_nationkey AS ordinal, n_name AS asset FROM nation WHERE n_regionkey < 3 UNION ALL SELECT doc_id, r::VARCHAR, s_suppkey, s_name FROM supplier JOIN d ON r = s_suppkey % 2 + 3 AND place = 1",
}

_SCORE = f"idf * tf * {retrieval.K1 + 1}::DOUBLE / (tf + {retrieval.K1}::DOUBLE * ({1 - retrieval.B}::DOUBLE + {retrieval.B}::DOUBLE * dl / avgdl))"
ORACLES["appended_index_batch"] = f"""WITH {retrieval._IDF},
posted AS (SELECT doc_id, len(t) AS dl, w, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS w FROM toks) GROUP BY ALL),
asked AS (SELECT id, w, count(*) AS times FROM (SELECT item_id AS id, unnest({T.bm25_tokens_sql("array_to_string(string_split_regex(text, chr(92) || 's+')[3:6], ' ')")}) AS w FROM benchmark) GROUP BY ALL),
s AS (SELECT id, doc_id, sum(times * {_SCORE}) AS score FROM asked JOIN posted USING (w) JOIN idf USING (w), st GROUP BY ALL HAVING score > 0)
SELECT id, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, doc_id) <= 3"""
