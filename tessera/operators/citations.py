"""Contexts, citation markers, lenient JSON and attribution of answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, retrieval
from tessera.session import table

SHOWN = 5


def numbered_context(chunks: Column) -> Column:
    """``[Source n] (source: x, type: y)`` blocks of array<struct<source,type,text>>."""
    block = lambda c, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] (source: "), F.coalesce(c["source"], F.lit("unknown")), F.lit(", type: "), F.coalesce(c["type"], F.lit("text")), F.lit(")\n"), F.coalesce(c["text"], F.lit("")))
    return F.array_join(F.transform(chunks, block), "\n\n")


def markers(answer: Column) -> Column:
    """Numbers in ``[1]`` and ``[2, 3]`` marks, first-seen order."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def cited(answer: Column, findings: Column) -> Column:
    """The findings an answer's marks point at, in their order; the first five without a usable mark."""
    good = F.filter(markers(answer), lambda i: (i >= 1) & (i <= F.size(findings)))
    return F.when(F.size(good) > 0, F.transform(good, lambda i: F.get(findings, i - 1))).otherwise(F.slice(findings, 1, SHOWN))


def lenient_json(text: Column, schema: str) -> Column:
    """A struct from JSON text, from a fenced block in it or from its outermost braces; null if none parses."""
    opts = {"mode": "PERMISSIVE"}
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*\n?(.*?)\n?```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.json_object_keys(x).isNotNull(), F.from_json(x, schema, opts))
    return F.coalesce(valid(F.trim(text)), valid(F.trim(fenced)), valid(braced))


def checked_answer(answer: Column, source_ids: Column, confidence: Column, texts: Column) -> Column:
    """struct(citation_verified, faithfulness_score, warning) of a generated answer over its source texts."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != ""))
    ok = F.coalesce(F.forall(source_ids, lambda i: (i >= 1) & (i <= F.size(texts))), F.lit(True))
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) == 0.0, 1.0).otherwise(confidence)
    said = F.concat_ws(" ", F.when(~ok, "One or more cited source IDs are out of range."), F.when(sure < 0.5, F.format_string("Low confidence score: %.2f.", sure)))
    own, other = words(answer), words(F.array_join(texts, " "))
    faithful = F.when(F.size(own) > 0, F.size(F.array_intersect(own, other)) / F.size(own)).otherwise(F.lit(0.0))
    return F.struct(ok.alias("citation_verified"), faithful.alias("faithfulness_score"), F.when(said != "", said).alias("warning"))


def retrieval_confidence(hits: DataFrame, score: str = "score") -> DataFrame:
    """0.6 * best + 0.4 * mean score, 0 .. 1; 0 without hits."""
    blend = 0.6 * F.max(score) + 0.4 * F.avg(score)
    return hits.agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)), F.lit(0.0)).alias("confidence"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, sources that are not blank, and languages: one aggregate."""
    return docs.agg(F.count("*").alias("documents"), F.count_distinct(F.when(F.trim("source") != "", F.col("source"))).alias("sources"), F.count_distinct("lang").alias("languages"))


# --- registered queries -------------------------------------------------------------------


def _marks(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("x [2, 9] y ["), (F.col("turn") % 4).cast("string"), F.lit("] [2] z")).alias("a"))
    f = F.array(*[F.lit(f"f{i}") for i in range(1, 4)])
    return c.select("conv_id", "turn", F.array_join(markers(F.col("a")).cast("array<string>"), ",").alias("marks"), F.array_join(cited(F.col("a"), f), ",").alias("cited"))


def _json(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n``` ok"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("well "), "props", F.lit(" yes"))).otherwise("none").alias("t"))
    return e.select("event_id", lenient_json(F.col("t"), "k int")["k"].alias("k"))


def _check(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    c = checked_answer(F.col("text"), F.array((F.col("item_id") % 3).cast("int")), F.when(F.col("item_id") % 2 == 0, 0.25).otherwise(0.9), F.array(F.substring("text", 1, 40), F.lit("other")))
    return b.select("item_id", c.alias("c")).select("item_id", "c.citation_verified", F.round("c.faithfulness_score", 6).alias("faithfulness_score"), "c.warning")


ANSWER = "this thing was late, and that delay"


def _attribution(spark, d):
    """Sources of a benchmark passage among the documents that a keyword search finds."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    hits = retrieval.bm25(docs, retrieval.QUESTION, 20)
    chunks = docs.join(F.broadcast(hits), "doc_id")  # 20 rows
    return evaluation.attribution(ANSWER, retrieval.QUESTION, chunks).select("doc_id", "source", F.length("excerpt").cast("long").alias("n"), "relevance")


def _confidence(spark, d):
    return retrieval_confidence(retrieval.vector_query(spark, d)).select(F.round("confidence", 6).alias("confidence"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus_stats(table(spark, d, "documents"))


def _helpers(spark, d):
    """File names, titles and lenient booleans of requests made of parts."""
    asked = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Show me the ").when(F.col("p_partkey") % 3 == 1, "which ").otherwise(""), "p_name", F.lit("s, by type & brand: "), "p_type", F.lit("?"))
    word = F.element_at(T.strings([" Yes", "not relevant", "1", "N"]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.slug(asked).alias("slug"), T.title(asked).alias("title"), T.truth(word).alias("truth"))


def _context(spark, d):
    """Every conversation's turns, in order, as numbered sources."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("source"), F.when(F.col("turn") % 2 == 0, "chat").alias("type"), "text"))).alias("c"))
    return turns.select("conv_id", F.sha2(numbered_context(F.col("c")), 256).alias("hash"))


def _hash(spark, d):
    c = table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    seen = c.where("doc_id % 2 = 0").select("hash").distinct()
    return c.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).join(seen, "hash", "left_anti")


QUERIES = {
    "text_helpers": _helpers,
    "numbered_context": _context,"citation_markers": _marks, "lenient_json": _json, "checked_answer": _check, "attribution": _attribution, "retrieval_confidence": _confidence, "corpus_stats": _stats, "embedding_cache_misses": _hash}

_W = lambda e: f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '\\s+'), lambda w: w <> ''))"
_ASKED = "CASE p_partkey % 3 WHEN 0 THEN 'Show me the ' WHEN 1 THEN 'which ' ELSE '' END || p_name || 's, by type & brand: ' || p_type || '?'"
ORACLES = {
    "text_helpers": f"WITH a AS (SELECT p_partkey, {_ASKED} AS q, CASE WHEN p_partkey % 3 = 0 THEN 'the ' ELSE '' END || p_name || 's, by type & brand: ' || p_type || '?' AS rest FROM part) SELECT p_partkey, substr(regexp_replace(replace(replace(replace(replace(lower(q), ',', ''), '&', ''), ':', ''), '?', ''), '[ _]+', '_', 'g'), 1, 50) AS slug, upper(rest[1]) || rest[2:] AS title, p_partkey % 2 = 0 AS truth FROM a",
    "numbered_context": "SELECT conv_id, sha256(string_agg('[Source ' || i || '] (source: ' || role || ', type: ' || CASE WHEN turn % 2 = 0 THEN 'chat' ELSE 'text' END || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY i)) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id",
    "citation_markers": "SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '2,9' ELSE '2,9,' || (turn % 4) END AS marks, CASE WHEN turn % 4 IN (1, 3) THEN 'f2,f' || (turn % 4) ELSE 'f2' END AS cited FROM conversations",
    "lenient_json": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract(props, '$.k')::INT END AS k FROM events",
    "checked_answer": f"WITH w AS (SELECT item_id, {_W('text')} AS a, {_W(chr(39) + chr(39) + ' || left(text, 40) || ' + chr(39) + ' other' + chr(39))} AS b FROM benchmark) SELECT item_id, item_id % 3 > 0 AS citation_verified, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0.0::DOUBLE END, 6) AS faithfulness_score, nullif(concat_ws(' ', CASE WHEN item_id % 3 = 0 THEN 'One or more cited source IDs are out of range.' END, CASE WHEN item_id % 2 = 0 THEN 'Low confidence score: 0.25.' END), '') AS warning FROM w",
    "retrieval_confidence": "WITH v AS (SELECT list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY s DESC, v.vec_id LIMIT 10) SELECT round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * max(s) + 0.4::DOUBLE * avg(s))), 6) AS confidence FROM v",
    "corpus_stats": "SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages FROM documents",
    "embedding_cache_misses": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING bool_and(doc_id % 2 <> 0)",
}

_KEY, _SENT = evaluation._KEY, evaluation._SENT
_SHOWN = 200
ORACLES["attribution"] = (
    f"WITH {retrieval._BM25}, c AS (SELECT doc_id, source, text, score, {_KEY(chr(39) + ANSWER + chr(39))} AS a, {_KEY(chr(39) + retrieval.QUESTION + chr(39))} AS w, {_KEY('text')} AS k, {_SENT('text')} AS s FROM bk JOIN documents USING (doc_id)), "
    f"r AS (SELECT *, 0.6::DOUBLE * {T.share_sql('a', 'k')} + 0.4::DOUBLE * least(CASE WHEN score <= 1 THEN score ELSE score / 10 END, 1.0::DOUBLE) AS rel, list_min(list_transform(s, lambda x, i: {{'o': -len(list_intersect({_KEY('x')}, w)), 'i': i, 's': x}})).s AS best FROM c) "
    f"SELECT doc_id, source, CASE WHEN length(text) <= {_SHOWN} THEN length(trim(text)) WHEN len(s) = 0 THEN length(trim(substr(text, 1, {_SHOWN}))) WHEN length(best) > {_SHOWN} THEN length(trim(substr(best, 1, {_SHOWN}))) + 3 ELSE length(best) END::BIGINT AS n, round(rel, 3) AS relevance FROM r WHERE rel >= {evaluation.MIN_RELEVANCE}"
)
