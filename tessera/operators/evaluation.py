"""Deterministic scores of answers, retrieval and routing, and their summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table

# What a category needs, thresholds and weights.
CATEGORY_SPECIALISTS = {
    "factual": ["document"],
    "summary": ["document"],
    "sql": ["analytics"],
    "reasoning": ["graph"],
    "comparison": ["graph"],
    "visual_reasoning": ["visual"],
    "ocr_extraction": ["visual"],
    "multimodal_document": ["document", "visual"],
    "edge": ["document"],
}
FLOOR, MAX_RETRIES = "document", 2
GRADE, SUPPORT, RELEVANT, MIN_RELEVANCE = 0.30, 0.30, 0.05, 0.1


def overlap_grade(pairs: DataFrame, question: str, document: str) -> DataFrame:
    """``pairs`` with overlap and relevant: the share of the question's terms in the document."""
    return pairs.withColumn("overlap", T.overlap_ratio(F.col(question), F.col(document))).withColumn("relevant", F.col("overlap") >= GRADE)


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's sentences with 30 % of their key terms in one context; trivial sentences count as supported."""
    held = F.transform(contexts, lambda c: T.key_terms(c))

    def supported(s: Column) -> Column:
        own = T.key_terms(s)
        return (F.size(own) == 0) | F.exists(held, lambda c: F.size(F.array_intersect(own, c)) >= SUPPORT * F.size(own))

    lines = T.sentences(answer)
    return F.when((F.size(lines) > 0) & (F.size(contexts) > 0), F.size(F.filter(lines, supported)) / F.size(lines)).otherwise(F.lit(0.0))


def coverage(query: Column, contexts: Column) -> Column:
    """Share of the query's key terms found in any context."""
    return T.share(T.key_terms(query), T.key_terms(F.array_join(contexts, " ")))


def source_relevance(answer: Column, text: Column, score: Column) -> Column:
    """0.6 * share of the answer's key terms + 0.4 * retriever score scaled to 0 .. 1."""
    scaled = F.when(score <= 1.0, F.least(score, F.lit(1.0))).otherwise(F.least(score / 10.0, F.lit(1.0)))
    return 0.6 * T.share(T.key_terms(answer), T.key_terms(text)) + 0.4 * scaled


def attribution(answer: str, query: str, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sources of an answer: (key, source, excerpt, relevance) at least MIN_RELEVANCE, best first."""
    rel = source_relevance(F.lit(answer), F.col("text"), F.col("score"))
    return chunks.where(F.coalesce(F.length("text"), F.lit(0)) > 0).select(key, "source", T.best_excerpt(F.col("text"), F.lit(query)).alias("excerpt"), F.round(rel, 3).alias("relevance"), rel.alias("_r")).where(F.col("_r") >= MIN_RELEVANCE).orderBy(F.col("_r").desc(), key).drop("_r")


def confidence(n_sources: Column, mean_relevance: Column, faithful: Column, covered: Column) -> Column:
    """Number of sources (five are enough), mean relevance, faithfulness and coverage, weighted, 0 .. 1."""
    parts = 0.20 * F.least(n_sources / 5.0, F.lit(1.0)) + 0.25 * mean_relevance + 0.30 * faithful + 0.25 * covered
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts))


def warnings(conf: Column, faithful: Column, covered: Column, n_sources: Column) -> Column:
    """Why a result is doubtful, or null."""
    said = F.concat_ws(
        "; ",
        F.when(conf < 0.3, "confidence is low: the sources hold little on this").when(conf < 0.5, "confidence is moderate: not every source is to the point"),
        F.when(faithful < 0.4, "some statements have no support in the sources"),
        F.when(covered < 0.4, "the sources do not cover what was asked"),
        F.when(n_sources == 0, "no source was relevant").when(n_sources == 1, "a single source: check it elsewhere"),
    )
    return F.when(said != "", said)


# --- answers against ground truth ---------------------------------------------------------


def retrieval_precision(chunks: Column, truth: Column) -> Column:
    good = F.filter(chunks, lambda c: T.keyword_jaccard(c, truth) >= RELEVANT)
    return F.when(F.size(chunks) > 0, F.size(good) / F.size(chunks)).otherwise(F.lit(0.0))


def retrieval_recall(chunks: Column, truth: Column) -> Column:
    items = lambda t: F.array_union(T.scoring_tokens(t), T.spans_and_numbers(t))
    return T.share(F.array_distinct(items(truth)), F.array_distinct(F.flatten(F.transform(chunks, items))))


def answer_relevance(query: Column, answer: Column) -> Column:
    return F.least(F.lit(1.0), 2.5 * T.keyword_jaccard(query, answer))


def claim_faithfulness(answer: Column, context: Column) -> Column:
    scores = F.transform(T.claims(answer), lambda c: T.claim_support(c, context))
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(F.lit(0.0))


def keyword_hit(answer: Column, expected: Column) -> Column:
    low = F.lower(answer)
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda k: F.contains(low, F.lower(k)))) / F.size(expected))


# --- scores of a run ----------------------------------------------------------------------


def run_scores() -> dict[str, Column]:
    """Score columns over runs: answer, findings array<struct<content,source,modality>>, citations array<string>,
    specialists, expected_specialists, expected_answer_contains arrays, expected_modality, retry_count. Null where nothing is expected.
    """
    corpus = F.array_join(F.transform("findings", lambda f: f["content"]), "\n")
    sources = F.transform("findings", lambda f: f["source"])
    expected, actual = F.col("expected_specialists"), F.array_distinct("specialists")
    judged = F.array_except(actual, F.array(F.lit(FLOOR)))
    kinds = F.transform("findings", lambda f: F.coalesce(f["modality"], F.lit("text")))
    answer_terms = T.terms(F.col("answer"))
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return {
        "faithfulness": F.when((F.length(corpus) > 0) & (F.length("answer") > 0), T.overlap_ratio(F.col("answer"), corpus)).otherwise(F.lit(0.0)),
        "citation_accuracy": F.when(some(F.col("citations")), F.size(F.filter("citations", lambda c: F.array_contains(sources, c))) / F.size("citations")),
        "routing_accuracy": F.when(some(expected), F.size(F.array_intersect(expected, actual)) / F.size(F.array_distinct(expected))),
        "routing_precision": F.when(some(expected) & (F.size(judged) > 0), F.size(F.array_intersect(judged, expected)) / F.size(judged)),
        "modality_match": F.when(F.col("expected_modality").isNotNull(), F.when(F.col("expected_modality") == "text", F.array_contains(kinds, "text")).otherwise(F.exists(kinds, lambda k: k != "text")).cast("double")),
        "answer_correctness": F.when(some(F.col("expected_answer_contains")), F.size(F.filter("expected_answer_contains", lambda k: F.size(F.array_except(T.terms(k), answer_terms)) == 0)) / F.size("expected_answer_contains")),
        "retry_efficiency": F.greatest(F.lit(0.0), 1.0 - F.col("retry_count") / F.lit(float(MAX_RETRIES + 1))),
    }


def score_runs(runs: DataFrame) -> DataFrame:
    return runs.select("*", *[F.round(c, 3).alias(name) for name, c in run_scores().items()])


#: The middle of a group lies within so small a share of its values around the approximate one, twice over.
NEAR = 10_000


def medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): exact medians of the non-null values, with no group's values in one place.

    Quantile sketches give each group a narrow bracket around its middle. What lies below is counted, and only values inside, a few in ``NEAR``, are
    ranked. Equal values are one row with a count, so a bracket of few different values is small whatever the group. NaN is the greatest value.
    """
    v = F.col(value).cast("double")
    keyed = rows.where(v.isNotNull()).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], v.alias("v"))
    keys = [f"k{i}" for i in range(len(by))]
    share = [0.5 - 2 / NEAR, 0.5 + 2 / NEAR]
    bracket = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", share, F.lit(NEAR)).alias("q"))
    ranges = bracket.select(*[F.col(k).alias(f"b{k}") for k in keys], "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    counted = keyed.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"b{k}"))
    # Values below a bracket become one row a group and task, before anything moves.
    placed = counted.join(F.broadcast(ranges) if not keys else ranges, same).where(F.col("v") <= F.col("hi"))
    low = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    few = placed.groupBy(*keys, low.alias("v"), "n").agg(F.sum("c").alias("c"))
    order = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = few.withColumn("upto", F.sum("c").over(order)).where(F.col("v").isNotNull())
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    first, second = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return ranked.groupBy(*keys).agg(((first + second) / 2).alias("median")).select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "median")


def metric_summary(scores: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, median, min, max and population deviation of the non-null values."""
    r = lambda c: F.round(c, 4)
    rest = scores.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), r(F.avg(value)).alias("mean"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"), r(F.stddev_pop(value)).alias("std"))
    middle = medians(scores, value, by).select(*[F.col(c).alias(f"_{c}") for c in by], r(F.col("median")).alias("median"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rest.join(middle, same).select(*by, "n", "mean", "median", "min", "max", "std")


def experiment_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean): the mean of each metric over the runs that have it; a metric that no run has is left out."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"))


def evaluated(examples: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of a pipeline: ``run`` adds answer and contexts (array) to the examples (query, truth, expected array)."""
    got = run(examples)
    context = F.array_join("contexts", "\n")
    return got.select(
        "*",
        retrieval_precision(F.col("contexts"), F.col("truth")).alias("retrieval_precision"), retrieval_recall(F.col("contexts"), F.col("truth")).alias("retrieval_recall"),
        answer_relevance(F.col("query"), F.col("answer")).alias("answer_relevance"), claim_faithfulness(F.col("answer"), context).alias("faithfulness"), keyword_hit(F.col("answer"), F.col("expected")).alias("keyword_hit"),
    )


def attributed_result(answer: str, query: str, chunks: DataFrame) -> DataFrame:
    """One row about an answer: number of sources, faithfulness, coverage, confidence and warnings over all its chunks."""
    sources = attribution(answer, query, chunks).agg(F.count("*").alias("n_sources"), F.coalesce(F.avg("relevance"), F.lit(0.0)).alias("mean_relevance"))
    # The chunks of one answer are a handful.
    contexts = chunks.where(F.coalesce(F.length("text"), F.lit(0)) > 0).agg(F.collect_list("text").alias("c"))
    both = contexts.crossJoin(F.broadcast(sources)).select("n_sources", "mean_relevance", faithfulness(F.lit(answer), F.col("c")).alias("faithfulness"), coverage(F.lit(query), F.col("c")).alias("coverage"))
    scored = both.withColumn("confidence", confidence(F.col("n_sources"), F.col("mean_relevance"), F.col("faithfulness"), F.col("coverage")))
    return scored.withColumn("warnings", warnings(F.col("confidence"), F.col("faithfulness"), F.col("coverage"), F.col("n_sources")))


def report(spark: SparkSession, scores: DataFrame, path: str) -> None:
    """One JSON file of the summary, a few rows."""
    scores.coalesce(1).write.mode("overwrite").json(path)


# --- registered queries -------------------------------------------------------------------


def _pairs(spark, d):
    """Benchmark passages with documents of the same number: a bounded stand-in for retrieved passages."""
    b, t = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text")
    return b.select("item_id", F.col("text").alias("question")).join(t, F.col("item_id") == F.col("doc_id"))


def _grade_query(spark, d):
    return overlap_grade(_pairs(spark, d), "question", "text").select("item_id", F.round("overlap", 6).alias("overlap"), "relevant")


def _faith_query(spark, d):
    # Two passages found for an answer: the question's own and the whole text of the document after it.
    after = table(spark, d, "documents").select((F.col("doc_id") - 1).alias("before"), F.col("text").alias("after"))
    pairs, c = _pairs(spark, d).join(after, F.col("item_id") == F.col("before")), F.array("question", "after")
    return pairs.select("item_id", F.round(faithfulness(F.col("text"), c), 6).alias("faithfulness"), F.round(coverage(F.col("question"), F.array(F.col("text"))), 6).alias("coverage"))


def _jaccard_query(spark, d):
    return _pairs(spark, d).select("item_id", F.round(T.keyword_jaccard(F.col("question"), F.col("text")), 6).alias("jaccard"), F.round(answer_relevance(F.col("question"), F.col("text")), 6).alias("relevance"), F.round(claim_faithfulness(F.col("question"), F.col("text")), 6).alias("claims"))


def _recall_query(spark, d):
    c = F.array(F.col("text"), F.lit("Order 12 of 2023 from Apex, 5%."))
    return _pairs(spark, d).select("item_id", F.round(retrieval_precision(c, F.col("question")), 6).alias("precision"), F.round(retrieval_recall(c, F.col("question")), 6).alias("recall"))


def _summary_query(spark, d):
    return metric_summary(table(spark, d, "events"), "value", ["event_type"])


def _runs(spark, d):
    c = table(spark, d, "conversations")
    kinds = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("document"), F.lit("graph"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("document"))).otherwise(F.array(F.lit("document"), F.lit("analytics")))
    finding = lambda content, source, kind: F.struct(F.coalesce(content, F.lit("")).alias("content"), F.lit(source).alias("source"), F.coalesce(kind, F.lit("text")).alias("modality"))
    return c.select(
        "conv_id", "turn", F.col("text").alias("answer"),
        F.array(finding(F.col("text"), "s1", F.lit("text")), finding(F.lit("the chart"), "s2", F.when(F.col("conv_id") % 2 == 0, "image").otherwise("text"))).alias("findings"),
        F.when(F.col("conv_id") % 4 > 0, F.array(F.lit("s1"), F.lit("s9"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        kinds.alias("specialists"), F.array(F.lit("graph")).alias("expected_specialists"), F.lit("visual").alias("expected_modality"),
        F.array(F.lit("orders"), F.lit("zzz")).alias("expected_answer_contains"), (F.col("conv_id") % 3).alias("retry_count"),
    )


def _runs_query(spark, d):
    return score_runs(_runs(spark, d)).select("conv_id", "turn", *run_scores())


def _experiment_query(spark, d):
    return experiment_means(score_runs(_runs(spark, d)), list(run_scores()))


def _case_summary(spark, d):
    return metric_summary(score_runs(_runs(spark, d)).withColumn("third", F.col("conv_id") % 3), "routing_accuracy", ["third"])


def _hit_query(spark, d):
    hit = keyword_hit(F.col("text"), F.array(F.lit("THE"), F.lit("de"), F.lit("zebra"), F.lit("."))).alias("hit")
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(hit, 6).alias("hit"))


def _confidence_query(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.abs(F.element_at("embedding", i).cast("double")).alias(c) for i, c in ((1, "m"), (2, "f"), (3, "c"))], (F.col("vec_id") % 7).alias("n"))
    conf = confidence(F.col("n"), F.col("m"), F.col("f"), F.col("c"))
    rows = e.withColumn("confidence", F.round(conf, 6))
    return rows.select("vec_id", "confidence", (F.size(F.split(warnings(F.col("confidence"), F.col("f"), F.col("c"), F.col("n")), "; "))).cast("long").alias("n_warnings"))


QUERIES = {"experiment_means": _experiment_query, "case_score_summary": _case_summary, "keyword_hit": _hit_query, "answer_confidence": _confidence_query, "overlap_grade": _grade_query, "faithfulness_coverage": _faith_query, "jaccard_relevance": _jaccard_query, "retrieval_recall": _recall_query, "metric_summary": _summary_query, "score_runs": _runs_query}

_P = "p AS (SELECT item_id, b.text AS question, d.text FROM benchmark b JOIN documents d ON item_id = doc_id)"
_TERMS = lambda e: T.terms_sql(e)
_TOKS = lambda e: f"list_distinct({T.scoring_tokens_sql(e)})"
_KEY = lambda e: f"list_distinct(list_filter(regexp_extract_all(lower({e}), '\\b[a-zA-Z]{{2,}}\\b'), lambda t: NOT list_contains({T.strings_sql(T.ATTRIBUTION_STOP_WORDS)}, t)))"
_SENT = lambda e: f"list_filter(list_transform(string_split(regexp_replace(trim({e}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_ITEMS = lambda e: f"list_distinct(list_concat(list_concat({T.scoring_tokens_sql(e)}, list_transform(regexp_extract_all({e}, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*'), lambda x: lower(x))), regexp_extract_all({e}, '\\d+(?:\\.\\d+)?%?')))"
_EXTRA = "'Order 12 of 2023 from Apex, 5%.'"
ORACLES = {
    "overlap_grade": f"WITH {_P}, t AS (SELECT item_id, {_TERMS('question')} AS a, {_TERMS('text')} AS b FROM p), o AS (SELECT item_id, {T.share_sql('a', 'b')} AS o FROM t) SELECT item_id, round(o, 6) AS overlap, o >= {GRADE} AS relevant FROM o",
    "jaccard_relevance": f"WITH {_P}, t AS (SELECT item_id, {_TOKS('question')} AS a, {_TOKS('text')} AS b, list_filter({_SENT('question')}, lambda s: len(regexp_split_to_array(s, '\\s+')) >= 3) AS s FROM p), j AS (SELECT item_id, {T.jaccard_sql('a', 'b')} AS j, b, s FROM t), u AS (SELECT item_id, list_avg(list_transform(list_transform(s, lambda x: {_TOKS('x')}), lambda y: least(1.0::DOUBLE, 3.0::DOUBLE * {T.jaccard_sql('y', 'b')}))) AS c FROM j) SELECT j.item_id, round(j, 6) AS jaccard, round(least(1.0::DOUBLE, 2.5::DOUBLE * j), 6) AS relevance, round(coalesce(c, 0.0::DOUBLE), 6) AS claims FROM j JOIN u USING (item_id)",
    "retrieval_recall": f"WITH {_P}, t AS (SELECT item_id, {_TOKS('question')} AS q, {_TOKS('text')} AS a, {_TOKS(_EXTRA)} AS b, {_ITEMS('question')} AS iq, list_distinct(list_concat({_ITEMS('text')}, {_ITEMS(_EXTRA)})) AS ic FROM p) SELECT item_id, round((({T.jaccard_sql('a', 'q')} >= {RELEVANT})::INT + ({T.jaccard_sql('b', 'q')} >= {RELEVANT})::INT)::DOUBLE / 2, 6) AS precision, round({T.share_sql('iq', 'ic')}, 6) AS recall FROM t",
    "faithfulness_coverage": f"WITH {_P}, t AS (SELECT item_id, list_transform({_SENT('text')}, lambda s: {_KEY('s')}) AS s, {_KEY('question')} AS a, {_KEY('after')} AS b, {_KEY('text')} AS c FROM (SELECT p.*, n.text AS after FROM p JOIN documents n ON n.doc_id = item_id + 1)) SELECT item_id, round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: len(x) = 0 OR len(list_intersect(x, a)) >= {SUPPORT}::DOUBLE * len(x) OR len(list_intersect(x, b)) >= {SUPPORT}::DOUBLE * len(x)))::DOUBLE / len(s) ELSE 0.0::DOUBLE END, 6) AS faithfulness, round({T.share_sql('a', 'c')}, 6) AS coverage FROM t",
    "metric_summary": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS min, round(max(value), 4) AS max, round(stddev_pop(value), 4) AS std FROM events WHERE value IS NOT NULL GROUP BY 1",
    "score_runs": f"WITH r AS (SELECT conv_id, turn, text, {_TERMS('text')} AS t, {_TERMS(chr(39) + 'the chart' + chr(39))} AS x FROM conversations) SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN round({T.share_sql('t', 'list_distinct(list_concat(t, x))')}, 3) ELSE 0.0::DOUBLE END AS faithfulness, CASE WHEN conv_id % 4 > 0 THEN 0.5::DOUBLE END AS citation_accuracy, CASE WHEN conv_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS routing_accuracy, CASE conv_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS routing_precision, CASE WHEN conv_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS modality_match, round(((list_contains(t, 'order'))::INT + list_contains(t, 'zzz')::INT)::DOUBLE / 2, 3) AS answer_correctness, round(1.0::DOUBLE - (conv_id % 3)::DOUBLE / 3, 3) AS retry_efficiency FROM r",
}

_METRICS = ("faithfulness", "citation_accuracy", "routing_accuracy", "routing_precision", "modality_match", "answer_correctness", "retry_efficiency")
ORACLES["experiment_means"] = "SELECT metric, count(*) AS n, round(avg(value), 3) AS mean FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM ({ORACLES['score_runs']})" for m in _METRICS) + ") WHERE value IS NOT NULL GROUP BY metric"
ORACLES["case_score_summary"] = f"SELECT conv_id % 3 AS third, count(*) AS n, round(avg(routing_accuracy), 4) AS mean, round(median(routing_accuracy), 4) AS median, round(min(routing_accuracy), 4) AS min, round(max(routing_accuracy), 4) AS max, round(stddev_pop(routing_accuracy), 4) AS std FROM ({ORACLES['score_runs']}) WHERE routing_accuracy IS NOT NULL GROUP BY 1"
ORACLES["keyword_hit"] = "SELECT conv_id, turn, round((contains(lower(text), 'the')::INT + contains(lower(text), 'de')::INT + contains(lower(text), 'zebra')::INT + contains(lower(text), '.')::INT) / 4.0, 6)::DOUBLE AS hit FROM conversations"
ORACLES["answer_confidence"] = "WITH e AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS m, abs(embedding[2]::DOUBLE) AS f, abs(embedding[3]::DOUBLE) AS c, vec_id % 7 AS n FROM embeddings), s AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.20::DOUBLE * least(n / 5.0::DOUBLE, 1.0::DOUBLE) + 0.25::DOUBLE * m + 0.30::DOUBLE * f + 0.25::DOUBLE * c)), 6) AS confidence FROM e) SELECT vec_id, confidence, nullif((confidence < 0.5)::INT + (f < 0.4)::INT + (c < 0.4)::INT + (n <= 1)::INT, 0)::BIGINT AS n_warnings FROM s"
