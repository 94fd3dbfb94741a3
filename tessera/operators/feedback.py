"""Feedback and retrieval logs: statistics, relevance, keywords and weight adjustment."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table

#: Fixed values of the weight rule.
BASE, TARGET, RATE, LOWEST, HIGHEST = 0.6, 0.7, 0.2, 0.1, 0.9

FEEDBACK_SCHEMA = "id long, timestamp timestamp, query string, retrieved_chunk_ids string, answer string, user_rating int, user_comment string, query_category string"
LOG_SCHEMA = "id long, timestamp timestamp, query string, chunk_id string, rank int, score double, was_relevant boolean"


def check_rating(rating: int) -> int:
    if not isinstance(rating, int) or not 1 <= rating <= 5:
        raise ValueError("user_rating is an integer from 1 to 5")
    return rating


def append_feedback(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Validated append of feedback rows (FEEDBACK_SCHEMA) to a Parquet table."""
    for r in rows:
        check_rating(r[5])
    spark.createDataFrame(rows, FEEDBACK_SCHEMA).write.mode("append").parquet(path)


def append_retrievals(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LOG_SCHEMA).write.mode("append").parquet(path)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """count, mean rating and a column for each rating, in one aggregate."""
    return feedback.agg(F.count("*").alias("total"), F.round(F.avg("user_rating"), 4).alias("avg_rating"), *[F.sum(F.when(F.col("user_rating") == r, 1).otherwise(0)).cast("long").alias(f"rating_{r}") for r in range(1, 6)])


def category_stats(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("query_category").agg(F.count("*").alias("n"), F.round(F.avg("user_rating"), 4).alias("avg_rating"))


def low_categories(feedback: DataFrame, most: float = 3.0) -> DataFrame:
    return category_stats(feedback).where(F.col("avg_rating") <= most).orderBy("avg_rating", "query_category")


def low_rated(feedback: DataFrame, most: int = 2) -> DataFrame:
    return feedback.where(F.col("user_rating") <= most).orderBy(F.col("user_rating"), F.col("timestamp").desc(), "id")


def retrieval_precision(logs: DataFrame) -> DataFrame:
    """judged rows, relevant ones and their share; unjudged rows are left out."""
    judged = logs.where(F.col("was_relevant").isNotNull())
    return judged.agg(F.count("*").alias("judged"), F.sum(F.col("was_relevant").cast("long")).alias("relevant")).withColumn("precision", F.round(F.col("relevant") / F.col("judged"), 6))


def training_triples(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """query, positive and negative chunk ids (sorted) and the mean rating: one join, not a lookup per query."""
    side = lambda v: F.array_sort(F.collect_list(F.when(F.col("was_relevant") == v, F.col("chunk_id"))))
    judged = logs.where(F.col("was_relevant").isNotNull()).groupBy("query").agg(side(True).alias("positives"), side(False).alias("negatives"))
    rated = feedback.groupBy("query").agg(F.round(F.avg("user_rating"), 4).alias("avg_rating"))
    return judged.join(rated, "query", "left")


def relevance_rates(logs: DataFrame, least: int = 2) -> DataFrame:
    by = logs.where(F.col("was_relevant").isNotNull()).groupBy("chunk_id").agg(F.sum(F.col("was_relevant").cast("long")).alias("relevant"), F.count("*").alias("total"))
    return by.where(F.col("total") >= least).withColumn("rate", F.round(F.col("relevant") / F.col("total"), 6))


def worst_chunks(logs: DataFrame, k: int = 10) -> DataFrame:
    return relevance_rates(logs).orderBy("rate", "chunk_id").limit(k)


def daily_trend(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.date_format(F.to_date("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("user_rating"), 4).alias("avg_rating"))


def failure_keywords(comments: DataFrame, text: str = "user_comment", k: int = 20) -> DataFrame:
    """The most frequent scoring words of over two letters."""
    words = comments.select(F.explode(F.filter(T.scoring_tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.length(w) > 2)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(k)


def adjusted_weights(logs: DataFrame) -> DataFrame:
    """vector and keyword weights from the relevance rate; defaults with no confidence where nothing is judged."""
    s = logs.where(F.col("was_relevant").isNotNull()).agg(F.count("*").alias("judged"), F.sum(F.col("was_relevant").cast("long")).alias("relevant"))
    vec = F.when(F.col("judged") == 0, F.lit(BASE)).otherwise(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), BASE + RATE * (F.col("relevant") / F.col("judged") - TARGET))))
    return s.select("judged", F.round(vec, 4).alias("vector_weight"), F.round(1 - vec, 4).alias("bm25_weight"), F.round(F.least(F.col("judged") / 100, F.lit(1.0)), 4).alias("confidence"))


def suggestions(feedback: DataFrame, logs: DataFrame) -> DataFrame:
    """One row for each rule that holds: rule, value, advice."""
    stats = feedback.agg(F.avg("user_rating").alias("rating"), F.avg((F.col("user_rating") <= 2).cast("double")).alias("low"))
    rate = logs.where(F.col("was_relevant").isNotNull()).agg(F.avg(F.col("was_relevant").cast("double")).alias("precision"))
    rule = lambda name, value, holds, advice: F.struct(F.lit(name).alias("rule"), value.alias("value"), holds.alias("holds"), F.lit(advice).alias("advice"))
    rules = F.array(
        rule("low_rating", F.col("rating"), F.col("rating") < 3.0, "review answers of the lowest categories"),
        rule("many_low", F.col("low"), F.col("low") > 0.3, "inspect frequent words of low-rated comments"),
        rule("low_precision", F.col("precision"), F.col("precision") < 0.5, "raise the keyword weight or rerank"),
        rule("no_judgements", F.lit(0.0), F.col("precision").isNull(), "collect relevance judgements"),
    )
    # Both sides are single aggregate rows.
    return stats.crossJoin(F.broadcast(rate)).select(F.explode(rules).alias("r")).where("r.holds").select("r.rule", F.round("r.value", 4).alias("value"), "r.advice")


def analysis(feedback: DataFrame, logs: DataFrame, comments: DataFrame, text: str = "user_comment", most: float = 3.0, low: int = 2) -> DataFrame:
    """(insight, name, value): what the feedback says, all in one table: figures, weak categories, frequent words of complaints,
    relevance of chunks, the worst of them, and the trend by day."""
    row = lambda insight, df, name, value: df.select(F.lit(insight).alias("insight"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    stats = feedback_stats(feedback)
    parts = [
        row("overall", stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in stats.columns])).alias("x")).select("x.*"), "k", "v"),
        row("low_category", category_stats(feedback).where(F.col("avg_rating") <= most), "query_category", "avg_rating"),
        row("failure_keyword", failure_keywords(comments, text), "word", "n"),
        row("chunk_rate", relevance_rates(logs), "chunk_id", "rate"),
        row("worst_chunk", worst_chunks(logs), "chunk_id", "rate"),
        row("daily_rating", daily_trend(feedback), "day", "avg_rating"),
        row("low_rated", feedback.where(F.col("user_rating") <= low).agg(F.count("*").alias("n")).withColumn("k", F.lit("queries")), "k", "n"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def learning_cycle(feedback: DataFrame, logs: DataFrame, comments: DataFrame) -> dict[str, DataFrame]:
    """One turn of the loop: what was found, the new weights, the advice, and triples to train on."""
    return {"insights": analysis(feedback, logs, comments), "weights": adjusted_weights(logs), "suggestions": suggestions(feedback, logs), "training": training_triples(logs, feedback)}


def sliding_requests(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Requests of a key in the last ``seconds`` up to and with each row. Times are rounded to the nearest second, halves to the even one."""
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-seconds, 0)
    at = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")
    return events.withColumn("_s", at).withColumn("in_window", F.count("*").over(w)).drop("_s")


def daily_budget(events: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """Requests a day and key and how many a budget would refuse."""
    day = F.date_format(F.col(ts), "yyyy-MM-dd").alias("day")
    return events.groupBy(key, day).agg(F.count("*").alias("used")).withColumn("refused", F.greatest(F.col("used") - most, F.lit(0)).cast("long"))


def changes(frames: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """Rows whose value differs from the one before by at least ``least``; the first of a key counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return frames.where(F.col(value).isNotNull()).withColumn("_d", F.abs(F.col(value) - before)).where(F.col("_d").isNull() | (F.col("_d") >= least)).drop("_d")


def keyframes(frames: DataFrame, key: str = "video", frame: str = "frame", hists: str = "hists", most: int = 50, least: float = 30.0) -> DataFrame:
    """(key, frame, position, distance): the scene cuts of every video, its first sampled frame among them.

    ``hists`` holds one histogram a channel. Of a video's frames every total / (4 * most)-th is looked at, and a cut is a mean Bhattacharyya
    distance, times 100, of at least ``least`` from the sampled frame before. The first ``most`` cuts of a video are its keyframes. Frames
    are numbered from 0; a frame without histograms is not sampled, a histogram without mass is at distance 1 from any.
    """
    total = Window.partitionBy(key)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(total) / (4 * most)))
    sampled = frames.select(key, frame, hists, step.alias("_step")).where(F.col(hists).isNotNull() & (F.col(frame) % F.col("_step") == 0))
    whole = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    alike = lambda a, b: F.try_divide(whole(F.zip_with(a, b, lambda x, y: F.sqrt(x * y))), F.sqrt(whole(a) * whole(b)))
    apart = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(alike(a, b), F.lit(0.0))))
    run = Window.partitionBy(key).orderBy(frame)
    before = sampled.withColumn("_before", F.lag(hists).over(run))
    each = F.zip_with(F.col(hists), F.col("_before"), apart)
    cuts = before.withColumn("distance", 100 * whole(each) / F.size(hists)).where(F.col("_before").isNull() | (F.col("distance") >= least))
    return cuts.select(key, frame, (F.row_number().over(run) - 1).alias("position"), "distance").where(F.col("position") < most)


# --- registered queries -------------------------------------------------------------------


def _feedback(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.concat(F.lit("q"), (F.col("event_id") % 400).cast("string")).alias("query"), (F.floor(F.col("value")) % 5 + 1).cast("int").alias("user_rating"), F.col("event_type").alias("query_category"))


def _logs(spark, d):
    v = table(spark, d, "labels")
    return v.select(F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("query"), F.concat(F.lit("c"), (F.col("doc_id") % 30).cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 9 != 0, F.col("quality") == 1).alias("was_relevant"))


def _triples_query(spark, d):
    out = training_triples(_logs(spark, d), _feedback(spark, d))
    return out.select("query", F.array_join("positives", ",").alias("positives"), F.array_join("negatives", ",").alias("negatives"), "avg_rating")


def _low_query(spark, d):
    return low_rated(_feedback(spark, d), 1).select("id", "user_rating", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _users(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts")


def _scene_query(spark, d):
    return changes(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", 30.0)


def _keyframe_query(spark, d):
    """Vectors as frames of eight videos, their components as the histograms of two channels."""
    e = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    half = lambda at: F.transform(F.slice("embedding", at, 8), lambda x: F.abs(x.cast("double")))
    frames = e.select((F.col("vec_id") % 8).alias("video"), F.floor(F.col("vec_id") / 8).alias("frame"), F.array(half(1), half(9)).alias("hists"))
    return keyframes(frames).select("video", "frame", F.col("position").cast("long").alias("position"), F.round("distance", 4).alias("distance"))


QUERIES = {
    "video_keyframes": _keyframe_query,
    "feedback_analysis": lambda s, d: analysis(_feedback(s, d), _logs(s, d), table(s, d, "conversations"), "text"),
    "feedback_stats": lambda s, d: feedback_stats(_feedback(s, d)),
    "feedback_categories": lambda s, d: category_stats(_feedback(s, d)),
    "low_rated_categories": lambda s, d: low_categories(_feedback(s, d)),
    "low_rated": _low_query,
    "retrieval_precision": lambda s, d: retrieval_precision(_logs(s, d)),
    "training_triples": _triples_query,
    "relevance_rates": lambda s, d: relevance_rates(_logs(s, d)),
    "worst_chunks": lambda s, d: worst_chunks(_logs(s, d)),
    "daily_trend": lambda s, d: daily_trend(_feedback(s, d)),
    "keyword_top20": lambda s, d: failure_keywords(table(s, d, "conversations"), "text"),
    "adjust_weights": lambda s, d: adjusted_weights(_logs(s, d)),
    "suggest_improvements": lambda s, d: suggestions(_feedback(s, d), _logs(s, d)),
    "rate_window_60s": lambda s, d: sliding_requests(_users(s, d), "user_id", "ts", 60).select("event_id", "in_window"),
    "daily_budget": lambda s, d: daily_budget(_users(s, d), "user_id", "ts", 2),
    "scene_change": _scene_query,
}

_F = "(SELECT event_id AS id, ts AS timestamp, 'q' || (event_id % 400) AS query, (floor(value)::BIGINT % 5 + 1)::INT AS user_rating, event_type AS query_category FROM events)"
_L = "(SELECT 'q' || (doc_id % 50) AS query, 'c' || (doc_id % 30) AS chunk_id, CASE WHEN doc_id % 9 <> 0 THEN quality = 1 END AS was_relevant FROM labels)"
_RATES = f"SELECT chunk_id, sum(was_relevant::INT)::BIGINT AS relevant, count(*) AS total, round(sum(was_relevant::INT)::DOUBLE / count(*), 6) AS rate FROM {_L} WHERE was_relevant IS NOT NULL GROUP BY chunk_id HAVING count(*) >= 2"
_SIDE = "coalesce(array_to_string(list(chunk_id ORDER BY chunk_id) FILTER (WHERE {}), ','), '')"
ORACLES = {
    "feedback_stats": f"SELECT count(*) AS total, round(avg(user_rating), 4) AS avg_rating, {', '.join(f'sum((user_rating = {r})::INT)::BIGINT AS rating_{r}' for r in range(1, 6))} FROM {_F}",
    "feedback_categories": f"SELECT query_category, count(*) AS n, round(avg(user_rating), 4) AS avg_rating FROM {_F} GROUP BY 1",
    "low_rated_categories": f"SELECT query_category, count(*) AS n, round(avg(user_rating), 4) AS avg_rating FROM {_F} GROUP BY 1 HAVING round(avg(user_rating), 4) <= 3.0",
    "low_rated": f"SELECT id, user_rating, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM {_F} WHERE user_rating <= 1",
    "retrieval_precision": f"SELECT count(*) AS judged, sum(was_relevant::INT)::BIGINT AS relevant, round(sum(was_relevant::INT)::DOUBLE / count(*), 6) AS precision FROM {_L} WHERE was_relevant IS NOT NULL",
    "training_triples": f"SELECT query, {_SIDE.format('was_relevant')} AS positives, {_SIDE.format('NOT was_relevant')} AS negatives, any_value(avg_rating) AS avg_rating FROM {_L} l LEFT JOIN (SELECT query, round(avg(user_rating), 4) AS avg_rating FROM {_F} GROUP BY query) f USING (query) WHERE was_relevant IS NOT NULL GROUP BY query",
    "relevance_rates": _RATES,
    "worst_chunks": f"{_RATES} ORDER BY rate, chunk_id LIMIT 10",
    "daily_trend": f"SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n, round(avg(user_rating), 4) AS avg_rating FROM {_F} GROUP BY 1",
    "keyword_top20": f"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter({T.scoring_tokens_sql('text')}, lambda w: length(w) > 2)) AS word FROM conversations) GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "adjust_weights": f"WITH s AS (SELECT count(*) AS judged, sum(was_relevant::INT) AS r FROM {_L} WHERE was_relevant IS NOT NULL), v AS (SELECT judged, greatest({LOWEST}::DOUBLE, least({HIGHEST}::DOUBLE, {BASE}::DOUBLE + {RATE}::DOUBLE * (r::DOUBLE / judged - {TARGET}::DOUBLE))) AS v FROM s) SELECT judged, round(v, 4) AS vector_weight, round(1 - v, 4) AS bm25_weight, round(least(judged / 100, 1.0::DOUBLE), 4) AS confidence FROM v",
    "suggest_improvements": f"WITH s AS (SELECT avg(user_rating) AS rating, avg((user_rating <= 2)::INT) AS low FROM {_F}), p AS (SELECT avg(was_relevant::INT) AS precision FROM {_L} WHERE was_relevant IS NOT NULL) SELECT * FROM (SELECT 'low_rating' AS rule, round(rating, 4) AS value, 'review answers of the lowest categories' AS advice FROM s WHERE rating < 3.0 UNION ALL SELECT 'many_low', round(low, 4), 'inspect frequent words of low-rated comments' FROM s WHERE low > 0.3 UNION ALL SELECT 'low_precision', round(precision, 4), 'raise the keyword weight or rerank' FROM p WHERE precision < 0.5)",
    "rate_window_60s": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "daily_budget": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, greatest(count(*) - 2, 0)::BIGINT AS refused FROM events GROUP BY 1, 2",
    "scene_change": "SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL QUALIFY lag(value) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL OR abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) >= 30.0",
}

_STATS = " UNION ALL ".join(f"SELECT 'overall' AS insight, '{c}' AS name, {c}::DOUBLE AS value FROM ({ORACLES['feedback_stats']})" for c in ("total", "avg_rating", *(f"rating_{r}" for r in range(1, 6))))
_PART = lambda insight, name, value, key: f" UNION ALL SELECT '{insight}', {name}, {value}::DOUBLE FROM ({ORACLES[key]})"
ORACLES["feedback_analysis"] = (
    _STATS + _PART("low_category", "query_category", "avg_rating", "low_rated_categories") + _PART("failure_keyword", "word", "n", "keyword_top20") + _PART("chunk_rate", "chunk_id", "rate", "relevance_rates")
    + _PART("worst_chunk", "chunk_id", "rate", "worst_chunks") + _PART("daily_rating", "day", "avg_rating", "daily_trend") + f" UNION ALL SELECT 'low_rated', 'queries', count(*)::DOUBLE FROM {_F} WHERE user_rating <= 2"
)

_HALF = lambda at: f"list_transform(embedding[{at}:{at + 7}], lambda x: abs(x::DOUBLE))"
_APART = lambda c: f"sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_transform(list_zip({c}, p{c}), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum({c}) * list_sum(p{c}))))"
ORACLES["video_keyframes"] = (
    f"WITH f AS (SELECT vec_id % 8 AS video, vec_id // 8 AS frame, {_HALF(1)} AS a, {_HALF(9)} AS b, count(*) OVER (PARTITION BY vec_id % 8) AS n FROM embeddings WHERE embedding IS NOT NULL), "
    "s AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM f WHERE frame % greatest(1, n // 200) = 0 WINDOW w AS (PARTITION BY video ORDER BY frame)), "
    f"c AS (SELECT video, frame, pa IS NULL AS head, CASE WHEN pa IS NOT NULL THEN 100.0::DOUBLE * ({_APART('a')} + {_APART('b')}) / 2 END AS distance FROM s) "
    "SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS position, round(distance, 4) AS distance FROM c WHERE head OR distance >= 30 QUALIFY position < 50"
)
