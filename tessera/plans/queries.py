"""Registered end-to-end plans: hops, corrective retrieval and a verified answer over the driver tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, index, knowledge, retrieval, warehouse
from tessera.plans import answering, batch, guard, questions
from tessera.session import table


QUESTION = "this thing with that"


def _search(spark, d):
    return index.documents_index(spark, d).search


def _hops(spark, d):
    found = answering.multi_hop(_search(spark, d), "this thing with that", 2)
    return spark.createDataFrame([(r.doc_id, round(float(r.score), 6)) for r in found.passages], "doc_id long, score double")


def _corrective(spark, d):
    rows, _ = answering.corrective(_search(spark, d), QUESTION)
    return spark.createDataFrame([(r.doc_id, round(float(r.overlap), 6), r.relevant) for r in rows], "doc_id long, overlap double, relevant boolean")


def _graph(spark, d):
    """The edges of the records, kept in the index of the documents."""
    kept = index.documents_index(spark, d)
    if not kept.has("edges"):
        triples = batch._kept(knowledge.record_triples(knowledge._records(spark, d)))  # parsed once, for nodes and edges
        order = ["doc_id", "line", "field"]
        kept.save_graph(knowledge.nodes_of(triples, order), knowledge.edges_of(triples, order))
    return kept.graph()[1]


def _ask(spark, d):
    search, edges = _search(spark, d), _graph(spark, d)
    return lambda question: answering.ask(spark, question, search, edges, lambda q: guard.answer_question(spark, d, q)[0])


def _answer(spark, d):
    got = _ask(spark, d)("Why was dispatch 17 late, and what is the total by supplier?")
    return spark.createDataFrame([(",".join(got["specialists"]), got["answer"], got["verification"]["grounded"], got["retry_count"])], "specialists string, answer string, grounded boolean, retry_count int")


def _evaluation(spark, d):
    """All published questions answered in one plan and scored: the mean of each metric."""
    _graph(spark, d)
    scores = evaluation.score_runs(batch.runs(spark, questions.cases(spark), index.documents_index(spark, d), d))
    return evaluation.experiment_means(scores, list(evaluation.run_scores()))


def _asked_of_items(spark, d):
    """Corrective retrieval for a question made of each benchmark item, words 3 to 10 of it, and for the published ones."""
    words = F.slice(F.split("text", r"\s+"), 3, 8)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_join(words, " ").alias("query"))
    cases = questions.cases(spark).select((-1 - F.col("id")).alias("id"), "query")
    got = batch.corrective(index.documents_index(spark, d), items.unionByName(cases))
    return got.select("id", "attempt", "doc_id", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"), "relevant")


def _template(spark, d):
    return guard.answer_question(spark, d, "What are the top 5 products?")[0]


# Statements, and what is expected of them: (statement, accepted, why, needs approval).
STATEMENTS = (
    ("SELECT a, count(*) FROM t GROUP BY a", True, "OK", False),
    ("  select 1 ;  ", True, "OK", False),
    ("SELECT `a`.`b` FROM t WHERE x = 'parquet.`/p`'", True, "OK", False),
    ("WITH a AS (SELECT 1) SELECT * FROM a", False, "Only SELECT queries are permitted.", False),
    ("EXPLAIN SELECT 1", False, "Only SELECT queries are permitted.", False),
    ("-- nothing", False, "Only SELECT queries are permitted.", True),
    ("", False, "Empty SQL query.", True),
    ("SELECT 1; SELECT 2", False, "Multiple SQL statements are not allowed.", True),
    ("SELECT * FROM orders; DROP TABLE orders;--", False, "Forbidden keyword detected: DROP.", True),
    ("UPDATE t SET a = 1", False, "Only SELECT queries are permitted.", True),
    ("SELECT replace(a, 'b', 'c') FROM t", False, "Forbidden keyword detected: replace.", True),
    ("SELECT /* DELETE */ 1", False, "Forbidden keyword detected: DELETE.", False),
    ("SELECT dropped, updates FROM t", True, "OK", False),
    ("SELECT reflect('a', 'b')", False, "Function not allowed: reflect.", True),
    ("SELECT * FROM csv.`/tmp/x`", False, "Files are not tables.", True),
)


def _guarded(spark, d):
    """What the guards say of a statement for each turn of the conversations: the forms in turn, with the speaker's role for the name of the table."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    form = F.element_at(T.strings([q for q, *_ in STATEMENTS]), (F.col("id") % len(STATEMENTS) + 1).cast("int"))
    said = guard.judged(F.regexp_replace(form, r"\bt\b", F.col("role")))
    return turns.select("id", said.alias("g")).select("id", "g.ok", "g.reason", "g.needs_approval")


# A question for each template, the registered query whose rows it shows, and a number of these rows.
TEMPLATE_QUESTIONS = (
    ("Show the monthly trend", "monthly_trend", "order_count"),
    ("What is the revenue by supplier?", "revenue_by_supplier", "order_count"),
    ("Which were delayed?", "delayed_by_supplier_region", "delayed_count"),
    ("top 10 products", "top_products", "total_qty"),
    ("order status breakdown", "status_distribution", "order_count"),
    ("sales per region", "revenue_by_region", "order_count"),
    ("how is priority spread?", "priority_breakdown", "order_count"),
    ("anything", "recent_orders", "o_orderkey"),
)


def _templates(spark, d):
    """Rows and the sum of a number of every template, asked by its question."""
    parts = []
    for question, name, number in TEMPLATE_QUESTIONS:
        rows = guard.answer_question(spark, d, question)[0]
        parts.append(rows.agg(F.lit(name).alias("template"), F.count("*").alias("n"), F.sum(F.col(number).cast("double")).alias("total")))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


QUERIES = {"multi_hop": _hops, "corrective_retrieval": _corrective, "answer_question": _answer, "evaluation_run": _evaluation, "corrective_batch": _asked_of_items, "question_template": _template, "question_templates": _templates, "statement_guard": _guarded}
ORACLES = {
    "question_template": warehouse.ORACLES["top_products"].replace("LIMIT 10", "LIMIT 5"),
    "question_templates": " UNION ALL ".join(f"SELECT '{name}' AS template, count(*) AS n, sum({number})::DOUBLE AS total FROM ({warehouse.ORACLES[name]})" for _, name, number in TEMPLATE_QUESTIONS),
    "statement_guard": "SELECT conv_id * 1000 + turn AS id, ok, reason, needs_approval FROM conversations JOIN (VALUES " + ", ".join(f"({i}, {ok}, '{why}', {asks})" for i, (_, ok, why, asks) in enumerate(STATEMENTS)) + f") AS t(i, ok, reason, needs_approval) ON (conv_id * 1000 + turn) % {len(STATEMENTS)} = i",
}

_ASKED = [QUESTION, *[answering.rewrite(QUESTION, i) for i in range(1, answering.REWRITES + 1)]]
_OVERLAP = T.share_sql("a", "b")
ORACLES["corrective_retrieval"] = (
    f"WITH {retrieval._IDF}, "
    + ", ".join(f"b{i} AS (SELECT doc_id, {i} AS step FROM ({retrieval.scores_sql(q)}) ORDER BY round(score, 9) DESC, doc_id LIMIT {answering.TOP})" for i, q in enumerate(_ASKED))
    + ", hits AS ("
    + " UNION ALL ".join(f"FROM b{i}" for i in range(len(_ASKED)))
    + f"), o AS (SELECT doc_id, step, {_OVERLAP} AS overlap FROM (SELECT doc_id, step, {T.terms_sql(chr(39) + QUESTION + chr(39))} AS a, {T.terms_sql('text')} AS b FROM hits JOIN documents USING (doc_id))), "
    f"good AS (SELECT min(step) AS step FROM o WHERE overlap >= {evaluation.GRADE}) "
    f"SELECT doc_id, round(overlap, 6) AS overlap, overlap >= {evaluation.GRADE} AS relevant FROM o, good WHERE CASE WHEN good.step IS NULL THEN o.step = {len(_ASKED) - 1} ELSE o.step = good.step AND overlap >= {evaluation.GRADE} END"
)

# Searches of many questions: each attempt ranks all documents for the questions that no earlier attempt answered.
_ALL_ASKED = "SELECT item_id AS id, array_to_string(string_split_regex(text, '\\s+')[3:10], ' ') AS query FROM benchmark UNION ALL " + " UNION ALL ".join(f"SELECT {-1 - i}, '{q.replace(chr(39), chr(39) * 2)}'" for i, (q, _) in enumerate(questions.CASES))


def _form(i: int) -> str:
    if not i:
        return "query"
    before, after = answering.REWRITE_FORMS[i - 1].split("{q}")
    return f"'{before}' || regexp_replace(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '\\?+$', '') || '{after}'"


def _attempt(i: int) -> str:
    left = "asked" if not i else f"(SELECT * FROM asked WHERE id NOT IN (SELECT id FROM g{i - 1} WHERE relevant)" + "".join(f" AND id NOT IN (SELECT id FROM g{j} WHERE relevant)" for j in range(i - 1)) + ")"
    k1, b = retrieval.K1, retrieval.B
    return f"""
w{i} AS (SELECT id, w, count(*) AS times FROM (SELECT id, unnest({T.bm25_tokens_sql('q')}) AS w FROM (SELECT id, {_form(i)} AS q FROM {left})) GROUP BY ALL),
s{i} AS (
  SELECT w{i}.id, p.doc_id, sum(times * idf * tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) AS score
  FROM w{i} JOIN posted p USING (w) JOIN idf USING (w), st GROUP BY ALL HAVING score > 0
),
h{i} AS (SELECT * FROM s{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, doc_id) <= {answering.TOP}),
o{i} AS (
  SELECT h.id, h.doc_id, CASE WHEN max(score) OVER v = min(score) OVER v THEN 1.0::DOUBLE ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END AS score,
         {T.terms_sql('query')} AS a, {T.terms_sql('text')} AS b
  FROM h{i} h JOIN asked USING (id) JOIN documents d ON d.doc_id = h.doc_id WINDOW v AS (PARTITION BY h.id)
),
g{i} AS (SELECT id, {i} AS attempt, doc_id, score, overlap, overlap >= {evaluation.GRADE} AS relevant FROM (SELECT *, {_OVERLAP} AS overlap FROM o{i}))"""


_LAST = answering.REWRITES
ORACLES["corrective_batch"] = (
    f"WITH {retrieval._IDF}, asked AS ({_ALL_ASKED}), posted AS (SELECT doc_id, len(t) AS dl, w, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS w FROM toks) GROUP BY ALL),"
    + ",".join(_attempt(i) for i in range(_LAST + 1))
    + " SELECT id, attempt, doc_id, round(score, 6) AS score, round(overlap, 6) AS overlap, relevant FROM ("
    + " UNION ALL ".join(f"SELECT * FROM g{i} WHERE relevant" for i in range(_LAST + 1))
    + f" UNION ALL SELECT * FROM g{_LAST} WHERE id NOT IN (SELECT id FROM g{_LAST} WHERE relevant))"
)
