"""The index, graph context and the service layer."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, index, knowledge, retrieval
from tessera.operators.index import CorpusIndex
from tessera.plans import answering, guard, questions, service

TEXTS = [
    (1, "Apex Materials shipped the steel late because of a storm."),
    (2, "The pump of CNC-Mill-07 failed, maintenance replaced the seal."),
    (3, "Quarterly revenue rose in the West region."),
    (4, ""),
    (5, None),
    (6, "Steel steel steel: Apex_Materials delivers steel to Chicago."),
]


@pytest.fixture
def kept(spark, tmp_path):
    out = CorpusIndex(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out.add(docs.where("doc_id <= 3"))
    out.add(docs.where("doc_id > 3"))
    return out


def test_restored_index_scores_like_the_corpus(spark, kept):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    again = CorpusIndex(spark, kept.path)
    for question in ("steel of apex", "the pump failed", "storm", "nothing here fits", "", "!!"):
        got = [(r.doc_id, round(r.score, 9)) for r in again.keyword(question, 4).collect()]
        assert got == [(r.doc_id, round(r.score, 9)) for r in retrieval.bm25(docs, question, 4).collect()]
    assert again.stored_chunks().count() == len(TEXTS) and {r.term: (r.df, r.cf) for r in again.term_statistics().collect()}["steel"] == (2, 5)
    first = again.search("steel chicago", 2).orderBy(F.col("score").desc()).collect()
    assert first[0].score == 1.0 and first[0].text.startswith("Steel")
    again.reset()
    with pytest.raises(FileNotFoundError):
        again.stored_chunks()


def test_vectors_are_checked_and_asked_by_text(spark, kept):
    kept.embed(kept.stored_chunks())
    best = kept.retrieve("The pump of CNC-Mill-07 failed, maintenance replaced the seal.", 2).collect()
    assert best[0].doc_id == 2 and best[0].score == pytest.approx(1.0)
    assert kept.retrieve("  ").count() == 0 and kept.hybrid("late steel", 3).count() == 3
    with pytest.raises(ValueError, match="lengths"):
        kept.add_vectors(spark.createDataFrame([(9, [1.0, 2.0])], "doc_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="dimensions"):
        kept.nearest([1.0], 3)


def test_graph_comes_back_and_gives_context(spark, kept):
    triples = spark.createDataFrame([(1, "CNC-Mill-07", "located_in", "Chicago_Plant", "Machine"), (2, "DISPATCH-1", "supplied_by", "Apex_Materials", "Order"), (3, "DISPATCH-2", "supplied_by", "Apex_Materials", "Order")], "at long, subject string, predicate string, object string, subject_type string")
    kept.save_graph(knowledge.nodes_of(triples, ["at"]), knowledge.edges_of(triples, ["at"]))
    nodes, edges = CorpusIndex(spark, kept.path).graph()
    asked = knowledge.question_entities('Why was Apex Materials late with ord-1001, apex materials, and "cnc mill 07"?')
    assert asked == ["ord-1001", "Apex Materials", "Apex", "Materials", "cnc mill 07"]
    lines = knowledge.context_lines(nodes, edges, ["Apex Materials", "cnc mill 07", "nobody"])
    assert {(r.entity, r.direction, r.line) for r in lines.collect()} == {
        ("Apex Materials", "in", "<- DISPATCH-1 supplied by"), ("Apex Materials", "in", "<- DISPATCH-2 supplied by"), ("cnc mill 07", "out", "-> located in Chicago Plant"),
    }
    contexts = knowledge.entity_contexts(lines)
    hits = kept.search("steel of apex", 3)
    out = {r.doc_id: r for r in knowledge.augmented(hits, contexts).collect()}
    assert "DISPATCH-1" in out["1"].graph_context and "DISPATCH-1" in out["6"].graph_context and out[knowledge.SUMMARY].score == 0.5
    alone = knowledge.augmented(hits.limit(0), contexts).collect()  # a question that only the graph answers
    assert [r.doc_id for r in alone] == [knowledge.SUMMARY]
    assert {r.node for r in knowledge.nodes_in_question(nodes, "what of the chicago plant and dispatch-2").collect()} == {"Chicago_Plant", "DISPATCH-2"}


def test_models_fall_back_and_say_so():
    def broken(_):
        raise TimeoutError

    said, trace = service.generate("q", [("a", broken), ("b", lambda _: " "), ("c", lambda q: q + "!")], lambda _: "plain")
    assert said == "q!" and trace == ["a: TimeoutError", "b: blank", "c: ok"]
    assert service.generate("q", [("a", broken)], lambda _: "plain") == ("plain", ["a: TimeoutError", "fallback"])


def test_plans_of_a_model_are_made_sane():
    tasks = [("wizard", "x"), ("document", "a"), ("document", "a"), ("document", "b"), ("graph", " "), ("document", "c"), ("document", "d"), ("graph", "g")]
    assert service.sane_plan(tasks, "q") == [("document", "a"), ("document", "b"), ("document", "c"), ("graph", "g")]
    assert service.sane_plan([("graph", "g")], "q") == [("document", "q"), ("graph", "g")]


def test_answer_without_a_model(spark):
    passages = spark.createDataFrame([("a", "nothing of it", 0), ("b", "the steel was late " + "x" * 400, 1), ("c", "late", 2)], "source string, text string, ord int")
    said = service.template_answer("Why was the steel late?", passages, k=2)
    assert said.index("[b]") < said.index("[c]") and "[a]" not in said and "Sources: b, c" in said and len(said) < 500
    assert "Why?" in service.template_answer("Why?", passages.limit(0))


def test_router_handlers_and_tools(spark, kept, tmp_path):
    sf = "/root/testdata/sf0.001"
    parts = service.Components(spark, kept, sf)
    ways = service.handlers(parts)
    router = service.Router(spark, ways["standard"])
    router.register("sql", ways["sql"])
    with pytest.raises(ValueError):
        router.register("poetry", ways["sql"])
    got = router.route("Show monthly order trend")
    assert got["category"] and got["answer"]
    assert "Apex" in ways["standard"]("Which supplier shipped steel late?")["answer"]
    assert ways["reasoning"]("Why did the pump fail?")["sources"][0] == "2" and ways["standard"](" ")["sources"] == []
    with pytest.raises(LookupError):
        service.handlers(service.Components(spark))["standard"]("x")
    calls = service.tools(parts)
    assert calls["search_documents"]("steel", 1).count() == 1 and calls["query_warehouse"]("top 3 products").count() == 3
    assert service.readiness(parts) == {"texts": True, "vectors": False, "graph": False, "warehouse": True}


def test_set_up_goes_on_after_a_failed_step(spark, tmp_path):
    parts = service.Components(spark, CorpusIndex(spark, str(tmp_path / "i")), "/nowhere")
    done = service.set_up(parts, spark.createDataFrame(TEXTS, "doc_id long, text string"))
    assert done["texts"] == done["vectors"] == "ok" and done["graph"] == done["visual"] == "skipped" and done["warehouse"] not in ("ok", "skipped")
    assert parts.index.retrieve("steel", 1).count() == 1


def test_experiment_scores_cases_and_survives_failures(spark, kept):
    def ask(question):
        if "executive" in question:
            raise RuntimeError("no")
        return answering.ask(spark, question, kept.search)

    scores, means = service.experiment(spark, ask, ["summary"], 2)
    rows = {r.id: r for r in scores.collect()}
    assert len(rows) == 2 and sum(r.error is not None for r in rows.values()) == 1
    assert {r.metric: r.n for r in means.collect()}["faithfulness"] == 2
    assert service.selected_cases(spark, ["sql", "edge"], 4).count() == 4 and service.selected_cases(spark).count() == len(questions.CASES)


def test_evaluated_pipeline(spark):
    examples = spark.createDataFrame([("late steel", "the steel was late", ["steel"])], "query string, truth string, expected array<string>")
    got = evaluation.evaluated(examples, lambda e: e.withColumn("answer", F.lit("The steel was late.")).withColumn("contexts", F.array(F.lit("the steel was late"), F.lit("apples")))).first()
    assert got.retrieval_precision == 0.5 and got.keyword_hit == 1.0 and got.faithfulness > 0.5


def test_attributed_result_warns(spark):
    chunks = spark.createDataFrame([("a", "s", "the steel was late", 0.9)], "doc_id string, source string, text string, score double")
    got = evaluation.attributed_result("The steel was late.", "steel late", chunks).first()
    assert got.n_sources == 1 and got.faithfulness == 1.0 and "single source" in got.warnings


def test_models_as_columns(spark):
    df = spark.createDataFrame([("Show monthly order trend",)], "q string")
    assert df.select(service.classified_by(lambda q: F.lit(" SQL "), F.col("q"))).first()[0] == "sql"
    assert df.select(service.classified_by(lambda q: F.lit("poem"), F.col("q"))).first()[0] in questions.CATEGORIES
    hits = spark.createDataFrame([(1, "b", 2.0), (2, "bbb", 1.0)], "doc_id long, text string, score double")
    assert service.reranked(hits, "b", 1, lambda q, t: F.length(t).cast("double")).first().doc_id == 2
    assert service.reranked(hits, "b", 1).first().doc_id == 1
    vectors = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert vectors.select(T.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1.0)


def test_multimodal_search_weighs_injected_branches(spark):
    text = spark.createDataFrame([("a", 1, "text", 0.9), ("b", 1, "text", 0.1)], "doc_id string, page int, type string, score double")
    visual = spark.createDataFrame([("a", 1, "image", 0.2), ("c", 1, "image", 0.8)], "doc_id string, page int, type string, score double")
    got = service.multimodal_search(lambda q, k: text, lambda q, k: visual, spark, "what does the chart show", 3, ["doc_id", "page"]).collect()
    assert got[0].doc_id == "c" and {r.type for r in got if r.doc_id == "a"} == {"image"}
    assert service.multimodal_search(lambda q, k: text, None, spark, "late orders", 3, ["doc_id", "page"]).count() == 2


def test_statements_that_reach_out_are_refused():
    for sql in ("SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('a', 'b')", "SELECT * FROM parquet.`/tmp/x`", "select * from csv . `file:///x`"):
        assert not guard.validate(sql)[0] and guard.needs_approval(sql)
    assert guard.validate("SELECT `a`.`b` FROM t WHERE x = 'parquet.`/p`'")[0]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT \"'\", reflect('java.lang.System', 'lineSeparator'), \"'\"",
        "SELECT reflect/**/('java.lang.System', 'lineSeparator')",
        "SELECT `reflect`('java.lang.System', 'lineSeparator')",
        "SELECT * FROM parquet.`x.parquet`",
        "WITH a AS (SELECT * FROM csv.`b`) SELECT * FROM a",
        "SELECT id FROM range(3) WHERE id IN (SELECT id FROM json.`q`)",
        "SELECT (SELECT max(id) FROM orc.`q`)",
        "SELECT * FROM IDENTIFIER('parquet.`x`')",
        "SELECT TRANSFORM(id) USING 'cat' FROM range(3)",
        "SELECT input_file_name() FROM range(3)",
    ],
)
def test_plans_that_reach_out_are_refused(spark, sql):
    assert guard.plan_reason(spark, sql)
    with pytest.raises(ValueError):
        guard.run_sql(spark, sql, approved=True)


def test_plain_statements_run(spark):
    spark.range(6).createOrReplaceTempView("six")
    sql = "WITH a AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM six) SELECT kind, count(DISTINCT id) AS n, sum(id) + 1 AS s, row_number() OVER (ORDER BY kind) AS r FROM a WHERE id BETWEEN 1 AND 5 AND kind LIKE '%d%' OR id IN (SELECT max(id) FROM six) GROUP BY kind ORDER BY kind"
    assert [tuple(r) for r in guard.run_sql(spark, f"```sql\n{sql};\n```").collect()] == [("odd", 3, 10, 1)]
    spark.sql("SELECT year(date '2024-01-02') || '-' || upper(trim(' a ')) AS x").createOrReplaceTempView("one")
    assert guard.run_sql(spark, "SELECT cast(x AS string), extract(MONTH FROM date '2024-05-01') m, coalesce(x, 'z') FROM one").first().m == 5


def test_questions_are_split_and_followed(spark):
    assert answering.split_compound("What is the revenue, and which suppliers were late? How many orders are open?")[1:] == ["which suppliers were late", "How many orders are open"]
    assert answering.split_compound("Why is it late and what does that cost?") == ["Why is it late and what does that cost?"]


def test_a_bad_file_is_one_bad_row(spark):
    from tessera.sources import tables

    docs = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}}'), (2, "{broken"), (3, None)], "k long, text string")
    got = {r.k: (r.text, bool(r.error)) for r in tables.flatten_documents(docs, "k", "text").collect()}
    assert got == {1: ("a.b[0]: 1\na.b[1]: 2", False), 2: (None, True), 3: (None, False)}


def test_assets_are_carried(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    assets = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "p"), ("b", 1, "q")], "source string, ordinal int, asset string")
    assert {(r.doc_id, r.asset) for r in index.carried_assets(docs, assets, "doc_id").collect()} == {(1, "x"), (2, "y"), (3, "p"), (3, "q")}


def test_respond_takes_the_next_way_and_says_so(spark, kept):
    parts = service.Components(spark, kept)
    got = service.respond(parts, "What is the total revenue by supplier?")
    assert got["trace"] == ["analytics: LookupError"] and got["kind"] == "planned" and 0 <= got["confidence"] <= 1 and got["sources"]
    shown = service.respond(parts, "Which supplier shipped steel late?", "direct", 2)
    assert shown["kind"] == "direct" and shown["confidence"] == 1.0 and len(shown["sources"]) == 2 and "steel" in shown["answer"].lower()
    assert service.respond(parts, "zzz qqq", "direct")["confidence"] == service.UNSURE
    with pytest.raises(ValueError):
        service.respond(parts, "x", "sideways")
    with pytest.raises(LookupError):
        service.respond(service.Components(spark), "late steel")


def test_words_for_yes_and_no(spark):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "w string").select(T.truth(F.col("w"))).collect()
    assert [r[0] for r in words(" Relevant", "NOT relevant", "y", None)] == [True, False, True, None]
    with pytest.raises(Exception, match="not a boolean"):
        words("perhaps")
    row = spark.createDataFrame([("Show me  the Café -- costs!", "list")], "a string, b string").select(T.slug(F.col("a")), T.title(F.col("a")), T.title(F.col("b")), T.title(F.lit(None).cast("string"))).first()
    assert tuple(row) == ("show_me_the_café_--_costs", "The Café -- costs!", "List", "Query Results")


def test_arriving_documents_are_indexed_once(spark, kept, tmp_path):
    from tessera.streaming import windows

    for at, rows in enumerate([[(7, "copper arrives"), (8, "zinc")], [(8, "zinc again"), (9, "copper")]]):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in" / str(at)))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in" / "*"))
        windows.index_stream(stream, kept, str(tmp_path / "ck")).awaitTermination()
    again = CorpusIndex(spark, kept.path)
    assert {r.doc_id for r in again.search("copper", 5).collect()} == {7, 9}
    assert sorted(r.doc_id for r in again.table("texts").select("doc_id").collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9] and again.table("vectors").count() == 3


def test_a_broken_write_is_mended(spark, kept, tmp_path):
    from tessera.streaming import windows

    before = [tuple(r) for r in kept.keyword("steel", 5).collect()]
    assert kept.whole()
    docs = [(7, "copper arrives"), (8, "zinc")]
    kept.segments.write(spark.createDataFrame(docs, "doc_id long, text string"))  # broke off before the list
    assert not kept.whole() and kept.table("texts").count() == 6 and kept.keyword("copper", 5).count() == 0
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in" / "*"))
    windows.index_stream(stream, kept, str(tmp_path / "ck")).awaitTermination()
    again = CorpusIndex(spark, kept.path)
    assert again.whole() and again.table("texts").count() == 8 and {r.doc_id for r in again.keyword("copper", 5).collect()} == {7}
    assert [r[0] for r in before] == [r.doc_id for r in again.keyword("steel", 5).collect()]


QUESTIONS = [
    "Why was supplier Apex Materials late, and what is the total by supplier?",
    "Compare supplier performance between Q3 and Q4",
    None,
    "What are the top 3 products, and which supplier delayed shipment ORD-7?",
    "How does MACHINE CNC-Mill-4 affect delay?",
]


def test_questions_of_one_plan_are_answered_as_one_by_one(spark, tmp_path):
    """The plan over all questions against the plan of each question."""
    import random

    from tessera.plans import answering, batch

    r = random.Random(3)
    words = "supplier Apex Materials delayed shipment ORD-7 total number orders performance thing everything quality Machine M-4 failed report Q3 Q4 region overview".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(3, 14))) + ".") for i in range(60)] + [(60, None), (61, ""), (62, "Supplier: Beta Works delayed order ORD-7. late delivery quality")]
    index = CorpusIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    triples = spark.createDataFrame([(i, r.choice(["Apex_Materials", "Beta", "CNC-Mill-4"]), r.choice(["delayed", "supplies", "affects"]), r.choice(["ORD-7", "quality", "delay"]), "Supplier") for i in range(30)], "at long, subject string, predicate string, object string, subject_type string")
    index.save_graph(knowledge.nodes_of(triples, ["at"]), knowledge.edges_of(triples, ["at"]))
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, query string")
    hops = {}
    for x in sorted(batch.multi_hop(index, asked).collect(), key=lambda x: (x.hop, -x.score, x.doc_id)):
        hops.setdefault(x.id, []).append((x.doc_id, round(x.score, 9)))
    got = {x.id: x for x in batch.answered(spark, asked, index, True, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == list(range(len(QUESTIONS)))
    for i, question in enumerate(QUESTIONS):
        want = answering.ask(spark, question or "", index.search, index.graph()[1], lambda q: guard.answer_question(spark, "/root/testdata/sf0.001", q)[0])
        x = got[i]
        assert x.answer == want["answer"] and x.specialists == want["specialists"] and x.retry_count == want["retry_count"], question
        assert [(f.content, f.source, f.modality) for f in x.findings] == [(f["content"], f["source"], f["modality"]) for f in want["findings"]], question
        assert x.citations == [c["source"] for c in want["citations"]] and (x.grounded, x.relevant) == (want["verification"]["grounded"], want["verification"]["relevant"])
        assert hops.get(i, []) == [(p.doc_id, round(p.score, 9)) for p in answering.multi_hop(index.search, question or "").passages], question


def test_segments_merge_in_tiers(spark, tmp_path, monkeypatch):
    """After any number of appends an index answers as one build; an append reads its batch and what it merges."""
    from tessera.operators import segments

    monkeypatch.setattr(segments, "FANOUT", 2)
    docs = [(i, f"word{i % 5} common " * (i % 4) + f"rare{i}") for i in range(21)] + [(21, ""), (22, None)]
    out = CorpusIndex(spark, str(tmp_path / "i"))
    read = []
    table = segments.Segments.table
    monkeypatch.setattr(segments.Segments, "table", lambda self, name, some=None: (read.append((name, sum(s["n"] for s in some or self.state()["segments"]))), table(self, name, some))[1])
    for at in range(0, 23, 5):
        read.clear()
        out.add(spark.createDataFrame(docs[at : at + 5], "doc_id long, text string"))
        appended = at // 5 + 1
        assert sorted(s["tier"] for s in out.segments.state()["segments"]) == [b for b in range(5) if appended >> b & 1]
        merged = [n for _, n in read]
        assert all(n <= 5 * (appended & -appended) for n in merged) and (appended % 2 == 0 or not read)
    again = CorpusIndex(spark, out.path)
    one = CorpusIndex(spark, str(tmp_path / "one"))
    one.add(spark.createDataFrame(docs, "doc_id long, text string"))
    for question in ("rare7 word2", "common common word4 rare20"):
        rows = [[(r.doc_id, round(r.score, 9)) for r in x.keyword(question, 6).collect()] for x in (again, one)]
        assert rows[0] == rows[1] == [(r.doc_id, round(r.score, 9)) for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), question, 6).collect()]
    assert sorted(map(tuple, again.term_statistics().collect())) == sorted(map(tuple, one.term_statistics().collect()))
    assert again.whole() and again.table("texts").count() == 23
    again.rebuild()
    assert len(again.segments.state()["segments"]) == 1 and [r.doc_id for r in again.keyword("rare7", 3).collect()] == [7]


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    """The k best of random questions equal those of a full scoring, from fewer blocks."""
    import math
    import random
    from collections import Counter

    from tessera.operators import segments

    monkeypatch.setattr(segments, "RANGE_DOCS", 8)
    monkeypatch.setattr(segments, "FIRST", 2)
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, r.choices(words, [1 / (j + 1) for j in range(60)], k=r.choice([3, 10, 40, 150]))) for i in range(500)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    out = CorpusIndex(spark, str(tmp_path / "i"))
    out.add(frame.where("doc_id < 300"))
    out.add(frame.where("doc_id >= 300"))
    asked = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 4])))) for i in range(25)] + [(25, ""), (26, None), (27, "unknown"), (28, "w0 w0 w1")]
    df = Counter(w for _, d in docs for w in set(d))
    idf = {w: math.log(500 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = retrieval.EPSILON * sum(idf.values()) / len(idf)
    mean = sum(len(d) for _, d in docs) / 500

    def score(question, d):
        held = Counter(d)
        return sum((idf[w] if idf[w] >= 0 else low) * held[w] * 2.5 / (held[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in question.split() if w in held)

    questions_ = spark.createDataFrame(asked, "id long, query string")
    for k in (1, 5):
        got = {}
        for x in out.keyword_batch(questions_, k).collect():
            got.setdefault(x.id, []).append((-round(x.score, 6), x.doc_id))
        for i, q in asked:
            ranked = sorted((-round(s, 9), j) for j, d in docs if (s := score(q or "", d)) > 0)[:k]
            assert sorted(got.get(i, [])) == sorted((round(s, 6), j) for s, j in ranked), q
        counts = out.segments.blocks_read(questions_, k).agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read")).first()
        assert counts.read < (0.8 if k == 1 else 0.95) * counts.blocks
