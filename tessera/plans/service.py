"""The engine put together: one configuration, handlers, tools, set-up, hooks for models, and evaluation runs.

Nothing here holds a table. A model is a callable given by the caller; without one the deterministic path is taken, and a model that fails is
said so in the trace, not hidden.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, knowledge, retrieval
from tessera.operators.index import CorpusIndex
from tessera.plans import answering, guard, questions

Model = Callable[[str], str]


@dataclass
class Components:
    """What questions are answered with. Missing parts are None, and asking for one by ``need`` is an error."""

    spark: SparkSession
    index: CorpusIndex | None = None
    warehouse: str | None = None
    models: list[tuple[str, Model]] = field(default_factory=list)
    embed_image: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None

    def need(self, name: str):
        part = getattr(self, name)
        if part is None:
            raise LookupError(f"{name} is not set up")
        return part


# --- models -------------------------------------------------------------------------------


def generate(prompt: str, models: list[tuple[str, Model]], fallback: Model) -> tuple[str, list[str]]:
    """The first model's text that is not blank, else the fallback's; and what was tried."""
    trace = []
    for name, model in models:
        try:
            said = model(prompt)
        except Exception as problem:  # noqa: BLE001 - any failure of a hosted model means: the next one
            trace.append(f"{name}: {type(problem).__name__}")
            continue
        if said and said.strip():
            return said, [*trace, f"{name}: ok"]
        trace.append(f"{name}: blank")
    return fallback(prompt), [*trace, "fallback"]


def template_answer(question: str, passages: DataFrame, k: int = 5, width: int = 300) -> str:
    """An answer without a model: the k passages (source, text, ord) that hold most of the question's words, cut to a width, with their sources."""
    words = [w for w in dict.fromkeys(re.findall(r"\w+", question.lower())) if len(w) > 2 and w not in T.STOP_WORDS]
    hits = F.size(F.filter(T.strings(words), lambda w: F.contains(F.lower("text"), w))) if words else F.lit(0)
    n = passages.count()
    if not n:
        return f"Nothing was found for the question: {question}"
    rows = passages.withColumn("hits", hits).orderBy(F.col("hits").desc(), "ord").limit(k).select("source", F.trim(F.substring("text", 1, width)).alias("text")).collect()
    said = [r for r in rows if r.text]
    lines = [f"From {n} passages:", *[f"[{r.source}] {r.text}" for r in said]]
    if said:
        lines.append("Sources: " + ", ".join(sorted({r.source for r in said})))
    return "\n\n".join(lines)


def sane_plan(tasks: list[tuple[str, str]], question: str, most: int = 3) -> list[tuple[str, str]]:
    """A model's plan (specialist, query) without unknown specialists and blank queries, at most ``most`` document tasks, and at least one."""
    kept, documents = [], 0
    for specialist, query in tasks:
        if specialist in questions.SPECIALISTS and query.strip() and (specialist, query) not in kept:
            documents += specialist == "document"
            if specialist != "document" or documents <= most:
                kept.append((specialist, query))
    return kept if any(s == "document" for s, _ in kept) else [("document", question), *kept]


def classified_by(classifier: Callable[[Column], Column], question: Column) -> Column:
    """A model's category where it is a known one, else the rules'."""
    said = F.lower(F.trim(classifier(question)))
    return F.when(said.isin(list(questions.CATEGORIES)), said).otherwise(questions.classify(question)["category"])


def reranked(hits: DataFrame, question: str, k: int, model: Callable[[Column, Column], Column] | None = None, key: str = "doc_id") -> DataFrame:
    """Hits in the order of a pair model's score, or of the word overlap where there is no model."""
    if model is None:
        return retrieval.rerank(hits, question, k, key)
    return hits.withColumn("rerank_score", model(F.lit(question), F.col("text"))).orderBy(F.col("rerank_score").desc(), key).limit(k)


# --- handlers -----------------------------------------------------------------------------

Handler = Callable[[str], dict]


class Router:
    """Handlers by category; a question goes to that of its category, else to the default."""

    def __init__(self, spark: SparkSession, default: Handler):
        self.spark, self.default, self.handlers = spark, default, {}

    def register(self, category: str, handler: Handler) -> None:
        if category not in questions.CATEGORIES:
            raise ValueError(f"unknown category {category!r}")
        self.handlers[category] = handler

    def route(self, question: str) -> dict:
        category = self.spark.createDataFrame([(question,)], "q string").select(questions.classify(F.col("q"))["category"]).first()[0]
        return {"category": category, **self.handlers.get(category, self.default)(question)}


CONTEXT_CHUNKS, CONTEXT_CHARS = 5, 2000


def handlers(parts: Components) -> dict[str, Handler]:
    """The three ways of a plain answer: from the warehouse, from several hops, from one search."""

    def sql(question: str) -> dict:
        rows, said = guard.answer_question(parts.spark, parts.need("warehouse"), question)
        return {"answer": said, "sources": ["warehouse"], "rows": guard.preview(rows)}

    def written(question: str, rows: list) -> dict:
        rows = rows[:CONTEXT_CHUNKS]
        passages = parts.spark.createDataFrame([(str(r.doc_id), r.text, i) for i, r in enumerate(rows)], "source string, text string, ord int")
        context = "\n".join(r.text for r in rows)[:CONTEXT_CHARS]
        answer, trace = generate(f"{question}\n{context}", parts.models, lambda _: template_answer(question, passages))
        return {"answer": answer, "sources": [str(r.doc_id) for r in rows], "trace": trace}

    def reasoning(question: str) -> dict:
        return written(question, answering.multi_hop(parts.need("index").search, question).passages)

    def standard(question: str) -> dict:
        return written(question, parts.need("index").search(question, CONTEXT_CHUNKS).orderBy(F.col("score").desc(), "doc_id").collect() if question.strip() else [])

    return {"sql": sql, "reasoning": reasoning, "standard": standard}


def tools(parts: Components) -> dict[str, Callable]:
    """What an agent may call, by name: each gives a DataFrame."""
    return {
        "search_documents": lambda query, k=5: parts.need("index").search(query, k),
        "search_vectors": lambda query, k=5: parts.need("index").retrieve(query, k),
        "query_warehouse": lambda question: guard.answer_question(parts.spark, parts.need("warehouse"), question)[0],
        "explore_graph": lambda question: knowledge.context_lines(*parts.need("index").graph(), knowledge.question_entities(question)),
    }


def multimodal_search(text_search: Callable[[str, int], DataFrame], visual_search: Callable[[str, int], DataFrame] | None, spark: SparkSession, question: str, k: int, keys: list[str]) -> DataFrame:
    """Injected text and visual searches (keys, type, score), weighed by what the question asks for."""
    m = spark.createDataFrame([(question,)], "q string").select(questions.modality(F.col("q")).alias("m")).select("m.*").first()
    hits = text_search(question, 2 * k)
    if visual_search is None:
        return retrieval.multimodal(hits, hits.limit(0), m.text_weight, 0.0, k, keys)
    return retrieval.multimodal(hits, visual_search(question, 2 * k), m.text_weight, m.visual_weight, k, keys)


# Confidence of a warehouse answer, of an answer from nothing, characters of a source shown.
SURE, UNSURE, SHOWN = 0.85, 0.3, 500
MODES = ("analytics", "retrieval", "direct")


def respond(parts: Components, question: str, mode: str | None = None, k: int = CONTEXT_CHUNKS) -> dict:
    """One question by one of three ways: the warehouse, the verified plan, one direct search.

    Without a mode the question's own kind decides. A way that fails is noted in ``trace`` and the next one is taken; the direct search
    answers from what it finds, with the best score as confidence.
    """
    if mode is not None and mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    question, trace = question.strip(), []
    kind = mode or parts.spark.createDataFrame([(question,)], "q string").select(questions.service_kind(F.col("q"))).first()[0]

    def analytics() -> dict:
        rows, said = guard.answer_question(parts.spark, parts.need("warehouse"), question)
        preview = guard.preview(rows)
        return {"answer": f"{said}\n{preview}", "sources": [], "confidence": SURE, "chart": guard.chart_spec(rows, question)}

    def planned() -> dict:
        index = parts.need("index")
        edges = index.graph()[1] if index.has("edges") else None
        got = answering.ask(parts.spark, question, index.search, edges, (lambda q: guard.answer_question(parts.spark, parts.warehouse, q)[0]) if parts.warehouse else None)
        held = [(f["source"], str(f["doc_id"]), f["content"], float(f["score"])) for f in got["findings"]]
        frame = parts.spark.createDataFrame(held, "source string, doc_id string, text string, score double")
        sure = evaluation.attributed_result(got["answer"], question, frame).first()
        return {"answer": got["answer"], "sources": [{"source": s, "doc_id": i, "text": t[:SHOWN], "score": round(x, 4)} for s, i, t, x in held], "confidence": round(sure.confidence, 3), "warnings": sure.warnings}

    def direct() -> dict:
        rows = parts.need("index").search(question, k).orderBy(F.col("score").desc(), "doc_id").collect() if question else []
        passages = parts.spark.createDataFrame([(str(r.doc_id), r.text, i) for i, r in enumerate(rows)], "source string, text string, ord int")
        answer, said = generate(question, parts.models, lambda _: template_answer(question, passages))
        best = max((float(r.score) for r in rows), default=0.0)
        return {"answer": answer, "sources": [{"source": "documents", "doc_id": str(r.doc_id), "text": r.text[:SHOWN], "score": round(float(r.score), 4)} for r in rows], "confidence": round(min(best, 1.0), 3) if best > 0 else UNSURE, "trace": said}

    ways = {"analytics": [analytics, planned, direct], "direct": [direct]}.get(kind, [planned, direct])
    for way in ways[:-1]:
        try:
            return {"kind": way.__name__, **way(), "trace": trace}
        except Exception as problem:  # noqa: BLE001 - the next way answers, and the trace says why
            trace.append(f"{way.__name__}: {type(problem).__name__}")
    last = ways[-1]()
    return {"kind": "direct", **last, "trace": trace + last["trace"]}


# --- set-up and evaluation ----------------------------------------------------------------


def set_up(parts: Components, docs: DataFrame, triples: DataFrame | None = None, order: list[str] | None = None, assets: DataFrame | None = None, images: DataFrame | None = None) -> dict[str, str]:
    """Build what questions need, step by step; a step that fails is reported and the others go on."""
    index = parts.need("index")
    graph = lambda: index.save_graph(knowledge.nodes_of(triples, order), knowledge.edges_of(triples, order))
    steps: list[tuple[str, Callable[[], object] | None]] = [
        ("reset", index.reset),
        ("texts", lambda: index.add(docs)),
        ("vectors", lambda: index.embed(docs)),
        ("graph", graph if triples is not None else None),
        ("assets", (lambda: index.add_assets(assets)) if assets is not None else None),
        ("visual", (lambda: index.add_vectors(images.withColumn("embedding", parts.embed_image(F.col("image"))), name="visual")) if images is not None and parts.embed_image else None),
        ("warehouse", (lambda: guard.answer_question(parts.spark, parts.warehouse, "orders")[0].limit(1).count()) if parts.warehouse else None),
    ]
    done = {}
    for name, step in steps:
        try:
            done[name] = "skipped" if step is None else "ok"
            if step is not None:
                step()
        except Exception as problem:  # noqa: BLE001 - reported, and the next step does not depend on it
            done[name] = f"{type(problem).__name__}: {str(problem)[:200]}"
    return done


def selected_cases(spark: SparkSession, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The published questions, all or those of some categories, the first ``limit`` of them."""
    out = questions.cases(spark)
    out = out.where(F.col("category").isin(categories)) if categories else out
    return out.orderBy("id").limit(limit) if limit is not None else out


RUN_SCHEMA = (
    "id long, category string, answer string, findings array<struct<content:string,source:string,modality:string>>, citations array<string>, specialists array<string>, "
    "expected_specialists array<string>, expected_modality string, expected_answer_contains array<string>, retry_count int, latency_seconds double, error string"
)


def experiment(spark: SparkSession, ask: Callable[[str], dict], categories: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ask the selected cases one by one and score the runs: (scores of each case, means of each metric).

    A case that fails scores as an empty answer, with its error beside it.
    """
    rows = []
    for case in selected_cases(spark, categories, limit).orderBy("id").collect():
        started, error = time.perf_counter(), None
        try:
            got = ask(case.query)
        except Exception as problem:  # noqa: BLE001 - one failed case must not end the run
            got, error = {"answer": "", "findings": [], "citations": [], "specialists": [], "retry_count": 0}, f"{type(problem).__name__}: {str(problem)[:200]}"
        findings = [(f["content"], f["source"], f["modality"]) for f in got["findings"]]
        kinds = {"visual_reasoning": "visual", "ocr_extraction": "visual"}
        rows.append((case.id, case.category, got["answer"], findings, [c["source"] for c in got["citations"]], list(got["specialists"]), evaluation.CATEGORY_SPECIALISTS.get(case.category, []), kinds.get(case.category, "text"), [], int(got["retry_count"]), round(time.perf_counter() - started, 3), error))
    scores = evaluation.score_runs(spark.createDataFrame(rows, RUN_SCHEMA))
    return scores, evaluation.experiment_means(scores, [*evaluation.run_scores(), "latency_seconds"])


def readiness(parts: Components) -> dict[str, bool]:
    """What is there: texts, vectors, graph, warehouse."""
    index = parts.index
    return {"texts": bool(index and index.has("texts")), "vectors": bool(index and index.has("vectors")), "graph": bool(index and index.has("edges")), "warehouse": parts.warehouse is not None}
