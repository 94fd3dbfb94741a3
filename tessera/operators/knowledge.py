"""Knowledge graph: triples from records and prose, nodes and edges, traversal, evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table, texts

# Record fields and their predicates.
ENTITY_FIELDS = {
    "supplier": "supplied_by",
    "destination": "shipped_to",
    "carrier": "carried_by",
    "warehouse": "dispatched_from",
    "location": "located_in",
    "status": "has_status",
    "status update": "has_status",
    "severity": "has_severity",
    "escalation": "escalated_to",
}
TEXT_FIELDS = {
    "reason": "delayed_because",
    "root cause": "failed_due_to",
    "issue": "reported_issue",
    "notes": "note",
    "note": "note",
    "production impact": "impacted",
    "items": "carries_item",
    "total delay": "delayed_by",
}
LONGEST = 200
_SUBJECT = r"^\s*(?:\[[^\]]*\]\s*)?(?:MACHINE\s*:\s*)?([A-Za-z][A-Za-z0-9\-_./]{2,40}?)\s*\|"
_HEAD = r"^\s*(?:\[[^\]]*\]\s*)?(?:MACHINE\s*:\s*)?[A-Za-z][A-Za-z0-9\-_./]{2,40}?\s*\|"
_FIELD = r"^\s*([A-Za-z][A-Za-z ]{1,24}?)\s*:\s*(.+?)\s*$"


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def record_triples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, field, subject, predicate, object, subject_type) of ``[ts] ID | Field: value | ...`` lines.

    A plain projection: lines and fields are exploded within a document, nothing is shuffled.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "_l"))
    heads = lines.where(F.col("_l").rlike(_HEAD)).select(
        key, "line", "_l",
        T.normalise_entity(F.regexp_extract("_l", _SUBJECT, 1)).alias("subject"),
        F.when(F.contains(F.upper(F.regexp_extract("_l", _HEAD, 0)), F.lit("MACHINE")), "Machine").otherwise("Order").alias("subject_type"),
    )
    parts = F.filter(F.transform(F.split("_l", r"\|"), lambda p, i: F.struct(i.alias("field"), F.lower(F.trim(F.regexp_extract(p, _FIELD, 1))).alias("name"), F.trim(F.regexp_extract(p, _FIELD, 2)).alias("value"))), lambda p: (p["field"] > 0) & (p["value"] != "") & (F.length(p["value"]) <= LONGEST))
    rows = heads.where("subject <> ''").select(key, "line", "subject", "subject_type", F.explode(parts).alias("p"))
    entity, free = F.element_at(_literal_map(ENTITY_FIELDS), F.col("p.name")), F.element_at(_literal_map(TEXT_FIELDS), F.col("p.name"))
    return rows.select(
        key, "line", F.col("p.field").alias("field"), "subject",
        F.coalesce(entity, free).alias("predicate"),
        F.when(entity.isNotNull(), T.normalise_entity(F.col("p.value"))).otherwise(F.regexp_replace("p.value", r"[.,;]+$", "")).alias("object"),
        "subject_type",
    ).where("predicate IS NOT NULL")


_NAME = r"([A-Z][A-Za-z0-9&\s\-]{1,40}?)"
_END = r"(.+?)(?:\.|,|$)"
# Prose rules in the order in which they claim a span: pattern, predicate, subject type, object type.
PROSE_RULES = (
    (r"(?:Supplier|Vendor|Manufacturer)\s+" + _NAME + r"\s+delayed\s+(?:shipment|delivery|order)\s+([A-Z0-9\-#]{3,20})", "delayed", "Supplier", "Order"),
    (r"(?:Supplier|Vendor)\s+" + _NAME + r"\s+delayed\s+(shipment|delivery|production|order(?:\s+\S+)?)", "delayed", "Supplier", "Order"),
    (r"(?:Machine|Equipment|Unit)\s+([A-Z0-9\-#]{2,20})\s+failed\s+due\s+to\s+" + _END, "failed_due_to", "Machine", "Product"),
    (r"(?:Machine|Equipment|Unit)\s+([A-Z0-9\-#]{2,20})\s+failed\s+(?:on|at|during)\s+" + _END, "failed", "Machine", "Order"),
    (r"(?:Order|PO|SO)\s+([A-Z0-9\-#]{3,20})\s+(?:was\s+)?cancelled\s+because\s+" + _END, "cancelled_because", "Order", "Supplier"),
    (r"(?:Supplier|Vendor)\s+" + _NAME + r"\s+supplied\s+" + _END, "supplied", "Supplier", "Product"),
    (_NAME + r"\s+shipped\s+to\s+" + _END, "shipped_to", "Supplier", "Location"),
    (_NAME + r"\s+caused\s+" + _END, "caused", "Supplier", "Order"),
    (_NAME + r"\s+resolved\s+" + _END, "resolved", "Person", "Order"),
    (r"([A-Z][A-Za-z0-9&\s\-#]{1,40}?)\s+(?:was\s+)?escalated\s+to\s+" + _END, "escalated", "Order", "Person"),
    (_NAME + r"\s+(?:is\s+)?(?:located\s+in|based\s+in|situated\s+in)\s+" + _END, "located_in", "Supplier", "Location"),
)


def _named(raw: str) -> str:
    return re.sub(r"\s+", "_", raw.strip().rstrip(".,;:!?"))


def prose_of(text: str) -> list[tuple[int, str, str, str, str, str]]:
    """(position, subject, predicate, object, subject type, object type); a span is claimed once, by the first rule.

    A later match is dropped if it starts or ends inside a claimed span.
    """
    taken: list[tuple[int, int]] = []
    out = []
    for pattern, predicate, s_type, o_type in PROSE_RULES:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            a, b = m.span()
            inside = any(x <= a < y or x < b <= y for x, y in taken)
            subject, obj = _named(m[1] or ""), _named(m[2] or "")
            if inside or not subject or not obj:
                continue
            taken.append((a, b))
            out.append((a, subject, predicate, obj, s_type, o_type))
    return out


def prose_triples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Triples from sentences. Rules need match spans, which Column functions do not give: Arrow batches in Python."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *t) for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in prose_of(body or "")]
            names = [key, "position", "subject", "predicate", "object", "subject_type", "object_type"]
            types = [b.column(0).type, pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, position long, subject string, predicate string, object string, subject_type string, object_type string")


# --- graph --------------------------------------------------------------------------------


def edges_of(triples: DataFrame, order: list[str]) -> DataFrame:
    """(subject, object, weight, predicates): predicates distinct, in the order of their first appearance."""
    first = triples.groupBy("subject", "object", "predicate").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("at"))
    # Distinct predicates of an edge are few, so this list is small whatever the number of mentions.
    return first.groupBy("subject", "object").agg(F.sum("n").alias("weight"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "predicate"))), lambda x: x["predicate"]), ", ").alias("predicates"))


def nodes_of(triples: DataFrame, order: list[str]) -> DataFrame:
    """(node, entity_type, mention_count): every end of a triple is a mention; the first type seen stays."""
    typed = "object_type" in triples.columns
    ends = F.array(F.struct(F.col("subject").alias("node"), F.col("subject_type").alias("kind"), F.lit(0).alias("side")), F.struct(F.col("object").alias("node"), (F.col("object_type") if typed else F.lit("Unknown")).alias("kind"), F.lit(1).alias("side")))
    flat = triples.select(*order, F.explode(ends).alias("e"))
    return flat.groupBy(F.col("e.node").alias("node")).agg(F.min_by("e.kind", F.struct(*order, "e.side")).alias("entity_type"), F.count("*").alias("mention_count"))


def matching_nodes(nodes: DataFrame, entity: str) -> DataFrame:
    """Nodes equal to, starting with or containing the entity, in this order; blanks and hyphens fold to underscores on both sides."""
    want = re.sub(r"[\s\-]+", "_", entity.strip()).lower()
    have = T.fold_entity(F.col("node"))
    rank = F.when(have == want, 0).when(have.startswith(want), 1).when(F.contains(have, F.lit(want)), 2)
    return nodes.withColumn("match", rank).where("match IS NOT NULL").orderBy("match", "node")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, hops) within ``depth`` steps of the seeds, against and along edges.

    One join a step. The frontier shrinks against what was reached, so a node appears once, with its least distance.
    """
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(edges.select(F.col("object"), F.col("subject")))
    reached = seeds.select("node", F.lit(0).alias("hops")).distinct()
    front = reached
    for step in range(1, depth + 1):
        new = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = new.join(reached.select("node"), "node", "left_anti").withColumn("hops", F.lit(step))
        reached = reached.union(front)
    return reached


def edge_sentence() -> Column:
    """An edge as words."""
    return F.translate(F.concat_ws(" ", "subject", "predicates", "object"), "_", " ")


def edge_evidence(edges: DataFrame, question: str, k: int = 6, least: int = 3) -> DataFrame:
    """The k edges whose words share most stemmed terms with the question; score is the share found."""
    asked = F.filter(T.terms(F.lit(question)), lambda t: F.length(t) >= least)
    sentence = edge_sentence()
    rows = edges.select("subject", "predicates", "object", sentence.alias("content"), F.size(F.array_intersect(T.terms(sentence), asked)).alias("hits"), F.size(asked).alias("asked"))
    return rows.where("hits > 0").orderBy(F.col("hits").desc(), "content", "subject", "object").limit(k).select("subject", "content", "hits", F.least(F.lit(1.0), F.col("hits") / F.greatest(F.lit(1), F.col("asked"))).alias("score"))


# Identifiers in a question, and opening words that are no names.
QUESTION_IDS = r"(?i)(?<![A-Za-z0-9_])(?:ORD|PO|SO|INV|MCH|MACH|EQP|LINE|UNIT)[-#]?\d{2,10}(?![A-Za-z0-9_])"
NO_NAMES = "the what which where when how why who did does was were are has had can could would should most many much".split()


def question_entities(question: str) -> list[str]:
    """Names a question may mean: identifiers, phrases and words in title case, quoted parts; first form of each, whatever its case."""
    title = r"[A-Z][a-z]{%s,}"
    found = [m.group() for m in re.finditer(QUESTION_IDS, question)]
    found += [m.group() for m in re.finditer(r"\b" + title % 1 + r"(?:\s+" + title % 1 + r")+\b", question)]
    found += [w for w in re.findall(r"\b" + title % 2 + r"\b", question) if w.lower() not in NO_NAMES]
    found += re.findall(r'"([^"]{2,60})"', question)
    kept: dict[str, str] = {}
    for x in found:
        if len(x.strip()) > 1:
            kept.setdefault(x.strip().lower(), x.strip())
    return list(kept.values())


def nodes_in_question(nodes: DataFrame, question: str, least: int = 3) -> DataFrame:
    """Nodes whose name, with blanks for underscores, stands in the question. The question goes to the scan as a literal."""
    name = F.lower(F.translate("node", "_", " "))
    return nodes.where((F.length("node") >= least) & (F.contains(F.lit(question.lower()), name) | F.contains(F.lit(question.lower()), F.lower("node"))))


def context_lines(nodes: DataFrame, edges: DataFrame, entities: list[str], most: int = 3) -> DataFrame:
    """(entity, node, entity_type, mention_count, direction, line): relations of the best nodes of each entity, at most ``most`` each.

    One pass over the nodes finds the matches of all entities, which are few rows; edges are filtered by them, not gathered.
    """
    spark = nodes.sparkSession
    want = [(e, re.sub(r"[\s\-]+", "_", e.strip()).lower()) for e in entities if e.strip()]
    asked = spark.createDataFrame(want or [("", "")], "entity string, want string").where("want <> ''")
    have = T.fold_entity(F.col("node"))
    rank = F.when(have == F.col("want"), 0).when(have.startswith(F.col("want")), 1).when(F.contains(have, F.col("want")), 2)
    # The entities of one question are a handful of rows.
    ranked = nodes.join(F.broadcast(asked), F.contains(have, F.col("want"))).withColumn("match", rank)
    best = Window.partitionBy("entity").orderBy("match", "node")
    matched = ranked.withColumn("at", F.row_number().over(best)).where(F.col("at") <= most).select("entity", "node", "entity_type", "mention_count")
    shown = lambda c: F.translate(c, "_", " ")
    out = edges.join(F.broadcast(matched), F.col("subject") == F.col("node")).withColumn("direction", F.lit("out")).withColumn("line", F.concat(F.lit("-> "), shown("predicates"), F.lit(" "), shown("object")))
    into = edges.join(F.broadcast(matched), F.col("object") == F.col("node")).withColumn("direction", F.lit("in")).withColumn("line", F.concat(F.lit("<- "), shown("subject"), F.lit(" "), shown("predicates")))
    columns = ["entity", "node", "entity_type", "mention_count", "direction", "line"]
    return out.select(*columns).unionByName(into.select(*columns)).distinct()


def entity_contexts(lines: DataFrame, most: int = 50) -> DataFrame:
    """(entity, context): text for a prompt, the first ``most`` relations of each node in their order; a reader's page, not a data set."""
    by = Window.partitionBy("entity", "node").orderBy(F.col("direction").desc(), "line")
    head = F.concat(F.translate("node", "_", " "), F.lit(" (type: "), "entity_type", F.lit(", mentions: "), F.col("mention_count").cast("string"), F.lit("):"))
    short = lines.withColumn("at", F.row_number().over(by)).where(F.col("at") <= most)
    each = short.groupBy("entity", "node", head.alias("head")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    page = F.concat_ws("\n  ", F.col("head"), F.transform("x", lambda x: x["line"]))
    return each.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", page.alias("page")))), lambda x: x["page"]), "\n").alias("context"))


def mentions(results: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """``results`` joined with each row of ``entities`` (a handful) that they name: as it is, with blanks, or with underscores."""
    low, e = F.lower(F.col(text)), F.lower("entity")
    return results.join(F.broadcast(entities), F.contains(low, e) | F.contains(low, F.translate(e, "_", " ")) | F.contains(low, F.translate(e, " ", "_")))


SUMMARY, SUMMARY_SCORE = "graph_summary", 0.5


def augmented(results: DataFrame, contexts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits (key, text, score) with graph_context, where they name an entity, and one more hit that sums the contexts up.

    Without any hit the summary still comes, so that a question that only the graph can answer gets its context.
    """
    named = mentions(results.select(key, "text"), contexts).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity", "context"))), lambda x: x["context"]), "\n---\n").alias("graph_context"))
    hits = results.select(F.col(key).cast("string").alias(key), "text", "score", F.col(key).alias("__key")).join(named.withColumnRenamed(key, "__key"), "__key", "left").drop("__key")
    whole = contexts.agg(F.array_sort(F.collect_list(F.struct("entity", "context"))).alias("x")).where(F.size("x") > 0)
    page = F.concat_ws("\n\n", F.lit("[Knowledge Graph Context]"), F.transform("x", lambda x: x["context"]))
    return hits.unionByName(whole.select(F.lit(SUMMARY).alias(key), page.alias("text"), F.lit(SUMMARY_SCORE).alias("score"), F.lit(None).cast("string").alias("graph_context")))


# Colours of entity types.
COLOURS = {
    "Supplier": "#e74c3c",
    "Machine": "#3498db",
    "Order": "#2ecc71",
    "Product": "#f39c12",
    "Location": "#9b59b6",
    "Person": "#1abc9c",
    "Unknown": "#95a5a6",
}
WIDEST = 5


def graph_export(nodes: DataFrame) -> DataFrame:
    """What a drawing needs of every node: label, size (15 and up to 30 more by mentions), colour by type."""
    size = 15 + F.least(3 * F.col("mention_count"), F.lit(30))
    colour = F.coalesce(_literal_map(COLOURS)[F.col("entity_type")], F.lit(COLOURS["Unknown"]))
    return nodes.withColumn("label", F.replace("node", F.lit("_"), F.lit(" "))).withColumn("size", size).withColumn("colour", colour)


def edge_export(edges: DataFrame) -> DataFrame:
    """What a drawing needs of every edge: label and width, which grows with the weight up to a bound."""
    return edges.withColumn("label", F.replace("predicates", F.lit("_"), F.lit(" "))).withColumn("width", F.least(F.col("weight"), F.lit(WIDEST)))


def order_graph(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customer-product, supplier-product and customer-region triples of the warehouse."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    triple = lambda a, x, p, b, y: [F.concat(F.lit(a), x.cast("string")).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(b), y.cast("string")).alias("object")]
    ordered = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct().select(*triple("customer-", F.col("o_custkey"), "ordered", "product-", F.col("l_partkey")))
    supplies = li.select("l_suppkey", "l_partkey").distinct().select(*triple("supplier-", F.col("l_suppkey"), "supplies", "product-", F.col("l_partkey")))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    located = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(*triple("customer-", F.col("c_custkey"), "located_in", "", F.col("r_name")))
    return ordered.unionByName(supplies).unionByName(located)


# --- registered queries -------------------------------------------------------------------


def _records(spark, d):
    o = texts(spark, d, "orders", ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))
    text = F.concat(
        F.lit("===== log =====\n["), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 07:00] DISPATCH-"), F.col("o_orderkey").cast("string"),
        F.lit(" | Supplier: Apex Materials | Status: "), F.col("o_orderstatus"), F.lit(" | ETA: tomorrow | Reason: late "), F.col("o_orderpriority"), F.lit(".\n[x] MACHINE: CNC-Mill-"), (F.col("o_custkey") % 9).cast("string"), F.lit(" | Location: Chicago Plant | Notes: ok;"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def _record_query(spark, d):
    return record_triples(_records(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), "subject", "predicate", "object", "subject_type")


def _edge_query(spark, d):
    return edges_of(record_triples(_records(spark, d)), ["doc_id", "line", "field"])


def _degree_query(spark, d):
    g = order_graph(spark, d)
    return g.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _bfs_query(spark, d):
    g = order_graph(spark, d)
    return neighbourhood(g, spark.range(1).select(F.lit("supplier-1").alias("node")), 2).select("node", F.col("hops").cast("long").alias("hops"))


def _match_query(spark, d):
    return matching_nodes(nodes_of(record_triples(_records(spark, d)), ["doc_id", "line", "field"]), "cnc mill").select("node", F.col("match").cast("long").alias("match"), "entity_type", "mention_count")


def _evidence_query(spark, d):
    out = edge_evidence(edges_of(record_triples(_records(spark, d)), ["doc_id", "line", "field"]), "Why was dispatch 17 late, and urgent?")
    return out.select("subject", "content", F.col("hits").cast("long").alias("hits"), F.round("score", 6).alias("score"))


# A sentence for each prose rule, {} being the order's key, and the triple it holds.
PROSE_SENTENCES = (
    ("Supplier Apex delayed shipment ORD-{}.", "Apex", "delayed", "ORD-{}", "Supplier", "Order"),
    ("Vendor Beta delayed production {}.", "Beta", "delayed", "production", "Supplier", "Order"),
    ("Machine M-{} failed due to heat.", "M-{}", "failed_due_to", "heat", "Machine", "Product"),
    ("Unit U-{} failed during startup.", "U-{}", "failed", "startup", "Machine", "Order"),
    ("Order PO-{} was cancelled because Gamma.", "PO-{}", "cancelled_because", "Gamma", "Order", "Supplier"),
    ("Vendor Beta supplied bolts {}.", "Beta", "supplied", "bolts_{}", "Supplier", "Product"),
    ("Acme shipped to Berlin {}.", "Acme", "shipped_to", "Berlin_{}", "Supplier", "Location"),
    ("Storm caused delay {}.", "Storm", "caused", "delay_{}", "Supplier", "Order"),
    ("Bob resolved ticket {}.", "Bob", "resolved", "ticket_{}", "Person", "Order"),
    ("Case {} was escalated to Alice.", "Case_{}", "escalated", "Alice", "Order", "Person"),
    ("Delta is located in Rome {}.", "Delta", "located_in", "Rome_{}", "Supplier", "Location"),
)


def _prose_query(spark, d):
    """Every order as a sentence of one rule, between sentences that no rule knows."""
    said = F.element_at(F.array(*[F.lit(p[0]) for p in PROSE_SENTENCES]), (F.col("o_orderkey") % len(PROSE_SENTENCES) + 1).cast("int"))
    text = F.concat(F.lit("nothing here. "), F.replace(said, F.lit("{}"), F.col("o_orderkey").cast("string")), F.lit(" and so it was."))
    o = texts(spark, d, "orders", ("o_orderkey",)).select("o_orderkey", text.alias("text"))
    return prose_triples(o, "o_orderkey").select("o_orderkey", "subject", "predicate", "object", "subject_type", "object_type")


ASKED = "Why was the CNC Mill 3 of Apex Materials late? See DISPATCH-17."


def _record_graph(spark, d):
    triples = record_triples(_records(spark, d))
    return nodes_of(triples, ["doc_id", "line", "field"]), edges_of(triples, ["doc_id", "line", "field"])


def _context_query(spark, d):
    nodes, edges = _record_graph(spark, d)
    return context_lines(nodes, edges, ["CNC Mill 3", "Apex Materials", "DISPATCH-17"]).select("entity", "node", "mention_count", "direction", "line")


def _question_nodes(spark, d):
    nodes, _ = _record_graph(spark, d)
    return nodes_in_question(nodes, ASKED).select("node", "mention_count")


def _mention_query(spark, d):
    asked = spark.createDataFrame([("CNC_Mill-3",), ("late 1",), ("Apex Materials",)], "entity string")
    return mentions(_records(spark, d), asked).select("doc_id", "entity")


def _export_query(spark, d):
    nodes, edges = _record_graph(spark, d)
    n = graph_export(nodes).select(F.lit("node").alias("kind"), "node", F.lit(None).cast("string").alias("target"), "label", F.col("size").cast("long").alias("size"), "colour")
    return n.unionByName(edge_export(edges).select(F.lit("edge").alias("kind"), F.col("subject").alias("node"), F.col("object").alias("target"), "label", F.col("width").cast("long").alias("size"), F.lit(None).cast("string").alias("colour")))


QUERIES = {
    "graph_export": _export_query,
    "graph_context": _context_query,
    "graph_question_nodes": _question_nodes,
    "graph_mentions": _mention_query,
    "record_triples": _record_query,
    "graph_edges": _edge_query,
    "order_graph": order_graph,
    "graph_degree": _degree_query,
    "graph_bfs2": _bfs_query,
    "graph_match_nodes": _match_query,
    "graph_evidence": _evidence_query,
    "prose_triples": _prose_query,
}

_REC = "SELECT o_orderkey AS doc_id, 1::BIGINT AS line, 'DISPATCH-' || o_orderkey AS subject, unnest(['supplied_by', 'has_status', 'delayed_because']) AS predicate, unnest(['Apex_Materials', o_orderstatus, 'late ' || o_orderpriority]) AS object, 'Order' AS subject_type FROM orders UNION ALL SELECT o_orderkey, 2, 'CNC-Mill-' || (o_custkey % 9), unnest(['located_in', 'note']), unnest(['Chicago_Plant', 'ok']), 'Machine' FROM orders"
_GRAPH = "SELECT DISTINCT 'customer-' || o_custkey AS subject, 'ordered' AS predicate, 'product-' || l_partkey AS object FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT DISTINCT 'supplier-' || l_suppkey, 'supplies', 'product-' || l_partkey FROM lineitem UNION ALL SELECT 'customer-' || c_custkey, 'located_in', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_EDGES = f"SELECT subject, object, count(*)::BIGINT AS weight, min(predicate) AS predicates FROM ({_REC}) GROUP BY ALL"
_ENDS = f"SELECT node, count(*) AS mention_count FROM (SELECT unnest([subject, object]) AS node FROM ({_REC})) GROUP BY node"
ORACLES = {
    "graph_export": f"SELECT 'node' AS kind, node, NULL::VARCHAR AS target, replace(node, '_', ' ') AS label, 15 + least(3 * mention_count, 30)::BIGINT AS size, CASE WHEN starts_with(node, 'DISPATCH-') THEN '#2ecc71' WHEN starts_with(node, 'CNC-Mill-') THEN '#3498db' ELSE '#95a5a6' END AS colour FROM ({_ENDS}) UNION ALL SELECT 'edge', subject, object, replace(predicates, '_', ' '), least(weight, 5)::BIGINT, NULL FROM ({_EDGES})",
    "graph_context": f"WITH n AS ({_ENDS}), a(entity, want) AS (VALUES ('CNC Mill 3', 'cnc_mill_3'), ('Apex Materials', 'apex_materials'), ('DISPATCH-17', 'dispatch_17')), r AS (SELECT entity, node, mention_count, CASE WHEN f = want THEN 0 WHEN starts_with(f, want) THEN 1 ELSE 2 END AS m FROM (SELECT *, lower(replace(replace(node, '-', '_'), ' ', '_')) AS f FROM n), a WHERE contains(f, want)), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY m, node) <= 3) SELECT DISTINCT entity, node, mention_count, 'out' AS direction, '-> ' || replace(predicates, '_', ' ') || ' ' || replace(object, '_', ' ') AS line FROM ({_EDGES}) JOIN b ON subject = node UNION ALL SELECT DISTINCT entity, node, mention_count, 'in', '<- ' || replace(subject, '_', ' ') || ' ' || replace(predicates, '_', ' ') FROM ({_EDGES}) JOIN b ON object = node",
    "graph_question_nodes": f"SELECT node, mention_count FROM ({_ENDS}) WHERE length(node) >= 3 AND (contains(lower('{ASKED}'), lower(replace(node, '_', ' '))) OR contains(lower('{ASKED}'), lower(node)))",
    "graph_mentions": "SELECT o_orderkey AS doc_id, entity FROM orders, (VALUES ('CNC_Mill-3'), ('late 1'), ('Apex Materials')) AS e(entity) WHERE entity = 'Apex Materials' OR (entity = 'late 1' AND starts_with(o_orderpriority, '1'))",
    "record_triples": _REC,
    "graph_edges": _EDGES,
    "order_graph": _GRAPH,
    "graph_degree": f"SELECT node, count(*) AS degree FROM (SELECT unnest([subject, object]) AS node FROM ({_GRAPH})) GROUP BY node",
    "graph_bfs2": f"WITH g AS ({_GRAPH}), b AS (SELECT subject AS a, object AS b FROM g UNION ALL SELECT object, subject FROM g), s AS (SELECT 'supplier-1' AS node, 0 AS hops UNION ALL SELECT b, 1 FROM b WHERE a = 'supplier-1' UNION ALL SELECT y.b, 2 FROM b x JOIN b y ON x.b = y.a WHERE x.a = 'supplier-1') SELECT node, min(hops)::BIGINT AS hops FROM s GROUP BY node",
    "graph_match_nodes": f"SELECT subject AS node, 1::BIGINT AS \"match\", 'Machine' AS entity_type, count(*) AS mention_count FROM ({_REC}) WHERE subject_type = 'Machine' GROUP BY subject",
    "graph_evidence": f"WITH e AS (SELECT subject, replace(subject || ' ' || predicates || ' ' || object, '_', ' ') AS content FROM ({_EDGES})), q AS (SELECT list_filter({T.terms_sql(chr(39) + 'Why was dispatch 17 late, and urgent?' + chr(39))}, lambda x: length(x) >= 3) AS q), h AS (SELECT subject, content, len(list_intersect({T.terms_sql('content')}, q))::BIGINT AS hits, len(q) AS n FROM e, q) SELECT subject, content, hits, round(least(1.0::DOUBLE, hits::DOUBLE / n), 6) AS score FROM h WHERE hits > 0 ORDER BY hits DESC, content LIMIT 6",
    "prose_triples": "SELECT o_orderkey, replace(s, '{}', o_orderkey::VARCHAR) AS subject, predicate, replace(o, '{}', o_orderkey::VARCHAR) AS object, subject_type, object_type FROM orders JOIN (VALUES "
    + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in p[1:]) + ")" for i, p in enumerate(PROSE_SENTENCES))
    + f") AS t(i, s, predicate, o, subject_type, object_type) ON o_orderkey % {len(PROSE_SENTENCES)} = i",
}
