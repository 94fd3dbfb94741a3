"""Document tagging: type, category, priority, dates and entities as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table, texts

# Keyword banks in the order in which they win ties, and priority signals.
TYPE_BANKS = {
    "log": ["timestamp", "log level", "error", "warning", "info", "debug", "critical", "traceback", "stack trace", "exception"],
    "email": ["from:", "to:", "subject:", "date:", "dear ", "sincerely", "best regards", "sent from", "reply-to"],
    "contract": ["agreement", "herein", "whereas", "party", "obligations", "termination", "indemnif", "liability", "governing law", "executed", "witness", "clause", "amendment"],
    "order": ["order id", "order number", "quantity", "unit price", "total", "shipping", "invoice", "sku", "purchase order", "line item", "dispatch", "delivery", "shipment", "tracking"],
    "report": ["summary", "analysis", "findings", "recommendation", "conclusion", "executive summary", "overview", "quarterly", "annual", "metrics", "kpi", "performance"],
}
CATEGORY_BANKS = {
    "logistics": ["shipment", "dispatch", "warehouse", "delivery", "freight", "carrier", "route", "tracking", "pallet", "dock", "transit", "eta", "load", "unload"],
    "finance": ["invoice", "payment", "revenue", "expense", "budget", "profit", "margin", "cost", "balance", "ledger", "accounts", "fiscal", "tax"],
    "hr": ["employee", "onboarding", "payroll", "benefits", "leave", "performance review", "hiring", "termination", "pto"],
    "legal": ["contract", "agreement", "clause", "liability", "compliance", "regulation", "statute", "litigation", "indemnif"],
    "operations": ["maintenance", "production", "schedule", "inventory", "quality", "downtime", "capacity", "throughput"],
    "customer_service": ["complaint", "ticket", "resolution", "sla", "escalat", "customer", "support", "feedback", "satisfaction"],
}
HIGH = [r"\bURGENT\b", r"\bCRITICAL\b", r"\bASAP\b", r"\bIMMEDIATE\b", r"\bESCALAT", r"\bSEVERE\b", r"\bBLOCK(?:ED|ING|ER)\b", r"\bOUTAGE\b", r"\bDOWNTIME\b", r"\bERROR\b"]
LOW = [r"\bFYI\b", r"\binformational\b", r"\broutine\b", r"\bminor\b", r"\bno.action.required\b"]
LEAST = 2


def bank_score(low: Column, bank: list[str]) -> Column:
    """How many of the keywords the lower-cased text contains, as substrings."""
    return F.size(F.filter(T.strings(bank), lambda k: F.contains(low, k)))


def best_bank(low: Column, banks: dict[str, list[str]]) -> Column:
    """The bank with most hits; earlier banks win ties; fewer than two hits are ``general``."""
    ranked = F.array(*[F.struct((-bank_score(low, b)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, b) in enumerate(banks.items())])
    best = F.array_min(ranked)
    return F.when(-best["s"] >= LEAST, best["name"]).otherwise(F.lit("general"))


def _plain(rule: str) -> str:
    """The longest run of letters that every match of a rule holds, lower-cased."""
    return max(re.findall(r"[a-z]+", re.sub(r"\(.*?\)|\\b", " ", rule).lower()), key=len)


def priority(text: Column, low: Column | None = None) -> Column:
    """The text's urgency; ``low`` is the text lower-cased, where the plain words are looked for before any pattern runs."""
    low = F.lower(text) if low is None else low
    hits = lambda rules: sum((F.when(F.contains(low, F.lit(_plain(r))) & text.rlike(T.ascii_edges("(?i)" + r)), 1).otherwise(0) for r in rules), F.lit(0))
    high, low = hits(HIGH), hits(LOW)
    return F.when(high >= 2, "high").when((high == 1) & (low == 0), "medium").when((low >= 1) & (high == 0), "low").otherwise("medium")


def tag_documents(docs: DataFrame, text: str = "text", detected: str | None = None) -> DataFrame:
    """``docs`` with type, category, priority, dates and entities.

    ``detected`` names a column with the loader's format; log and email there win over the keywords.
    """
    body, low = F.coalesce(F.col(text), F.lit("")), F.col("__low")
    # Lower-cased in a projection of its own: inside the lambdas it would be done again for every keyword.
    lowered = docs.withColumn("__low", F.lower(body))
    kind = best_bank(low, TYPE_BANKS)
    if detected:
        kind = F.when(F.col(detected).isin("log", "email"), F.col(detected)).otherwise(kind)
    return lowered.withColumns({"type": kind, "category": best_bank(low, CATEGORY_BANKS), "priority": priority(body, low), "dates": T.dates(body), "entities": T.names(body)}).drop("__low")


def _tag_query(spark: SparkSession, d: str) -> DataFrame:
    out = tag_documents(texts(spark, d))
    return out.select("doc_id", "type", "category", "priority", F.size("dates").cast("long").alias("n_dates"), F.size("entities").cast("long").alias("n_entities"))


def _tagged_records(spark: SparkSession, d: str) -> DataFrame:
    """Tags of sentences built from the star schema, which hold every cue."""
    o = texts(spark, d, "orders", ("o_orderkey", "o_orderdate", "o_orderstatus"))
    text = F.concat(F.lit("Order number PO-"), F.col("o_orderkey").cast("string"), F.lit(" total quantity invoice. Delivery and shipment on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" by Apex Materials; "), F.when(F.col("o_orderstatus") == "P", "URGENT outage, ESCALATION").when(F.col("o_orderstatus") == "F", "routine, no action required").otherwise("error in warehouse"))
    out = tag_documents(o.select("o_orderkey", text.alias("text")))
    return out.select("o_orderkey", "type", "category", "priority", F.concat_ws("|", "dates").alias("dates"), F.concat_ws("|", "entities").alias("entities"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """All seven kinds of entities in a sentence made of each order."""
    place = F.when(F.col("o_orderstatus") == "F", "Port Delta").when(F.col("o_orderstatus") == "O", "Omega").otherwise("North Pier")
    said = F.concat(
        F.lit("Supplier Firm"), F.col("o_custkey").cast("string"), F.lit(" delayed it on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("; it lies at "), place,
        F.lit(" warehouse. See ord-100"), F.col("o_orderkey").cast("string"), F.lit(' and "'), F.col("o_orderpriority"), F.lit('" on LINE-'), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit(" after the outage."),
    )
    o = texts(spark, d, "orders", ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")).select("o_orderkey", T.extracted(said).alias("e"))
    joined = lambda kind, name: F.concat_ws("|", f"e.{kind}").alias(name)
    return o.select("o_orderkey", joined("suppliers", "suppliers"), joined("dates", "dates"), joined("locations", "locations"), joined("order_ids", "order_ids"), joined("machine_ids", "machine_ids"), joined("quoted_entities", "quoted"), joined("concepts", "concepts"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", T.dates(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n_dates"), F.concat_ws("|", "x").alias("dates"))


QUERIES = {"tag_documents": _tag_query, "tag_records": _tagged_records, "extract_ids": _ids, "extract_dates": _dates}


def _best_sql(low: str, banks: dict[str, list[str]]) -> str:
    rows = ", ".join("{'s': -len(list_filter(" + T.strings_sql(b) + f", lambda k: contains({low}, k))), 'i': {i}, 'name': '{n}'" + "}" for i, (n, b) in enumerate(banks.items()))
    return f"(SELECT CASE WHEN -b.s >= {LEAST} THEN b.name ELSE 'general' END FROM (SELECT list_min([{rows}]) AS b))"


def _priority_sql(e: str) -> str:
    hits = lambda rules: " + ".join(f"(regexp_matches({e}, '(?i){r}'))::INT" for r in rules)
    return f"(SELECT CASE WHEN h >= 2 THEN 'high' WHEN h = 1 AND l = 0 THEN 'medium' WHEN l >= 1 AND h = 0 THEN 'low' ELSE 'medium' END FROM (SELECT {hits(HIGH)} AS h, {hits(LOW)} AS l))"


def _distinct_sql(e: str) -> str:
    """Distinct in first-seen order."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def _dates_sql(e: str) -> str:
    return _distinct_sql(f"list_transform(regexp_extract_all({e}, '(?i){T.DATE_FORMS}'), lambda x: trim(x))")


def _names_sql(e: str) -> str:
    found = _distinct_sql(f"regexp_extract_all({e}, '{T.NAME_FORMS}')")
    return f"list_filter({found}, lambda x: length(x) >= 3 AND NOT list_contains({T.strings_sql(T.NAME_STOPS)}, x))"


_RECORDS_SQL = "SELECT o_orderkey, 'Order number PO-' || o_orderkey || ' total quantity invoice. Delivery and shipment on ' || strftime(o_orderdate, '%Y-%m-%d') || ' by Apex Materials; ' || CASE o_orderstatus WHEN 'P' THEN 'URGENT outage, ESCALATION' WHEN 'F' THEN 'routine, no action required' ELSE 'error in warehouse' END AS text FROM orders"
ORACLES = {
    "tag_documents": f"SELECT doc_id, {_best_sql('lower(text)', TYPE_BANKS)} AS type, {_best_sql('lower(text)', CATEGORY_BANKS)} AS category, {_priority_sql('text')} AS priority, len({_dates_sql('text')})::BIGINT AS n_dates, len({_names_sql('text')})::BIGINT AS n_entities FROM documents",
    "tag_records": f"SELECT o_orderkey, {_best_sql('lower(text)', TYPE_BANKS)} AS type, {_best_sql('lower(text)', CATEGORY_BANKS)} AS category, {_priority_sql('text')} AS priority, array_to_string({_dates_sql('text')}, '|') AS dates, array_to_string({_names_sql('text')}, '|') AS entities FROM ({_RECORDS_SQL})",
    "extract_dates": f"SELECT doc_id, len({_dates_sql('text')})::BIGINT AS n_dates, array_to_string({_dates_sql('text')}, '|') AS dates FROM documents",
    "extract_ids": "SELECT o_orderkey, 'Firm' || o_custkey AS suppliers, strftime(o_orderdate, '%Y-%m-%d') AS dates, CASE o_orderstatus WHEN 'F' THEN 'Port Delta' WHEN 'O' THEN 'Omega' ELSE 'North Pier' END AS locations, 'ORD-100' || o_orderkey AS order_ids, 'LINE-' || (o_custkey % 90 + 10) AS machine_ids, o_orderpriority AS quoted, 'delay|outage' AS concepts FROM orders",
}
