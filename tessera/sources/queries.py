"""Registered queries of the sources over columns of the driver tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tessera.session import table, texts, work_dir
from tessera.sources import binary, markup, mime, reader, splits, tables, text


def _csv_rows(spark, d):
    return tables.row_documents(table(spark, d, "nation"), "n_nationkey")


def _csv_columns(spark, d):
    return tables.column_documents(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey").select("column", F.col("row_count").cast("long").alias("row_count"), "text")


def _log(spark, d):
    o = texts(spark, d, "orders", ("o_orderkey", "o_orderdate", "o_orderpriority")).select(
        "o_orderkey",
        F.concat(F.lit("intro\n\n[2024-01-12 08:00] ERROR PO-4521 | it failed\n  more of it\n"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 09:30:00 - started "), F.col("o_orderpriority"), F.lit("\nfrom here\n[2024-01-12 10:00] done\n")).alias("text"),
    )
    return text.log_entries(o, "o_orderkey", "text").select("o_orderkey", F.col("entry").cast("long").alias("entry"), "timestamp", "level", "entry_id", "message")


def _sniff(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("From: a@b\nSubject: x\n\n"), "text")).when(F.col("turn") % 3 == 1, F.lit("2024-01-12 08:00 a\n2024-01-12 08:01 b\n2024-01-12 08:02 c")).otherwise(F.col("text")).alias("text"))
    return c.select("conv_id", "turn", text.sniff(F.col("text")).alias("format"))


def _mail(spark, d):
    """Every turn as a mailbox of two messages; a repeated header, and a subject in every second mailbox only."""
    subject = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Subject: about "), F.col("conv_id").cast("string"), F.lit("\n"))).otherwise("")
    box = F.concat(F.lit("From x@y Mon\nFrom: "), "role", F.lit("@b\nTo: q\nTo: c"), F.col("conv_id").cast("string"), F.lit("@d\n"), subject, F.lit("\nhello\nFrom z@y Tue\nFrom: e@f\nDate: "), F.col("turn").cast("string"), F.lit("\n\nbye"))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), box.alias("text"))
    return text.emails(c, "id", "text").select("id", F.col("message").cast("long").alias("message"), "email_from", "email_to", "email_date", "email_subject")


def _flat(spark, d):
    """Every event as a nested value, its props inside a list; every seventh is cut short and does not parse."""
    whole = F.concat(F.lit('{"event": {"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), "event_type", F.lit('", "tags": ['), F.col("user_id").cast("string"), F.lit(", "), "props", F.lit('], "ok": true}}'))
    body = F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return tables.flatten_documents(texts(spark, d, "events", ("event_id", "event_type", "user_id", "props")).select("event_id", body.alias("body")), "event_id", "body").select("event_id", "text", F.col("error").isNotNull().alias("failed"))


def _yaml(spark, d):
    text = F.concat(F.lit("part:\n  name: '"), "p_name", F.lit("'\n  size: "), F.col("p_size").cast("string"), F.lit("\n  seen:\n    - "), "p_brand", F.lit("\n    - key: "), F.col("p_partkey").cast("string"))
    return tables.flatten_documents(texts(spark, d, "part", ("p_partkey", "p_name", "p_size", "p_brand")).select("p_partkey", text.alias("body")), "p_partkey", "body", "yaml").drop("error")


# --- files made of rows, read as files ------------------------------------------------------


def _zipped(parts: Callable[..., dict[str, str]], *columns: str):
    """A Column of zip archives, one a row, with the members that ``parts`` makes of the columns."""

    @F.pandas_udf("binary")
    def make(rows: pd.DataFrame) -> pd.Series:
        made = []
        for row in rows.itertuples(index=False):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for name, body in parts(*row).items():
                    z.writestr(name, body)
            made.append(held.getvalue())
        return pd.Series(made)

    return make(F.struct(*columns)).alias("content")


def _file(name: str, key: str):
    return F.concat(F.lit("/in/"), F.col(key).cast("string"), F.lit("." + name)).alias("path")


def _docx(spark, d):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"

    def body(key, name, segment):
        cells = "".join(f"<w:tc>{p(t)}</w:tc>" for t in (str(key), segment, ""))
        return {"word/document.xml": f"<w:document {w}><w:body>{p(name)}{p('')}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>"}

    files = texts(spark, d, "customer", ("c_custkey", "c_name", "c_mktsegment")).select(_file("docx", "c_custkey"), _zipped(body, "c_custkey", "c_name", "c_mktsegment"))
    return binary.parsed(files, binary.docx_parts).select("source", "text", F.col("meta")["paragraph_count"].alias("paragraphs"), "error")


def _pptx(spark, d):
    ns = "xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main' xmlns:p='http://schemas.openxmlformats.org/presentationml/2006/main'"

    def slide(text, kind=""):
        return f"<p:sld {ns}><p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"

    def body(key, name, brand):
        notes = {"ppt/notesSlides/notesSlide2.xml": slide(brand, "<p:ph type='body'/>")} if key % 2 else {}
        return {"ppt/slides/slide10.xml": slide(str(key)), "ppt/slides/slide2.xml": slide(name), **notes}

    files = texts(spark, d, "part", ("p_partkey", "p_name", "p_brand")).select(_file("pptx", "p_partkey"), _zipped(body, "p_partkey", "p_name", "p_brand"))
    m = F.col("meta")
    return binary.parsed(files, binary.pptx_parts).select("source", F.col("part").cast("long").alias("part"), "text", m["slide_number"].alias("slide"), m["has_notes"].alias("notes"))


def _xlsx(spark, d):
    s = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def body(key, name, balance):
        return {
            "xl/workbook.xml": f"<workbook {s} xmlns:r='{r}'><sheets><sheet name='Sheet {key}' r:id='r1'/></sheets></workbook>",
            "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r1' Target='worksheets/a.xml'/></Relationships>",
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><t>balance</t></si><si><t>{escape(name)}</t></si></sst>",
            "xl/worksheets/a.xml": f"<worksheet {s}><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row><c r='A2' t='s'><v>2</v></c><c r='B2'><v>{balance}</v></c></row></sheetData></worksheet>",
        }

    rows = texts(spark, d, "supplier", ("s_suppkey", "s_name", "s_nationkey")).select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    files = rows.select(_file("xlsx", "s_suppkey"), _zipped(body, "s_suppkey", "s_name", "s_nationkey"))
    m = F.col("meta")
    return binary.parsed(files, binary.xlsx_parts).select("source", "text", m["sheet_name"].alias("sheet"), m["row_count"].alias("rows"), m["column_count"].alias("columns"))


def _broken(spark, d):
    """Customers whose files are no archives in every third case: a row each, with text or with an error."""
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    made = _zipped(lambda key: {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>{key}</w:t></w:r></w:p></w:body></w:document>"}, "c_custkey")
    files = texts(spark, d, "customer", ("c_custkey",)).select(_file("docx", "c_custkey"), F.when(F.col("c_custkey") % 3 == 0, F.lit(b"no archive")).otherwise(made).alias("content"))
    return binary.parsed(files, binary.docx_parts).select("source", "text", F.col("error").isNotNull().alias("failed"))


def _media(spark, d):
    files = table(spark, d, "supplier").select(_file("png", "s_suppkey"), F.col("s_name").cast("binary").alias("content"))
    said = binary.parsed(files, binary.media_parts("Image", lambda data: data.decode() if data[-1] % 2 else ""), named=True)
    return said.select("source", "text", F.col("meta")["has_text"].alias("has_text"))


def _code(spark, d):
    files = table(spark, d, "conversations").select(F.concat(F.lit("/in/"), "conv_id", F.lit("_"), "turn", F.when(F.col("turn") % 2 == 0, ".py").otherwise(".sql")).alias("source"), "text")
    return tables.code_documents(files).select("source", "language", "modality", F.col("line_count").cast("long").alias("line_count"))


def _folder(spark, d):
    """Nations written as CSV, orders of each status as text files; the folder is then ingested."""
    root = f"{work_dir(spark)}/folder-{spark.sparkContext.applicationId}"
    table(spark, d, "nation").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/tables")
    notes = table(spark, d, "region").select(F.concat(F.lit("First of "), "r_name", F.lit("\n\nSecond of "), "r_name").alias("value"), F.col("r_regionkey").alias("at"))
    notes.write.mode("overwrite").partitionBy("at").text(f"{root}/notes")
    found = reader.ingest(spark, root, ["csv", "txt"])
    return found.select("file_type", F.col("part").cast("long").alias("part"), "text", F.col("error").isNotNull().alias("failed"))


#: Lines of a part of a written file, about.
PART_ROWS = 500_000


def _written(rows, key: str, order: list[str], n: int) -> str:
    """About ``n`` lines of a column ``value`` as one text for each ``key``, in parts whose numbers follow the order; the folder. No task sorts or writes a whole text."""
    spark = rows.sparkSession
    root = f"{work_dir(spark)}/files-{uuid.uuid4().hex}"
    pieces = max(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    rows.repartitionByRange(pieces, key, *order).sortWithinPartitions(key, *order).select(key, "value").write.partitionBy(key).text(root)
    return root


def _log_files(spark, d):
    """All events as logs, one for each type, an entry over three lines; written in parts and read back in byte ranges."""
    e = table(spark, d, "events")
    level = F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "info", "WARNING")]), (F.col("event_id") % 3 + 1).cast("int"))
    value = F.concat(F.lit("[2024-01-12 08:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("] "), level, F.lit(" | PO-"), (F.col("event_id") + 1000).cast("string"), F.lit(" | user "), F.col("user_id").cast("string"), F.lit("\n  at "), "props", F.lit("\n"))
    root = _written(e.select("event_type", "event_id", value.alias("value")), "event_type", ["event_id"], e.count())
    log = splits.text_records(spark, root, parts=True)["log"]
    return log.select(F.regexp_extract("source", "event_type=([^/]*)", 1).alias("event_type"), F.col("entry").cast("long").alias("entry"), "timestamp", "level", "entry_id", "message")


def _csv_files(spark, d):
    """All orders as CSV, a text for each status, with values over two lines; written in parts and read back in byte ranges."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority")
    row = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"say ""'), "o_orderpriority", F.lit('"",\nand go",'))
    rows = o.select("o_orderstatus", "o_orderkey", row.alias("value"))
    heads = o.select("o_orderstatus").distinct().select("o_orderstatus", F.lit(-1).cast("long").alias("o_orderkey"), F.lit("key,note,empty").alias("value"))
    found = splits.csv_records(spark, _written(rows.unionByName(heads), "o_orderstatus", ["o_orderkey"], o.count()), "*.txt", parts=True)
    status = F.regexp_extract("source", "o_orderstatus=([^/]*)", 1)
    return found.select(status.alias("o_orderstatus"), "row", "total_rows", splits.named_values(F.col("names"), F.col("fields")).alias("text"))


def _title(spark, d):
    return table(spark, d, "pages").select("page_id", markup.title(F.col("html")).alias("title"))


def _html(spark, d):
    return table(spark, d, "pages").select("page_id", markup.flat_text(F.col("html")).alias("text"))


def _visible(spark, d):
    return markup.html_documents(table(spark, d, "pages"), "page_id")


def _mime(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("/x/File."), F.element_at(F.array(*[F.lit(x) for x in ("TXT", "pdf", "xlsx", "exe", "zzz", "py")]), (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    k = mime.classify(F.col("path"))
    return p.select("page_id", k["ext"].alias("ext"), k["category"].alias("category"), k["loader"].alias("loader"), k["blocked"].alias("blocked"), mime.language(F.col("path")).alias("language"))


def _sections(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("one \n\n\n two\n"), "text", F.lit("\n\n  \n\nend")).alias("text"))
    return text.plain_sections(c, "id", "text").select("id", F.col("section_index").cast("long").alias("section_index"), "text")


QUERIES = {
    "csv_row_docs": _csv_rows,
    "csv_column_docs": _csv_columns,
    "log_entries": _log,
    "sniff_format": _sniff,
    "email_messages": _mail,
    "plain_sections": _sections,
    "json_flatten": _flat,
    "yaml_flatten": _yaml,
    "docx_files": _docx,
    "pptx_files": _pptx,
    "xlsx_files": _xlsx,
    "broken_files": _broken,
    "image_files": _media,
    "code_files": _code,
    "ingest_folder": _folder,
    "log_files": _log_files,
    "csv_files": _csv_files,
    "html_title": _title,
    "html_text": _html,
    "html_documents": _visible,
    "mime_classify": _mime,
}

_TAGS = "html"
for _t in markup.DROPPED:
    _TAGS = f"regexp_replace({_TAGS}, '(?is)<{_t}\\b.*?</{_t}\\s*>', ' ', 'g')"
_TAGS = f"regexp_replace(regexp_replace({_TAGS}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
ORACLES = {
    "csv_row_docs": "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS text FROM nation",
    "csv_column_docs": "WITH v AS (SELECT 'n_name' AS \"column\", n_name AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation UNION ALL SELECT 'n_regionkey', n_regionkey::VARCHAR, row_number() OVER (ORDER BY n_nationkey) - 1 FROM nation) SELECT \"column\", count(*) AS row_count, 'Column: ' || \"column\" || chr(10) || string_agg('  [' || i || '] ' || v, chr(10) ORDER BY i) AS text FROM v GROUP BY \"column\"",
    "log_entries": "SELECT o_orderkey, unnest([0, 1, 2, 3])::BIGINT AS entry, unnest([NULL, '2024-01-12 08:00', strftime(o_orderdate, '%Y-%m-%d') || ' 09:30:00', '2024-01-12 10:00']) AS timestamp, unnest([NULL, 'ERROR', NULL, NULL]) AS level, unnest([NULL, 'PO-4521', NULL, NULL]) AS entry_id, unnest(['intro ', 'it failed more of it', 'started ' || o_orderpriority || ' from here', 'done']) AS message FROM orders",
    "sniff_format": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'log' ELSE 'plain' END AS format FROM conversations",
    "email_messages": "SELECT conv_id * 1000 + turn AS id, unnest([0, 1])::BIGINT AS message, unnest([role || '@b', 'e@f']) AS email_from, unnest(['c' || conv_id || '@d', NULL]) AS email_to, unnest([NULL, turn::VARCHAR]) AS email_date, unnest([CASE WHEN turn % 2 = 0 THEN 'about ' || conv_id END, NULL]) AS email_subject FROM conversations",
    "plain_sections": "WITH p AS (SELECT conv_id * 1000 + turn AS id, list_filter(list_transform(string_split(regexp_replace('one ' || chr(10) || chr(10) || chr(10) || ' two' || chr(10) || text || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || 'end', '\\n{2,}', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM conversations) SELECT id, unnest(range(len(s))) AS section_index, unnest(s) AS text FROM p",
    "json_flatten": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'event.id: ' || event_id || chr(10) || 'event.type: ' || event_type || chr(10) || 'event.tags[0]: ' || user_id || chr(10) || 'event.tags[1].k: ' || json_extract_string(props, '$.k') || chr(10) || 'event.ok: True' END AS text, event_id % 7 = 0 AS failed FROM events",
    "yaml_flatten": "SELECT p_partkey, 'part.name: ' || p_name || chr(10) || 'part.size: ' || p_size || chr(10) || 'part.seen[0]: ' || p_brand || chr(10) || 'part.seen[1].key: ' || p_partkey AS text FROM part",
    "docx_files": "SELECT '/in/' || c_custkey || '.docx' AS source, c_name || chr(10) || c_custkey || ' | ' || c_mktsegment AS text, '2' AS paragraphs, NULL::VARCHAR AS error FROM customer",
    "pptx_files": "SELECT '/in/' || p_partkey || '.pptx' AS source, unnest([0, 1])::BIGINT AS part, unnest([p_name || CASE WHEN p_partkey % 2 = 1 THEN chr(10) || '[Notes] ' || p_brand ELSE '' END, p_partkey::VARCHAR]) AS text, unnest(['1', '2']) AS slide, unnest([(p_partkey % 2 = 1)::VARCHAR, 'false']) AS notes FROM part",
    "xlsx_files": "SELECT '/in/' || s_suppkey || '.xlsx' AS source, 'Sheet: Sheet ' || s_suppkey || chr(10) || 'Columns: name | balance' || chr(10) || 'name: ' || s_name || ' | balance: ' || s_nationkey AS text, 'Sheet ' || s_suppkey AS sheet, '1' AS rows, '2' AS columns FROM supplier",
    "broken_files": "SELECT '/in/' || c_custkey || '.docx' AS source, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS text, c_custkey % 3 = 0 AS failed FROM customer",
    "image_files": "SELECT '/in/' || s_suppkey || '.png' AS source, CASE WHEN ascii(right(s_name, 1)) % 2 = 1 THEN s_name ELSE '[Image: ' || s_suppkey || '.png]' END AS text, (ascii(right(s_name, 1)) % 2 = 1)::VARCHAR AS has_text FROM supplier",
    "code_files": "SELECT '/in/' || conv_id || '_' || turn || CASE WHEN turn % 2 = 0 THEN '.py' ELSE '.sql' END AS source, CASE WHEN turn % 2 = 0 THEN 'python' ELSE 'sql' END AS language, 'code' AS modality, len(string_split(text, chr(10)))::BIGINT AS line_count FROM conversations",
    "ingest_folder": "SELECT 'csv' AS file_type, row_number() OVER (ORDER BY n_nationkey) - 1 AS part, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS text, false AS failed FROM nation UNION ALL SELECT 'txt', unnest([0, 1]), unnest(['First of ', 'Second of ']) || r_name, false FROM region",
    "log_files": "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS entry, '2024-01-12 08:' || lpad((event_id % 60)::VARCHAR, 2, '0') AS timestamp, ['ERROR', 'INFO', 'WARNING'][(event_id % 3 + 1)::INT] AS level, 'PO-' || (event_id + 1000) AS entry_id, 'user ' || user_id || ' at ' || props || ' ' AS message FROM events",
    "csv_files": "SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row, count(*) OVER (PARTITION BY o_orderstatus) AS total_rows, 'key: ' || o_orderkey || chr(10) || 'note: say \"' || o_orderpriority || '\",' || chr(10) || 'and go' AS text FROM orders",
    "html_title": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages",
    "html_text": f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_TAGS}, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS text FROM pages",
    "mime_classify": "SELECT page_id, ['txt', 'pdf', 'xlsx', 'exe', 'zzz', 'py'][(page_id % 6 + 1)::INT] AS ext, ['text', 'document', 'table', 'unknown', 'unknown', 'code'][(page_id % 6 + 1)::INT] AS category, ['txt_loader', 'pdf_loader', 'excel_loader', NULL, NULL, 'code_loader'][(page_id % 6 + 1)::INT] AS loader, page_id % 6 = 3 AS blocked, CASE WHEN page_id % 6 = 5 THEN 'python' ELSE 'unknown' END AS language FROM pages",
}
# The pages hold these character references, some without their end, and others only in what is dropped.
_REFERENCES = (("&quot;?", '"'), ("&#x27;?", "''"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&"))


def _plain(e: str) -> str:
    for reference, character in _REFERENCES:
        e = f"regexp_replace({e}, '{reference}', '{character}', 'g')"
    return e


ORACLES["html_documents"] = f"SELECT page_id, {_plain('title')} AS title, {_plain('text')} AS text FROM ({ORACLES['html_text']}) JOIN ({ORACLES['html_title']}) USING (page_id) WHERE text <> ''"
