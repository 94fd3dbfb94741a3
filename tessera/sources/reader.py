"""Ingestion: files of many kinds to one documents schema, tagged."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import tagging
from tessera.sources import binary, markup, mime, splits, tables

COLUMNS = ("doc_id", "source", "part", "text", "file_type", "detected_format", "meta", "error")


def _row(df: DataFrame, kind: str, detected=None, meta=None, error=None) -> DataFrame:
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        T.doc_id(F.col("source"), F.col("part")).alias("doc_id"), "source", F.col("part").cast("int").alias("part"), "text", F.lit(kind).alias("file_type"),
        (none if detected is None else detected).alias("detected_format"), (empty if meta is None else meta).alias("meta"), (none if error is None else error).alias("error"),
    )


def _texts(spark: SparkSession, path: str, names: list[str], recursive: bool) -> DataFrame:
    """Text files in byte ranges, split by their sniffed format."""
    found = splits.text_records(spark, path, _glob(names), recursive)
    plain, log, mail = (found[kind].withColumnRenamed(column, "part") for kind, column in (("plain", "section_index"), ("log", "entry"), ("email", "message")))
    stamp = F.map_filter(F.create_map(F.lit("timestamp"), F.col("timestamp"), F.lit("log_level"), F.col("level"), F.lit("entry_id"), F.col("entry_id")), lambda k, v: v.isNotNull())
    heads = F.map_filter(F.create_map(*[x for n in ("from", "to", "date", "subject") for x in (F.lit(f"email_{n}"), F.col(f"email_{n}"))]), lambda k, v: v.isNotNull())
    return _row(plain, "txt", F.lit("plain")).unionByName(_row(log, "txt", F.lit("log"), stamp)).unionByName(_row(mail, "txt", F.lit("email"), heads))


def _glob(names: list[str]) -> str:
    """Files of these extensions, in any case of letters."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names) + "}"


def ingest(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Tagged documents of all readable files under ``path``. Unknown kinds give nothing; errors are rows with ``error``."""
    wanted = [e for e in (extensions or list(mime.READER_OF)) if e in mime.READER_OF]
    kinds = {r for r in map(mime.READER_OF.get, wanted)}
    names = lambda kind: [e for e in wanted if mime.READER_OF[e] == kind]
    # A file is listed and read by the branch of its kind alone.
    of = lambda kind: binary.read_binary(spark, path, _glob(names(kind)), recursive).select("path", "content", mime.extension(F.col("path")).alias("ext"))
    whole = lambda kind: of(kind).select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    one = lambda df: df.withColumn("part", F.lit(0))
    out = []
    if "text" in kinds:
        out.append(_texts(spark, path, names("text"), recursive))
    if "html" in kinds:
        pages = markup.html_documents(whole("html").withColumnRenamed("text", "html"), "source")
        out.append(_row(one(pages), "html", meta=F.create_map(F.lit("title"), F.col("title"))))
    if "code" in kinds:
        code = tables.code_documents(whole("code"))
        out.append(_row(one(code), "code", meta=F.create_map(F.lit("language"), F.col("language"), F.lit("line_count"), F.col("line_count").cast("string"))))
    if "structured" in kinds:
        data = of("structured").select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "ext")
        for kind, own in (("json", ["json"]), ("yaml", ["yaml", "yml"])):
            out.append(_row(one(tables.flatten_documents(data.where(F.col("ext").isin(own)), "source", "text", kind)), kind, error=F.col("error")))
    for kind, parser in binary.PARSERS.items():
        if kind in kinds:
            out.append(_row(binary.parsed(of(kind), parser), kind, meta=F.col("meta"), error=F.col("error")))
    for kind in ("image", "audio", "video"):
        if kind in kinds:
            out.append(_row(binary.parsed(of(kind), binary.media_parts(kind.capitalize()), named=True), kind, meta=F.col("meta"), error=F.col("error")))
    if "csv" in kinds:
        out.append(_csv(spark, path, names("csv"), recursive))
    every = functools.reduce(lambda a, b: a.unionByName(b), out)
    return tagging.tag_documents(every, detected="detected_format")


def _csv(spark: SparkSession, path: str, names: list[str], recursive: bool) -> DataFrame:
    """Row documents of CSV files, each under its own header, read in byte ranges."""
    rows = splits.csv_records(spark, path, _glob(names), recursive)
    meta = F.create_map(F.lit("row_index"), F.col("row").cast("string"), F.lit("total_rows"), F.col("total_rows").cast("string"), F.lit("mode"), F.lit("row"))
    texts = rows.select("source", F.col("row").alias("part"), splits.named_values(F.col("names"), F.col("fields")).alias("text"), "row", "total_rows")
    return _row(texts.where(F.trim("text") != ""), "csv", meta=meta)
