"""CSV rows and columns as documents, warehouse loading, JSON and YAML flattening, source code."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import mime


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, **options).csv(path)


def row_text(df: DataFrame, template: str | None = None) -> Column:
    """``column: value`` lines of the columns that are not empty, or a filled template.

    A template with a name that is no column falls back to the lines.
    """
    names = re.findall(r"\{(\w+)\}", template or "")
    if template and all(n in df.columns for n in names):
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("\n", *[F.when(value(c) != "", F.concat(F.lit(f"{c}: "), value(c))) for c in df.columns])


def row_documents(df: DataFrame, order: str, template: str | None = None) -> DataFrame:
    """(row key, text) of the rows that are not blank: a projection, with the table's own key as the index."""
    return df.select(F.col(order), row_text(df, template).alias("text")).where(F.trim("text") != "")


def column_documents(df: DataFrame, order: str) -> DataFrame:
    """(column, row_count, text): ``Column: name`` and ``  [i] value`` lines, blanks left out but counted."""
    columns = [c for c in df.columns if c != order]
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])
    flat = df.select(F.col(order).alias("o"), F.explode(values).alias("x")).select("o", "x.*")
    listed = flat.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("p"))
    lines = F.filter(F.transform("p", lambda x, i: F.when(F.trim(x["v"]) != "", F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), x["v"]))), lambda s: s.isNotNull())
    return listed.select("column", F.size("p").alias("row_count"), F.concat_ws("\n", F.concat(F.lit("Column: "), F.col("column")), F.array_join(lines, "\n")).alias("text"))


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def load_warehouse(spark: SparkSession, path: str, name: str, schema: str | None = None, mode: str = "replace") -> DataFrame:
    """A CSV file as a table: columns in snake case; replace, append or fail; an empty file is an error."""
    if mode not in ("replace", "append", "fail"):
        raise ValueError("mode is replace, append or fail")
    df = (spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)).option("header", True).csv(path)
    df = df.toDF(*[snake(c) for c in df.columns])
    if not df.limit(1).count():
        raise ValueError(f"no rows in {path}")
    df.write.mode({"replace": "overwrite", "append": "append", "fail": "errorifexists"}[mode]).saveAsTable(name)
    return spark.table(name)


def flatten(value, prefix: str = "") -> list[str]:
    """``path: value`` lines of a nested value."""
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in flatten(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [line for i, v in enumerate(value) for line in flatten(v, f"{prefix}[{i}]")]
    return [f"{prefix}: {value}"]


def flatten_documents(docs: DataFrame, key: str, text: str, kind: str = "json") -> DataFrame:
    """(key, text, error) with nested JSON or YAML as lines. Depth is unbounded, so this walks values in Arrow batches.

    A text that does not parse gives a null text and the reason in ``error``; the other rows are not touched by it.
    """
    dtype = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kind == "yaml":
            import yaml

            quick = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

            def parse(t: str):
                try:
                    return yaml.load(t, quick)
                except yaml.YAMLError:  # what libyaml refuses is for the slower parser to judge
                    return yaml.safe_load(t)
        else:
            parse = json.loads

        def lines_of(t: str | None) -> tuple[str | None, str | None]:
            try:
                return (None if t is None else "\n".join(flatten(parse(t)))), None
            except Exception as problem:  # noqa: BLE001 - one bad file is one bad row
                return None, f"{type(problem).__name__}: {str(problem)[:200]}"

        for b in batches:
            out = [lines_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[key, "text", "error"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dtype}, text string, error string")


def code_documents(files: DataFrame) -> DataFrame:
    """(source, text) files with language, modality and line count."""
    return files.select("source", "text", mime.language(F.col("source")).alias("language"), F.lit("code").alias("modality"), F.size(F.split("text", "\n")).alias("line_count"))
