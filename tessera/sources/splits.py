"""Records of large text files: logs, mailboxes, paragraphs and CSV, read in byte ranges.

Spark cuts a text file into blocks and deals whole lines to the block in which they begin. A record may begin in one block and end
in another, so the files are read twice. The first pass tells of each block how many records begin in it, what comes before the first of them,
the first if it ends there, how the last begins, and, for CSV, whether a quoted value is open at its end for either state at its start. A prefix scan
over these borders, one row a block, gives each block its first number and its state; the second pass reads the records
that lie inside a block. No file passes through one task and only the pieces at borders move.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import work_dir
from tessera.sources import text

#: A block of a part file is numbered by the part and its first byte in it; parts are below so many bytes.
PART_BYTES = 1 << 42
#: Blocks that begin inside a quoted value and may be broadcast; beyond it lines are dealt anew by block.
BROADCAST_BLOCKS = 100_000
_SHAPE = "source string, block long, inside boolean, n long, head string, first string, tail string, ends boolean"
_RECORD = "source string, block long, k long, text string"

# A line that begins outside a quoted value and ends inside one; the rest of a quoted value up to its end.
_OPENED = re.compile(r'(?>(?:"(?>[^"]+|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?>[^"]+|"")*+\Z')
_QUOTED = re.compile(r'(?>[^"]+|"")*+')
_SKIPPED = re.compile(r"[^,]*+,")
_PART = r"/part-(\d+)[^/]*$"


def lines(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, parts: bool = False) -> DataFrame:
    """(source, block, at, line) of the files under ``path``; ``at`` sorts the lines of a block. Broken encodings are replaced.

    With ``parts`` a folder of part files, as Spark writes them, is one file: its parts follow each other by their numbers, and the folder is the source.
    """
    rows = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path)
    source, block = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"), F.col("_metadata.file_block_start")
    if parts:
        block = F.regexp_extract(source, _PART, 1).cast("long") * PART_BYTES + block
        source = F.regexp_replace(source, "/[^/]*$", "")
    return rows.select(source.alias("source"), block.alias("block"), F.monotonically_increasing_id().alias("at"), F.make_valid_utf8("value").alias("line"))


def quoted_after(line: str, inside: bool) -> bool:
    """Whether a quoted CSV value is open after ``line``, as the parser of the csv module sees it."""
    if '"' not in line:
        return inside
    if inside:
        end = _QUOTED.match(line).end()
        if end == len(line):
            return True
        rest = _SKIPPED.match(line, end + 1)
        return bool(rest) and quoted_after(line[rest.end() :], False)
    return bool(_OPENED.match(line))


class _Marked:
    """Records that begin at marked lines."""

    hypotheses = (False,)

    @staticmethod
    def begins(line: str, marked: bool, inside: bool) -> bool | None:
        return marked

    @staticmethod
    def after(line: str, inside: bool) -> bool:
        return False


class _Quoted:
    """CSV records: they begin at lines outside quoted values; blank lines there belong to none."""

    hypotheses = (False, True)

    @staticmethod
    def begins(line: str, marked: bool, inside: bool) -> bool | None:
        return False if inside else True if line else None

    @staticmethod
    def after(line: str, inside: bool) -> bool:
        return quoted_after(line, inside)


def _borders(kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block and state at its start: records that begin, the piece before the first, the first unless it is the last, the last one, the state at the end."""

    class State:
        def __init__(self, inside: bool):
            self.start = self.inside = inside
            self.n, self.head, self.first, self.tail = 0, None, None, None

        def take(self, line: str, marked: bool) -> None:
            begins = kind.begins(line, marked, self.inside)
            if begins:
                if self.n == 1:
                    self.first = self.tail
                self.n, self.tail = self.n + 1, [line]
            elif begins is not None:
                if self.n:
                    self.tail.append(line)
                elif self.head is None:
                    self.head = [line]
                else:
                    self.head.append(line)
            self.inside = kind.after(line, self.inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, states = None, []
        done: list[tuple] = []

        def close() -> None:
            join = lambda x: None if x is None else "\n".join(x)
            done.extend((*block, s.start, s.n, join(s.head), join(s.first), join(s.tail), s.inside) for s in states)

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            rows = [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, names=["source", "block", "inside", "n", "head", "first", "tail", "ends"])

        for b in batches:
            for source, at, line, marked in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                if block != (source, at):
                    if block:
                        close()
                    block, states = (source, at), [State(h) for h in kind.hypotheses]
                for s in states:
                    s.take(line, marked)
            yield out()
        if block:
            close()
            yield out()

    return run


def _inner(kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records that begin and end in a block: (source, block, k from 1, text). The last that begins in it is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, k, inside = None, None, 0, False
        for b in batches:
            done: list[tuple] = []
            for source, at, line, marked, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != (source, at):
                    block, held, k, inside = (source, at), None, 0, bool(starts)
                begins = kind.begins(line, marked, inside)
                if begins:
                    if held is not None:
                        done.append((source, at, k, "\n".join(held)))
                    held, k = [line], k + 1
                elif begins is not None and held is not None:
                    held.append(line)
                inside = kind.after(line, inside)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=["source", "block", "k", "text"])

    return run


def _kept(df: DataFrame) -> DataFrame:
    """A row or two a block, written to the engine's own folder: it is read several times."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/borders-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scanned(borders: DataFrame) -> DataFrame:
    """Borders of the state each block really begins in, with ``before``: the records that begin in earlier blocks of the file.

    A block maps the state at its start to that at its end: to one state whatever the start, to the same or to the other.
    What a block begins with follows from the last block before it of the first sort and the number of swaps since.
    """
    f = lambda inside: F.max(F.when(F.col("inside") == inside, F.col("ends")))
    maps = borders.groupBy("source", "block").agg(f(False).alias("f0"), F.coalesce(f(True), f(False)).alias("f1"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("f0") & ~F.col("f1")).cast("int")
    maps = maps.withColumn("fixed", F.when(F.col("f0") == F.col("f1"), F.col("f0"))).withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
    known = F.struct(F.col("fixed").alias("to"), F.col("swaps").alias("at"))
    last = F.last(F.when(F.col("fixed").isNotNull(), known), ignorenulls=True).over(earlier)
    maps = maps.withColumn("last", last)
    odd = (F.col("swaps") - F.coalesce(F.col("last.at"), F.lit(0))) % 2 == 1
    start = maps.select("source", "block", (F.coalesce(F.col("last.to"), F.lit(False)) != odd).alias("inside"))
    real = borders.join(start, ["source", "block", "inside"])
    return real.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def records(found: DataFrame, marked: Column | None = None) -> DataFrame:
    """(source, number, block, text) of the records in ``found`` (as ``lines`` gives it).

    With ``marked``, a condition on ``line``, a record begins at each marked line and is numbered from 1; lines before the first are
    number 0. Without it the lines are CSV: a record begins at each line outside quoted values that is not blank, from 1.
    ``block`` is where the record begins. Lines are joined by line feeds. No lines, no records.
    """
    whole, joined, _ = _parts(found, marked)
    return whole.unionByName(joined)


def _parts(found: DataFrame, marked: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records that end in the block in which they begin before its last, the other records, and the borders."""
    kind = _Quoted if marked is None else _Marked
    rows = found.select("source", "block", "line", (F.lit(False) if marked is None else F.coalesce(marked, F.lit(False))).alias("marked"), "at")
    borders = _kept(_scanned(_kept(rows.select("source", "block", "line", "marked").mapInArrow(_borders(kind), _SHAPE))))
    if marked is None:
        inside = borders.where("inside").select("source", "block", F.lit(True).alias("starts"))
        if borders.where("inside").count() <= BROADCAST_BLOCKS:
            rows = rows.join(F.broadcast(inside), ["source", "block"], "left")  # lines stay in their order
        else:
            rows = rows.join(inside, ["source", "block"], "left").repartition("source", "block").sortWithinPartitions("source", "block", "at")
    else:
        rows = rows.withColumn("starts", F.lit(False))
    whole = rows.select("source", "block", "line", "marked", "starts").mapInArrow(_inner(kind), _RECORD)
    whole = whole.join(borders.select("source", "block", "before"), ["source", "block"]).select("source", (F.col("before") + F.col("k")).alias("number"), "block", "text")
    ends = F.array(F.struct(F.lit(0).alias("k"), F.col("head").alias("piece")), F.struct(F.col("n").cast("int").alias("k"), F.col("tail").alias("piece")))
    edges = borders.select("source", "block", "before", F.explode(ends).alias("e")).where(F.col("e.piece").isNotNull())
    edges = edges.groupBy("source", (F.col("before") + F.col("e.k")).alias("number")).agg(F.array_sort(F.collect_list(F.struct("block", "e.k", "e.piece"))).alias("p"))
    joined = edges.select("source", "number", F.col("p")[0]["block"].alias("block"), F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("text"))
    return whole, joined, borders


def renumbered(found: DataFrame) -> DataFrame:
    """Records numbered 0, 1, 2 ... in each file, without gaps, block by block."""
    here = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("source", "block").agg(F.count("*").alias("n")).select("source", "block", F.coalesce(F.sum("n").over(here), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "block").orderBy("number")) - 1
    return found.join(counts, ["source", "block"]).withColumn("number", F.col("before") + inside).drop("before")


# --- kinds of files -----------------------------------------------------------------------


def _heads(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for b in batches:
            rows = []
            for source, block, line in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                now, k = (now, k + 1) if (source, block) == now else ((source, block), 0)
                if k < n:
                    rows.append((source, block, k, line))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["source", "block", "k", "line"])

    return run


def formats(found: DataFrame) -> DataFrame:
    """(source, f): log, email or plain, from the first lines of each file; in ``mbox`` whether its messages begin at From lines."""
    # Only the first bytes of a file or a part can be those of the source; of parts, the least.
    heads = found.where(F.col("block") % PART_BYTES == 0).select("source", "block", "line").mapInArrow(_heads(text.SNIFFED), "source string, block long, k long, line string")
    tops = heads.groupBy("source", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("top"))
    first = tops.groupBy("source").agg(F.min_by("top", "block").alias("top"))
    place = F.struct("block", "at")
    opened = found.groupBy("source").agg(F.count_if(F.col("line").rlike(text.MBOX)).alias("n"), F.min(F.when(F.col("line").rlike(text.MBOX), place)).alias("first"), F.min(place).alias("least"))
    mbox = (F.col("n") >= 2) | ((F.col("n") == 1) & (F.col("first") > F.col("least")))
    return first.select("source", text.sniff(F.col("top")).alias("f")).join(opened.select("source", mbox.alias("mbox")), "source")


def text_records(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True, parts: bool = False) -> dict[str, DataFrame]:
    """Log entries, messages and paragraphs of the text files under ``path``, each file read by its sniffed kind: log, email and plain.

    The columns are those of ``text.log_entries``, ``text.emails`` and ``text.plain_sections``, with ``source`` as the key.
    """
    found = lines(spark, path, glob, recursive, parts)
    kinds = _kept(formats(found))
    of = lambda which: found.join(F.broadcast(kinds.where(which).select("source")), "source", "left_semi") if kinds.count() <= BROADCAST_BLOCKS else _ordered(found.join(kinds.where(which).select("source"), "source", "left_semi"))
    strip = F.regexp_replace("text", r"^\s+|\s+$", "")
    log = text.parsed_entries(records(of("f = 'log'"), F.col("line").rlike(text.OPENS)).withColumnRenamed("number", "entry").withColumnRenamed("text", "piece"), "source")
    boxes = records(of("f = 'email' AND mbox"), F.col("line").rlike(text.MBOX))
    ruled = records(of("f = 'email' AND NOT mbox"), F.col("line").rlike(text.RULE)).withColumn("text", F.when(F.col("number") > 0, F.regexp_replace("text", r"\A[^\n]*\n?", "")).otherwise(F.col("text")))
    messages = renumbered(boxes.unionByName(ruled).withColumn("text", strip).where("text <> ''")).withColumnRenamed("number", "message")
    sections = renumbered(records(of("f = 'plain'"), F.col("line") == "").withColumn("text", strip).where("text <> ''"))
    totals = sections.groupBy("source").agg(F.count("*").alias("total_sections"))
    plain = sections.join(totals, "source").select("source", "total_sections", F.col("number").alias("section_index"), "text")
    return {"log": log, "email": text.parsed_emails(messages, "source"), "plain": plain}


def _ordered(found: DataFrame) -> DataFrame:
    return found.repartition("source", "block").sortWithinPartitions("source", "block", "at")


def _fields(record: str) -> Column:
    """The values of a CSV record."""
    split = F.pandas_udf(lambda texts: texts.map(lambda t: next(csv.reader(io.StringIO(t)), [])), "array<string>")
    return split(record)


def csv_records(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = True, parts: bool = False) -> DataFrame:
    """(source, row, total_rows, names, fields) of the rows of CSV files, each under its own header.

    Values may hold commas, quotes and line feeds in quotes, as the csv module reads them, but for ``\\r\\n`` within a value, which becomes a line feed, and
    a line end at the end of a value that is never closed. Blank lines are no rows; a file of a header only has none.
    """
    whole, joined, borders = _parts(lines(spark, path, glob, recursive, parts), None)
    # The header and the number of rows come from the borders, so that records are read and parsed once.
    first = borders.where("before = 0 AND n > 1").select("source", F.col("first").alias("text")).unionByName(joined.where("number = 1").select("source", "text"))
    header = first.select("source", _fields("text").alias("names"))
    totals = borders.groupBy("source").agg((F.sum("n") - 1).alias("total_rows"))
    rows = whole.unionByName(joined).where("number > 1").select("source", (F.col("number") - 2).alias("row"), _fields("text").alias("fields"))
    return rows.join(header, "source").join(totals, "source").select("source", "row", "total_rows", "names", "fields")


def named_values(names: Column, fields: Column) -> Column:
    """``name: value`` lines of the values that are not empty, under names that are not empty."""
    pairs = F.transform(F.arrays_zip(names.alias("n"), fields.alias("v")), lambda p: F.when((p["n"] != "") & (p["v"] != ""), F.concat(p["n"], F.lit(": "), p["v"])))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "\n")
