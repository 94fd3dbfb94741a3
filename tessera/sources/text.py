"""Plain text, logs and e-mail: sniffing and splitting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shape of a log line and of e-mail headers.
_STAMP = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]?\d{2}:\d{2}(?::\d{2})?"
LOG_LINE = r"(?i)^[\[{(]?(" + _STAMP + r")[\]}).]?\s*(?:[|\-]\s*)?(?:(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|NOTICE)\s*[|\-:]?\s*)?(?:\[?([A-Z]{2,5}-\d{3,})\]?\s*[|\-:]?\s*)?(.*)"
_OPENS = r" *[\[{(]?" + _STAMP
#: A line that opens a log entry, one that opens a message of a mailbox, and one that parts messages.
OPENS, MBOX, RULE = r"(?i)^" + _OPENS, r"^From\s+\S+", r"^-{3,}\s*$"
HEADER = r"(?im)^(From|To|Date|Subject|Cc|Bcc):\s*(.+)$"
SNIFFED, LOG_HITS, LOG_SHARE, HEADERS = 30, 3, 0.4, 2


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line."""
    parts = F.split(text, r"\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sniff(text: Column) -> Column:
    """log, email or plain, from the first lines."""
    top = F.slice(lines(text), 1, SNIFFED)
    hits = F.size(F.filter(top, lambda x: F.trim(x).rlike(LOG_LINE)))
    keys = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(top, "\n"), F.lit(HEADER), 1), lambda k: F.lower(k)))
    named = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in ("from", "to", "subject", "date")])))
    return F.when((hits >= LOG_HITS) | ((F.size(top) > 0) & (hits / F.greatest(F.size(top), F.lit(1)) > LOG_SHARE)), "log").when(named >= HEADERS, "email").otherwise("plain")


def plain_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, total_sections, text): paragraphs between blank lines."""
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.col(text), r"\n{2,}"), strip), lambda s: s != "")
    return docs.select(key, parts.alias("p")).select(key, F.size("p").alias("total_sections"), F.posexplode("p").alias("section_index", "text"))


def log_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entry, text, timestamp, level, entry_id, message): a stamped line opens an entry, others go on with it.

    Entries count from 1. Lines before the first stamp form entry 0, from the first line that is not blank. Nothing is shuffled: a text is
    cut before its stamped lines.
    """
    body = F.array_join(lines(F.col(text)), "\n")
    cut = docs.select(key, body.rlike(r"(?i)\A" + _OPENS).cast("int").alias("before"), F.posexplode(F.split(body, r"(?i)(?:\A|\n)(?=" + _OPENS + ")")).alias("at", "piece"))
    numbered = cut.select(key, (F.col("at") + F.col("before")).alias("entry"), "piece")
    return parsed_entries(numbered, key)


def parsed_entries(numbered: DataFrame, key: str) -> DataFrame:
    """Log entries of (key, entry, piece): what ``log_entries`` says of each."""
    lead = F.regexp_replace("piece", r"\A(?: *\n)+", "")
    kept = numbered.withColumn("piece", F.when(F.col("entry") > 0, F.col("piece")).otherwise(lead)).where((F.col("entry") > 0) | (F.trim("piece") != ""))
    rows = kept.withColumn("p", F.split("piece", "\n"))
    first = F.trim(F.col("p")[0])
    stamped = F.col("entry") > 0
    part = lambda i: F.when(stamped & (F.regexp_extract(first, LOG_LINE, i) != ""), F.regexp_extract(first, LOG_LINE, i))
    said = F.transform("p", lambda x, i: F.when((i == 0) & stamped, F.trim(F.regexp_extract(F.trim(x), LOG_LINE, 4))).otherwise(F.trim(x)))
    return rows.select(key, "entry", F.col("piece").alias("text"), part(1).alias("timestamp"), F.upper(part(2)).alias("level"), part(3).alias("entry_id"), F.array_join(said, " ").alias("message"))


def emails(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, message, text, email_from, email_to, email_date, email_subject); the last of repeated headers counts."""
    mbox = F.split(F.col(text), r"(?m)(?=^From\s+\S+)")
    parts = F.when(F.size(F.filter(mbox, lambda s: s != "")) >= 2, mbox).otherwise(F.split(F.col(text), r"(?m)^-{3,}\s*$"))
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    clean = F.filter(F.transform(parts, strip), lambda s: s != "")
    return parsed_emails(docs.select(key, F.posexplode(clean).alias("message", "text")), key)


def parsed_emails(rows: DataFrame, key: str) -> DataFrame:
    """Messages of (key, message, text) with their headers."""
    keys = F.transform(F.regexp_extract_all("text", F.lit(HEADER), 1), lambda k: F.lower(k))
    values = F.transform(F.regexp_extract_all("text", F.lit(HEADER), 2), lambda v: F.trim(v))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = lambda name: F.element_at(F.filter(pairs, lambda p: p["k"] == name), -1)["v"]
    return rows.select(key, "message", "text", *[F.when(F.array_contains(keys, n), last(n)).alias(f"email_{n}") for n in ("from", "to", "date", "subject")])


def read_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """(source, text, detected_format): one row a file."""
    rows = spark.read.options(**options).text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("source"), F.col("value").alias("text"), sniff(F.col("value")).alias("detected_format"))
