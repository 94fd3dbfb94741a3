"""Canonical exact fingerprints, in DataFrame functions only.

A text is folded to a canonical form, hashed to 128 bits with two differently seeded
xxHash64, and texts with equal hashes are compared byte by byte before they may share a
fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_HASHES, cuts, range_of, stored, wide_hash

#: White space but for the space itself, and any white space.
_OTHER = r"\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Runs that become one space; a space alone, the common case, is no match.
BLANKS = f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"
#: Quotes and dashes that differ in looks only and that Unicode leaves apart.
LOOKS, PLAIN = "‘’“”‐‒–—", "''\"\"----"
#: The normaliser that Spark's own collations bring along.
NORMALIZER = "com.ibm.icu.text.Normalizer"


def canonical(text: Column) -> Column:
    """Unicode NFKC, quotes and dashes folded, lower case, blanks to one space, trimmed; null is empty.

    NFKC is made again of the lower-cased text, which some capitals (as a dotted I) leave decomposed.
    """
    out = F.coalesce(text, F.lit(""))
    compose = lambda c: F.java_method(F.lit(NORMALIZER), F.lit("compose"), c, F.lit(True))
    folded = compose(F.lower(F.translate(compose(out), LOOKS, PLAIN)))
    out = F.when(out.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.lower(out))
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def with_next(docs: DataFrame, range_rows: int = 256, most: int = 1 << 16, marks: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``docs`` (doc_id, text) with ``after_``x for the text and every column that ``marks`` adds: that of the next row.

    The next row is that of the next lower doc_id, after the last row the first. Rows with one doc_id follow in the order of two
    hashes of their text; null ids come last, in the same order. Rows are dealt by ranges of doc_id cut at quantiles (null ids: of the hash), in one
    shuffle. Each range also gets a ghost: the first row of the next lower range that has rows. There are at most ``most`` ranges of each kind.
    """
    n, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    ranges, unnamed = (max(1, min(most, x // range_rows)) for x in (n, n - ids))
    bounds = cuts(docs, "doc_id", ranges)
    cut = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    share = F.col("t1").cast("double") / 2.0**64 + 0.5
    cut = cut.withColumn("g", F.when(F.col("doc_id").isNull(), -1 - F.least(F.floor(share * unnamed), F.lit(unnamed - 1))).otherwise(range_of(F.col("doc_id"), bounds)).cast("long"))
    first = stored(cut.groupBy("g").agg(F.max(F.struct("doc_id", (-F.col("t1").cast("decimal(20,0)")).alias("a"), (-F.col("t2").cast("decimal(20,0)")).alias("b"))).alias("x")).select("g", "x.*"), "heads")
    down = Window.orderBy(F.col("g").desc())
    above = first.select("doc_id", "a", "b", F.coalesce(F.lag("g").over(down), F.min("g").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("g"))
    # One small row a range: the number of ranges is bounded, and so is what is broadcast.
    heads = above.select(F.col("doc_id").alias("d"), (-F.col("a")).cast("long").alias("x1"), (-F.col("b")).cast("long").alias("x2"), F.col("g").alias("to"))
    ghosts = (
        cut.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")))
        .select("doc_id", "text", "t1", "t2", F.col("to").alias("g"))
        .dropDuplicates(["g"])
    )
    plain = ["doc_id", "text", "t1", "t2", "g", "ghost"]
    rows = marks(cut.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1))))
    marked = ["text", *[c for c in rows.columns if c not in plain]]
    order = Window.partitionBy("g").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "t1", "t2")
    for c in marked:
        rows = rows.withColumn(f"after_{c}", F.lead(c).over(order))
    return rows.where(F.col("ghost") == 0).drop("g", "ghost")


def edited(text: Column, after: Column) -> Column:
    """The last floor(n / 2) code points replaced by as many of the first of ``after`` (or all of it)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def _name(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(a)), 16, "0"), F.lpad(F.lower(F.hex(b)), 16, "0"))


def _split_buckets(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(t1, t2, part) of the rows of buckets whose canonical texts are not all equal; none, but for a collision of 128 bits.

    Texts of a bucket that are equal as they are need no canonical form: one or two of each hash (t1, t2) are folded.
    """
    repeated = stored(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated
    wanted = stored(hashed.join(side, ["h1", "h2"], "left_semi").select("t1", "t2", "h1", "h2").distinct(), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_HASHES else wanted
    # Partial aggregation keeps two texts a hash and task, however many copies there are.
    ends = docs.join(side, ["t1", "t2"]).groupBy("h1", "h2", "t1", "t2").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    forms = ends.select("h1", "h2", "t1", "t2", F.explode(F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))).alias("text"))
    forms = stored(forms.select("h1", "h2", "t1", "t2", canonical(F.col("text")).alias("c")), "forms")
    mixed = stored(forms.groupBy("h1", "h2").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h1", "h2"), "mixed")
    parts = forms.join(mixed, ["h1", "h2"], "left_semi").select("h1", "h2", "c", "t1", "t2").distinct()
    return parts.select("t1", "t2", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("c")).alias("part"))


def fingerprints(docs: DataFrame, hash_of: Callable[[Column], tuple[Column, Column]] = wide_hash) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Texts share a fingerprint if and only if their canonical forms are equal, so likeness is
    1.0 or 0.0, taken from a comparison of bytes. A null text is an empty one; all empty
    texts share a fingerprint. Rows with a null or repeated doc_id are rows like any other;
    a table of one row has itself as the next; an empty table gives an empty result; other columns are ignored. ``hash_of``
    may be replaced to test what happens when hashes collide.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def marks(rows: DataFrame) -> DataFrame:
        h1, h2 = hash_of(F.col("c"))
        return rows.withColumn("c", canonical(F.col("text"))).withColumn("h1", h1).withColumn("h2", h2).drop("c")

    rows = with_next(base, marks=marks).withColumn("e", edited(F.col("text"), F.col("after_text")))
    forms = rows.withColumn("ce", canonical(F.col("e")))
    e1, e2 = hash_of(F.col("ce"))
    # Forms are compared as bytes where their hashes agree; elsewhere they differ.
    like = lambda one, two, form: F.when((F.col("h1") == one) & (F.col("h2") == two), (canonical(F.col("text")) == form).cast("double")).otherwise(0.0)
    hashed = stored(
        forms.select(
            "doc_id", "t1", "t2", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "h1", "h2", e1.alias("e1"), e2.alias("e2"),
            like(e1, e2, F.col("ce")).alias("near_edited"), like(F.col("after_h1"), F.col("after_h2"), canonical(F.col("after_text"))).alias("near_next"),
        ),
        "hashed",
    )
    keyed = base.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")
    parts = stored(_split_buckets(keyed, hashed), "parts")
    named = hashed.join(parts, ["t1", "t2"], "left") if parts.limit(1).count() else hashed.withColumn("part", F.lit(None).cast("int"))
    own = F.concat(_name("h1", "h2"), F.coalesce(F.concat(F.lit("-"), F.col("part").cast("string")), F.lit("")))
    other = F.when(F.col("near_edited") == 1.0, own).when((F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2")), F.concat(_name("e1", "e2"), F.lit("-e"))).otherwise(_name("e1", "e2"))
    return named.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), other.alias("edited_fingerprint"), "near_edited", "near_next")
