"""One test a finding of the fourth round."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import tagging


@pytest.mark.parametrize("n", [3_000, 100_000])
def test_names_of_thousands_of_words(spark, n):
    """a run of capitalised words is one name, however long; the regex engine's stack does not grow with it."""
    long, cut = " ".join(["Aa"] * n), " ".join(["Bb"] * n) + " Cc9"
    rows = spark.createDataFrame([(1, f"x {long}, y {cut} Dd, Ee-F1"), (2, "Apex Materials")], "doc_id long, text string")
    got = {r.doc_id: r for r in tagging.tag_documents(rows).withColumn("spans", T.spans_and_numbers(F.col("text"))).collect()}
    assert got[1].entities == [long, cut.removesuffix(" Cc9"), "Ee-F1"] and got[2].entities == ["Apex Materials"]
    assert got[1].spans[:2] == [long.lower(), cut.removesuffix("9").lower()]


def test_names_are_those_of_the_plain_form(spark):
    """the same names as the pattern in the SQL finds, on texts made of what can begin, end or break a name."""
    dice, parts = random.Random(4), ["A", "B", *["Aa", "Bbb", " Cc", " "] * 4, "a", "9", "_", "-", "  ", "\n", "\t", ".", "12", "The", "é", "É", "AB", "-42"]
    texts = [(i, "".join(dice.choices(parts, k=dice.randint(1, 40)))) for i in range(4_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    plain = F.filter(T.found(F.col("text"), T.NAME_FORMS), lambda x: (F.length(x) >= 3) & ~x.isin(T.NAME_STOPS))
    both = rows.select("doc_id", T.names(F.col("text")).alias("got"), plain.alias("want")).collect()
    assert sum(len(r.want) for r in both) > 1_000 and all(r.got == r.want for r in both)
    sql = duckdb.connect()
    sql.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    sql.executemany("INSERT INTO documents VALUES (?, ?)", texts[:400])
    want = dict(sql.execute(f"SELECT doc_id, {tagging._names_sql('text')} FROM documents").fetchall())
    assert {r.doc_id: r.got for r in both if r.doc_id in want} == want
