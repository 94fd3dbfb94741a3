"""One test a finding of the third round."""

from pyspark.sql import functions as F

from tessera import catalogue, session
from tessera.operators import feedback, knowledge, traversal
from tessera.sources import tables


def test_sliding_window_rounds_to_the_nearest_second(spark):
    """F2: 60.2 seconds apart, but 61 where both are rounded; 60.9 apart, but 60; halves go to the even second."""
    rows = [(1, 1, 100.4), (2, 1, 160.6), (3, 2, 100.6), (4, 2, 161.4), (5, 3, 100.5), (6, 3, 160.5), (7, 4, 100.5), (8, 4, 161.5), (9, 5, None), (10, 5, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {r.event_id: r.in_window for r in feedback.sliding_requests(events, "user_id", "ts", 60).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 2, 7: 1, 8: 1, 9: 2, 10: 2}


def test_short_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """F10, F14, F15, F16: the pieces of a table of short rows grow with it, not with the cores."""
    monkeypatch.setattr(session, "PIECE_ROWS", 100)
    spark.range(2_050).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    dealt = session.texts(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 21 and dealt.count() == 2_050


def test_sources_of_rows_are_dealt(spark):
    """F5, F11, F14, F15, F16: work that costs much a row does not run in the one task that reads a small file."""
    for name in ("yaml_flatten", "pptx_files", "tag_records", "graph_evidence", "record_triples"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_yaml_reads_as_before(spark):
    """the quick parser and, where it refuses, the slow one."""
    rows = spark.createDataFrame([(1, "a: [1, {b: ~}]\nc: 2020-01-02"), (2, "a: [1"), (3, None), (4, "x")], "k long, body string")
    got = {r.k: (r.text, r.error and r.error.split(":")[0]) for r in tables.flatten_documents(rows, "k", "body", "yaml").collect()}
    assert got == {1: ("a[0]: 1\na[1].b: None\nc: 2020-01-02", None), 2: (None, "ParserError"), 3: (None, None), 4: (": x", None)}


def test_edges_are_kept_once_and_not_made_distinct(spark, monkeypatch):
    """a step finds nodes from the edges as they are, so that no pass shuffles all of them in both directions."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), (None, "c")], "subject string, object string")
    seeds = spark.createDataFrame([("a",)], "node string")
    written, kept = {}, traversal._kept
    monkeypatch.setattr(traversal, "_kept", lambda df, path: written.setdefault(path.rsplit("/", 1)[-1], kept(df, path)))
    want = {("a", 0), ("b", 1), ("c", 2)}
    assert sorted(map(tuple, traversal.reach(edges, seeds, 5).collect())) == sorted(want) and written["edges"].count() == 5
    near = knowledge.neighbourhood(edges.where("subject IS NOT NULL"), seeds, 1)
    assert sorted(map(tuple, near.collect())) == [("a", 0), ("b", 1)]
    assert near._jdf.queryExecution().analyzed().toString().count("Deduplicate") == 4
