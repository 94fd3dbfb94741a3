"""F1 of the third round: what a batch of questions reads and moves, and what the graph keeps for it."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, knowledge, segments

QUESTIONS = ["Why was dispatch 7 late?", "Apex Materials, urgent dispatch", "nothing here", "", None, "late late urgent apex dispatch 3"]


@pytest.mark.parametrize("literals", [1_000, 0])
def test_edges_that_share_terms_with_a_batch_are_kept_once(spark, tmp_path, monkeypatch, literals):
    """An edge is one row of the kept graph, however many terms it has, and a batch finds what ``edge_evidence`` finds of each question."""
    monkeypatch.setattr(index, "LITERALS", literals)
    r = random.Random(1)
    kept = index.CorpusIndex(spark, str(tmp_path / "i"))
    rows = [(i, f"DISPATCH-{i % 40}", r.choice(["delayed_because", "supplied_by"]), r.choice(["Apex_Materials", "late 1-URGENT", "late"]), "Order") for i in range(200)]
    triples = spark.createDataFrame(rows, "at long, subject string, predicate string, object string, subject_type string")
    kept.save_graph(knowledge.nodes_of(triples, ["at"]), knowledge.edges_of(triples, ["at"]))
    edges = kept.graph()[1]
    assert kept.table("edge_terms").count() == edges.count()
    got = {}
    for x in kept.evidence_batch(spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, query string")).collect():
        got.setdefault(x.id, []).append((x["rank"], x.subject, x.content, x.hits, round(x.score, 9)))
    for i, question in enumerate(QUESTIONS):
        want = [(n, x.subject, x.content, x.hits, round(x.score, 9)) for n, x in enumerate(knowledge.edge_evidence(edges, question or "").collect(), 1)]
        assert sorted(got.get(i, [])) == want, question


@pytest.mark.parametrize(("literals", "blocks"), [(1_000, 200_000), (0, -1)])
def test_postings_stay_where_they_are_read(spark, tmp_path, monkeypatch, literals, blocks):
    """A batch reads the buckets of its words and does not shuffle postings, whatever Spark thinks of their size; past the bounds it finds the same."""
    monkeypatch.setattr(segments, "LITERALS", literals)
    monkeypatch.setattr(segments, "BROADCAST_BLOCKS", blocks)
    r = random.Random(2)
    kept = index.CorpusIndex(spark, str(tmp_path / "i"))
    kept.add(spark.createDataFrame([(i, " ".join(r.choices("a bolt gear pump seal late".split(), k=r.randrange(1, 9)))) for i in range(300)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "late pump"), (2, "gear gear bolt"), (3, "unknown"), (4, "")], "id long, query string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted, own, first, *_ = kept.segments._ranges(asked, 3)
        plan = kept.segments._scores(wanted, first, own)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    if literals:
        assert "BroadcastHashJoin" in plan and "PartitionFilters: [bucket" in plan and "SortMergeJoin" not in plan
    got = {(x.id, x.doc_id, round(x.score, 9)) for x in kept.keyword_batch(asked, 3).collect()}
    want = {(i, x.doc_id, round(x.score, 9)) for i, q in ((1, "late pump"), (2, "gear gear bolt")) for x in kept.keyword(q, 3).select("doc_id", F.col("score")).collect()}
    assert got == want and len(got) == 6
