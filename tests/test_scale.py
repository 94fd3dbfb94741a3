"""Reach to a depth, exact medians and the embedding cache against plain Python."""

import random
import statistics
from collections import defaultdict

import pytest

from tessera.operators import embedding, evaluation, traversal


def brute_reach(edges, seeds, depth):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    hops = dict.fromkeys(seeds, 0)
    front = set(seeds)
    for step in range(1, depth + 1):
        front = {y for x in front for y in near[x]} - hops.keys()
        hops |= dict.fromkeys(front, step)
    return set(hops.items())


@pytest.mark.parametrize("few,hub", [(200_000, 100_000), (0, 4), (30, 4)])
def test_reach(spark, monkeypatch, few, hub):
    """By broadcast, by joins with hubs in parts, and from the nodes that are left."""
    monkeypatch.setattr(traversal, "FEW", few)
    monkeypatch.setattr(traversal, "HUB", hub)
    monkeypatch.setattr(traversal, "PARTS", 3)
    r = random.Random(5)
    edges = [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", f"m{r.randrange(60)}") for i in range(40)] + [(f"m{r.randrange(60)}", f"m{r.randrange(60)}") for _ in range(30)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("m1", "c0"), (None, "x"), ("x", "x"), ("hub", "n1")]
    frame = spark.createDataFrame(edges, "subject string, object string")
    seeds = spark.createDataFrame([("n1",), ("alone",), ("n1",), (None,)], "node string")
    for depth in (0, 2, 9):
        got = traversal.reach(frame, seeds, depth).collect()
        assert {tuple(x) for x in got} == brute_reach(edges, {"n1", "alone"}, depth) and len(got) == len(set(got))


def test_medians(spark):
    r = random.Random(6)
    groups = {"even": [1.0, 2.0, 2.0, 9.0], "odd": [3.0, -1.0, 5.0], "one": [7.5], "ties": [1.0] * 50_000 + [2.0] * 49_999, "many": [r.gauss(0, 1) * 10 ** r.randrange(9) for _ in range(60_001)], "far": [1e300, *map(float, range(30_001))], None: [4.0, 6.0]}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("one", None), ("empty", None)]
    got = {x.g: x.median for x in evaluation.medians(spark.createDataFrame(rows, "g string, x double").repartition(4), "x", ["g"]).collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}
    whole = evaluation.medians(spark.createDataFrame(rows, "g string, x double"), "x", []).collect()
    assert [x.median for x in whole] == [statistics.median([x for v in groups.values() for x in v])]


def test_embedding_cache(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["aa", "ae", "aa", "xyz", "", None, "a" * 5000, "a" * 1200, *[f"i{k}" for k in range(40)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), embedding.letter_model)
    assert cache.vectors(docs).where("vector IS NOT NULL").count() == 0
    assert cache.fill(docs.where("doc_id < 8")) == 5 and cache.fill(docs) == 40 and cache.fill(docs) == 0
    got = {x.doc_id: x for x in cache.vectors(docs).collect()}
    assert len(got) == len(rows) and got[0].vector == got[2].vector == [1.0, 0, 0, 0, 0] and got[6].vector == got[7].vector
    assert all(got[i].vector is None and "no letter" in got[i].error for i in (3, 4, 5)) and got[20].vector == [0, 0, 1.0, 0, 0]


def test_batches_under_a_budget_are_halved():
    asked = []

    def model(texts):
        asked.append(len(texts))
        if len(texts) > 3:
            raise RuntimeError("too many")
        return [[float(len(t))] for t in texts] if texts != ["bad"] else []

    texts = [str(i) * i for i in range(1, 9)]
    assert embedding.embedded(texts, model) == [([float(len(t))], None) for t in texts] and asked == [8, 4, 2, 2, 4, 2, 2]
    assert embedding.embedded(["bad"], model) == [(None, "0 vectors for 1 texts")]
    assert [len(x) for x in embedding.batches_of(["x" * 400] * 5 + ["y" * 9000, "z"], 4, 300)] == [2, 2, 1, 1, 1]


@pytest.mark.parametrize("names", [200_000, 7])
def test_mentions_of_many_names(spark, monkeypatch, names):
    from tessera.operators import mentions

    monkeypatch.setattr(mentions, "NAMES", names)
    r = random.Random(8)
    words = ["apex", "Mill", "a_b", "x", "co", "coop", "late one"]
    entities = ["Apex Mill", "a b", "coop", "co", "COOP", "", None, "mill x", "late_one", "zzz", *[f"{r.choice(words)} {r.choice(words)}" for _ in range(20)]]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(12)))) for i in range(80)] + [(80, None), (81, ""), (None, "coop"), (3, "apex_mill")]
    forms = lambda e: {e.lower(), e.lower().replace("_", " "), e.lower().replace(" ", "_")}
    want = sorted((str(i), e) for i, t in docs for e in set(entities) - {"", None} if any(f in (t or "").lower() for f in forms(e)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = mentions.mentions_of(frame, spark.createDataFrame([(e,) for e in entities], "entity string")).collect()
    assert sorted((str(x.doc_id), x.entity) for x in got) == want
    assert mentions.mentions_of(frame, spark.createDataFrame([], "entity string")).count() == 0
