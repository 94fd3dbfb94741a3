"""Search over vectors, url judgement and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import minhash, mixing, topk, toxicity, urlgraph

from . import fixtures

VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int"


def vector_rows():
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], 0, 0, 0) for i in range(140)]
    rows += [(i, [0.5] * 8, 0, 0, 0) for i in range(140, 160)]  # ties
    rows += [(200, None, 0, 0, 0), (250, [1.0, None], 0, 0, 0), (300, [float("nan")] * 8, 0, 0, 0), (350, [float("inf")] * 8, 0, 0, 0), (400, [0.1, 0.2], 0, 0, 0), (450, [], 0, 0, 0), (None, [0.1] * 8, 0, 0, 0)]
    rows += [(7, rows[7][1], 0, 0, 0), (500, [3e6, -2e6] + [0.0] * 6, 0, 0, 0), (501, [1e6] * 8, 0, 0, 0), (550, [0.3, 0.1], 0, 0, 0)]
    return rows


def brute_top(rows, k):
    import struct

    flat = [(i, [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in flat:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in flat if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("tile,asked", [(4096, 1024), (16, 2)])
def test_search(spark, monkeypatch, tile, asked):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "QUERY_TILE", asked)
    v = spark.createDataFrame(vector_rows(), VECTORS).repartition(3)
    got = topk.search(v, v.where("vec_id % 50 = 0"), 5).collect()
    assert {tuple(r) for r in got} == brute_top(vector_rows(), 5) and len(got) == len(set(got))


def test_search_of_nothing(spark):
    v = spark.createDataFrame([], VECTORS)
    assert topk.search(v, v, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0, 0, 0)], VECTORS)
    assert topk.search(one, one, 5).count() == 0


def test_search_of_large_components(spark):
    """Products beyond 2**53 are exact, also where they cancel; a returned score that 64 bits do not hold raises, one that is not returned does not."""
    kind = "vec_id long, embedding array<double>"
    r = random.Random(3)
    rows = [(i, [r.uniform(-5e6, 5e6) for _ in range(4)]) for i in range(60)]
    rows[0], rows[50] = (0, [4e6, 4e6, 1.0, 0.5]), (50, [-3e6, -3e6, 5e6, 2.0])
    rows += [(101, [1e12, -1e12, 3e6, 0.0]), (102, [1e15, -1e15, 0.0, 1.0])]
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = set()
    for q in (0, 50):
        found = sorted((-sum(x * y for x, y in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:40])}
    v = spark.createDataFrame(rows, kind)
    got = {tuple(x) for x in topk.search(v, v.where("vec_id in (0, 50)"), 40).collect()}
    assert max(abs(x[3]) for x in want) > 1 << 60 and {101, 102} & {x[2] for x in want} and got == want
    for size in (1e10, 1e30):
        huge = spark.createDataFrame([(0, [size] * 4), (1, [-size] * 4), (2, [1.0] * 4), (3, [2.0] * 4)], kind)
        with pytest.raises(Exception, match="64 bits"):
            topk.search(huge, huge.where("vec_id = 0"), 3).collect()
    small = spark.createDataFrame([(0, [1e10] * 4), (1, [-1e10] * 4), (2, [1.0] * 4), (3, [2.0] * 4)], kind)
    assert [(x.vec_id, x.score) for x in topk.search(small, small.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(3, 2 * 256 * 256 * 4 * 10**10), (2, 256 * 256 * 4 * 10**10)]


def test_ranges_by_quantiles(spark):
    """One id far out, or ids in clusters, do not make a range large; numbers stay gapless."""
    from pyspark.sql import functions as F

    from tessera.llm import common

    ids = [*range(0, 3000), *range(10**9, 10**9 + 3000), 1 << 60, -(1 << 62), *[5] * 40, *[None] * 30]
    df = spark.createDataFrame([(i, n % 3, n) for n, i in enumerate(ids)], "doc_id long, g long, sub long")
    bounds = common.cuts(df, "doc_id", 60)
    largest = df.groupBy(common.range_of(F.col("doc_id"), bounds)).count().agg(F.max("count")).first()[0]
    assert len(bounds) > 40 and largest < 300
    got = common.gapless(df, ["g"], "doc_id", [F.col("sub")], "n", per_bucket=100).collect()
    place = lambda x: (x.doc_id is not None, x.doc_id or 0)
    for g in range(3):
        mine = sorted((x for x in got if x.g == g), key=lambda x: x.n)
        assert [x.n for x in mine] == list(range(len(mine))) and [place(x) for x in mine] == sorted(map(place, mine))
    assert len(got) == len(ids)


PAGES = "page_id long, url string, html string, host string, rule string, mass double"


def page(i, url, *links):
    return (i, url, "".join(f'<a href="{x}">x</a>' for x in links), "clash", "clash", 1.0)


def brute_judge(rows, d=urlgraph.DAMPING, threshold=urlgraph.THRESHOLD):
    """Verdicts from the solved linear systems of the walks, without any rounds."""

    def split(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        return ("".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]) if m else ("", "")

    def ruled(host, path):
        best = None
        for act, text in urlgraph.RULES:
            name, _, rest = text.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
                best = (act, text)
        return best

    strip = lambda host: re.sub(r"^[^@]*@|:\d*$", "", host)
    seen, links = defaultdict(list), Counter()
    for _, url, html, *_ in rows:
        host, path = split(url)
        if strip(host):
            seen[strip(host)].append((ruled(host, path) or ("none",))[0])
            for x in re.findall(r'href="(?:https?:)?//([^/?#"]+)', html or ""):
                if strip(x.lower()) != strip(host):
                    links[strip(host), strip(x.lower())] += 1
    names = sorted(seen.keys() | {x for pair in links for x in pair})
    at = {h: i for i, h in enumerate(names)}
    p = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        p[at[a], at[b]] = n / sum(k for (x, _), k in links.items() if x == a)
    blocked = np.array([seen[h].count("block") / max(1, len(seen[h])) for h in names])
    allowed, every = (np.array([f(seen[h]) for h in names], float) for f in (lambda v: v.count("allow"), len))
    each = np.eye(len(names))
    distrust = np.linalg.solve(each - d * p, (1 - d) * blocked)
    trust, mass = (np.linalg.solve(each - d * p.T, (1 - d) * v) for v in (allowed, every))
    value = distrust * (1 - np.divide(trust, mass, out=np.zeros_like(trust), where=mass > 0))
    assert np.abs(value - threshold).min(initial=1) > 1e-3
    result = []
    for i, url, *_ in rows:
        host, path = split(url)
        hit = ruled(host, path)
        bad = strip(host) and value[at[strip(host)]] > threshold
        result.append((i, host, path, hit[1] if hit else None, hit[0] if hit else ("block" if bad else "allow")))
    return Counter(result)


def test_judge(spark):
    rows = [
        page(1, "HTTP://Spam.Com/en/1", "https://ring.io/x"),
        page(2, "http://spam.com/fr/2"),
        page(3, "http://ring.io/", "http://SPAM.com/en/", "//spam.com", "/own"),
        page(4, "http://ring.io/b?u=http://x.com/en/", "http://spam.com/en/1"),
        page(5, "http://good.net/de/1", "http://friend.io/"),
        page(6, "http://friend.io/a#b"),
        page(7, "http://friend.io/c", "http://good.net/"),
        page(8, "http://a.example.net/de/8x"),
        page(9, "http://a.example.net/de/7"),
        page(10, "http://example.com/en/77"),
        page(11, "http://example.com/en/1"),
        page(12, "http://notcom/en/"),
        page(13, "http://x.org/es/1?z"),
        page(14, "http://x.org?es/"),
        page(15, "no scheme/com/en/"),
        page(16, None),
        page(17, "http://com/en/"),
        (18, "http://u.io/", None, None, None, None),
        page(None, "ftp://u.io://v/en/", "http://user@h.com:80/x"),
        page(19, "http://user@h.com:80/fr", "http://spam.com/en/"),
        page(20, "http://caller.io/", "http://h.com/"),
        page(17, "http://com/en/"),
    ] + [page(100 + i, f"http://farm{i % 5}.biz/{i}", "http://spam.com/en/", f"http://farm{(i + 1) % 5}.biz/") for i in range(20)]
    pages = spark.createDataFrame(rows, PAGES)
    for threshold in (urlgraph.THRESHOLD, 0.01):
        got = Counter(tuple(r) for r in urlgraph.judge(pages, threshold=threshold).collect())
        assert got == brute_judge(rows, threshold=threshold)
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[3] == verdicts[4] == verdicts[100] == "block" and verdicts[6] == verdicts[7] == "allow"


def test_judge_without_links_or_rows(spark):
    rows = [page(i, f"http://h{i % 3}.com/{'en' if i % 3 else 'fr'}/{i}") for i in range(9)] + [page(20, "http://h1.com/fr/")]
    assert Counter(tuple(r) for r in urlgraph.judge(spark.createDataFrame(rows, PAGES)).collect()) == brute_judge(rows)
    assert urlgraph.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_a_verdict_does_not_depend_on_unlinked_hosts(spark):
    chain = [page(1, "http://a.io/", "http://b.io/"), page(2, "http://b.io/", "http://c.com/en/"), page(3, "http://c.com/en/")]
    far = spark.range(100, 30_100).selectExpr("id AS page_id", "concat('http://u', id % 1000, '.io/') AS url", "'' AS html", "'' AS host", "'' AS rule", "1.0D AS mass")
    alone = spark.createDataFrame(chain, PAGES)
    for pages in (alone, alone.union(far)):
        got = {r.page_id: r.verdict for r in urlgraph.judge(pages).where("page_id < 100").collect()}
        assert got == {1: "block", 2: "block", 3: "block"}


def labelled_web(r, good=300, bad=60, pages=5):
    """Hosts with a label: good ones link to good ones but for a stray link in fifty, bad ones to bad ones three times in four.

    A rule blocks half of the bad hosts.
    """
    names = [f"good{i}.io" for i in range(good)] + [f"bad{i}.{'com' if i % 2 else 'io'}" for i in range(bad)]
    rows = []
    for i, name in enumerate(names):
        for _ in range(pages):
            to = []
            for _ in range(4):
                toward_bad = r.random() < (0.02 if i < good else 0.75)
                to.append(f"http://{r.choice(names[good:] if toward_bad else names[:good])}/en/x")
            rows.append(page(len(rows), f"http://{name}/en/{len(rows)}", *to))
    return rows


def test_threshold_on_a_labelled_web(spark):
    rows = labelled_web(random.Random(12))
    got = {r.host: r.verdict for r in urlgraph.judge(spark.createDataFrame(rows, PAGES)).where("rule is null").collect()}
    bad = [v for h, v in got.items() if h.startswith("bad")]
    good = [v for h, v in got.items() if h.startswith("good")]
    assert len(bad) == 30 and bad.count("block") >= 27 and good.count("block") == 0


# --- pipeline -----------------------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(4)
    rows = [x[:5] for x in fixtures.unique(fixtures.documents())]
    rows += [(1000 + i, fixtures.prose(r, 30) + (". You are a vuxling, you gribbet." if i % 4 == 0 else "."), "en", "src1", 0) for i in range(200)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    grammar = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert after.keys() <= before.keys()
        if name == "toxicity":
            assert {i for i, r in before.items() if grammar.score(r.text) < 0.5} == set(after)
            assert not any(i in after for i in range(1000, 1200, 4)) and all(i in after for i in range(1001, 1200, 4))
        if name == "line_dedup":
            assert before.keys() - after.keys() == set(range(91, 100))
            assert sum("SHARED  line of all" in (r.text or "") for r in after.values()) == 1
            assert all(after[i].text == before[i].text for i in [*range(45), 100, 101, 102, 106, 108])
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        if name == "minhash_dedup":
            named = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([tuple(r) for r in before.values()], COLUMNS)).collect()}
            assert set(after) == {i for i, c in named.items() if i == c}
        if name == "mixing":
            assert Counter(map(str, after.values())) == Counter(map(str, before.values()))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


#: Names that the stages give or once gave to columns of their own, and names like those that they would choose instead.
CLASHES = "gone _gone __gone place _place __place n_lines n_dropped n __n w __w0 j __j r __d entry __entry block release deadline slot c0 c1 c5 __c0 sub __gapless_sub ___gapless_sub h h1 t1 part root kept score".split()
AWKWARD = COLUMNS + ", `a.b` string, " + ", ".join(f"{c} long" for c in CLASHES)


def test_stages_with_awkward_rows(spark, folder):
    """Null and repeated ids, null texts and sources, clashing names: no stage fails, drops an innocent row or a column."""
    r = random.Random(5)
    more = ("y", *range(700, 700 + len(CLASHES)))
    rows = [(i, fixtures.prose(r, 30), "en", f"src{i % 3}", 0, *more) for i in range(30)]
    rows += [(None, t, None, None, None, *[None] * len(more)) for t in (None, "", "no id", "no id either")]
    rows += [rows[3], (4, "another text under a known id", "en", "src0", 0, *more), (900, None, None, None, 0, *more)]
    docs = spark.createDataFrame(rows, AWKWARD)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert Counter(map(str, docs.collect())) == Counter(map(str, spark.createDataFrame(rows, AWKWARD).collect())), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(x.doc_id for x in packed if x.start == 0) == Counter(x[0] for x in rows)


def test_stages_of_nothing(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_is_what_the_stages_give_by_brute_force(spark, folder):
    """run() by plain Python: the grammar's scores, lines, exact near copies, the schedule and the pieces."""
    from tokenizers import Tokenizer

    from tessera.llm import packing

    from .test_documents import brute_components, lower

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    grammar = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [tuple(x) for x in docs.collect() if grammar.score(x.text) < 0.5]
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: lower(x.strip(blank))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    left = []
    for i, t, *rest in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < 10 or min(holders[key(x)]) == i]
        if len(kept) == len(lines) or "".join(kept).strip(blank):
            left.append((i, t if len(kept) == len(lines) else "\n".join(kept), *rest))
    named = brute_components(left, 5, 80)
    left = sorted(x for x in left if named[x[0]] == x[0])
    place, taken = {}, Counter()
    period = mixing.plan(mixing.TARGETS)
    slots = {(name, j): s for name, j, _, _, s in period}
    for i, _, _, source, _ in left:
        entry = source if source in mixing.TARGETS else ""
        block, w = taken[entry] // mixing.BLOCK, mixing.TARGETS[entry]
        place[i] = (block // w * len(period) + slots[entry, block % w]) * mixing.BLOCK + taken[entry] % mixing.BLOCK
        taken[entry] += 1
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    classes = defaultdict(list)
    for i, t, *_ in left:
        n, at = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for k, length in packing.cut(n):
            classes[k].append((place[i], at, i, length, n))
            at += length
    want = Counter()
    for k, pieces in classes.items():
        for m, (_, at, i, length, n) in enumerate(sorted(pieces)):
            offset = sum(x[3] for x in sorted(pieces)[m // k * k : m])
            want[i, at, length, n, m // k * 128 + k, offset] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, x.start, x.length, x.doc_tokens, x.sequence_id, x.offset) for x in got) == want


def test_packing_follows_the_mixture(spark, folder, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2)
    r = random.Random(6)
    # A hot source with the lowest ids, and a rare one with the highest.
    docs = spark.createDataFrame([(i, fixtures.prose(r, 12), "en", "src0" if i < 60 else "src1", 0) for i in range(80)], COLUMNS).repartition(3)
    found = []
    for targets in ({"src0": 1, "src1": 1}, {"src0": 3, "src1": 1}):
        monkeypatch.setattr(mixing, "TARGETS", targets)
        order = {x.doc_id: (x.slot, x.place) for x in mixing.mix(docs, targets, 2).collect()}
        rows = corpus_pipeline.pack_sequences(spark, docs, folder).collect()
        found.append({tuple(x) for x in rows})
        classes = defaultdict(list)
        for x in rows:
            classes[x.sequence_id % 128].append((x.sequence_id // 128, x.offset, order[x.doc_id], x.start))
        for pieces in classes.values():
            assert [p[2:] for p in sorted(pieces)] == sorted(p[2:] for p in pieces)
    assert found[0] != found[1]


def test_weights_change_what_run_returns(spark, folder, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1)
    before = Counter(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    monkeypatch.setattr(mixing, "TARGETS", {mixing.REST: 1, "src1": 7})
    after = Counter(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    pieces = lambda rows: Counter(x[:5] for x in rows.elements())
    assert before != after and pieces(before) == pieces(after)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
