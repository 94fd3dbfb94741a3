"""The prefix trie, the filter audit and chat formatting against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import audit, chat, trie

from . import fixtures

TURNS = "conv_id long, turn long, role string, text string, d long, node long, part long, salt int, n long, parent long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn(c, t, role, text):
    return (c, t, role, text, 7, 7, 7, 7, 7, 7)


def conversations():
    """Families with shared heads, copies, a chain shared to its end, a long conversation, null and repeated rows."""
    r = random.Random(4)
    says = lambda: r.choice(["yes", "no", "", "ünï", None, "tell me more"])
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(-5, 0), 305, 777]:
        rows += [turn(c, t, r.choice(["user", "assistant"]), says()) for t in range(r.randrange(1, 8))]
    for c in (400, 401, 402, 500):
        rows += [turn(c, t, "user", f"chain {t}") for t in range(19)]
    rows += [turn(600, t, "user", f"long {t}") for t in range(300)]
    rows += [turn(c, 0, "system", "the same") for c in range(700, 760)]
    rows += [turn(31, None, None, "before"), turn(None, 0, "user", "nobody's"), turn(8, 3, "user", "again"), turn(8, 3, "user", "again")]
    r.shuffle(rows)
    return rows




def brute_trie(rows, ranked, family=100, heads=6):
    own = defaultdict(list)
    for c, rank, role, text in sorted(ranked):
        own[c].append((role, text))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family if c >= 0 else -(abs(c) % family))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids[path])
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))))
        for p, m in members.items()
    )


def places(spark, rows, df):
    """(c, rank, role, text) as the operator orders them: by turn, equal turns by its hashes."""
    got = defaultdict(list)
    keyed = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    h1, h2 = trie.wide_hash(F.col("k"))
    for x in keyed.withColumn("h1", h1).withColumn("h2", h2).collect():
        if x.conv_id is not None:
            got[x.conv_id].append(((x.turn is not None, x.turn or 0, x.h1, x.h2), x.role, x.text))
    return [(c, n, role, text) for c, v in got.items() for n, (_, role, text) in enumerate(sorted(v))]


@pytest.mark.parametrize("piece,hash_of", [(4096, trie.wide_hash), (3, lambda c: (F.length(c).cast("long"), F.lit(1).cast("long")))])
def test_prefix_trie(spark, monkeypatch, piece, hash_of):
    """Also with pieces of three turns and ids, all levels joined by shuffles, and hashes that nearly always collide."""
    monkeypatch.setattr(trie, "PIECE", piece)
    if piece == 3:
        monkeypatch.setattr(trie, "SMALL", 0)
        monkeypatch.setattr(trie, "FILE_ROWS", 100)
    rows = conversations()
    if piece == 3:
        rows = [x for x in rows if x[1] is not None and not (x[0] == 8 and x[3] == "again")]  # equal turns follow by hash
        rows = [x for x in rows if x[1] < 30]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = Counter(tuple(x) for x in trie.prefix_trie(df, hash_of=hash_of).collect())
    want = brute_trie(rows, places(spark, rows, df))
    assert got == want


def test_trie_of_little(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([turn(None, 1, "user", "x")], TURNS)).collect() == []
    one = spark.createDataFrame([turn(5, 1, "user", "x"), turn(5, 2, "user", "yy")], TURNS)
    h = zlib.crc32(b"5") % 6
    got = sorted(tuple(x) for x in trie.prefix_trie(one).collect())
    assert len(got) == 1 + max(0, 2 - h) and got[0][:4] == (5, 0, None, 1)


DOCS = "doc_id long, text string, source string, part string, mask int, n long, salt int, first long"


def audited():
    r = random.Random(8)
    rows = []
    for i in range(150):
        words = [r.choice(fixtures.WORDS) + str(r.randrange(r.choice([3, 400]))) for _ in range(r.choice([0, 5, 150, 199, 200, 201, 400]))]
        text = " ".join(words) + r.choice(["", " #", " A B C " * r.randrange(9), "\x0b&"])
        rows.append((i, text, r.choice(["a", "b", None, ""])))
    rows += [(i + 1000, rows[i % 7][1], r.choice(["a", "c"])) for i in range(60)]  # copies
    rows += [(None, rows[3][1], "a"), (None, None, None), (2000, None, "a"), (-1, rows[3][1], "a"), (5, rows[5][1], "a"), (5, "other", "b"), (3000, "é" * 300 + " X", "d"), (3001, "w " * 200000, "d")]
    return [(*x, "p", 1, 1, 1, 1) for x in rows]


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, t, s, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * (i is not None and i > least.get(t, i))
        failed.append((s or "", set(f), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order):
                mine = [y for y in failed if y[0] == part]
                before = set(order[:step])
                gone = [y for y in mine if x in y[1] and not y[1] & before]
                shapley[part, x] += len(gone)
                kept = sum(not y[1] & (before | {x}) for y in mine)
                out[part, order, step + 1] = (kept, len(gone), sum(x in y[1] and bool(y[1] & before) for y in mine), sum(y[1] == {x} for y in mine), sum(y[2] for y in gone), sum(y[3] for y in gone))
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.mark.parametrize("hash_of", [audit.wide_hash, lambda c: (F.length(c).cast("long"), F.lit(1).cast("long"))])
def test_audit(spark, hash_of):
    rows = audited()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1040, 3)] + [(6, None, 1), (7, 1, None), (None, 1, 1), (9, 1, 0), (9, 0, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, marks, hash_of).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert Counter(map(tuple, got)) == brute_audit(rows, labels) and len(got) == 600 * len({x[2] or "" for x in rows})


def test_audit_of_nothing(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), marks).count() == 0
    assert audit.audit(spark.createDataFrame([(1, None, None, "", 0, 0, 0, 0)], DOCS), marks).count() == 600


TRICKY = ["", "<", "|", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<|text|>a<|image|>", "a<", "|b", "\n", "\\n", "é<|ü|>", None]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>ab\n", max_size=30))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.builds(lambda t: {"type": "text", "text": t}, st.text(alphabet="<|\\>a\n", max_size=8)), st.sampled_from([{"type": k, "ref": "r"} for k in ("image", "audio", "document")])), max_size=6))
def test_parts_are_read_back(parts):
    got = chat.parts_of("".join(chat.flatten(parts).pieces))
    want = [(p["type"], p.get("text", "")) for p in parts] or [("text", "")]
    assert got == want


def test_attachments():
    parts = [{"text": "see "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.01}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "image"}]
    seen = chat.flatten(parts)
    assert seen.attachments == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 768), (4, "image", None, 1)]
    assert "".join(seen.pieces) == "<|text|>see <|image|><|audio|><|document|><|image|>" and seen.texts == [(8, 4)]
    with pytest.raises(ValueError, match="video"):
        chat.flatten([{"type": "video"}])


def chats():
    r = random.Random(2)
    rows = [turn(c, t, r.choice(["user", "assistant", None, "as\nsis\\tant", "<|x|>"]), r.choice(TRICKY)) for c in range(20) for t in range(r.randrange(1, 9))]
    rows += [turn(3, None, "assistant", "first"), turn(None, 1, "assistant", "nobody's"), turn(4, 0, "user", "x"), turn(4, 0, "user", "x"), turn(50, 0, "assistant", "w " * 100000)]
    return rows + [turn(60, t, "assistant", f"long {t}") for t in range(400)]


def brute_chats(rows):
    groups = defaultdict(list)
    for c, t, role, text, *_ in rows:
        groups[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    out = set()
    for c, v in groups.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(v)]
        mine = "".join(t for r, t in turns if r == "assistant")
        whole = sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n") for r, t in turns)
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(mine), sha(mine), whole))
    return out


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_chats_are_read_back(spark, most):
    rows = chats()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    made = chat.format_chats(df, most=most)
    assert {tuple(x) for x in chat.read_back(made).collect()} == brute_chats(rows)
    turns = Counter((x.conv_id, x.role, x.body) for x in chat.read_chats(made).collect())
    assert turns == Counter((c, role or "", text or "") for c, _, role, text, *_ in rows)
    assert sum(x.n_turns for x in made.collect()) == len(rows)


def test_typed_parts(spark):
    shape = f"conv_id long, turn long, role string, parts {chat.PARTS}"
    p = lambda **x: (x.get("type"), x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [
        (1, 0, "user", [p(type="text", text="a <|image|> "), p(type="image", ref="i1", width=100, height=100), p(type="text", text="<"), p(type="text", text="|im_end|>")]),
        (1, 1, "assistant", [p(type="text", text="heard"), p(type="audio", ref="a1", seconds=2.0), p(text="so")]),
        (1, 2, "user", []),
        (1, 3, "user", None),
        (2, 0, "assistant", [p(type="document", ref="d1", pages=2)]),
    ]
    made = chat.format_chats(spark.createDataFrame(rows, shape), parts="parts").collect()
    got = {x.conv_id: x for x in made}
    assert [tuple(a) for a in got[1].attachments] == [(0, 1, "image", "i1", 16), (1, 1, "audio", "a1", 50)] and got[1].expanded_tokens == 66
    masked = [chat.unescape(got[1].formatted[s.start : s.start + s.length]) for s in got[1].loss]
    assert masked == ["heard", "so"] and got[2].loss == [] and got[2].expanded_tokens == 512
    read = chat.read_chats(spark.createDataFrame(made)).orderBy("conv_id", "turn").collect()
    assert [[tuple(x) for x in r.parts] for r in read] == [
        [("text", "a <|image|> "), ("image", ""), ("text", "<"), ("text", "|im_end|>")],
        [("text", "heard"), ("audio", ""), ("text", "so")],
        [("text", "")],
        [("text", "")],
        [("document", "")],
    ]


def test_no_chats(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0
