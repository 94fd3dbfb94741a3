"""Operators over documents against brute force, on the awkward fixture."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, fingerprint, linededup, minhash, mixing, packing, sharding, suffixes, toxicity

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_sets(rows, width):
    out = defaultdict(list)
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        out[i].append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, width=2, percent=80):
    sets = brute_sets([x for x in rows if x[0] is not None], width)
    flat = [(i, s) for i, many in sets.items() for s in many]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(flat):
        for j, b in flat[k + 1 :]:
            n = len(a & b)
            if a and b and 100 * n >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width,percent", [(2, 80), (5, 80), (2, 60)])
def test_near_duplicates(spark, width, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = fixtures.documents()
    got = minhash.near_duplicates(fixtures.frame(spark), width, percent).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, width, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.component_id in (None, r.doc_id)) for r in got)
    sizes = Counter((i, len(s)) for i, many in brute_sets(rows, width).items() for s in many)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_crowds_are_compared_whole(spark, monkeypatch):
    """A bucket whose least member is far from two others that are near to each other."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(11)
    base = fixtures.prose(r, 200)
    rows = [fixtures.row(i, fixtures.near(r, base, 10 + 3 * (i % 9))) for i in range(90)]
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(fixtures.frame(spark, rows), 2, 80).collect()}
    assert got == brute_components(rows)


def test_block_counts():
    r = np.random.default_rng(1)
    a = [np.unique(r.integers(0, 300, n, dtype=np.uint64)) for n in (1, 50, 200)]
    b = [np.unique(r.integers(0, 300, n, dtype=np.uint64)) for n in (80, 3)]
    assert minhash._counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (12, 10), (20, 20), (None, 1), (7, 8), (8, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.id, r.root) for r in got} == {(4, 3), (5, 3), (9, 3), (11, 10), (12, 10), (8, 7)} | {(101 + i, 100) for i in range(40)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least=1, min_docs=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and seen[key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("most", [linededup.BROADCAST_KEYS, 0])
def test_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", most)
    got = linededup.dedup_lines(fixtures.frame(spark))
    assert set(got.columns) >= {"lang", "source", "n", "entry"}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == Counter(brute_lines(fixtures.documents()))


def test_line_dedup_keeps_first_and_least(spark):
    rows = [fixtures.row(i, f"Head\nbody {i}\nhead \n\nab") for i in range(12)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(fixtures.frame(spark, rows), 10, 3, keep_first=True).collect()}
    assert got[0] == "Head\nbody 0\n\nab" and all(got[i] == f"body {i}\n\nab" for i in range(1, 12))


def brute_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length,gram,crowd,segment", [(200, 20, 2000, 1 << 20), (50, 16, 3, 1 << 20), (64, 20, 2000, 512), (20, 20, 0, 300)])
def test_repeated_strings(spark, monkeypatch, length, gram, crowd, segment):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    got = suffixes.without_repeats(fixtures.frame(spark), length, gram).collect()
    mine = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert mine == Counter(brute_repeats(fixtures.documents(), length))


@pytest.mark.parametrize("batches,crowd", [(2, 2000), (5, 2000), (8, 3)])
def test_batches_do_not_change_the_result(spark, monkeypatch, batches, crowd):
    """A table through its own index: strings are found both ways, in at most log2(n) + 1 levels, and nothing but spans stays."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    levels = []
    keep, drop = suffixes.LogIndex.keep, suffixes.LogIndex.drop
    monkeypatch.setattr(suffixes.LogIndex, "keep", lambda self, array: (keep(self, array), levels.append(sorted(self.levels))))
    monkeypatch.setattr(suffixes.LogIndex, "drop", lambda self: (drop(self), levels.append([])))
    before = len(suffixes.written(spark))
    got = suffixes.without_repeats(fixtures.frame(spark), 64, batches=batches).collect()
    mine = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
    assert mine == Counter(brute_repeats(fixtures.documents(), 64))
    # After i batches there is a level for each bit of i.
    assert levels == [[b for b in range(9) if i >> b & 1] for i in range(1, batches)] + [[]]
    assert len(suffixes.written(spark)) - before == 1 + batches


def test_equal_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    """With a window hash of one value all windows collide, and the result is still that of the bytes."""
    real = suffixes._window_hashes
    monkeypatch.setattr(suffixes, "_window_hashes", lambda find, sizes, data: (*real(find, sizes, data)[:2], np.zeros(len(real(find, sizes, data)[0]), np.uint64)))
    texts = [b"the same head and then one tail of its own", b"the same head and then another tail of it!", b"xx the same head and then one tail of"]
    rows = [(t[i:], t[:i]) for t in texts for i in [t.index(b"same")]]
    order = sorted(range(3), key=lambda i: rows[i])
    table = pa.table({"suffix": [rows[i][0] for i in order], "left": [rows[i][1] for i in order], "n": [1] * 3, "k1": order, "k2": order, "lo": [0] * 3})
    found = [r for b in suffixes._scanned(20, 4)(iter(table.to_batches())) for r in b.to_pylist()]
    want = {i: 0 for i in range(3)}
    for i, t in enumerate(texts):
        at = t.index(b"same")
        gone = set()
        for k in range(len(t) - 19):
            if any(u[u.index(b"same") + k - at :][:20] == t[k : k + 20] for j, u in enumerate(texts) if j != i and u.index(b"same") + k - at >= 0):
                gone |= set(range(k, k + 20))
        want[i] = len(gone)
    assert {i: sum(r["end"] - r["start"] for r in found if r["k1"] == i) for i in range(3)} == want and any(want.values())


def test_levels_are_kept_and_opened_again(spark, tmp_path):
    """Batches added over several calls, each by a family opened anew, find what any earlier batch holds."""
    path, rows = str(tmp_path / "index"), fixtures.documents()
    seen = []
    for k in range(5):
        part = rows[k::5]
        seen += part
        index = suffixes.LogIndex(spark, path, 64)
        got = suffixes.without_repeats(fixtures.frame(spark, part), 64, index=index).collect()
        mine = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)
        assert mine == Counter(brute_repeats(seen, 64)[len(seen) - len(part) :])
    last = suffixes.LogIndex(spark, path, 64)
    assert sorted(last.levels) == [0, 2]  # five batches: one, and four that have merged
    for i in last.levels:  # arrays are sorted by their bytes within a file
        for part in last.level(i).withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list(F.struct("head", "suffix", "left")).alias("x")).collect():
            assert [tuple(e) for e in part.x] == sorted(tuple(e) for e in part.x)
    with pytest.raises(ValueError):
        suffixes.LogIndex(spark, path, 65)


def test_sharding(spark):
    rows = fixtures.documents()
    got = sharding.shard(fixtures.frame(spark), 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)

    def jump(key, n):
        b, j, key = -1, 0, key % 2**64
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    for r in got:
        assert r.shard == jump(r.doc_id or 0, 40) and r.grown_shard == jump(r.doc_id or 0, 41)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert jump(-5, 40) == sharding.jump_hash(np.array([-5], np.int64).view(np.uint64), 40)[0]
    spread = np.bincount(sharding.jump_hash(np.arange(40_000, dtype=np.uint64), 40))
    assert spread.min() > 850 and spread.max() < 1150


def test_mixing(spark):
    targets = {"": 2, "src0": 5, "src1": 3, "src2": 1}
    rows = fixtures.documents()
    got = mixing.mix(fixtures.frame(spark), targets, 3).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in rows)
    by = defaultdict(list)
    for r in got:
        assert r.entry == (r.source if r.source in targets else "")
        assert r.release <= r.slot < r.deadline
        by[r.entry].append(r)
    for entry, part in by.items():
        part.sort(key=lambda r: (r.block, r.place))
        assert [r.block * 3 + r.place for r in part] == list(range(len(part)))
        assert [r.doc_id for r in part] == sorted((r.doc_id for r in part), key=lambda x: (x is not None, x or 0))
    assert len({(r.slot) for r in got}) == len({(r.entry, r.block) for r in got})
    order = [(r.doc_id, r.text) for r in mixing.mixed(fixtures.frame(spark), targets, 3).collect()]
    assert order == [(r.doc_id, r.text) for r in sorted(got, key=lambda r: (r.slot, r.place))]


def test_numbers_of_rows_without_keys(spark):
    from tessera.llm.common import gapless

    rows = [(None if i % 3 else i, i, "g" if i % 2 else None) for i in range(400)]
    got = gapless(spark.createDataFrame(rows, "k long, t long, _n string"), ["_n"], "k", [F.col("t")], "at", 10).collect()
    for g in (None, "g"):
        part = sorted((r for r in got if r._n == g), key=lambda r: r.at)
        assert [r.at for r in part] == list(range(200))
        known = [r.k for r in part if r.k is not None]
        assert [r.k for r in part][-len(known) :] == sorted(known)


def test_schedule_deviates_by_less_than_one_block():
    targets = mixing.TARGETS
    period, seen = sum(targets.values()), Counter()
    for name, _, release, deadline, slot in mixing.plan(targets):
        assert release <= slot < deadline
        seen[name] += 1
        for k, w in targets.items():
            assert abs(seen[k] - w * (slot + 1) / period) < 1
    assert seen == Counter(targets)
    with pytest.raises(ValueError):
        mixing.mix(None, {"a": 0})


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = fixtures.documents()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    got = packing.pack(fixtures.frame(spark)).collect()
    assert sum(r.length for r in got) == sum(len(b) // 4 for many in texts.values() for b in many)
    for r in got:
        assert any(len(b) // 4 == r.doc_tokens and zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for b in texts[r.doc_id])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for part in bins.values():
        part.sort(key=lambda r: r.offset)
        ends = np.cumsum([0] + [r.length for r in part])
        assert [r.offset for r in part] == ends[:-1].tolist() and ends[-1] <= 2048
        total = int(ends[-1])
        assert part[0].padded == (total if total & (total - 1) == 0 else 2048)


def test_piece_classes():
    for n in [*range(1, 5000), 65536, 10**6 + 7]:
        pieces = packing.cut(n)
        assert sum(length for _, length in pieces) == n
        assert all(0 < length and length * k <= 2048 for k, length in pieces)


def test_word_codes_match_the_tokenizer(monkeypatch):
    codes = packing.WordCodes(packing.tokenizer_path())
    texts = ["Don't stop, a.b,c. x,", "", "  ", "<|endoftext|> hi <|startoftext|>x", "<|ENDOFTEXT|>", "ΣΑΣ İx, ǅ. Å é́", "foo\x1cbar!\x85?", "​x ﬁn, ²x ½.", "Äkeitß$$$ Œuvre,*** it's 'll Ÿ", None, "1,2 3. ,. .,", "日本語 テスト, 漢字."]
    for t, got in zip(texts, codes.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == codes.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert codes.shortcut
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    fresh = packing.WordCodes(packing.tokenizer_path())
    assert fresh.encode(texts) == codes.encode(texts) and len(fresh) <= 3
    other = packing.WordCodes(packing.tokenizer_path("byte_bpe_50k.json"))  # other rules: no shortcut
    assert not other.shortcut
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [other.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_codes_on_random_strings():
    import random

    r = random.Random(8)
    letters = "abcXYZ'éÉßẞœŒÿŸÅKİıǅé  \n\t\u00a0.,;!?%$-_0129½²<|>~`\u0301日本ΣσςйЙ"
    codes = packing.WordCodes(packing.tokenizer_path())
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    for t, got in zip(texts, codes.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == codes.tokenizer.encode(t, add_special_tokens=False).ids, t


def brute_edited(rows):
    rows = sorted(rows, key=lambda x: -x[0])
    out = {}
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [256, 5])
def test_fingerprints(spark, monkeypatch, width):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (width, 1 << 20, lambda d: d))
    rows = fixtures.unique(fixtures.documents())
    got = {r.doc_id: r for r in fingerprint.fingerprints(fixtures.frame(spark, rows)).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute_edited(rows)
    assert got[100].fingerprint == got[101].fingerprint == got[102].fingerprint != got[103].fingerprint
    assert got[103].fingerprint == got[104].fingerprint and got[104].near_next == 1.0 and got[103].near_next == 0.0
    names = {i: r.fingerprint for i, r in got.items()}
    for i, t, *_ in rows:
        for j, u, *_ in rows:
            if (t or "") == (u or ""):
                assert names[i] == names[j]
    for r in got.values():
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)


def test_fingerprint_rows_without_or_with_repeated_ids(spark):
    assert fingerprint.fingerprints(fixtures.frame(spark)).count() == len(fixtures.documents())
    one = fingerprint.fingerprints(fixtures.frame(spark, [fixtures.row(None, "abc")])).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_next_rows_without_ids(spark):
    """Rows without an id are split too; each row's next is the one after it in the whole order."""
    rows = [fixtures.row(None, f"text {i % 40}") for i in range(120)] + [fixtures.row(i, f"named {i}") for i in range(9)]
    got = fingerprint.with_next(fixtures.frame(spark, rows).select("doc_id", "text"), 7).collect()
    key = lambda r: (r.doc_id is None, -(r.doc_id or 0), r.t1, r.t2)
    ordered = sorted(got, key=key)
    assert len(got) == len(rows)
    assert Counter((key(r), r.after_text) for r in got) == Counter((key(r), ordered[(i + 1) % len(rows)].text) for i, r in enumerate(ordered))


def test_fingerprints_and_likeness_by_brute_force(spark):
    import unicodedata

    def form(t):
        t = unicodedata.normalize("NFKC", t or "").translate(str.maketrans(fingerprint.LOOKS, fingerprint.PLAIN))
        return " ".join(unicodedata.normalize("NFKC", t.lower()).split())

    rows = fixtures.unique(fixtures.documents()) + [fixtures.row(i, t) for i, t in enumerate(["Ｆull  Ｗidth", "full width", "ab ab ab ab", "x", "X", "a\u0301 b", "á  B"], 300)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(fixtures.frame(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda x: -x[0])
    names = defaultdict(set)
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i].near_edited, got[i].near_next) == (float(form(t) == form(e)), float(form(t) == form(after)))
        names[form(t)].add(got[i].fingerprint)
        names[form(e)].add(got[i].edited_fingerprint)
    assert all(len(v) == 1 for v in names.values()) and len({x for v in names.values() for x in v}) == len(names)


def test_canonical_form_of_every_code_point(spark):
    import unicodedata

    points = [(i, "a" + chr(i) + "b") for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    got = spark.createDataFrame(points, "i int, t string").select("i", "t", fingerprint.canonical(F.col("t")).alias("c")).toPandas()
    changed = 0
    for i, t, c in got.itertuples(index=False):
        want = unicodedata.normalize("NFKC", t).translate(str.maketrans(fingerprint.LOOKS, fingerprint.PLAIN))
        want = unicodedata.normalize("NFKC", want.lower())
        changed += want != t
        if not any(x.isspace() for x in want):
            # The two libraries hold different versions of Unicode: letters new in one are not lower-cased by the other.
            assert c == want or unicodedata.normalize("NFKC", c) == c and chr(i).lower() != chr(i), hex(i)
    assert changed > 5000


def test_fingerprint_collisions_are_told_apart(spark):
    from pyspark.sql import functions as F

    weak = lambda c: (F.lit(1).cast("long"), F.length(c).cast("long") % 2)
    rows = [fixtures.row(i, t) for i, t in enumerate(["aa", "bb", "aa", "c", "d", "C", "AA "])]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(fixtures.frame(spark, rows), weak).collect()}
    assert got[0] == got[2] == got[6] and got[3] == got[5] and len({got[0], got[1], got[3], got[4]}) == 4


def test_canonical_form(spark):
    from pyspark.sql import functions as F

    pairs = [("Café  AU\tlait ", "café au lait"), ("ＡＢＣ", "abc"), ("“x” – y", '"x" - y'), ("a b", "a b"), (None, "")]
    got = spark.createDataFrame([(a,) for a, _ in pairs], "t string").select(fingerprint.canonical(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in pairs]


def test_toxicity(spark):
    import random

    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = fixtures.prose(r, 25) + ". "
        if bad:
            text += f"You {r.choice(['blargh', 'snorfel', 'gribbet'])} are {r.choice(['vuxling', 'vuxhed', 'vuxmor'])}. " + fixtures.prose(r, 10)
        rows.append(fixtures.row(i, text))
        labels.append((i, 1, int(bad)))
    extra = [fixtures.row(900, None), fixtures.row(901, ""), fixtures.row(None, "blargh you blargh"), fixtures.row(902, "x " * 50_000)]
    docs = fixtures.frame(spark, rows + extra)
    table = spark.createDataFrame([*labels, (None, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(docs, table)
    got = {x.doc_id: x for x in toxicity.score(docs, grammar).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [x for x in got.values() if x.doc_id is not None and x.doc_id < 400 and x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in held)
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) / len(held) > 0.95
    assert 0 <= got[901].score < 0.5 and got[900].score == got[901].score and not got[None].held_out
    kept = toxicity.without_toxic(docs, grammar)
    assert kept.columns == docs.columns and not any(x.doc_id == 5 for x in kept.collect())
    assert toxicity.learn(docs, spark.createDataFrame([], table.schema)).score("blargh") < 0.5


def brute_factors(kinds):
    """What the grammar does to each insult and threat, said without states."""
    out = []
    for i, k in enumerate(kinds):
        if k not in (toxicity.INSULT, toxicity.THREAT):
            out.append(1.0)
            continue
        near = kinds[max(0, i - toxicity.TARGET_REACH) : i] + kinds[i + 1 : i + 1 + toxicity.TARGET_REACH]
        aimed = toxicity.TARGET in near
        w = toxicity.TARGETED if aimed else toxicity.UNAIMED if k == toxicity.THREAT else 1.0
        w *= toxicity.REPORTED if toxicity.REPORT in kinds[:i] else 1.0
        w *= toxicity.NEGATED if toxicity.NEGATION in kinds[max(0, i - toxicity.NEGATION_REACH) : i] else 1.0
        out.append(w)
    return out


def test_composition_equals_running_in_turn():
    import random

    r = random.Random(2)
    machines = [toxicity.targets(), toxicity.reports(), toxicity.negations(), toxicity.insults(), toxicity.threats()]
    for _ in range(300):
        word = [r.choice(toxicity.SYMBOLS) for _ in range(r.randrange(15))]
        for a in machines:
            for b in machines:
                one = a.run(word)
                two = b.run(s for s, _ in one)
                assert toxicity.compose(a, b).run(word) == [(s, v * w) for (_, v), (s, w) in zip(one, two, strict=True)]


def test_clause_weights_by_brute_force():
    import random

    r = random.Random(3)
    g = toxicity.Grammar({"w:blargh": 5.0, "a:menace": 2.0})
    words = {"blargh": toxicity.INSULT, "menace": toxicity.THREAT, "kill": toxicity.THREAT, "you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT, "tree": toxicity.OTHER}
    weights = {"blargh": 5.0, "menace": 2.0, "kill": toxicity.THREAT_WEIGHT}
    for _ in range(2000):
        clause = [r.choice(list(words)) for _ in range(r.randrange(12))]
        factors = brute_factors([words[w] for w in clause])
        assert math.isclose(g.clause(clause), sum(f * weights.get(w, 0.0) for w, f in zip(clause, factors, strict=True)))


def test_threats_are_learned_where_aimed(spark):
    """A word that is harmless alone and toxic next to a target becomes a threat."""
    import random

    r = random.Random(7)
    rows = [fixtures.row(i, fixtures.prose(r, 20) + (". I shall zorp you. " if i % 4 == 0 else ". They zorp wood daily here now. " if i % 4 == 1 else ". ") + fixtures.prose(r, 9)) for i in range(400)]
    rows = [(i, t.replace("They zorp", "Some zorp"), *x) for i, t, *x in rows]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(4, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    g = toxicity.learn(fixtures.frame(spark, rows), labels)
    assert g.arc("zorp")[0] == toxicity.THREAT and g.score("i will zorp you") > 0.5 > g.score("we zorp trees")


def test_grammar_composes():
    g = toxicity.Grammar({"w:blargh": 5.0})
    plain, aimed = g.clause("the blargh thing".split()), g.clause("you are a blargh".split())
    assert g.clause("a blargh you".split()) == aimed > plain
    assert g.clause("you are not a blargh".split()) < aimed
    assert g.clause("he said you are a blargh".split()) < aimed
    assert g.clause("he said you are not a blargh".split()) < g.clause("he said you are a blargh".split())
    assert g.clause("i will kill you".split()) > g.clause("kill the process".split()) > 0
    assert g.clause("hello there".split()) == 0
    assert math.isclose(g.features("blargh. fine.")[0], plain / 4)


@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: minhash.near_duplicates(d),
        lambda d, s: linededup.dedup_lines(d),
        lambda d, s: suffixes.without_repeats(d),
        lambda d, s: sharding.shard(d, 40),
        lambda d, s: mixing.mix(d, mixing.TARGETS),
        lambda d, s: packing.pack(d),
        lambda d, s: fingerprint.fingerprints(d),
        lambda d, s: toxicity.score(d, toxicity.learn(d, s.createDataFrame([], "doc_id long, quality int, toxic int"))),
    ],
)
def test_empty_table(spark, run):
    assert run(fixtures.frame(spark, []), spark).count() == 0


def test_canonical_form_covers_all_of_unicode(spark):
    import unicodedata

    from pyspark.sql import functions as F

    letters = "ąężČěřďťňőűğāēµάέΐΰйёїấệộ각힣ﬁﬀ½™ｱｶﾞÅΩİǅ"
    pairs = [(x, form, unicodedata.normalize(form, f"A {x} z")) for x in letters for form in ("NFC", "NFD", "NFKC", "NFKD")]
    pairs += [("marks", str(i), "q" + m) for i, m in enumerate(("̣̇", "̣̇"))]
    got = spark.createDataFrame(pairs, "x string, form string, t string").select("x", fingerprint.canonical(F.col("t")).alias("c")).distinct().collect()
    assert len(got) == len({x for x, *_ in pairs})


def test_what_toxicity_learns_by_plain_counts(spark):
    """Lexicon, coefficients and scores again without the operator's code: counts of training texts, odds, and the optimum of the penalised likelihood."""
    import math
    import random

    r = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        bad = r.random() < 0.3
        said = fixtures.prose(r, 12) + (f". You {r.choice(['blargh', 'snorfel'])} are vux{r.randrange(3)}led. " if bad or r.random() < 0.05 else ". ") + fixtures.prose(r, 5)
        rows.append(fixtures.row(i, said))
        labels.append((i, 1, int(bad)))
    rows += [fixtures.row(1000 + i, rows[i][1]) for i in range(0, 60, 3)] + [fixtures.row(2000, None)]
    labels += [(1000 + i, 1, 1 - labels[i][2] if i % 2 else labels[i][2]) for i in range(0, 60, 3)] + [(2000, 1, 1), (3, 1, None)]
    grammar = toxicity.learn(fixtures.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts, votes = {x[0]: x[1] for x in rows}, defaultdict(list)
    for i, _, t in labels:
        if t is not None and zlib.crc32(str(i).encode()) % 5 and texts[i] is not None:
            votes[texts[i]].append(t)
    sample = {t: int(2 * sum(v) >= len(v)) for t, v in votes.items()}
    seen = {0: Counter(), 1: Counter()}
    for t, label in sample.items():
        low = t.lower()
        words = set(toxicity.WORD.findall(low))
        seen[label].update({"w:" + w for w in words} | {"p:" + w[:n] for w in words for n in toxicity.STEMS if len(w) > n} | {"a:" + w for w in toxicity.aimed_words(low)})
    positive = sum(sample.values())
    want = {}
    for e, t in seen[1].items():
        odds = (t + 1) / (seen[0][e] + 2)
        if t >= toxicity.LEAST_TOXIC and odds >= toxicity.LEAST_ODDS:
            want[e] = min(max(math.log(odds * (len(sample) - positive) / positive), 0.1), 8.0)
    assert want and grammar.lexicon.keys() == want.keys() and all(abs(grammar.lexicon[e] - v) < 1e-9 for e, v in want.items())
    # At the optimum, residuals and penalty balance for every coefficient.
    *w, bias = grammar.coefficients
    x = [grammar.features(t) for t in sample]
    p = [1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(w, f))))) for f in x]
    slopes = [sum((y - q) * f[j] for f, y, q in zip(x, sample.values(), p)) - 0.05 * w[j] for j in range(3)] + [sum(y - q for y, q in zip(sample.values(), p)) - 0.0005 * bias]
    assert max(map(abs, slopes)) < 1e-5
    got = {s.doc_id: s.score for s in toxicity.score(fixtures.frame(spark, rows), grammar).collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(w, grammar.features(t))))))) < 1e-12 for i, t in texts.items())
