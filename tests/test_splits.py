"""Records of files in byte ranges: the same as of whole files, wherever the blocks are cut."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import reader, splits, text


@pytest.fixture
def cut(spark):
    """Reads in blocks of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "134217728b", "spark.sql.files.openCostInBytes": "4194304b"}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")

    yield to
    for k, v in names.items():
        spark.conf.set(k, v)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a",\n', max_size=24))
def test_quotes_are_followed_as_the_csv_module_does(body):
    """Line by line, a value is open exactly where the csv module goes on with the record."""
    inside, opened = False, []
    for line in body.split("\n"):
        opened.append(inside)
        inside = splits.quoted_after(line, inside)
    rows, at = [], 0
    source = csv.reader(io.StringIO(body))
    for _ in source:
        rows.append(at)
        at = source.line_num
    begins = [i for i, x in enumerate(opened) if not x]
    assert [i for i in begins if i < at] == rows


def noisy_csv(r, rows):
    out = io.StringIO()
    out.write("id,na\"me,,note\n")
    for i in range(rows):
        value = lambda: r.choice(["", "x", "a,b", 'say "hi"', "two\nlines", "\n\n", '"', "é", " "])
        csv.writer(out, lineterminator=r.choice(["\n", "\n", "\n\n"])).writerow([str(i), value(), value(), value()][: r.choice([2, 4, 4])])
    return out.getvalue() + r.choice(["", '99,un"quoted, "x" y\n', '100,"never closed\nto the end'])


@pytest.mark.parametrize("size", [400, 1 << 27])
def test_csv(spark, tmp_path, cut, size):
    cut(size)
    r = random.Random(size)
    files = {f"{i}.csv": noisy_csv(r, r.choice([0, 1, 60])) for i in range(5)}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "empty.csv").write_text("")
    got = {(x.source.split("/")[-1], x.row): (x.total_rows, x.names, x.fields) for x in splits.csv_records(spark, str(tmp_path)).collect()}
    want = {}
    for name, body in files.items():
        head, *rows = [x for x in csv.reader(io.StringIO(body)) if x]
        want |= {(name, i): (len(rows), head, x) for i, x in enumerate(rows)}
    assert got == want
    texts = {(x.source.split("/")[-1], x.part): x.text for x in reader.ingest(spark, str(tmp_path), ["csv"]).collect()}
    named = {k: "\n".join(f"{a}: {b}" for a, b in zip(v[1], v[2]) if a and b) for k, v in want.items()}
    assert texts == {k: v for k, v in named.items() if v.strip(" ")}


def noisy_log(r, rows):
    out = r.choice(["", "\n \n", "before\n\nit\n"])
    for i in range(rows):
        out += r.choice(["[2024-01-12 08:00] ERROR PO-4521 | x", " 2024-01-12 09:00:01 - y", "  more", "", "at line 3", "{2024/01/12 10:00} WARNING z"]) + f" {i}" * r.randrange(2) + "\n"
    return out


def noisy_mail(r, rows):
    part = lambda i: f"From: a{i}@b\nTo: c@d\nSubject: s{i}\n\nbody\n\nof {i}\n"
    if r.random() < 0.5:
        return "".join(r.choice(["From x@y Mon\n", "From z@y\n"]) + part(i) for i in range(max(2, rows)))
    return "---\n".join(part(i) for i in range(rows)) + "-----  \n\n"


def noisy_plain(r, rows):
    return "".join(r.choice(["one", "two words", " ", "", "", "\t"]) + "\n" for _ in range(rows))


@pytest.mark.parametrize("size", [300, 1 << 27])
def test_texts(spark, tmp_path, cut, size):
    cut(size)
    r = random.Random(size)
    files = {}
    for i in range(4):
        files[f"a{i}.log"] = "2024-01-12 08:00 a\n2024-01-12 08:01 b\n2024-01-12 08:02 c\n" + noisy_log(r, 50)
        files[f"b{i}.TXT"] = noisy_mail(r, 6)
        files[f"c{i}.md"] = "plain\n\n" + noisy_plain(r, 60)
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = splits.text_records(spark, str(tmp_path), reader._glob(["log", "txt", "md"]))
    docs = spark.createDataFrame(sorted(files.items()), "source string, text string")
    whole = {"log": text.log_entries(docs.where("source LIKE 'a%'"), "source", "text"), "email": text.emails(docs.where("source LIKE 'b%'"), "source", "text"), "plain": text.plain_sections(docs.where("source LIKE 'c%'"), "source", "text")}
    for kind, want in whole.items():
        seen = {tuple(str(v).split("/")[-1] if c == "source" else v for c, v in zip(want.columns, x)) for x in got[kind].select(*want.columns).collect()}
        assert seen == {tuple(x) for x in want.collect()} and seen, kind


def test_a_value_over_many_blocks(spark, tmp_path, cut):
    cut(250)
    (tmp_path / "a.csv").write_text('k,v\n1,"' + "line, of\n" * 100 + '"\n2,x\n')
    rows = splits.csv_records(spark, str(tmp_path)).orderBy("row").collect()
    assert [(x.row, x.fields) for x in rows] == [(0, ["1", "line, of\n" * 100]), (1, ["2", "x"])]


def test_many_open_blocks_are_joined(spark, tmp_path, cut, monkeypatch):
    monkeypatch.setattr(splits, "BROADCAST_BLOCKS", 0)
    test_csv(spark, tmp_path, cut, 400)


def test_no_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    (tmp_path / "a.csv").write_text("")
    assert splits.csv_records(spark, str(tmp_path)).count() == 0
    assert all(x.count() == 0 for x in splits.text_records(spark, str(tmp_path)).values())
