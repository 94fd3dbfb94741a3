"""F12 of the third round: a text of many rows is written in parts, in order, and read back as one file."""

import csv
import io
import random

import duckdb
import pytest

from tessera.sources import queries, splits, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=[150, 1 << 27])
def blocks(spark, request):
    """Reads in blocks of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "134217728b", "spark.sql.files.openCostInBytes": "4194304b"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{request.param}b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in names.items():
        spark.conf.set(k, v)


def dealt(r, folder, records):
    """The records over part files of a folder, with gaps in their numbers."""
    folder.mkdir()
    cuts = sorted(r.randrange(len(records) + 1) for _ in range(12))
    for part, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(records)])):
        if i < j:
            (folder / f"part-{part + 2:05d}-{r.randrange(10**6)}.c000.txt").write_text("".join(records[i:j]))


def test_parts_are_one_csv_file(spark, tmp_path, blocks):
    r = random.Random(5)
    want = {}
    for name, n in (("s=A", 80), ("s=B", 1), ("s=C", 0)):
        rows = [[str(i), r.choice(["x", "a,b", 'say "hi"', "two\nlines"]), r.choice(["", "é" * 40])] for i in range(n)]
        out = []
        for row in [["id", "na\nme", "note"], *rows]:
            line = io.StringIO()
            csv.writer(line, lineterminator="\n").writerow(row)
            out.append(line.getvalue())
        dealt(r, tmp_path / name, out)
        want |= {(name, i): (n, ["id", "na\nme", "note"], row) for i, row in enumerate(rows)}
    got = splits.csv_records(spark, str(tmp_path), "*.txt", parts=True).collect()
    assert {(x.source.split("/")[-1], x.row): (x.total_rows, x.names, x.fields) for x in got} == want and len(got) == len(want)


def test_parts_are_one_log(spark, tmp_path, blocks):
    entries = [f"[2024-01-12 08:{i % 60:02d}] ERROR PO-{i} | one\n  more\n" for i in range(70)]
    dealt(random.Random(6), tmp_path / "t=a", entries)
    got = splits.text_records(spark, str(tmp_path), parts=True)["log"].drop("source")
    whole = text.log_entries(spark.createDataFrame([("a", "".join(entries))], "source string, text string"), "source", "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*got.columns).collect())) and got.count() == 70


def test_no_task_writes_a_whole_text(spark, monkeypatch):
    """Parts grow in number with the rows, and the results are those of the SQL."""
    monkeypatch.setattr(queries, "PART_ROWS", 40)
    written, roots = queries._written, []
    monkeypatch.setattr(queries, "_written", lambda *a: roots.append(written(*a)) or roots[-1])
    for name, base in (("csv_files", "orders"), ("log_files", "events")):
        sql = queries.ORACLES[name]
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {base} AS SELECT * FROM '{SF}/{base}.parquet'")
        want = duckdb.sql(sql)
        got = queries.QUERIES[name](spark, SF)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
        files = spark.read.text(roots[-1]).selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()
        assert len(files) > 10 and max(x["count"] for x in files) <= 3 * 200
