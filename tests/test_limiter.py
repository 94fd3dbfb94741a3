"""The limiter's decisions over several micro-batches, against a plain loop."""

import datetime
import random

from tessera.streaming import limiter


def test_decisions_across_batches(spark, tmp_path):
    r = random.Random(7)
    start = datetime.datetime(2024, 5, 1, 23, 50, tzinfo=datetime.timezone.utc)
    rows, at = [], 0
    for i in range(400):
        at += r.choice([0, 1, 5, 30])
        rows.append((i, r.choice([1, 1, 1, 2, 3]), start + datetime.timedelta(seconds=at)))
    rows += [(1000, None, start), (1001, 1, None)]
    schema = "id long, who long, ts timestamp"
    want, states = {}, {}
    for part in range(4):  # a file is a micro-batch
        mine = rows[part * 100 : part * 100 + 100] + (rows[400:] if part == 0 else [])
        r.shuffle(mine)
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        said = limiter.limited(stream, "who", "id", per_window=3, seconds=60, per_day=60, late="1 day")
        query = said.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        for i, who, ts in sorted((x for x in mine if x[1] is not None and x[2] is not None), key=lambda x: (x[2], x[0])):
            now = round(ts.timestamp() * 1e6)
            days, recent = states.setdefault(who, ({}, []))
            recent[:] = [t for t in recent if t > now - 60_000_000]
            used = days.get(ts.date(), 0)
            want[i] = limiter.SPENT if used >= 60 else limiter.BUSY if len(recent) >= 3 else limiter.ADMITTED
            if want[i] == limiter.ADMITTED:
                recent.append(now)
                days[ts.date()] = used + 1
    got = {x.id: x.decision for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and set(want.values()) == {limiter.SPENT, limiter.BUSY, limiter.ADMITTED}


def test_time_does_not_run_back():
    one = limiter.Limiter(2, 60_000_000, 3)
    assert [one.decide(t * 1_000_000) for t in (0, 1, 2, 61, 62)] == [limiter.ADMITTED, limiter.ADMITTED, limiter.BUSY, limiter.ADMITTED, limiter.SPENT]
    assert one.decide(limiter.DAY) == limiter.ADMITTED and one.used == 1
