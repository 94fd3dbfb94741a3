"""A request limiter with state: each request of a stream is admitted or refused by what was admitted before it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import work_dir
from tessera.streaming.windows import event_stream

# Requests in a window of so many seconds, and on a day.
PER_WINDOW, WINDOW, PER_DAY = 15, 60, 1000
DAY = 86_400_000_000
ADMITTED, BUSY, SPENT = "admitted", "window full", "budget spent"


class Limiter:
    """What one key has used: the admitted requests of the last ``window`` microseconds, and those of the day (UTC)."""

    def __init__(self, per_window: int, window: int, per_day: int, state: tuple = (-1, 0, [])):
        self.per_window, self.window, self.per_day = per_window, window, per_day
        self.day, self.used, self.recent = state[0], state[1], list(state[2])

    def decide(self, at: int) -> str:
        """Admit or refuse a request at ``at`` (microseconds); a refused one uses nothing. Times do not run back."""
        if at // DAY != self.day:
            self.day, self.used = at // DAY, 0
        self.recent = [t for t in self.recent if t > at - self.window]
        if self.used >= self.per_day:
            return SPENT
        if len(self.recent) >= self.per_window:
            return BUSY
        self.recent.append(at)
        self.used += 1
        return ADMITTED


def limited(requests: DataFrame, key: str, request: str, ts: str = "ts", per_window: int = PER_WINDOW, seconds: int = WINDOW, per_day: int = PER_DAY, late: str = "1 hour") -> DataFrame:
    """(key, request, ts, decision) of each request of a stream, by an exact state for each key; keys and request ids are longs.

    Requests of a micro-batch are decided in the order of time, then of id. One that comes later than the last one decided is decided
    at that one's time, so that no decision is taken back; one beyond the watermark is refused by Spark before it comes here. A state holds at most
    ``per_window`` times and leaves with the watermark, a day after its last request. Rows without a key or a time are no requests. The ids
    and times of one key in one micro-batch are sorted in memory: the source's rate option (files or bytes a trigger) bounds them.
    """
    state_of = "day long, used long, recent array<long>, last long"
    names = ["key", "request", "ts", "decision"]

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day, used, recent, last = state.get if state.exists else (-1, 0, [], 0)
        limiter = Limiter(per_window, seconds * 1_000_000, per_day, (day, used, recent))
        rows = pd.concat([b[["at", "request", "ts"]] for b in batches]).sort_values(["at", "request"], kind="stable")
        said = []
        for at in rows["at"]:
            last = max(last, int(at))
            said.append(limiter.decide(last))
        state.update((limiter.day, limiter.used, limiter.recent, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + DAY // 1000)
        yield pd.DataFrame({"key": k[0], "request": rows["request"], "ts": rows["ts"], "decision": said}, columns=names)

    rows = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(request).cast("long").alias("request"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"))
    out = rows.groupBy("key").applyInPandasWithState(decide, "key long, request long, ts timestamp, decision string", state_of, "append", GroupStateTimeout.EventTimeTimeout)
    return out.toDF(key, request, "ts", "decision")


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run a bounded stream to its end into files of the engine's own folder, and read them."""
    spark = df.sparkSession
    root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


#: Limits for the events of the tables, which are hours apart.
ASKED = {"per_window": 2, "seconds": 21_600, "per_day": 3}


def _limited(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a request of its user."""
    said = run_to_table(limited(event_stream(spark, d), "user_id", "event_id", late="40 days", **ASKED), "limited")
    return said.select("event_id", "user_id", "decision")


QUERIES = {"stream_limiter": _limited}
ORACLES = {
    "stream_limiter": f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
run(user_id, i, event_id, decision, recent, day, used) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, '', []::BIGINT[], -1::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, i, event_id, decision, CASE WHEN decision = '{ADMITTED}' THEN list_append(live, us) ELSE live END, day, before + (decision = '{ADMITTED}')::BIGINT
  FROM (
    SELECT *, CASE WHEN before >= {ASKED['per_day']} THEN '{SPENT}' WHEN len(live) >= {ASKED['per_window']} THEN '{BUSY}' ELSE '{ADMITTED}' END AS decision
    FROM (
      SELECT e.user_id, e.i, e.event_id, e.us, e.us // {DAY} AS day, CASE WHEN e.us // {DAY} = run.day THEN run.used ELSE 0 END AS before,
             list_filter(run.recent, lambda t: t > e.us - {ASKED['seconds'] * 1_000_000}) AS live
      FROM run JOIN e ON e.user_id = run.user_id AND e.i = run.i + 1
    )
  )
)
SELECT event_id, user_id, decision FROM run WHERE i > 0
"""
}
