"""Retry bursts and replay spikes on live tables (the rest of ST3).

* A *retry burst* is a run of retries (attempt number above one) to one
  endpoint in which each follows the one before within ``gap``, and which has
  at least ``min_retries`` of them.  Session windows keep it in the state
  store; it is emitted once, when the watermark passes its end.  Tasks merge
  their own rows into sessions before the exchange, so a hot endpoint sends
  few rows.
* A *replay spike* is a day on which a tenant's replays reach ``percent`` per
  cent of its mean over its earlier active days, of which there must be
  ``min_days``.  Daily counts are a windowed aggregate (with partial sums in
  each task) and reach the second operator as one row for each tenant and
  day.  That one keeps the tenant's open days and its running baseline as
  keyed state; a timer at each day's end compares the day, emits the spike
  once and adds the day to the baseline, so days are judged in order whatever
  the order of arrival.

Both work on batch frames as well.  Rows without a time, an endpoint or a
tenant take no part, and rows behind the watermark are dropped, as in every
windowed stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import predicates as P

#: Session settings of the keyed state: its store, and sessions merged in each task before the exchange.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def stream_session(spark: SparkSession) -> SparkSession:
    """A session on the same context whose streams keep their state in RocksDB."""
    s = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(k, spark.conf.get(k))
    for k, v in STATE_CONF.items():
        s.conf.set(k, v)
    return s


# ---------------------------------------------------------------------------
# retry bursts
# ---------------------------------------------------------------------------
def retries_of(attempts: DataFrame) -> DataFrame:
    return attempts.where((F.col("attempt_number") > 1) & F.col("attempted_at").isNotNull() & F.col("endpoint_id").isNotNull())


def retry_bursts(retries: DataFrame, gap: str = "2 days", min_retries: int = 3) -> DataFrame:
    """One row per burst among :func:`retries_of` a table: endpoint, first and last retry, retries, failures,
    highest attempt number."""
    return (retries.groupBy(F.session_window("attempted_at", gap).alias("w"), "endpoint_id")
            .agg(F.count(F.lit(1)).alias("retries"), P.count_if(P.is_delivery_failure()).alias("failures"),
                 F.max("attempt_number").alias("max_attempt_number"), F.max("attempted_at").alias("last_retry"))
            .where(F.col("retries") >= min_retries)
            .select("endpoint_id", F.col("w.start").cast("timestamp_ntz").alias("first_retry"),
                    F.col("last_retry").cast("timestamp_ntz").alias("last_retry"), "retries", "failures", "max_attempt_number"))


def live_retry_bursts(attempts: DataFrame, gap: str = "2 days", min_retries: int = 3, delay: str = "2 hours") -> DataFrame:
    """The bursts of a stream of attempt rows that the watermark has passed."""
    timed = retries_of(attempts).withColumn("attempted_at", F.col("attempted_at").cast("timestamp"))
    return retry_bursts(timed.withWatermark("attempted_at", delay), gap, min_retries)  # only retries move the watermark


# ---------------------------------------------------------------------------
# replay spikes
# ---------------------------------------------------------------------------
DAY_MS = 86_400_000
SPIKES = "user_id string, day timestamp, replays long, earlier_days long, earlier_replays long"


def tenant_replays(replays: DataFrame) -> DataFrame:
    return replays.where(F.col("replayed_at").isNotNull() & F.col("user_id").isNotNull())


def daily_replays(known: DataFrame) -> DataFrame:
    """(w, user_id, replays) per tenant and day."""
    return known.groupBy(F.window("replayed_at", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("replays"))


def is_spike(replays, earlier_days, earlier_replays, percent: int, min_days: int):
    """Whole numbers only: replays / (earlier_replays / earlier_days) >= percent / 100."""
    return (earlier_days >= min_days) & (100 * replays * earlier_days >= percent * earlier_replays)


def replay_spikes(replays: DataFrame, percent: int = 120, min_days: int = 3) -> DataFrame:
    """The batch form: a running baseline over each tenant's days (one row for each tenant and day)."""
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = daily_replays(tenant_replays(replays)).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "replays")
    return (days.withColumn("earlier_days", F.count(F.lit(1)).over(before))
            .withColumn("earlier_replays", F.coalesce(F.sum("replays").over(before), F.lit(0).cast("bigint")))
            .where(is_spike(F.col("replays"), F.col("earlier_days"), F.col("earlier_replays"), percent, min_days)))


class SpikeDetector(StatefulProcessor):
    """Per tenant: open days (map state), baseline (value state) and a timer at the end of each open day."""

    def __init__(self, percent: int, min_days: int):
        self.percent, self.min_days = percent, min_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open_days", "day long", "replays long")
        self.baseline = handle.getValueState("baseline", "days long, replays long")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for end, n in zip(pdf["day_end_ms"], pdf["replays"]):
                day = (int(end),)
                known = self.open.getValue(day)[0] if self.open.containsKey(day) else 0
                self.open.updateValue(day, (known + int(n),))
                self.handle.registerTimer(int(end))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = int(expiredTimerInfo.getExpiryTimeInMs())
        if not self.open.containsKey((end,)):
            return
        n = int(self.open.getValue((end,))[0])
        days, total = self.baseline.get() if self.baseline.exists() else (0, 0)
        self.open.removeKey((end,))
        self.baseline.update((days + 1, total + n))
        if is_spike(n, days, total, self.percent, self.min_days):
            yield pd.DataFrame({"user_id": [key[0]], "day": [pd.Timestamp(end - DAY_MS, unit="ms")], "replays": [n],
                                "earlier_days": [days], "earlier_replays": [total]})

    def close(self) -> None:
        pass


def live_replay_spikes(replays: DataFrame, percent: int = 120, min_days: int = 3, delay: str = "2 hours") -> DataFrame:
    """The spikes of a stream of replay rows (from a :func:`stream_session`) whose days the watermark has passed."""
    timed = tenant_replays(replays).withColumn("replayed_at", F.col("replayed_at").cast("timestamp")).withWatermark("replayed_at", delay)
    days = daily_replays(timed).select(F.window_time("w").alias("day_time"), "user_id", "replays",
                                       F.unix_millis(F.col("w.end")).alias("day_end_ms"))
    return days.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SpikeDetector(percent, min_days), outputStructType=SPIKES, outputMode="Append", timeMode="EventTime")


def append_stream(df: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a stream that appends its rows to a parquet sink."""
    w = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
