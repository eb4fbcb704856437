"""Streams equal their batch twins (ST1-ST3)."""
import os

from pyspark.sql import functions as F

import uploads
from paths import SF0001
from deliverylens.plans import jobs
from deliverylens.sources.testdata import load_tables
from deliverylens.streaming import jobs as ST


def _attempt_files(spark, scratch):
    """The sf0.001 attempts as three parquet files arriving in a folder."""
    src = os.path.join(scratch, "incoming")
    a = load_tables(spark, SF0001).attempts
    a = a.withColumn("_b", F.pmod(F.xxhash64("attempt_id"), F.lit(3)))
    for b in range(3):
        a.where(F.col("_b") == b).drop("_b").coalesce(1).write.parquet(os.path.join(src, f"part{b}"))
    return a.drop("_b"), os.path.join(src, "*")


def test_stream_health_equals_batch(spark, scratch):
    batch_in, src = _attempt_files(spark, scratch)
    sink = os.path.join(scratch, "health")
    q = ST.stream_endpoint_health(spark, src, sink, checkpoint=os.path.join(scratch, "ck"), delay="0 seconds")
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = ST.endpoint_health_windows(batch_in, "1 hour")
    cols = ["window_start", "endpoint_id", "total_attempts", "failure_count", "timeout_count", "avg_response_time"]
    # windows behind the watermark (the latest time seen) are closed: exactly
    # those are emitted, and they equal the batch rows
    last = batch_in.agg(F.max("attempted_at")).first()[0]
    closed = want.where(F.col("window_start") + F.expr("interval 1 hour") <= F.lit(last)).select(*cols)
    assert closed.count() > 0
    assert got.select(*cols).exceptAll(closed).count() == 0 == closed.exceptAll(got.select(*cols)).count()


def test_stream_dedupe(spark, scratch):
    batch_in, src = _attempt_files(spark, scratch)
    sink = os.path.join(scratch, "dedupe")
    q = ST.stream_dedupe_attempts(spark, src, sink, checkpoint=os.path.join(scratch, "ck"), delay="36500 days")
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    keys = batch_in.select("event_id", "attempt_number").distinct().count()
    assert got.count() == keys
    assert got.select("event_id", "attempt_number").distinct().count() == keys


def test_stream_ingest_equals_batch(spark, scratch):
    src = os.path.join(scratch, "uploads")
    os.makedirs(src)
    uploads.write(src, "steady.csv")
    uploads.write(src, "slow.csv", columns=uploads.HEADER[::-1])  # another column order
    uploads.write(src, "bad_keys.csv")
    streamed = os.path.join(scratch, "streamed")
    q = ST.stream_ingest_csv(spark, src, streamed, "user_3", checkpoint=os.path.join(scratch, "ck"))
    q.awaitTermination(300)
    batch = os.path.join(scratch, "batch")
    jobs.ingest_csv_job(spark, src, batch, "user_3")
    a, b = jobs.read_tables(spark, streamed), jobs.read_tables(spark, batch)
    key = ["attempt_id", "event_id", "attempt_number", "http_status", "response_time_ms", "timeout", "user_id"]
    assert a.attempts.count() == b.attempts.count() == 32
    assert a.attempts.select(*key).exceptAll(b.attempts.select(*key)).count() == 0
    assert a.events.count() == b.events.count() == 27
    assert {r.user_id for r in a.events.union(b.events).select("user_id").collect()} == {"user_3"}


def test_stream_json_ingest_equals_batch(spark, scratch):
    import json
    src = os.path.join(scratch, "docs")
    os.makedirs(src)
    base_doc = {"event_type": "invoice.paid", "customer_id": "c1", "user_id": "u1",
                "endpoint": {"endpoint_id": "ep1", "avg_success_rate": 0.5, "active": True,
                             "rate_limit_per_minute": 60}}
    for i in range(3):
        docs = [dict(base_doc, event_id=f"e{i}{j}",
                     delivery_attempts=[{"attempt_number": k, "http_status": 200 if k == 2 else 500,
                                         "response_time_ms": 100, "timeout": False, "signature_valid": True,
                                         "attempted_at": f"2024-01-0{i + 1} 00:00:0{k}"} for k in (1, 2)],
                     replay_history={"previous_replays": j, "duplicate_detected": False,
                                     "manually_triggered": True})
                for j in range(3)]
        with open(os.path.join(src, f"batch{i}.json"), "w") as f:
            json.dump(docs, f)
    streamed = os.path.join(scratch, "streamed")
    ST.stream_ingest_json(spark, src, streamed, "u1", checkpoint=os.path.join(scratch, "ck")).awaitTermination(300)
    batch = os.path.join(scratch, "batch")
    jobs.ingest_json_job(spark, src, batch, "u1")
    a, b = jobs.read_tables(spark, streamed), jobs.read_tables(spark, batch)
    assert a.attempts.count() == b.attempts.count() == 18
    assert a.replays.count() == b.replays.count() == 9
    assert a.events.count() == 9
    assert a.replays.select("replay_id").exceptAll(b.replays.select("replay_id")).count() == 0


def test_stream_health_drops_late_rows(spark, scratch):
    import datetime as dt

    from deliverylens import schemas as S

    src, sink, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))

    def rows(day, n, status):
        return [(f"a{day}-{i}", f"e{i}", "ep1", 1, status, 100.0, False, True, "u1",
                 dt.datetime(2024, 1, day, 10, 30)) for i in range(n)]

    def emit(batch_rows, name):
        spark.createDataFrame(batch_rows, S.DELIVERY_ATTEMPTS).coalesce(1).write.parquet(os.path.join(src, name))

    emit(rows(10, 3, 200) + rows(11, 2, 500), "b1")
    ST.stream_endpoint_health(spark, os.path.join(src, "*"), sink, checkpoint=ck, delay="2 hours").awaitTermination(300)
    emit(rows(1, 4, 500), "b2")       # nine days behind the watermark: late
    emit(rows(12, 1, 200), "b3")      # moves the watermark past day 11
    ST.stream_endpoint_health(spark, os.path.join(src, "*"), sink, checkpoint=ck, delay="2 hours").awaitTermination(300)
    got = {(r.window_start.day, r.total_attempts, r.failure_count) for r in spark.read.parquet(sink).collect()}
    assert (10, 3, 0) in got and (11, 2, 2) in got
    assert not any(day == 1 for day, _, _ in got)


def test_stream_dedupe_state_survives_restart(spark, scratch):
    import datetime as dt

    from deliverylens import schemas as S

    src, sink, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))

    def emit(ids, status, name):
        rows = [(f"a-{status}-{i}", f"e{i}", "ep1", 1, status, 100.0, False, True, "u1",
                 dt.datetime(2024, 1, 10, 10, 0)) for i in ids]
        spark.createDataFrame(rows, S.DELIVERY_ATTEMPTS).coalesce(1).write.parquet(os.path.join(src, name))

    emit(range(5), 500, "b1")
    ST.stream_dedupe_attempts(spark, os.path.join(src, "*"), sink, checkpoint=ck).awaitTermination(300)
    emit(range(3, 8), 200, "b2")  # e3, e4 repeat (event_id, attempt_number) after the restart
    ST.stream_dedupe_attempts(spark, os.path.join(src, "*"), sink, checkpoint=ck).awaitTermination(300)
    out = spark.read.parquet(sink).collect()
    got = {r.event_id: r.http_status for r in out}
    assert len(out) == 8 and len(got) == 8
    assert got["e3"] == 500 and got["e4"] == 500 and got["e7"] == 200


def test_arrivals_are_removed_once_streamed(spark, scratch):
    """every arrival used to stay on disk beside the store."""
    from deliverylens.streaming import bursts as B
    sink, folder = os.path.join(scratch, "out"), os.path.join(scratch, "stream")
    parts = [spark.createDataFrame([(f"e{i}{j}",) for j in range(3)], "event_id string") for i in range(2)]
    ST.in_arrivals(spark, parts, folder, lambda rows, checkpoint: B.append_stream(rows, sink, checkpoint))
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == ["e00", "e01", "e02", "e10", "e11", "e12"]
    assert os.listdir(os.path.join(folder, "in")) == []
