"""Retry bursts and replay spikes: streams against brute force, late rows, restarts, edges."""
import datetime as dt
import os
import random

from deliverylens import schemas as S
from deliverylens.streaming import bursts as B

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def attempts(spark, rows):
    """rows: (endpoint, attempt number, hours from the start or None, status)"""
    full = [(f"a{i}", f"e{i}", ep, n, status, 10.0, False, True, "u1", None if h is None else START + dt.timedelta(hours=h))
            for i, (ep, n, h, status) in enumerate(rows)]
    return spark.createDataFrame(full, S.DELIVERY_ATTEMPTS)


def replays(spark, rows):
    """rows: (tenant, hours from the start or None)"""
    full = [(f"r{i}", u, None if h is None else START + dt.timedelta(hours=h)) for i, (u, h) in enumerate(rows)]
    return spark.createDataFrame(full, "replay_id string, user_id string, replayed_at timestamp_ntz")


def brute_bursts(rows, gap=48, least=3):
    out = []
    for ep in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(((h, n, s) for e, n, h, s in rows if e == ep and n is not None and n > 1 and h is not None), key=lambda r: r[:2])
        runs = []
        for r in mine:
            if runs and r[0] - runs[-1][-1][0] <= gap:
                runs[-1].append(r)
            else:
                runs.append([r])
        out += [(ep, START + dt.timedelta(hours=r[0][0]), START + dt.timedelta(hours=r[-1][0]), len(r),
                 sum((s or 0) >= 500 for _, _, s in r), max(n for _, n, _ in r)) for r in runs if len(r) >= least]
    return sorted(out)


def brute_spikes(rows, percent=120, min_days=3):
    out = []
    for u in {r[0] for r in rows if r[0] is not None}:
        days = {}
        for t, h in rows:
            if t == u and h is not None:
                days[int(h // 24)] = days.get(int(h // 24), 0) + 1
        n = total = 0
        for d in sorted(days):
            if n >= min_days and 100 * days[d] * n >= percent * total:
                out.append((u, START + d * DAY, days[d], n, total))
            n, total = n + 1, total + days[d]
    return sorted(out)


def some_attempts():
    rnd = random.Random(8)
    rows = [(f"ep{rnd.randrange(4)}", rnd.randint(1, 5), rnd.randrange(0, 2400), rnd.choice([200, 500, 404, None])) for _ in range(500)]
    return rows + [(None, 3, 5, 500), ("ep1", 3, None, 500), ("ep1", None, 7, 500), ("ep9", 2, 0, 500), ("ep9", 2, 48, 500), ("ep9", 2, 96, 500), ("ep9", 2, 145, 500)]


def some_replays():
    rnd = random.Random(9)
    rows = [(f"u{rnd.randrange(3)}", rnd.random() ** rnd.choice([1, 3]) * 960) for _ in range(900)]
    return rows + [(None, 3.0), ("u1", None), ("u5", 1.0)]


def test_batch_forms(spark):
    rows = some_attempts()
    want = brute_bursts(rows)
    assert len(want) > 20 and any(r[0] == "ep9" and r[3] == 3 for r in want)
    assert sorted(map(tuple, B.retry_bursts(B.retries_of(attempts(spark, rows))).collect())) == want
    rows = some_replays()
    want = brute_spikes(rows)
    assert len(want) > 2
    assert sorted(map(tuple, B.replay_spikes(replays(spark, rows)).collect())) == want
    assert B.replay_spikes(replays(spark, [])).count() == 0 == B.retry_bursts(B.retries_of(attempts(spark, []))).count()


def run(spark, folder, name, frame, plan):
    """One arrival of a stream; the checkpoint and the sink go on between calls."""
    frame.coalesce(2).write.parquet(os.path.join(folder, "in", name))
    session = B.stream_session(spark)
    stream = session.readStream.schema(frame.schema).parquet(os.path.join(folder, "in", "*"))
    q = B.append_stream(plan(stream), os.path.join(folder, "out"), os.path.join(folder, "checkpoint"))
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted((tuple(r) for r in spark.read.parquet(os.path.join(folder, "out")).collect()))


def test_stream_of_bursts_emits_each_once_over_restarts(spark, scratch):
    rows = some_attempts()
    timed = sorted((r for r in rows if r[2] is not None), key=lambda r: r[2])
    plan = lambda s: B.live_retry_bursts(s, delay="0 seconds")
    run(spark, scratch, "a", attempts(spark, timed[:200]), plan)
    run(spark, scratch, "b", attempts(spark, timed[200:330] + [("ep1", 3, None, 500)]), plan)
    got = run(spark, scratch, "c", attempts(spark, timed[330:]), plan)
    last = START + dt.timedelta(hours=max(r[2] for r in timed if r[1] and r[1] > 1 and r[0]))
    assert got == [r for r in brute_bursts(rows) if r[2] + 2 * DAY <= last] and got


def test_stream_of_spikes_keeps_its_baseline_over_restarts(spark, scratch):
    rows = some_replays()
    timed = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
    plan = lambda s: B.live_replay_spikes(s, delay="0 seconds")
    run(spark, scratch, "a", replays(spark, timed[:350]), plan)
    got = run(spark, scratch, "b", replays(spark, timed[350:]), plan)
    last = START + dt.timedelta(hours=max(h for u, h in timed if u))
    assert got == [r for r in brute_spikes(rows) if r[1] + DAY <= last] and got


def test_late_rows_change_nothing_and_days_are_judged_in_order(spark, scratch):
    plan = lambda s: B.live_replay_spikes(s, delay="12 hours")
    quiet = [("u1", d * 24 + 1.0) for d in range(4)]
    # day 5 arrives before day 4 does, within the watermark's delay
    run(spark, scratch, "a", replays(spark, quiet + [("u1", 5 * 24 + 1.0)] * 4), plan)
    run(spark, scratch, "b", replays(spark, [("u1", 4 * 24 + 23.5)] * 3), plan)
    run(spark, scratch, "c", replays(spark, [("u1", 9 * 24.0)]), plan)
    got = run(spark, scratch, "d", replays(spark, [("u1", 2 * 24 + 2.0)] * 50 + [("u1", 12 * 24.0)]), plan)  # day 2 is long over
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(START + 4 * DAY, 3, 4, 4), (START + 5 * DAY, 4, 5, 7)]
