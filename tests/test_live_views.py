"""A1-A6 from refreshed states equal the full recomputation after any sequence of commits."""
import datetime as dt
import random

from deliverylens import schemas as S
from deliverylens.operators import analytics as A
from deliverylens.plans import jobs
from deliverylens.plans import live_views as LV

AT = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(str, df.collect()))


def same(spark, base, views, users):
    t = jobs.read_tables(spark, base, users)
    assert rows(LV.endpoint_instability(spark, views, 1)) == rows(A.endpoint_instability(t.attempts, 1))
    assert rows(LV.retry_patterns(spark, views)) == rows(A.retry_patterns(t.attempts))
    assert rows(LV.replay_frequency(spark, views)) == rows(A.replay_frequency(t.replays))
    assert rows(LV.tenant_overview(spark, views, users)) == rows(A.tenant_overview(t))
    assert rows(LV.tenant_endpoints(spark, views)) == rows(A.tenant_endpoints(t))
    assert rows(LV.tenant_event_counts(spark, views)) == rows(A.tenant_event_counts(t.events))


def test_views_equal_a_recomputation(spark, scratch):
    rnd = random.Random(3)
    base, views = f"{scratch}/store", f"{scratch}/views"
    users = spark.createDataFrame([(f"u{i}", f"n{i}", f"m{i}") for i in range(4)], S.USERS)
    event = lambda i: (f"e{i}", rnd.choice(["a.failed", "a.paid"]), "c", None, 1.0, f"k{i}", "high", rnd.choice(["u0", "u1", "u2", None]), AT)
    attempt = lambda n: (f"a{n}", f"e{rnd.randrange(40)}", rnd.choice(["p", "q", None]), rnd.randint(1, 3), rnd.choice([200, 404, 500, None]),
                         rnd.choice([None, 1.5, 10.25]), rnd.random() < 0.2, True, None, AT)
    replay = lambda n: (f"r{n}", "e1", rnd.choice(["success", None]), rnd.choice([True, False, None]), True, "u1", AT)
    frame = lambda r, schema: spark.createDataFrame(r, schema)
    steps = [
        {"webhook_events": frame([event(i) for i in range(10)], S.WEBHOOK_EVENTS), "delivery_attempts": frame([attempt(n) for n in range(60)], S.DELIVERY_ATTEMPTS)},
        {"delivery_attempts": frame([attempt(n) for n in range(60, 90)], S.DELIVERY_ATTEMPTS)},  # some without their event so far
        {"webhook_events": frame([event(i) for i in range(10, 30)], S.WEBHOOK_EVENTS), "replay_actions": frame([replay(n) for n in range(9)], S.REPLAY_ACTIONS)},
        {"webhook_events": frame([], S.WEBHOOK_EVENTS)},
        {"webhook_events": frame([event(i) for i in range(30, 40)], S.WEBHOOK_EVENTS), "delivery_attempts": frame([attempt(n) for n in range(90, 120)], S.DELIVERY_ATTEMPTS)},
    ]
    for i, writes in enumerate(steps):
        jobs.commit_batch(spark, base, writes)
        if i != 1:  # two commits may be taken at once
            assert LV.refresh(spark, base, views) == i == LV.held_version(spark, views)
            same(spark, base, views, users)
    taken = jobs.last_version(spark, views)
    assert LV.refresh(spark, base, views) == 4 and jobs.last_version(spark, views) == taken  # nothing new, nothing written


def test_empty_store(spark, scratch):
    base, views = f"{scratch}/store", f"{scratch}/views"
    assert LV.refresh(spark, base, views) == -1
    jobs.commit_batch(spark, base, {"webhook_events": spark.createDataFrame([], S.WEBHOOK_EVENTS)})
    assert LV.refresh(spark, base, views) == 0
    assert LV.endpoint_instability(spark, views).count() == 0 == LV.tenant_event_counts(spark, views).count()
