"""HLL and KLL states: merges, bounds against the exact answers, edges."""
import datetime as dt
import random

import numpy as np

from deliverylens.operators import sketches as SK


def table(spark, rows):
    return spark.createDataFrame(rows, "user_id string, attempted_at timestamp_ntz, event_id string, response_time_ms double")


def some(n, seed=1):
    rnd = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    return [(f"u{rnd.randrange(3)}", day + dt.timedelta(days=rnd.randrange(90)), f"e{rnd.randrange(n // 2)}", rnd.expovariate(0.01)) for _ in range(n)]


def test_estimates_keep_their_bounds_at_every_level(spark):
    rows = some(30_000)
    days = SK.daily_states(table(spark, rows))
    assert days.count() == 270
    for keys in (["user_id"], []):
        for r in SK.estimates(SK.merged(days, *keys)).collect():
            mine = [x for x in rows if not keys or x[0] == r.user_id]
            exact = len({x[2] for x in mine})
            assert r.rows == r.n_values == len(mine) and abs(r.distinct_count - exact) <= SK.COUNT_ERROR * exact
            values = np.sort([x[3] for x in mine])
            for p, q in ((0.25, r.q25), (0.5, r.q50), (0.75, r.q75)):
                assert abs(np.searchsorted(values, q) / len(values) - p) <= SK.RANK_ERROR


def test_states_added_later_keep_the_bounds(spark):
    """Days merged into stored states: rows and values are exact, counts as good as from all days at once."""
    rows = sorted(some(8_000, 2), key=lambda r: r[1])
    old, new = SK.daily_states(table(spark, rows[:5000])), SK.daily_states(table(spark, rows[5000:]))
    stored = SK.merged(old, "user_id")
    both = SK.merged(stored.unionByName(SK.merged(new, "user_id")), "user_id")
    found = SK.estimates(both).collect()
    assert len(found) == 3
    for r in found:
        mine = [x for x in rows if x[0] == r.user_id]
        exact = len({x[2] for x in mine})
        assert r.rows == r.n_values == len(mine) and abs(r.distinct_count - exact) <= SK.COUNT_ERROR * exact


def test_nulls_and_empty_tables(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("u", at, None, None), ("u", at, "e", None), ("v", at, "e", 1.0), ("v", None, "e", 3.0), (None, at, "x", 2.0)]
    got = {r.user_id: r for r in SK.estimates(SK.merged(SK.daily_states(table(spark, rows)), "user_id")).collect()}
    assert (got["u"].rows, got["u"].distinct_count, got["u"].n_values, got["u"].q50) == (2, 1, 0, None)
    assert (got["v"].rows, got["v"].distinct_count, got["v"].n_values) == (2, 1, 2) and got["v"].q50 in (1.0, 3.0)
    assert got[None].distinct_count == 1
    assert SK.daily_states(table(spark, [])).count() == 0
