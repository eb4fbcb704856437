"""Counters over whole uploads, against plain Python."""
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import uploads
from deliverylens.functions import predicates as P
from deliverylens.functions.scalars import avg_exact, round_to, truncated_health, with_surrogate_id
from deliverylens.operators import analytics as A
from deliverylens.operators.ingest import coerce_attempts
from deliverylens.sources.files import read_attempts_csv


def typed(spark, scratch, name):
    raw = read_attempts_csv(spark, uploads.write(scratch, name))
    return with_surrogate_id(coerce_attempts(raw), "att", ["event_id", "attempt_number", "ord"], name="attempt_id")


def plain(name):
    out = []
    for e, kind, _, ep, n, status, ms, timeout, sig in uploads.FILES[name]():
        out.append((e, kind, ep, int(n), int(status) if status.isdigit() else 500, float(ms) if ms else 1000.0,
                    timeout == "True", sig == "True"))
    return out


def golden(name):
    rows = plain(name)
    n = len(rows)
    fail400 = sum(r[4] >= 400 for r in rows)
    fail500 = sum(r[4] >= 500 or r[6] for r in rows)
    won = {r[0] for r in rows if 200 <= r[4] < 300}
    return (n, len({r[0] for r in rows}), len({r[2] for r in rows}), fail400, fail500, sum(r[6] for r in rows),
            sum(not r[7] for r in rows), sum(200 <= r[4] < 300 for r in rows), int((1 - fail400 / n) * 100),
            round(sum(r[5] for r in rows) / n, 4), len(won), len({r[0] for r in rows if "failed" in r[1].lower()}))


@pytest.mark.parametrize("name", sorted(uploads.FILES))
def test_golden_counts(spark, scratch, name):
    df = typed(spark, scratch, name)
    rec = (df.groupBy("event_id").agg(F.max(P.is_success().cast("int")).alias("ok"))
           .agg(F.sum("ok")).first()[0])
    failed_type = df.select("event_id", "event_type").distinct().where(P.mentions_failed_ci()).count()
    r = df.agg(F.count(F.lit(1)), F.count_distinct("event_id"), F.count_distinct("endpoint_id"),
               P.count_if(P.is_http_failure()), P.count_if(P.is_delivery_failure()),
               P.count_if(P.is_timeout()), P.count_if(~F.col("signature_valid")),
               P.count_if(P.is_success()),
               truncated_health(P.count_if(P.is_http_failure()), F.count(F.lit(1))),
               round_to(avg_exact("response_time_ms"), 4)).first()
    assert tuple(r) + (rec, failed_type) == golden(name)


def test_truncated_health_of_the_uploads():
    assert golden("slow.csv")[8] == 19 and golden("bad_keys.csv")[8] == 9
    assert golden("bad_keys.csv")[3:5] == (9, 0)


def test_instability_and_retries(spark, scratch):
    df, rows = typed(spark, scratch, "many.csv"), plain("many.csv")
    by_ep, by_try = defaultdict(list), defaultdict(list)
    for r in rows:
        by_ep[r[2]].append(r)
        by_try[r[3]].append(200 <= r[4] < 300)
    inst = {r["endpoint_id"]: (r["total_attempts"], r["failure_count"], r["timeout_count"])
            for r in A.endpoint_instability(df).collect()}
    assert inst == {k: (len(v), sum(r[4] >= 500 or r[6] for r in v), sum(r[6] for r in v)) for k, v in by_ep.items()}
    pats = {r["attempt_number"]: (r["count"], round(r["success_rate_percent"] * r["count"] / 100))
            for r in A.retry_patterns(df).collect()}
    assert pats == {k: (len(v), sum(v)) for k, v in by_try.items()}


def test_instability_sorted_by_rate(spark, scratch):
    rates = [r["failure_rate"] for r in A.endpoint_instability(typed(spark, scratch, "many.csv")).collect()]
    assert rates == sorted(rates, reverse=True)
