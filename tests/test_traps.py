"""Semantics traps and rule boundaries."""
from pyspark.sql import Row
from pyspark.sql import functions as F

from deliverylens import schemas as S
from deliverylens.functions import predicates as P
from deliverylens.functions.scalars import bround_to, json_safe, round_to, truncated_health
from deliverylens.operators import analytics as A
from deliverylens.operators import decisions as D
from deliverylens.operators import features as FE
from deliverylens.operators import views as V
from deliverylens.tables import Tables


def attempts_df(spark, rows):
    return spark.createDataFrame(rows, S.DELIVERY_ATTEMPTS)


def att(i, ev, ep, n, status, rt=100.0, timeout=False, sig=True, user=None):
    return (f"a{i}", ev, ep, n, status, rt, timeout, sig, user, None)


def test_truncated_health(spark):
    df = spark.createDataFrame([(8, 10), (9, 10), (0, 0), (0, 7), (3, 3)], "f int, t int")
    got = [r[0] for r in df.select(truncated_health("f", "t")).collect()]
    assert got == [19, 9, 100, 100, 0]


def test_failure_predicates_differ(spark):
    df = spark.createDataFrame([(401, False), (None, True), (None, False), (500, False), (504, True)],
                               "http_status int, timeout boolean")
    rows = df.select(P.is_http_failure().alias("p3"), P.is_delivery_failure().alias("p4")).collect()
    assert [(r.p3, r.p4) for r in rows] == [(True, False), (False, True), (False, False), (True, True),
                                           (True, True)]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.5,)], "x double")
    r = df.select(bround_to("x", 2).alias("b"), round_to("x", 2).alias("r"), bround_to("x", 0).alias("b0")).collect()
    assert [x.b for x in r] == [round(0.125, 2), round(1.005, 2), round(2.5, 2)]
    assert r[1].r == 1.0  # binary 1.00499.. rounds down, unlike decimal-text rounding
    assert r[2].b0 == 2.0


def test_json_safe(spark):
    df = spark.createDataFrame([(float("inf"), None, "k"), (float("nan"), 3, None)], "x double, n int, s string")
    r = json_safe(df).collect()
    assert [(x.x, x.n, x.s) for x in r] == [(0.0, 0, "k"), (0.0, 3, None)]


def test_retry_count_null_without_attempts(spark):
    events = spark.createDataFrame([("e1", "invoice.paid", None, "c", None, 1.0, "k1", "high", "u1", None),
                                    ("e2", "compliance.failed", None, "c", None, 2.0, "k2", None, "u1", None)],
                                   "event_id string, event_type string, x string, customer_id string, "
                                   "invoice_id string, payload_size_kb double, idempotency_key string, "
                                   "priority string, user_id string, created_at timestamp_ntz").drop("x")
    attempts = attempts_df(spark, [att(1, "e1", "ep1", 1, 500), att(2, "e1", "ep1", 2, 200)])
    eps = spark.createDataFrame([("ep1", "c", "production", "v1", 0.9, 100, True, "u1")], S.ENDPOINTS)
    reps = spark.createDataFrame([], S.REPLAY_ACTIONS)
    t = Tables(users=spark.createDataFrame([("u1", "U", "u@x")], S.USERS), events=events, endpoints=eps,
               attempts=attempts, replays=reps)
    f = {r.event_id: r for r in FE.event_features(t).collect()}
    assert f["e1"].retry_count == 1 and f["e1"].is_recovered == 1 and f["e1"].error_ratio == 0.5
    assert f["e2"].retry_count is None and f["e2"].timeout_ratio == 0.0 and f["e2"].is_recovered == 0
    assert f["e2"].priority_high is False and f["e1"].priority_high is True
    assert f["e2"].replay_count == 0


def test_failure_reason_and_action_boundaries(spark):
    df = spark.createDataFrame(
        [(0.1, 0.0, 0.5, False, False), (0.0, 0.2, 0.5, False, False), (0.0, 0.0, 0.69, False, False),
         (0.0, 0.0, 0.7, False, False), (0.0, 0.0, None, False, False), (0.0, 0.0, 0.79, False, False),
         (0.0, 0.0, 0.8, False, False), (0.0, 0.0, 0.8, True, False), (0.0, 0.0, 0.8, True, True)],
        "timeout_ratio double, error_ratio double, endpoint_health_score double, "
        "safe_to_replay boolean, is_anomaly boolean")
    r = df.select(D.failure_reason().alias("f"), D.recommended_action().alias("a"),
                  D.delivery_state().alias("s")).collect()
    assert [x.f for x in r] == ["timeout", "server_error", "endpoint_offline", "unknown", "unknown",
                                "unknown", "unknown", "unknown", "unknown"]
    assert [x.a for x in r][5:] == ["monitor_endpoint_health", "manual_review_required", "trigger_auto_replay",
                                     "block_source_anomaly_detected"]
    assert r[7].s == "recovered" and r[0].s == "failed"


def test_response_categories(spark):
    df = spark.createDataFrame([(s, t) for s, t in [(200, False), (403, False), (404, False), (413, False),
                                                    (520, False), (503, False), (None, True), (None, False),
                                                    (418, False)]], "http_status int, timeout boolean")
    got = [r[0] for r in df.select(D.response_category()).collect()]
    assert got == ["success", "invalid_signature", "endpoint_not_found", "payload_too_large",
                   "malformed_response", "server_error", "timeout", "other", "other"]


def test_delivery_outcomes(spark):
    rows = [att(1, "del", "p", 1, 200),
            att(2, "rec", "p", 1, 500), att(3, "rec", "p", 2, 200),
            att(4, "exp", "p", 1, 404), att(5, "exp", "p", 2, 404),
            att(6, "big", "p", 1, 413), att(7, "big", "p", 2, 413),
            att(8, "mal", "p", 1, 520), att(9, "mal", "p", 2, 201),
            att(10, "tmo", "p", 1, 504, timeout=True), att(11, "tmo", "p", 2, 200),
            att(12, "dup", "p", 1, 200)]
    ev = spark.createDataFrame(
        [(e, "k" if e in ("del", "dup") else e, ts) for e, ts in
         [("del", "2024-01-01"), ("dup", "2024-01-02"), ("rec", "2024-01-01"), ("exp", "2024-01-01"),
          ("big", "2024-01-01"), ("mal", "2024-01-01"), ("tmo", "2024-01-01")]],
        "event_id string, idempotency_key string, created_at string").withColumn(
        "created_at", F.to_timestamp_ntz("created_at"))
    out = {r.event_id: r for r in D.label_delivery_outcome(attempts_df(spark, rows), ev).collect()}
    assert (out["del"].delivery_state, out["del"].safe_to_replay) == ("delivered", True)
    assert (out["rec"].delivery_state, out["rec"].failure_reason, out["rec"].recommended_action) == \
        ("recovered", "customer_endpoint_down", "retry_later")
    assert (out["exp"].delivery_state, out["exp"].failure_reason) == ("expired", "endpoint_deleted")
    assert (out["big"].delivery_state, out["big"].safe_to_replay) == ("failed", True)
    assert (out["mal"].failure_reason, out["mal"].recommended_action) == ("malformed_response", "inspect_endpoint")
    assert (out["tmo"].failure_reason, out["tmo"].recommended_action) == ("none", "monitor_endpoint")
    assert (out["dup"].delivery_state, out["dup"].recommended_action) == ("duplicate", "avoid_replay")


def test_tenancy_follows_event(spark):
    events = spark.createDataFrame([("e1", "u1", "invoice.failed"), ("e2", "u2", "invoice.paid")],
                                   "event_id string, user_id string, event_type string")
    attempts = attempts_df(spark, [att(1, "e1", "ep", 1, 401, user="u2"), att(2, "e2", "ep", 1, 200, user="u1")])
    users = spark.createDataFrame([("u1", "A", "a@x"), ("u2", "B", "b@x"), ("u3", "C", "c@x")], S.USERS)
    t = Tables(users=users, events=events, endpoints=None, attempts=attempts, replays=None)
    got = {r.user_id: (r.health_score, r.replays_prevented, r.active_anomalies)
           for r in A.tenant_overview(t).collect()}
    assert got == {"u1": (0, 3, 1), "u2": (100, 3, 0), "u3": (100, 0, 0)}


def test_top_k_ties_broken_by_id(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "endpoint_id string, failure_rate double")
    assert [r.endpoint_id for r in V.top_unstable(df, 2).collect()] == ["c", "a"]


def test_badge_case_sensitive(spark):
    df = spark.createDataFrame([("invoice.failed",), ("Invoice.FAILED",)], "event_type string")
    got = df.select(P.mentions_failed_cs().alias("cs"), P.mentions_failed_ci().alias("ci")).collect()
    assert [(r.cs, r.ci) for r in got] == [(True, True), (False, True)]


def test_class_balance_and_report(spark):
    df = spark.createDataFrame([Row(is_recovered=1, p=1)] * 6 + [Row(is_recovered=0, p=1)] * 2 +
                               [Row(is_recovered=0, p=0)] * 2)
    bal = {r.is_recovered: r.share_pct for r in A.class_balance(df).collect()}
    assert bal == {1: 60.0, 0: 40.0}
    rep = {r.label: r for r in A.classification_report(df, "is_recovered", "p").collect()}
    assert rep["1"].precision == 0.75 and rep["1"].recall == 1.0 and rep["0"].recall == 0.5
    assert rep["accuracy"].f1_score == 0.8 and rep["accuracy"].support == 10
    assert rep["macro avg"].precision == round((0.75 + 1.0) / 2, 4)


def test_fallback_for_unknown_ids(spark):
    from deliverylens.ml.intelligence import with_fallback
    decided = spark.createDataFrame(
        [("e1", "recovered", "unknown", True, False, "trigger_auto_replay", 0.91, 0.0, False)],
        "event_id string, delivery_state string, failure_reason string, safe_to_replay boolean, "
        "is_anomaly boolean, recommended_action string, endpoint_health double, timeout_ratio double, "
        "is_fallback boolean")
    ids = spark.createDataFrame([("e1",), ("nope",), ("nope",)], "event_id string")
    out = {r.event_id: r for r in with_fallback(ids, decided).collect()}
    assert len(out) == 2 and out["e1"].endpoint_health == 0.91 and not out["e1"].is_fallback
    fb = out["nope"]
    assert (fb.delivery_state, fb.failure_reason, fb.safe_to_replay, fb.is_anomaly, fb.recommended_action,
            fb.endpoint_health, fb.timeout_ratio, fb.is_fallback) == \
        ("failed", "timeout", True, False, "trigger_auto_replay", 0.85, 0.1, True)


def test_ingest_summary_scopes(spark):
    from paths import SF0001
    from deliverylens.sources.testdata import load_tables
    t = load_tables(spark, SF0001)
    inst, pats = A.endpoint_instability(t.attempts), A.retry_patterns(t.attempts)
    allr = V.ingest_summary(t, inst, pats)
    ten = V.ingest_summary(t, inst, pats, scope="tenant")
    assert allr.where("user_id is null").count() == 3 + 4
    per_user = ten.where("section <> 'ingest'").groupBy("user_id").count().collect()
    assert per_user and all(r["count"] <= 7 for r in per_user)
    # counts rows are identical in both scopes
    assert allr.where("section = 'ingest'").exceptAll(ten.where("section = 'ingest'")).count() == 0


def test_tenant_filter_matches_full_result(spark):
    from paths import SF0001
    from deliverylens.sources.testdata import load_tables
    t = load_tables(spark, SF0001)
    for fn in (A.tenant_overview, A.tenant_endpoints, lambda t, user_id=None: V.list_events(t, 1, 5, user_id),
               lambda t, user_id=None: A.tenant_event_counts(t.events, 10, user_id)):
        full = fn(t).where("user_id = 'user_3'")
        one = fn(t, user_id="user_3")
        assert one.count() == full.count() > 0
        assert one.exceptAll(full).count() == 0


def test_one_hot_declared_values(spark):
    df = spark.createDataFrame([("a", "high"), ("b", None), ("c", "urgent")], "id string, priority string")
    out = FE.one_hot(df, "priority", ["urgent", "high"])
    assert out.columns == ["id", "priority_high", "priority_urgent"]
    got = {r.id: (r.priority_high, r.priority_urgent) for r in out.collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, True)}


def test_tenant_rankings_against_brute_force(spark):
    """R1 with scope='tenant' (no SQL twin) against pandas on sf0.001."""
    from paths import SF0001
    from deliverylens.sources.testdata import load_tables
    t = load_tables(spark, SF0001)
    a = t.attempts.select("event_id", "endpoint_id", "attempt_number", "http_status", "timeout").toPandas()
    e = t.events.select("event_id", F.col("user_id").alias("owner")).toPandas()
    m = a.merge(e, on="event_id")
    m["fail"] = ((m["http_status"].fillna(0) >= 500) | m["timeout"].fillna(False)).astype(int)
    m["ok"] = ((m["http_status"] >= 200) & (m["http_status"] < 300)).fillna(False).astype(int)
    want = set()
    for owner, g in m.groupby("owner"):
        ep = g.groupby("endpoint_id").agg(n=("fail", "size"), f=("fail", "sum")).reset_index()
        ep = ep[ep["n"] > 5]
        ep["rate"] = ep["f"] / ep["n"]
        ep = ep.sort_values(["rate", "endpoint_id"], ascending=[False, True]).head(3)
        want |= {(owner, "unstable_endpoints", r.endpoint_id, round(r.rate * 100, 4)) for r in ep.itertuples()}
        rp = g.groupby("attempt_number").agg(n=("ok", "size"), s=("ok", "sum")).reset_index()
        rp = rp.sort_values("attempt_number").head(4)
        want |= {(owner, "retry_effectiveness", f"attempt #{r.attempt_number}", round(r.s * 100 / r.n, 4))
                 for r in rp.itertuples()}
    out = V.ingest_summary(t, None, None, scope="tenant").where("section <> 'ingest'").collect()
    got = {(r.user_id, r.section, r.label, round(r.value, 4)) for r in out}
    assert got == want


def test_timeline_pages_of_a_hot_event(spark):
    """An event that spans several partitions is paged in order; one without attempts has one empty page."""
    import datetime as dt

    from deliverylens import schemas as S
    from deliverylens.operators import views as V
    from deliverylens.tables import Tables

    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(e, "invoice.paid", "c", None, 1.0, e, "high", "u1", at) for e in ("hot", "few", "none")], S.WEBHOOK_EVENTS)
    rows = [(f"h{i:05d}", "hot", "ep", i, 200 if i % 2 else 500, 1.0, False, True, "u1", at) for i in range(1, 2001)]
    rows += [("f2", "few", "ep", 2, 200, None, False, True, "u1", at), ("f1", "few", "ep", None, 200, 1.6, False, True, "u1", at)]
    attempts = spark.createDataFrame(rows, S.DELIVERY_ATTEMPTS).repartition(5)
    t = Tables(users=None, events=events, endpoints=None, attempts=attempts, replays=None)
    pages = {(r.event_id, r.page): r for r in V.timeline_pages(t, page_size=300).collect()}
    hot = [pages["hot", p] for p in range(7)]
    assert [p.n_attempts for p in hot] == [300] * 6 + [200] and ("hot", 7) not in pages
    assert [a.attempt_number for p in hot for a in p.attempts] == list(range(1, 2001))
    assert hot[0].attempts[0].is_success and hot[0].attempts[0].detail == "Response in 1ms" and not hot[0].attempts[1].is_success
    assert [a.attempt_id for a in pages["few", 0].attempts] == ["f1", "f2"]
    assert pages["none", 0].n_attempts == 0 and pages["none", 0].attempts == [] and len(pages) == 9
    few = V.timeline_pages(t, spark.createDataFrame([("few",)], "event_id string"), page_size=1).collect()
    assert sorted((r.event_id, r.page, r.n_attempts) for r in few) == [("few", 0, 1), ("few", 1, 1)]
