"""Ingest, merge and validation semantics."""
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import uploads
from deliverylens import schemas as S
from deliverylens.functions.stats import exact_quantiles
from deliverylens.operators import ingest as M
from deliverylens.plans import jobs
from deliverylens.sources import files as FILES


def doc(event_id, attempts, replays=None, endpoint=None, user="u1", event_type="invoice.paid"):
    d = {"event_id": event_id, "event_type": event_type, "customer_id": "c1", "user_id": user,
         "endpoint": endpoint or {"endpoint_id": "ep1", "avg_success_rate": 0.5, "active": True,
                                  "rate_limit_per_minute": 60},
         "delivery_attempts": [dict({"timeout": False, "signature_valid": True, "response_time_ms": 100,
                                     "attempted_at": f"2024-01-01 00:00:0{i}"}, **a)
                               for i, a in enumerate(attempts)]}
    if replays is not None:
        d["replay_history"] = replays
    return d


def write_docs(scratch, name, docs, as_array=True):
    p = os.path.join(scratch, name)
    with open(p, "w") as f:
        json.dump(docs if as_array else docs[0], f)
    return p


def test_require_columns_names_first_missing():
    with pytest.raises(ValueError, match="Missing required column: customer_id"):
        FILES.require_columns(["event_id", "event_type", "endpoint_id"])


def test_csv_header_check(spark, scratch):
    p = os.path.join(scratch, "bad.csv")
    with open(p, "w") as f:
        f.write("event_id,event_type\nx,y\n")
    with pytest.raises(ValueError, match="customer_id"):
        FILES.read_attempts_csv(spark, p)


def test_coerce_rules(spark):
    raw = spark.createDataFrame(
        [("e", "t", "c", "ep", "2", None, None, "TRUE", "yes"), ("e", "t", "c", "ep", "x", "404.0", "5", "1", None),
         ("e", "t", "c", "ep", "3.7", "201", "7.5", "false", "True")], S.RAW_CSV)
    r = M.coerce_attempts(raw).collect()
    assert (r[0].http_status, r[0].response_time_ms, r[0].timeout, r[0].signature_valid) == (500, 1000.0, True, False)
    assert (r[1].is_valid, r[1].http_status, r[1].timeout) == (False, 404, False)
    assert (r[2].attempt_number, r[2].signature_valid) == (3, True)


def test_json_object_and_array_and_validation(spark, scratch):
    docs = [doc("e1", [{"attempt_number": 1, "http_status": 500}, {"attempt_number": 2, "http_status": 401}],
                replays={"previous_replays": 3, "duplicate_detected": True, "manually_triggered": False}),
            doc("e2", [{"attempt_number": 1, "http_status": 200}],
                replays={"previous_replays": 0, "duplicate_detected": False, "manually_triggered": False}),
            doc("e3", [{"attempt_number": 1}]),                      # missing status
            doc("e4", [], replays={"previous_replays": 1, "duplicate_detected": False, "manually_triggered": False}),
            doc("e5", [{"attempt_number": 1, "http_status": 200}])]  # no replay history: fine
    arr = FILES.read_logs_json(spark, write_docs(scratch, "a.json", docs))
    one = FILES.read_logs_json(spark, write_docs(scratch, "o.json", docs, as_array=False))
    assert arr.count() == 5 and one.count() == 1
    ok, bad = M.validate_logs(arr, FILES.CORRUPT)
    reasons = {r.event_id: r.reject_reason for r in bad.collect()}
    assert reasons == {"e3": "missing:delivery_attempts.http_status", "e4": "replays_without_attempts"}
    rep = M.expand_replays(ok).collect()
    assert len(rep) == 3 and {r.replay_result for r in rep} == {"failed"}  # last attempt was 401
    assert len({r.replay_id for r in rep}) == 3
    assert M.explode_attempts(ok).count() == 4


def test_malformed_json_rejected(spark, scratch):
    p = os.path.join(scratch, "m.json")
    with open(p, "w") as f:
        f.write('{"event_id": "x", "delivery_attempts": [}\n')
    df = FILES.read_logs_json(spark, p, multiline=False)
    _, bad = M.validate_logs(df, FILES.CORRUPT)
    assert [r.reject_reason for r in bad.collect()] == ["malformed_json"]


def test_upsert_endpoint_policies(spark):
    existing = spark.createDataFrame([("ep1", "cust_old", "production", "v2", 0.9, 100, True, "u0")], S.ENDPOINTS)
    docs = spark.createDataFrame(
        [doc("e1", [{"attempt_number": 1, "http_status": 200}],
             endpoint={"endpoint_id": "ep1", "avg_success_rate": 0.4, "active": False, "rate_limit_per_minute": 5},
             user="u7"),
         doc("e2", [{"attempt_number": 1, "http_status": 200}],
             endpoint={"endpoint_id": "ep1", "avg_success_rate": 0.3, "active": True, "rate_limit_per_minute": 6},
             user="u8"),
         doc("e3", [{"attempt_number": 1, "http_status": 200}],
             endpoint={"endpoint_id": "ep9", "avg_success_rate": 0.2, "active": True, "rate_limit_per_minute": 7})],
        S.RAW_LOG).withColumn("ord", F.monotonically_increasing_id())
    out = {r.endpoint_id: r for r in M.upsert_endpoints(existing, docs, F.col("ord")).collect()}
    # last payload wins, customer and url type kept
    assert (out["ep1"].avg_success_rate, out["ep1"].rate_limit_per_minute, out["ep1"].user_id,
            out["ep1"].customer_id, out["ep1"].endpoint_url_type, out["ep1"].change) == \
        (0.3, 6, "u8", "cust_old", "production", "updated")
    assert (out["ep9"].endpoint_url_type, out["ep9"].expected_signature_version, out["ep9"].change) == \
        ("custom", "v1", "inserted")
    # CSV path never updates, inserts with defaults and the first event's customer
    rows = spark.createDataFrame([("e2", "ep1", "cB"), ("e1", "ep5", "cA"), ("e0", "ep5", "cZ")],
                                 "event_id string, endpoint_id string, customer_id string")
    out2 = {r.endpoint_id: r for r in M.insert_endpoints_if_absent(existing, rows, F.lit("u1")).collect()}
    assert out2["ep1"].avg_success_rate == 0.9 and not out2["ep1"].inserted
    assert (out2["ep5"].customer_id, out2["ep5"].avg_success_rate, out2["ep5"].rate_limit_per_minute) == \
        ("cZ", 0.9, 100)


def test_dedupe_modes_and_first_row(spark):
    rows = spark.createDataFrame([("e1", 1, "epA", "t", "c", 3), ("e1", 1, "epB", "t", "c", 1),
                                  ("e1", 2, "epC", "t", "c", 2), (None, 1, "epD", "t", "c", 0)],
                                 "event_id string, attempt_number int, endpoint_id string, event_type string, "
                                 "customer_id string, o int")
    assert M.dedupe_attempts_in_batch(rows, F.col("o"), "reference").count() == 4
    strict = M.dedupe_attempts_in_batch(rows.where("event_id is not null"), F.col("o"), "strict").collect()
    assert sorted((r.attempt_number, r.endpoint_id) for r in strict) == [(1, "epB"), (2, "epC")]
    first = M.first_row_per_event(rows, F.col("o")).collect()
    assert len(first) == 3 and {r.endpoint_id for r in first} == {"epB"}


def test_quality_checks(spark):
    from deliverylens.tables import Tables
    ev = spark.createDataFrame([("e1", "k", "u1", None), ("e1", "k", "u9", None)],
                               "event_id string, idempotency_key string, user_id string, created_at timestamp_ntz")
    users = spark.createDataFrame([("u1", "A", "a@x")], S.USERS)
    empty = lambda s: spark.createDataFrame([], s)
    t = Tables(users=users, events=ev.select("event_id", "idempotency_key", "user_id"),
               endpoints=empty(S.ENDPOINTS), attempts=empty(S.DELIVERY_ATTEMPTS), replays=empty(S.REPLAY_ACTIONS))
    kv = {(r.table_name, r.key_columns) for r in M.key_violations(t).collect()}
    assert ("webhook_events", "event_id") in kv and ("webhook_events", "idempotency_key") in kv
    orphans = [(r.table_name, r.fk_value) for r in M.fk_orphans(t).collect()]
    assert orphans == [("webhook_events", "u9")]


def test_csv_ingest_is_idempotent(spark, scratch):
    base = os.path.join(scratch, "store")
    path = uploads.write(scratch, "many.csv")
    r1 = jobs.ingest_csv_job(spark, path, base, "user_1").first()
    assert (r1.total_events, r1.events_processed, r1.attempts_inserted) == (48, 48, 120)
    r2 = jobs.ingest_csv_job(spark, path, base, "user_1").first()
    assert r2.attempts_inserted == 0
    t = jobs.read_tables(spark, base)
    assert t.events.count() == 48 and t.attempts.count() == 120 and t.endpoints.count() == 5
    ep = t.endpoints.first()
    assert (ep.avg_success_rate, ep.rate_limit_per_minute, ep.endpoint_url_type) == (0.9, 100, "custom")
    ev = t.events.where("event_id = 'w-b7'").first()
    assert (ev.payload_size_kb, ev.priority, ev.user_id) == (250.0, "medium", "user_1")


def test_json_ingest_is_idempotent(spark, scratch):
    base = os.path.join(scratch, "store")
    docs = [doc("e1", [{"attempt_number": 1, "http_status": 500}, {"attempt_number": 1, "http_status": 200}],
                replays={"previous_replays": 2, "duplicate_detected": False, "manually_triggered": True}),
            doc("e2", [{"attempt_number": 1}])]
    p = write_docs(scratch, "docs.json", docs)
    c1 = dict((r.item, r.n) for r in jobs.ingest_json_job(spark, p, base, "u1").collect())
    assert c1 == {"webhook_events": 1, "delivery_attempts": 1, "replay_actions": 2, "rejected_documents": 1}
    c2 = dict((r.item, r.n) for r in jobs.ingest_json_job(spark, p, base, "u1").collect())
    assert c2["delivery_attempts"] == 0 and c2["replay_actions"] == 0 and c2["webhook_events"] == 0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=997), np.full(400, 3.0)])  # a hot value
    df = spark.createDataFrame([(float(v), int(i % 5)) for i, v in enumerate(vals)], "x double, g int")
    got = {r.prob: r.value for r in exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.95, 1.0], 7).collect()}
    for q, v in got.items():
        assert abs(v - np.quantile(vals, q)) < 1e-12


def test_upload_by_unknown_user_is_rejected(spark, scratch):
    base = os.path.join(scratch, "store")
    path = uploads.write(scratch, "steady.csv")
    users = spark.createDataFrame([("user_1", "A", "a@x")], S.USERS)
    with pytest.raises(ValueError, match="unknown user_id"):
        jobs.ingest_csv_job(spark, path, base, "user_404", users=users)
    assert jobs.read_tables(spark, base).attempts.count() == 0  # nothing written
    r = jobs.ingest_csv_job(spark, path, base, "user_1", users=users).first()
    assert r.attempts_inserted == 12


def test_out_of_range_and_fractions(spark):
    raw = spark.createDataFrame([("e", "t", "c", "ep", "-1.5", "99999999999", "5", "false", "true"),
                                 ("e", "t", "c", "ep", "1e12", "nan", "5", "false", "true")], S.RAW_CSV)
    a, b = M.coerce_attempts(raw).collect()
    assert (a.attempt_number, a.http_status, a.is_valid) == (-1, 500, True)
    assert (b.attempt_number, b.http_status, b.is_valid) == (None, 500, False)


def test_columns_by_name_across_files(spark, scratch):
    src = os.path.join(scratch, "in")
    uploads.write(src, "steady.csv")
    uploads.write(src, "bad_keys.csv", columns=uploads.HEADER[::-1] + ["note"])
    df = FILES.read_attempts_csv(spark, src)
    assert df.where("event_id like 'w-%'").count() == df.count() == 22
    uploads.write(src, "slow.csv", columns=uploads.HEADER[:-1])
    with pytest.raises(ValueError, match="signature_valid"):
        FILES.read_attempts_csv(spark, src)


def test_only_committed_batches_are_read(spark, scratch):
    base = os.path.join(scratch, "store")
    left = spark.createDataFrame([("r0", "e0", "success", False, False, "u", None)], S.REPLAY_ACTIONS)
    left.write.parquet(os.path.join(base, "replay_actions", "batch=bcrashed"))  # a batch that never committed
    jobs.ingest_csv_job(spark, uploads.write(scratch, "steady.csv"), base, "u1")
    docs = [doc("e1", [{"attempt_number": 1, "http_status": 500}],
                replays={"previous_replays": 1, "duplicate_detected": False, "manually_triggered": True})]
    jobs.ingest_json_job(spark, write_docs(scratch, "d.json", docs), base, "u1")
    t = jobs.read_tables(spark, base)
    assert [r.event_id for r in t.replays.collect()] == ["e1"]
    assert t.events.count() == 13 and t.endpoints.count() == 4


def test_two_writers(spark, scratch):
    base = os.path.join(scratch, "store")
    ev = spark.createDataFrame([("e1",)], "event_id string").select(
        *[(F.col("event_id") if f.name == "event_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in S.WEBHOOK_EVENTS.fields])
    seen = jobs.last_version(spark, base)
    jobs.commit_batch(spark, base, {"webhook_events": ev}, seen)
    with pytest.raises(jobs.ConcurrentCommit):
        jobs.commit_batch(spark, base, {"webhook_events": ev.withColumn("event_id", F.lit("e2"))}, seen)
    assert [r.event_id for r in jobs.read_table(spark, base, "webhook_events").collect()] == ["e1"]


def test_documents_take_the_uploader(spark, scratch):
    base = os.path.join(scratch, "store")
    d = doc("e1", [{"attempt_number": 1, "http_status": 200}])
    del d["user_id"]
    path = write_docs(scratch, "d.json", [d])
    jobs.ingest_json_job(spark, path, base, "u7")
    jobs.ingest_json_job(spark, path, base, "u7")
    t = jobs.read_tables(spark, base)
    assert {r.user_id for df in (t.events, t.attempts, t.endpoints) for r in df.collect()} == {"u7"}


def test_replay_ids_stay_unique(spark, scratch):
    base = os.path.join(scratch, "store")
    h = {"previous_replays": 2, "duplicate_detected": False, "manually_triggered": True}
    docs = [doc("e1", [{"attempt_number": k, "http_status": 500}], replays=h) for k in (1, 2)]
    jobs.ingest_json_job(spark, write_docs(scratch, "d.json", docs), base, "u1")
    rows = jobs.read_tables(spark, base).replays.collect()
    assert len(rows) == len({r.replay_id for r in rows}) == 2


def test_huge_replay_count_is_expanded_in_chunks(spark):
    d = doc("e1", [{"attempt_number": 1, "http_status": 500}],
            replays={"previous_replays": 2500, "duplicate_detected": False, "manually_triggered": True})
    out = M.expand_replays(spark.createDataFrame([d], S.RAW_LOG))
    assert out.select("replay_id").distinct().count() == out.count() == 2500


def test_ids_do_not_depend_on_the_file(spark, scratch):
    ids = []
    for name, rows in (("many.csv", uploads.many()), ("other.csv", uploads.many()[::-1])):
        base = os.path.join(scratch, name + "-store")
        jobs.ingest_csv_job(spark, uploads.write(scratch, name, rows=rows), base, "u1")
        ids.append({r.attempt_id for r in jobs.read_tables(spark, base).attempts.collect()})
    assert ids[0] == ids[1] and len(ids[0]) == 120


def test_rows_without_a_time_get_the_load_time(spark, scratch):
    import datetime as dt
    base, at = os.path.join(scratch, "store"), dt.datetime(2025, 5, 4, 3, 2, 1)
    jobs.ingest_csv_job(spark, uploads.write(scratch, "steady.csv"), base, "u1", load_ts=at)
    h = {"previous_replays": 1, "duplicate_detected": False, "manually_triggered": True}
    jobs.ingest_json_job(spark, write_docs(scratch, "d.json", [doc("e1", [{"attempt_number": 1, "http_status": 500}], replays=h)]),
                         base, "u1", load_ts=at)
    t = jobs.read_tables(spark, base)
    assert {r.created_at for r in t.events.collect()} == {at}
    assert {r.attempted_at for r in t.attempts.collect()} == {at, dt.datetime(2024, 1, 1)}
    assert {r.replayed_at for r in t.replays.collect()} == {at}


def test_rejects_are_kept(spark, scratch):
    base = os.path.join(scratch, "store")
    rows = uploads.steady() + [["", "t", "c", "ep", "1", "200", "5", "False", "True"],
                               ["w-x", "t", "c", "ep", "one", "200", "5", "False", "True"]]
    jobs.ingest_csv_job(spark, uploads.write(scratch, "bad.csv", rows=rows), base, "u1")
    jobs.ingest_json_job(spark, write_docs(scratch, "d.json", [doc("e2", [{"attempt_number": 1}])]), base, "u2")
    got = {(r.source, r.reason, r.user_id) for r in jobs.read_table(spark, base, "rejects").collect()}
    assert got == {("csv", "missing:event_id", "u1"), ("csv", "bad:attempt_number", "u1"),
                   ("json", "missing:delivery_attempts.http_status", "u2")}


def test_reference_mode_keeps_repeats_with_ids_of_their_own(spark, scratch):
    base = os.path.join(scratch, "store")
    jobs.ingest_csv_job(spark, uploads.write(scratch, "mixed.csv"), base, "u1", mode="reference")
    rows = jobs.read_tables(spark, base).attempts.collect()
    assert len(rows) == len({r.attempt_id for r in rows}) == 10


def test_null_keys(spark):
    from deliverylens.tables import Tables
    empty = lambda s: spark.createDataFrame([], s)
    ev = spark.createDataFrame([("e1", None), ("e2", None), (None, "k")], "event_id string, idempotency_key string")
    users = spark.createDataFrame([("u1", "A", None), ("u2", "B", None)], S.USERS)
    t = Tables(users=users, events=ev, endpoints=empty(S.ENDPOINTS), attempts=empty(S.DELIVERY_ATTEMPTS),
               replays=empty(S.REPLAY_ACTIONS))
    assert [(r.table_name, r.key_columns, r.key_value, r.n_rows) for r in M.key_violations(t).collect()] == \
        [("webhook_events", "event_id", "<null>", 1)]
    dup = M.duplicate_events(ev.withColumn("created_at", F.lit(None).cast("timestamp_ntz")))
    assert dup.count() == 0


def test_timeline_of_chosen_events_and_of_events_without_attempts(spark):
    from paths import SF0001
    from deliverylens.operators import views as V
    from deliverylens.sources.testdata import load_tables
    t = load_tables(spark, SF0001)
    whole = V.event_timeline(t)
    assert whole.select("event_id").distinct().count() == t.events.count()
    ids = t.events.select("event_id").orderBy("event_id").limit(5)
    some = V.event_timeline(t, ids)
    assert some.select("event_id").distinct().count() == 5
    assert some.exceptAll(whole).count() == 0


def test_orphans_are_counted_without_sorting_either_side(spark, capsys):
    """Null and repeated keys on both sides; one grouping a key column, no join that sorts or holds a side."""
    from deliverylens.tables import Tables
    users = spark.createDataFrame([("u1", None, None), (None, None, None), ("u1", "x", None)], "user_id string, name string, email string")
    events = spark.createDataFrame([("e1", "u1"), ("e1", "u9"), (None, None), ("e2", "u9")], "event_id string, user_id string")
    endpoints = spark.createDataFrame([("p1", None), ("p1", "u1")], "endpoint_id string, user_id string")
    attempts = spark.createDataFrame([("e1", "p1", "u1"), ("e7", "p7", None), ("e7", None, "u1"), (None, "p1", "u7")],
                                     "event_id string, endpoint_id string, user_id string")
    replays = spark.createDataFrame([("e2", "u1"), ("e8", "u1"), (None, None)], "event_id string, user_id string")
    found = M.fk_orphans(Tables(users=users, events=events, endpoints=endpoints, attempts=attempts, replays=replays))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("delivery_attempts", "endpoint_id", "p7", 1), ("delivery_attempts", "event_id", "e7", 2), ("delivery_attempts", "user_id", "u7", 1),
        ("replay_actions", "event_id", "e8", 1), ("webhook_events", "user_id", "u9", 2)]
    found.explain()
    assert "Join" not in capsys.readouterr().out


def exchange_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def staged_files(spark):
    from deliverylens.session import checkpoint_dir
    return {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(checkpoint_dir(spark), "staged")) for f in fs}


def state(spark, base):
    return {t: sorted(map(str, jobs.read_table(spark, base, t).collect())) for t in jobs.SCHEMAS if t != "users"}


def test_an_upload_in_slices_equals_one_in_a_piece(spark, scratch, monkeypatch):
    """Two groups of buckets, merged one after the other; a batch leaves neither its copy nor exchange files."""
    import datetime as dt
    at, got, found = dt.datetime(2025, 5, 4), [], []
    rows = uploads.mixed() + uploads.steady() + [["", "t", "c", "ep", "1", "200", "5", "False", "True"], ["w-m0", "t", "c", "ep", "x", "200", "5", "False", "True"],
                                                 ["w-z", "t", "c", "ep", "x", "200", "5", "False", "True"]]
    path = uploads.write(scratch, "all.csv", rows=rows)
    h = {"previous_replays": 2, "duplicate_detected": False, "manually_triggered": True}
    docs = [doc(f"e{i % 5}", [{"attempt_number": 1 + i // 5, "http_status": 500}], replays=h) for i in range(8)] + [doc("e9", [{"attempt_number": 1}])]
    json_path = write_docs(scratch, "d.json", docs)
    init = jobs.Slices.__init__

    def spied(self, *args):
        init(self, *args)
        found.append(len(self.groups))

    monkeypatch.setattr(jobs.Slices, "__init__", spied)
    for size in (1 << 30, 1):
        monkeypatch.setattr(jobs, "SLICE_BYTES", size)
        monkeypatch.setattr(jobs.KEYS, "BUCKETS", 2)
        base = os.path.join(scratch, f"store{size}")
        files, exchanges = staged_files(spark), exchange_files(spark)
        report = jobs.ingest_csv_job(spark, path, base, "u1", load_ts=at)
        counts = jobs.ingest_json_job(spark, json_path, base, "u1", load_ts=at)
        for _ in range(50):  # they go in the background
            left = {f for f in exchange_files(spark) - exchanges if f.endswith(".data")}
            if not left:
                break
            time.sleep(0.2)
        assert not left and staged_files(spark) == files
        got.append((report.collect(), sorted(counts.collect()), state(spark, base)))
    assert got[0] == got[1]
    assert found == [1, 1, 2, 2]
    r = got[0][0][0]
    assert (r.total_events, r.events_processed, r.rejected_rows) == (19, 18, 3)
