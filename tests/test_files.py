"""File sources and sinks."""
import json
import os

from pyspark.sql import functions as F

import pytest
from paths import SF0001
from deliverylens.plans import bulk, jobs
from deliverylens.operators import features as FE
from deliverylens.sources import files as FILES
from deliverylens.sources.testdata import load_tables


def test_bulk_load_in_fk_order(spark, scratch):
    src = os.path.join(scratch, "csv")
    os.makedirs(src)
    files = {
        "endpoints.csv": "endpoint_id,customer_id,endpoint_url_type,expected_signature_version,avg_success_rate,"
                         "rate_limit_per_minute,active,last_config_change_at\n"
                         "ep_00001,cust_0001,production,v1,0.91,60,True,2024-01-01 00:00:00\n",
        "webhook_events.csv": "event_id,event_type,customer_id,invoice_id,created_at,payload_size_kb,"
                              "idempotency_key,priority\n"
                              "evt_000001,invoice.paid,cust_0001,inv_1,2024-01-01 00:00:00,120,k1,high\n",
        "delivery_attempts.csv": "attempt_id,event_id,endpoint_id,attempt_number,attempted_at,http_status,"
                                 "response_time_ms,response_body_category,timeout,signature_valid,retry_scheduled\n"
                                 "att_00000001,evt_000001,ep_00001,1,2024-01-01 00:01:00,504,610,timeout,True,True,True\n"
                                 "att_00000002,evt_000001,ep_00001,2,2024-01-01 00:05:00,200,300,success,False,True,False\n",
        "replay_actions.csv": "event_id,replayed_at,replay_result,duplicate_detected,manually_triggered\n"
                              "evt_000001,2024-01-02 00:00:00,success,False,True\n",
    }
    for name, text in files.items():
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    out = os.path.join(scratch, "tables")
    counts = {r.table_name: r.rows_added for r in bulk.bulk_load(spark, src, out).collect()}
    assert counts == {"endpoints": 1, "webhook_events": 1, "delivery_attempts": 2, "replay_actions": 1}
    t = bulk.read_bulk_tables(spark, out)
    a = t.attempts.orderBy("attempt_number").collect()
    assert (a[0].http_status, a[0].timeout, a[1].timeout) == (504, True, False)
    assert (a[0].response_body_category, a[0].retry_scheduled, a[1].retry_scheduled) == ("timeout", True, False)
    assert t.endpoints.first().last_config_change_at.year == 2024
    r = t.replays.first()
    assert r.replay_id.startswith("rep_") and r.manually_triggered is True
    # a rerun finds all files in the ledger
    assert {r.rows_added for r in bulk.bulk_load(spark, src, out).collect()} == {0}
    assert bulk.ledger(spark, out).count() == 4 and jobs.last_version(spark, out) == 0
    # a load that crashes before its commit has changed nothing; the next one loads all that is new
    with open(os.path.join(src, "delivery_attempts.csv"), "a") as f:
        f.write("att_00000002,evt_000001,ep_00001,2,2024-01-01 00:05:00,200,300,success,False,True,False\n"
                "att_00000003,evt_000001,ep_00001,three,2024-01-01 00:09:00,200,300,success,False,True,False\n"
                "att_00000004,evt_000001,ep_00001,4,2024-01-01 00:09:00,,,success,False,True,False\n")
    create, FILES.create_file = FILES.create_file, None
    try:
        with pytest.raises(TypeError):
            bulk.bulk_load(spark, src, out)
    finally:
        FILES.create_file = create
    assert bulk.read_bulk_tables(spark, out).attempts.count() == 2 and bulk.ledger(spark, out).count() == 4
    # of two writers that read one version, the second is refused and finds the file loaded when it runs again
    version = jobs.last_version(spark, out)
    assert {r.rows_added for r in bulk.bulk_load(spark, src, out).where("rows_added > 0").collect()} == {1}
    with pytest.raises(jobs.ConcurrentCommit):
        jobs.commit_batch(spark, out, {"loads": bulk.ledger(spark, out)}, version, bulk.SCHEMAS)
    assert {r.rows_added for r in bulk.bulk_load(spark, src, out).collect()} == {0}
    rejects = jobs.read_table(spark, out, "rejects", bulk.SCHEMAS).collect()
    assert [(r.source, r.reason) for r in rejects] == [("delivery_attempts.csv", "bad:attempt_number")] and "att_00000003" in rejects[0].body
    t = bulk.read_bulk_tables(spark, out)
    assert sorted(r.attempt_id for r in t.attempts.collect()) == ["att_00000001", "att_00000002", "att_00000004"]
    assert t.endpoints.count() == 1


def test_features_roundtrip_and_report_export(spark, scratch):
    f = FE.select_model_columns(FE.event_features(load_tables(spark, SF0001)))
    path = os.path.join(scratch, "features")
    FILES.write_features(f, path)
    assert "event_id" not in FILES.read_features(spark, path, schema=f.schema).columns
    back = FILES.read_features(spark, path, schema=f.schema, keep=tuple(f.columns))
    assert back.count() == f.count()
    assert back.exceptAll(f).count() == 0
    ev = FE.event_features(load_tables(spark, SF0001))
    p2 = os.path.join(scratch, "raw_features")
    FILES.write_features(ev, p2, fmt="parquet")
    read = FILES.read_features(spark, p2, fmt="parquet")
    assert dict(read.dtypes)["priority_high"] == "int"
    rep = os.path.join(scratch, "report")
    FILES.export_report(f.limit(3), rep)
    lines = [json.loads(x) for p in os.listdir(rep) if p.endswith(".json")
             for x in open(os.path.join(rep, p))]
    assert len(lines) == 3 and "event_id" in lines[0]


def test_bulk_load_in_slices_equals_one_in_a_piece(spark, scratch, monkeypatch):
    """two groups of buckets a file, from compressed files; repeated and null keys, no copies left behind."""
    import gzip
    from deliverylens.session import checkpoint_dir
    src = os.path.join(scratch, "csv")
    os.makedirs(os.path.join(src, "replay_actions.csv"))
    with gzip.open(os.path.join(src, "replay_actions.csv", "part-0.csv.gz"), "wt") as f:
        f.write("replay_id,event_id,replayed_at,replay_result,duplicate_detected,manually_triggered\n")
        f.writelines(f"{'r%d' % (i % 7) if i else ''},e{i % 4},2024-01-0{1 + i % 9} 00:00:00,success,False,True\n" for i in range(20))
    staged = lambda: {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(checkpoint_dir(spark), "staged")) for f in fs}
    got, before = [], staged()
    monkeypatch.setattr(jobs.KEYS, "BUCKETS", 2)
    for size in (1 << 30, 1):
        monkeypatch.setattr(jobs, "SLICE_BYTES", size)
        out = os.path.join(scratch, f"tables{size}")
        counts = {r.table_name: r.rows_added for r in bulk.bulk_load(spark, src, out).collect()}
        got.append((counts, sorted(map(str, bulk.read_bulk_tables(spark, out).replays.collect())), bulk.ledger(spark, out).first().rows_added))
    assert got[0] == got[1] and got[0][0]["replay_actions"] == 7 == len(got[0][1]) == got[0][2]
    assert staged() == before
