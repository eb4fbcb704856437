"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables through ``load_tables`` (so it grows with
them) and runs one job of the library.  ``oracle.SQL`` holds the SQL twin of
every deterministic one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import intelligence as INTEL
from ..ml import isolation_forest as IFOREST
from ..ml import recovery as REC
from ..ml import split as SPL
from ..operators import analytics as A
from ..operators import decisions as D
from ..operators import features as FE
from ..operators import ingest as M
from ..operators import views as V
from ..session import checkpoint_dir, staged
from ..sources import raw as RAW
from ..sources.testdata import STORED_BEFORE, load_tables

from . import jobs as JOBS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _scratch(spark, kind: str) -> str:
    """A new folder in the shared storage."""
    return os.path.join(checkpoint_dir(spark), kind, uuid.uuid4().hex)


_TABLES: dict = {}


def _t(spark, sf_dir):
    """The domain tables for a data folder.  The lazy plans are built once
    per session and folder (parsing and analysing the mapping expressions
    is not free); every query still runs its whole plan."""
    key = (id(spark), sf_dir)
    if key not in _TABLES:  # the session is held too, so its id stays unique
        _TABLES[key] = (spark, load_tables(spark, sf_dir))
    return _TABLES[key][1]


@register("load_tables")
def _load_tables(spark, sf_dir):
    t = _t(spark, sf_dir)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in t.as_dict().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("endpoint_instability")
def _a1(spark, sf_dir):
    return A.endpoint_instability(_t(spark, sf_dir).attempts)


@register("retry_patterns")
def _a2(spark, sf_dir):
    return A.retry_patterns(_t(spark, sf_dir).attempts)


@register("replay_frequency")
def _a3(spark, sf_dir):
    return A.replay_frequency(_t(spark, sf_dir).replays)


@register("tenant_overview")
def _a4(spark, sf_dir):
    return A.tenant_overview(_t(spark, sf_dir))


@register("tenant_endpoints")
def _a5(spark, sf_dir):
    return A.tenant_endpoints(_t(spark, sf_dir))


@register("tenant_event_counts")
def _a6(spark, sf_dir):
    return A.tenant_event_counts(_t(spark, sf_dir).events, limit=10)


@register("distinct_events")
def _a7(spark, sf_dir):
    return A.distinct_events(_t(spark, sf_dir).attempts)


@register("sketch_bounds")
def _sketches(spark, sf_dir):
    """A7 and A10 by sketches: states for each tenant and day, merged by month and then by tenant; the exact counts
    beside whether each estimate keeps its bound."""
    from ..operators import sketches as SK
    rows = _t(spark, sf_dir).attempts.where(F.col("user_id").isNotNull())
    days = SK.daily_states(rows)
    months = SK.merged(days, "user_id", F.trunc("day", "month").alias("month"))
    return SK.against_exact(rows, SK.estimates(SK.merged(months, "user_id")))


@register("event_base")
def _fe1(spark, sf_dir):
    return FE.event_base(_t(spark, sf_dir))


@register("attempt_features")
def _fe2(spark, sf_dir):
    return FE.attempt_features(_t(spark, sf_dir).attempts)


@register("replay_features")
def _fe2b(spark, sf_dir):
    return FE.replay_features(_t(spark, sf_dir).replays)


@register("event_features")
def _fe3(spark, sf_dir):
    return FE.event_features(_t(spark, sf_dir))


@register("one_hot_priority")
def _fe4(spark, sf_dir):
    ev = _t(spark, sf_dir).events.select("event_id", "priority")
    return FE.one_hot(ev, "priority", ["low", "medium", "high", "critical"])


@register("features_per_event")
def _fe5(spark, sf_dir):
    return FE.features_per_event(_t(spark, sf_dir))


@register("select_model_columns")
def _fe6(spark, sf_dir):
    return FE.select_model_columns(FE.event_features(_t(spark, sf_dir)))


@register("class_balance")
def _a8(spark, sf_dir):
    return A.class_balance(FE.event_features(_t(spark, sf_dir)))


@register("null_counts")
def _a9(spark, sf_dir):
    from ..functions.stats import null_counts
    f = FE.event_features(_t(spark, sf_dir))
    return null_counts(f)


@register("describe_features")
def _a10(spark, sf_dir):
    return A.describe_features(FE.event_features(_t(spark, sf_dir)))


@register("stratified_split")
def _ml1(spark, sf_dir):
    f = FE.event_features(_t(spark, sf_dir)).select("event_id", "endpoint_id", "is_recovered")
    return SPL.stratified_split(staged(f, "features"))  # the rank search and the result read it


@register("shuffle_split")
def _ml7(spark, sf_dir):
    return SPL.shuffle_split(_t(spark, sf_dir).events.select("event_id"))


@register("class_weight")
def _a13(spark, sf_dir):
    f = SPL.stratified_split(staged(FE.event_features(_t(spark, sf_dir)).select("event_id", "is_recovered"), "features"))
    return A.class_weight(f.where(F.col("split") == "train"))


# ---------------------------------------------------------------------------
# decisions (D1-D3, D5-D9), P11, A11
# ---------------------------------------------------------------------------


def _rules(spark, sf_dir):
    return D.intelligence_rules(FE.features_per_event(_t(spark, sf_dir)))


@register("intelligence_rules")
def _d5(spark, sf_dir):
    return _rules(spark, sf_dir)


@register("failure_reason")
def _d1(spark, sf_dir):
    return _rules(spark, sf_dir).select("event_id", "failure_reason")


@register("recommended_action")
def _d2(spark, sf_dir):
    return _rules(spark, sf_dir).select("event_id", "recommended_action")


@register("delivery_state")
def _d3(spark, sf_dir):
    return _rules(spark, sf_dir).select("event_id", "delivery_state")


@register("replay_gate")
def _d6(spark, sf_dir):
    return D.replay_gate(_rules(spark, sf_dir))


@register("response_category")
def _d7(spark, sf_dir):
    a = _t(spark, sf_dir).attempts
    return D.with_response_category(a).select("attempt_id", "http_status", "timeout", "response_category")


@register("label_delivery_outcome")
def _d8(spark, sf_dir):
    t = _t(spark, sf_dir)
    return D.label_delivery_outcome(t.attempts, t.events)


@register("retry_scheduled")
def _d9(spark, sf_dir):
    return D.retry_scheduled(_t(spark, sf_dir).attempts)


@register("labels_for_split")
def _p11(spark, sf_dir):
    t = _t(spark, sf_dir)
    train = SPL.shuffle_split(t.events.select("event_id")).where(F.col("split") == "train")
    return D.label_delivery_outcome(t.attempts, t.events).join(train.select("event_id"), "event_id", "left_semi")


def baseline_prediction(features: DataFrame) -> DataFrame:
    """A transparent predictor for the report: recovered iff the endpoint's
    health is at least 0.7 (the 'endpoint offline' line of D1)."""
    return features.withColumn(
        "prediction", F.coalesce((F.col("endpoint_health_score") >= 0.7).cast("int"), F.lit(0)))


@register("classification_report")
def _a11(spark, sf_dir):
    rows = staged(baseline_prediction(FE.event_features(_t(spark, sf_dir))).select("event_id", "is_recovered", "prediction"), "features")
    f = SPL.stratified_split(rows).where(F.col("split") == "test")
    return A.classification_report(f, label="is_recovered", pred="prediction")


# ---------------------------------------------------------------------------
# views (P1, E1-E4, R1, R3-R7) and the hourly twin of the health stream
# ---------------------------------------------------------------------------
@register("event_lookup")
def _p1(spark, sf_dir):
    t = _t(spark, sf_dir)
    requested = t.replays.select("event_id").unionByName(t.attempts.select("event_id"))
    return V.event_lookup(t.events, requested)


@register("list_events")
def _e1(spark, sf_dir):
    return V.list_events(_t(spark, sf_dir), page=1, limit=5)


@register("event_timeline")
def _e2(spark, sf_dir):
    return V.event_timeline(_t(spark, sf_dir))


@register("timeline_pages")
def _j6(spark, sf_dir):
    """The nested pages, two attempts each; the arrays joined to text, which both engines write alike."""
    pages = V.timeline_pages(_t(spark, sf_dir), page_size=2)
    names = F.transform("attempts", lambda a: F.concat_ws(":", a["attempt_number"].cast("string"), a["attempt_id"], a["detail"]))
    return pages.select("event_id", "event_type", "page", "n_attempts", F.concat_ws("|", names).alias("attempts"))


@register("top_unstable")
def _e3(spark, sf_dir):
    return V.top_unstable(A.endpoint_instability(_t(spark, sf_dir).attempts), k=5)


@register("first_attempt_patterns")
def _e4(spark, sf_dir):
    return V.first_attempt_patterns(A.retry_patterns(_t(spark, sf_dir).attempts), k=4)


@register("instability_view")
def _r3(spark, sf_dir):
    return V.instability_view(A.endpoint_instability(_t(spark, sf_dir).attempts))


@register("retry_view")
def _r4(spark, sf_dir):
    return V.retry_view(A.retry_patterns(_t(spark, sf_dir).attempts))


@register("endpoint_view")
def _r5(spark, sf_dir):
    return V.endpoint_view(A.tenant_endpoints(_t(spark, sf_dir)))


@register("replay_view")
def _r6(spark, sf_dir):
    return V.replay_view(A.replay_frequency(_t(spark, sf_dir).replays))


@register("system_status")
def _r7(spark, sf_dir):
    return V.system_status(A.tenant_overview(_t(spark, sf_dir)))


@register("ingest_summary")
def _r1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return V.ingest_summary(t, A.endpoint_instability(t.attempts), A.retry_patterns(t.attempts))


@register("endpoint_health_hourly")
def _st3_twin(spark, sf_dir):
    from ..streaming.jobs import endpoint_health_windows
    return endpoint_health_windows(_t(spark, sf_dir).attempts, "1 hour")


# ---------------------------------------------------------------------------
# streams run to their end (ST1-ST3), and the batch form of bursts and spikes
# ---------------------------------------------------------------------------
def _arrivals(df: DataFrame, time: str, cuts: list[str]) -> list[DataFrame]:
    """The rows of each span of time between ``cuts``, in order; rows without a time arrive first."""
    at = F.lit(0)
    for c in cuts:
        at = at + F.coalesce((F.col(time) >= F.lit(c).cast("timestamp_ntz")).cast("int"), F.lit(0))
    return [df.where(at == i) for i in range(len(cuts) + 1)]


ATTEMPT_CUTS, REPLAY_CUTS = ["1997-06-01", "1999-06-01"], ["2024-01-11", "2024-01-21"]


def _streamed(spark, arrivals, plan) -> DataFrame:
    """What a stream over ``arrivals`` has appended to its sink at its end; ``plan(rows)`` is the stream."""
    from ..streaming import bursts as B
    from ..streaming import jobs as ST
    folder, session = _scratch(spark, "streams"), B.stream_session(spark)
    sink = os.path.join(folder, "out")
    ST.in_arrivals(session, arrivals, folder, lambda rows, checkpoint: B.append_stream(plan(rows), sink, checkpoint))
    return spark.read.parquet(sink)


@register("retry_bursts")
def _bursts(spark, sf_dir):
    from ..streaming import bursts as B
    return B.retry_bursts(B.retries_of(_t(spark, sf_dir).attempts))


@register("replay_spikes")
def _spikes(spark, sf_dir):
    from ..streaming import bursts as B
    return B.replay_spikes(_t(spark, sf_dir).replays)


@register("stream_endpoint_health")
def _st3(spark, sf_dir):
    """ST3 as a stream over three arrivals: the hourly windows that are over at its end."""
    from ..streaming import jobs as ST
    arrivals = _arrivals(_t(spark, sf_dir).attempts, "attempted_at", ATTEMPT_CUTS)
    out = _streamed(spark, arrivals, ST.live_endpoint_health)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("stream_dedupe_attempts")
def _st2(spark, sf_dir):
    """ST2 as a stream: a third of the rows arrive twice at once, and a fifth again with the next arrival.
    The watermark's delay spans the table, so each key is kept once; returns the keys with the rows kept."""
    from ..streaming import jobs as ST
    parts = _arrivals(_t(spark, sf_dir).attempts, "attempted_at", ATTEMPT_CUTS)
    arrivals = []
    for i, part in enumerate(parts):
        twice = part.unionByName(part.where(F.col("attempt_number") % 3 == 0))
        arrivals.append(twice if i == 0 else twice.unionByName(parts[i - 1].where(F.col("attempt_number") % 5 == 0)))
    kept = _streamed(spark, arrivals, lambda rows: ST.deduped_attempts(rows, delay="3650 days"))
    return kept.groupBy("event_id", "attempt_number").agg(F.count(F.lit(1)).alias("kept"))


@register("stream_retry_bursts")
def _st3_bursts(spark, sf_dir):
    """Retry bursts as a stream: each is emitted once, when the watermark has passed it."""
    from ..streaming import bursts as B
    arrivals = _arrivals(_t(spark, sf_dir).attempts, "attempted_at", ATTEMPT_CUTS)
    return _streamed(spark, arrivals, B.live_retry_bursts)


@register("stream_replay_spikes")
def _st3_spikes(spark, sf_dir):
    """Replay spikes as a stream: each tenant's baseline and open days are keyed state, timers close the days."""
    from ..streaming import bursts as B
    arrivals = _arrivals(_t(spark, sf_dir).replays, "replayed_at", REPLAY_CUTS)
    out = _streamed(spark, arrivals, B.live_replay_spikes)
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@register("stream_ingest_store")
def _st1(spark, sf_dir):
    """ST1 as a stream of upload rows: half of the events, then the other half with the first sent once more;
    the stored attempts."""
    from ..streaming import jobs as ST
    rows = RAW.attempts_csv_rows(_t(spark, sf_dir)).withColumnRenamed("uploader", "user_id")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    base = _store(spark)
    ST.in_arrivals(spark, [rows.where(half), rows], _scratch(spark, "streams"),
                   lambda stream, checkpoint: ST.stream_ingest_rows(spark, stream.withColumn("ord", RAW.input_order()), base, checkpoint))
    return JOBS.read_table(spark, base, "delivery_attempts")


# ---------------------------------------------------------------------------
# ingest (S3-S5, S11, M1-M10) and data quality (Q1-Q3)
# ---------------------------------------------------------------------------
def _stored(t):
    """Rows already stored before the incoming batch (see STORED_BEFORE)."""
    cut = F.lit(STORED_BEFORE).cast("timestamp_ntz")
    att = t.attempts.where(F.col("attempted_at") < cut)
    ev = t.events.where(F.col("created_at") < cut)
    eps = t.endpoints.join(att.select("endpoint_id"), "endpoint_id", "left_semi")
    return ev, eps, att


def _coerced(t):
    return M.coerce_attempts(RAW.attempts_csv_rows(t))


def _csv_first_rows(t):
    return M.first_row_per_event(_coerced(t), RAW.input_order())


def _docs(t):
    return RAW.parse_log_documents(RAW.log_documents_json(t))


def _valid_docs(t):
    return M.validate_logs(_docs(t))[0]


@register("coerce_attempts")
def _s3(spark, sf_dir):
    return _coerced(_t(spark, sf_dir))


@register("first_row_per_event")
def _m6(spark, sf_dir):
    return _csv_first_rows(_t(spark, sf_dir)).select(
        "attempt_id", "event_id", "attempt_number", "endpoint_id", "event_type", "customer_id")


_ATT_OUT = ["attempt_id", "event_id", "endpoint_id", "attempt_number", "http_status", "response_time_ms",
            "timeout", "signature_valid"]


@register("dedupe_attempts_in_batch")
def _m5(spark, sf_dir):
    rows = _csv_first_rows(_t(spark, sf_dir))
    return M.dedupe_attempts_in_batch(rows, RAW.input_order(), mode="strict").select(*_ATT_OUT)


@register("insert_endpoints_if_absent")
def _m2(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, eps, _ = _stored(t)
    return M.insert_endpoints_if_absent(eps, _csv_first_rows(t), F.col("uploader"))


@register("insert_events_if_absent")
def _m3(spark, sf_dir):
    t = _t(spark, sf_dir)
    ev, _, _ = _stored(t)
    rows = _coerced(t).withColumnRenamed("uploader", "user_id")
    return M.insert_events_if_absent(ev, rows, RAW.input_order())


def _inserted_attempts(t):
    _, _, att = _stored(t)
    rows = _csv_first_rows(t).withColumnRenamed("uploader", "user_id")
    return M.insert_attempts_if_absent(att, rows, RAW.input_order(), mode="strict")


@register("insert_attempts_if_absent")
def _m4(spark, sf_dir):
    return _inserted_attempts(_t(spark, sf_dir)).select(*_ATT_OUT, "user_id")


@register("ingest_report")
def _m9(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, _, stored = _stored(t)

    def merge(typed):
        rows = M.first_row_per_event(typed, RAW.input_order()).withColumnRenamed("uploader", "user_id")
        return M.insert_attempts_if_absent(stored, rows, RAW.input_order(), mode="strict")

    return M.merge_with_report(_coerced(t), merge)[1]


@register("backfill_tenant")
def _m10(spark, sf_dir):
    return M.backfill_tenant(_t(spark, sf_dir).attempts).select("attempt_id", "user_id")


@register("with_surrogate_id")
def _s11(spark, sf_dir):
    from ..functions.scalars import surrogate_id
    a = _t(spark, sf_dir).attempts
    return a.select("attempt_id", surrogate_id("att", "event_id", "attempt_number", "attempt_id")
                    .alias("surrogate_id"))


@register("read_logs_json")
def _s4(spark, sf_dir):
    d = _docs(_t(spark, sf_dir))
    fields = ["attempt_number", "http_status", "response_time_ms", "timeout", "signature_valid", "attempted_at", "attempt_id"]
    text = F.transform("delivery_attempts", lambda a: F.concat_ws(
        ":", *[F.coalesce(a[f].cast("string"), F.lit("-")) for f in fields]))
    return d.select(
        "event_id", "event_type", "customer_id", "user_id",
        F.col("endpoint.endpoint_id").alias("endpoint_id"), F.col("endpoint.avg_success_rate").alias("avg_success_rate"),
        F.col("endpoint.active").alias("active"),
        F.col("endpoint.rate_limit_per_minute").alias("rate_limit_per_minute"),
        F.size("delivery_attempts").alias("n_attempts"), F.array_join(text, ",").alias("attempts"),
        F.col("replay_history.previous_replays").alias("previous_replays"),
        F.col("replay_history.duplicate_detected").alias("duplicate_detected"),
        F.col("replay_history.manually_triggered").alias("manually_triggered"))


@register("validate_logs")
def _s5(spark, sf_dir):
    d = _docs(_t(spark, sf_dir))
    return d.select("event_id", F.element_at("delivery_attempts", 1)["attempt_id"].alias("attempt_id"),
                    M.reject_reason().alias("reject_reason"))


@register("explode_attempts")
def _m8(spark, sf_dir):
    return M.explode_attempts(_valid_docs(_t(spark, sf_dir)))


@register("expand_replays")
def _m7(spark, sf_dir):
    return M.expand_replays(_valid_docs(_t(spark, sf_dir)))


@register("upsert_endpoints")
def _m1(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, eps, _ = _stored(t)
    return M.upsert_endpoints(eps, _valid_docs(t), RAW.document_order())


def _store(spark) -> str:
    return _scratch(spark, "stores")


@register("ingest_csv_store")
def _m11_csv(spark, sf_dir):
    """M11 end to end: the rows before the cut as one upload, then all rows as another; the stored attempts."""
    rows = (RAW.attempts_csv_rows(_t(spark, sf_dir)).withColumn("ord", RAW.input_order())
            .withColumnRenamed("uploader", "user_id"))
    base = _store(spark)
    JOBS.ingest_csv_batch(spark, rows.where(F.col("attempted_at") < F.lit(STORED_BEFORE).cast("timestamp_ntz")), base)
    JOBS.ingest_csv_batch(spark, rows, base)
    return JOBS.read_table(spark, base, "delivery_attempts")


@register("ingest_json_store")
def _m11_json(spark, sf_dir):
    """M11 end to end for documents, uploaded twice by one tenant; the stored attempts and replays."""
    docs, base = _docs(_t(spark, sf_dir)), _store(spark)
    for _ in range(2):  # the second upload adds nothing
        JOBS.ingest_json_batch(spark, docs, base, "user_1")
    a = JOBS.read_table(spark, base, "delivery_attempts").select(
        F.lit("attempt").alias("kind"), F.col("attempt_id").alias("id"), "event_id", "attempt_number",
        F.col("http_status").cast("string").alias("result"), "user_id")
    r = JOBS.read_table(spark, base, "replay_actions").select(
        F.lit("replay").alias("kind"), F.col("replay_id").alias("id"), "event_id",
        F.lit(None).cast("int").alias("attempt_number"), F.col("replay_result").alias("result"), "user_id")
    return a.unionByName(r)


_LIVE: dict = {}


def _live_views(spark, sf_dir) -> str:
    """A store that the tables reach in three commits, with the views brought up to date after each; the views'
    folder.  Built once per session and data folder."""
    from . import live_views as LV
    key = (id(spark), sf_dir)
    if key in _LIVE:
        return _LIVE[key][1]
    t, base, views = _t(spark, sf_dir), _store(spark), _store(spark)
    events = _arrivals(t.events, "created_at", ATTEMPT_CUTS)
    attempts = _arrivals(t.attempts, "attempted_at", ATTEMPT_CUTS)  # many come before or after their event's commit
    replays = _arrivals(t.replays, "replayed_at", REPLAY_CUTS)
    for e, a, r in zip(events, attempts, replays):
        JOBS.commit_batch(spark, base, {"webhook_events": e, "delivery_attempts": a, "replay_actions": r})
        LV.refresh(spark, base, views)
    _LIVE[key] = (spark, views)  # the session is held, so its id stays unique
    return views


@register("live_endpoint_instability")
def _a1_live(spark, sf_dir):
    """A1 from states that were refreshed commit by commit."""
    from . import live_views as LV
    return LV.endpoint_instability(spark, _live_views(spark, sf_dir))


@register("live_tenant_overview")
def _a4_live(spark, sf_dir):
    """A4 from states that were refreshed commit by commit."""
    from . import live_views as LV
    return LV.tenant_overview(spark, _live_views(spark, sf_dir), _t(spark, sf_dir).users)


@register("bulk_load_store")
def _s7(spark, sf_dir):
    """S7 end to end: the tables as CSV files, loaded twice; the stored attempts with what each load has added."""
    from . import bulk
    t, folder = _t(spark, sf_dir), _scratch(spark, "bulk")
    for table, name, schema in bulk.FILES.BULK_FILES:
        df = t.as_dict()[table]
        columns = [c for c in schema.fieldNames() if c in df.columns]
        df.select(*columns).write.option("header", True).option("compression", "gzip").csv(os.path.join(folder, "csv", name))
    base = os.path.join(folder, "store")
    first, second = (bulk.bulk_load(spark, os.path.join(folder, "csv"), base) for _ in range(2))
    stored = bulk.read_bulk_tables(spark, base).as_dict()
    n = None
    for table, df in stored.items():
        one = df.agg(F.count(F.lit(1)).alias("rows_stored")).select(F.lit(table).alias("table_name"), "rows_stored")
        n = one if n is None else n.unionByName(one)
    return (n.join(first, "table_name").withColumnRenamed("rows_added", "first_load")
            .join(second.withColumnRenamed("rows_added", "second_load"), "table_name"))


@register("stored_events_lookup")
def _p1_store(spark, sf_dir):
    """P1 on the table store: the events come in four batches, then those that a tenant's replays ask for are
    looked up through the key index."""
    t, base = _t(spark, sf_dir), _store(spark)
    for part in _arrivals(t.events, "created_at", ["1996-01-01", "1997-06-01", "1999-01-01"]):
        JOBS.commit_batch(spark, base, {"webhook_events": part})
    asked = t.replays.where(F.col("user_id") == "user_3").select(F.col("event_id").alias("key"))
    return JOBS.lookup(spark, base, "webhook_events", asked).select("event_id", "event_type", "customer_id", "user_id", "created_at")


@register("key_violations")
def _q1(spark, sf_dir):
    return M.key_violations(_t(spark, sf_dir))


@register("fk_orphans")
def _q2(spark, sf_dir):
    return M.fk_orphans(_t(spark, sf_dir))


@register("duplicate_events")
def _q3(spark, sf_dir):
    return M.duplicate_events(_t(spark, sf_dir).events)


# ---------------------------------------------------------------------------
# model-backed jobs (rows-only checks): ML2-ML6, A12, D4, R2
# ---------------------------------------------------------------------------

_MODELS: dict = {}


def _fitted(spark, sf_dir):
    key = (id(spark), sf_dir)
    if key not in _MODELS:  # fitted once per session and folder; session held
        t = _t(spark, sf_dir)
        rows = INTEL.model_rows(FE.event_features(t))  # both splits; in the shared folder
        _MODELS[key] = (spark, INTEL.fit_models(t, rows=rows), rows)
    return _MODELS[key]


def models_for(spark, sf_dir):
    return _fitted(spark, sf_dir)[1]


def _fpe_rows(t):
    return FE.select_model_columns(FE.features_per_event(t))


@register("score_recovery")
def _ml5(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = REC.score_recovery(models_for(spark, sf_dir).recovery, _fpe_rows(t))
    return s.select("event_id", "prediction", "p_recovered", "safe_to_replay")


@register("risk_score")
def _ml6(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = REC.score_recovery(models_for(spark, sf_dir).recovery, _fpe_rows(t))
    return s.select("event_id", "risk_score")


@register("score_anomaly")
def _ml4(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = models_for(spark, sf_dir)
    s = IFOREST.score_isolation_forest(REC.impute(_fpe_rows(t)), m.forest, FE.MODEL_FEATURES)
    return (s.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(m.threshold))
            .select("event_id", "anomaly_score", "is_anomaly",
                    F.when(F.col("is_anomaly"), -1).otherwise(1).alias("anomaly_label")))


@register("anomaly_rate")
def _a12(spark, sf_dir):
    _, models, rows = _fitted(spark, sf_dir)
    return INTEL.anomaly_rate(_t(spark, sf_dir), models, rows)


@register("event_intelligence")
def _d4(spark, sf_dir):
    return INTEL.event_intelligence(_t(spark, sf_dir), models_for(spark, sf_dir))


@register("event_intelligence_for_ids")
def _d4_ids(spark, sf_dir):
    """D4 + J7 for the events that replays and customers ask about; ids without features get the fallback row."""
    t = _t(spark, sf_dir)
    ids = (t.replays.select("event_id")
           .unionByName(t.users.select(F.concat(F.lit("evt_of_"), "user_id").alias("event_id"))))
    return INTEL.event_intelligence(t, models_for(spark, sf_dir), ids)


@register("event_analysis_report")
def _r2(spark, sf_dir):
    t = _t(spark, sf_dir)
    return INTEL.event_analysis_report(t, INTEL.event_intelligence(t, models_for(spark, sf_dir)))
