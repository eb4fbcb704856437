"""Ingest, upsert and data-quality jobs.

The original service upserts row by row (a lookup per event and per
attempt).  Here each table's merge is one set-based plan: pick one incoming
row per key with a partial-aggregating ``min_by``/``max_by`` (a key holding
a third of the batch is reduced map-side), then ``left_anti`` against the
stored keys and ``unionByName``.  Input order -- "first row", "last
payload" -- is an explicit ordering column, never the physical row order.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import surrogate_id
from ..session import staged
from ..tables import Tables


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# S3: typing of the all-string CSV rows
# ---------------------------------------------------------------------------
def _lenient_int(c) -> Column:
    """Text -> int the way ``int(float)`` would: '3', '3.0', '3.7' -> 3, '-1.5' -> -1;
    null where the text is no number or does not fit an int."""
    return _c(c).try_cast("double").try_cast("int")


def _flag(c) -> Column:
    """``str(x).lower() == 'true'``: only 'true' in any case is true."""
    return F.coalesce(F.lower(_c(c)) == "true", F.lit(False))


def coerce_attempts(raw: DataFrame) -> DataFrame:
    """S3: typed attempt rows.  A bad attempt number marks the row invalid
    (the original load fails on it); a missing status becomes 500, a missing
    response time 1000.0; flags are true only for the text 'true'."""
    status = _lenient_int("http_status")
    rt = F.expr("try_cast(response_time_ms as double)")
    extra = [c for c in raw.columns if c not in S.REQUIRED_CSV_COLUMNS]
    return raw.select(
        "event_id", "event_type", "customer_id", "endpoint_id",
        _lenient_int("attempt_number").alias("attempt_number"),
        F.coalesce(status, F.lit(S.CSV_NULL_STATUS)).alias("http_status"),
        F.coalesce(rt, F.lit(S.CSV_NULL_RESPONSE_MS)).alias("response_time_ms"),
        _flag("timeout").alias("timeout"),
        _flag("signature_valid").alias("signature_valid"),
        (_lenient_int("attempt_number").isNotNull() & F.col("event_id").isNotNull()).alias("is_valid"),
        *extra)


def coerced_beside_text(raw: DataFrame) -> DataFrame:
    """The upload's own text rows with S3's verdict (``is_valid``)."""
    return raw.withColumn("is_valid", _lenient_int("attempt_number").isNotNull() & F.col("event_id").isNotNull())


def with_attempt_ids(rows: DataFrame, order: Column) -> DataFrame:
    """``attempt_id`` derived from (event_id, attempt_number) and, among rows
    repeated under that key, their rank in input order."""
    key = Window.partitionBy("event_id", "attempt_number").orderBy(order)
    ranked = rows.withColumn("_rank", F.row_number().over(key))
    return ranked.withColumn("attempt_id", surrogate_id("att", "event_id", "attempt_number", "_rank")).drop("_rank")


# ---------------------------------------------------------------------------
# Per-document validation of raw log documents
# ---------------------------------------------------------------------------
_ENDPOINT_FIELDS = ["endpoint_id", "avg_success_rate", "active", "rate_limit_per_minute"]
_ATTEMPT_FIELDS = ["attempt_number", "http_status", "response_time_ms", "timeout", "signature_valid",
                   "attempted_at"]
_REPLAY_FIELDS = ["previous_replays", "duplicate_detected", "manually_triggered"]


def reject_reason(corrupt_col: str | None = None) -> Column:
    """First failing rule of a document, in schema order; null = valid."""
    checks: list[tuple[Column, str]] = []
    if corrupt_col:
        checks.append((F.col(corrupt_col).isNotNull(), "malformed_json"))
    for f in ["event_id", "event_type", "customer_id"]:
        checks.append((F.col(f).isNull(), f"missing:{f}"))
    checks.append((F.col("endpoint").isNull(), "missing:endpoint"))
    for f in _ENDPOINT_FIELDS:
        checks.append((F.col(f"endpoint.{f}").isNull(), f"missing:endpoint.{f}"))
    checks.append((F.col("delivery_attempts").isNull(), "missing:delivery_attempts"))
    def field_missing(name):
        return lambda a: a[name].isNull()

    for f in _ATTEMPT_FIELDS:
        checks.append((F.exists("delivery_attempts", field_missing(f)), f"missing:delivery_attempts.{f}"))
    for f in _REPLAY_FIELDS:
        checks.append((F.col("replay_history").isNotNull() & F.col(f"replay_history.{f}").isNull(),
                       f"missing:replay_history.{f}"))
    # replays need a last attempt to take their result from
    checks.append(((F.coalesce(F.col("replay_history.previous_replays"), F.lit(0)) > 0)
                   & (F.size("delivery_attempts") == 0), "replays_without_attempts"))
    expr = None
    for cond, reason in checks:
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr.otherwise(F.lit(None).cast("string"))


def judge_logs(docs: DataFrame, corrupt_col: str | None = None) -> DataFrame:
    """S5's verdict beside each document: ``reject_reason`` (null: valid)."""
    return docs.withColumn("reject_reason", reject_reason(corrupt_col))


def split_logs(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged documents as (valid, rejected); rejects keep the reason."""
    return (judged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            judged.where(F.col("reject_reason").isNotNull()))


def validate_logs(docs: DataFrame, corrupt_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split documents into (valid, rejected)."""
    return split_logs(judge_logs(docs, corrupt_col))


# ---------------------------------------------------------------------------
# M8 / M7: documents -> attempt rows and replay rows
# ---------------------------------------------------------------------------
def _parse_ts(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def explode_attempts(docs: DataFrame) -> DataFrame:
    """M8: one row per nested attempt, carrying the document's endpoint and
    uploader; ``doc_pos`` keeps the position inside the document."""
    a = docs.select(
        "event_id", F.col("endpoint.endpoint_id").alias("endpoint_id"), "user_id",
        F.posexplode("delivery_attempts").alias("doc_pos", "a"))
    return a.select(
        F.coalesce(F.col("a.attempt_id"),
                   surrogate_id("att", "event_id", F.col("a.attempt_number"), F.col("a.attempted_at")))
        .alias("attempt_id"),
        "event_id", "endpoint_id",
        F.col("a.attempt_number").alias("attempt_number"),
        F.col("a.http_status").alias("http_status"),
        F.col("a.response_time_ms").cast("double").alias("response_time_ms"),
        F.col("a.timeout").alias("timeout"),
        F.col("a.signature_valid").alias("signature_valid"),
        "user_id",
        _parse_ts(F.col("a.attempted_at")).alias("attempted_at"),
        "doc_pos")


REPLAY_CHUNK = 1000  # replays of one document that a single array holds


def expand_replays(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """M7: ``previous_replays`` replay rows per document; the result is
    'failed' when the document's last attempt has status >= 400.  Ids come
    from (event, i), so re-ingesting a document adds nothing.  A document's
    count is expanded chunk by chunk, so a huge one builds no huge array.
    ``carry`` names further document columns to keep."""
    carry = carry or []
    n = F.coalesce(F.col("replay_history.previous_replays"), F.lit(0))
    d = docs.where((n > 0) & (F.size("delivery_attempts") > 0))
    last_status = F.element_at("delivery_attempts", -1)["http_status"]
    step = F.lit(REPLAY_CHUNK)
    return (d.select("event_id", "user_id", "replay_history", *carry, n.alias("n"),
                     F.when(last_status >= 400, "failed").otherwise("success").alias("replay_result"),
                     F.explode(F.sequence(F.lit(1), n, step)).alias("first"))
            .withColumn("i", F.explode(F.sequence("first", F.least(F.col("first") + (step - 1), "n"))))
            .select(surrogate_id("rep", "event_id", "i").alias("replay_id"), "event_id", "replay_result",
                    F.coalesce(F.col("replay_history.duplicate_detected"), F.lit(False)).alias("duplicate_detected"),
                    F.coalesce(F.col("replay_history.manually_triggered"), F.lit(False)).alias("manually_triggered"),
                    "user_id", *carry))


def dedupe_replays(replays: DataFrame, order: Column) -> DataFrame:
    """One row per replay id: that of the first document in input order."""
    return _first_by(replays, ["replay_id"], order, list(replays.columns))


# ---------------------------------------------------------------------------
# M5 / M6: batch-internal first rows
# ---------------------------------------------------------------------------
def _first_by(df: DataFrame, keys: list[str], order: Column, cols: list[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order`` (partial agg)."""
    s = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.min_by(s, order).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols if c not in keys]))


def first_row_per_event(rows: DataFrame, order: Column) -> DataFrame:
    """M6: every attempt row of an event takes endpoint, type and customer
    from the event's first row in input order; rows without an event id are
    dropped (as a group-by on the id drops them)."""
    r = rows.where(F.col("event_id").isNotNull())
    return with_first_row(r, first_of_event(r, order))


FIRST_ROW_COLUMNS = ["endpoint_id", "event_type", "customer_id"]


def first_of_event(rows: DataFrame, order: Column, *more: str) -> DataFrame:
    """Each event's endpoint, type and customer (and ``more`` columns) by its first row in input order."""
    return _first_by(rows, ["event_id"], order, [*FIRST_ROW_COLUMNS, *more])


def with_first_row(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows with endpoint, type and customer of their event's first row."""
    return rows.drop(*FIRST_ROW_COLUMNS).join(first.select("event_id", *FIRST_ROW_COLUMNS), "event_id")


TIE_BREAK_COLUMNS = ["http_status", "response_time_ms", "timeout", "signature_valid"]
ATTEMPT_COLUMNS = ["attempt_number", *TIE_BREAK_COLUMNS]


def dedupe_attempts_in_batch(rows: DataFrame, order: Column, mode: str = "strict") -> DataFrame:
    """M5: ``strict`` keeps the first row per (event_id, attempt_number) in
    input order; ``reference`` keeps every row (the original session does
    not flush, so in-batch repeats are all inserted)."""
    if mode == "reference":
        return rows
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    key = "__dedupe_order"
    # rows equal on the order key are told apart by their own fields, so the
    # kept row never depends on arrival inside a task
    ties = [c for c in TIE_BREAK_COLUMNS if c in rows.columns]
    total = F.struct(order.alias("o"), *[F.col(c) for c in ties])
    return _first_by(rows.withColumn(key, total), ["event_id", "attempt_number"], F.col(key),
                     list(rows.columns))


# ---------------------------------------------------------------------------
# M1-M4: merges
# ---------------------------------------------------------------------------
def upsert_endpoints(existing: DataFrame, docs: DataFrame, order: Column) -> DataFrame:
    """M1 (document path): the last payload per endpoint wins inside the
    batch; a known endpoint gets its success rate, rate limit, active flag
    and owner overwritten (customer kept); an unknown one is inserted with
    url type 'custom' and signature 'v1'.  Adds ``change``."""
    payload = F.struct(F.col("endpoint.avg_success_rate").alias("avg_success_rate"),
                       F.col("endpoint.rate_limit_per_minute").alias("rate_limit_per_minute"),
                       F.col("endpoint.active").alias("active"),
                       F.col("customer_id").alias("customer_id"),
                       F.col("user_id").alias("user_id"))
    latest = (docs.select(F.col("endpoint.endpoint_id").alias("endpoint_id"), payload.alias("p"),
                          order.alias("_ord"))
              .where(F.col("endpoint_id").isNotNull())  # no id, nothing to upsert
              .groupBy("endpoint_id").agg(F.max_by("p", "_ord").alias("p")))
    e = existing.withColumn("_stored", F.lit(True)).alias("e")
    j = e.join(latest.alias("n"), "endpoint_id", "full_outer")
    known, new = F.coalesce(F.col("e._stored"), F.lit(False)), F.col("p").isNotNull()
    pick = lambda field: F.when(new, F.col(f"p.{field}")).otherwise(F.col(f"e.{field}"))
    return j.select(
        "endpoint_id",
        F.when(known, F.col("e.customer_id")).otherwise(F.col("p.customer_id")).alias("customer_id"),
        F.coalesce(F.col("e.endpoint_url_type"), F.lit(S.NEW_ENDPOINT_URL_TYPE)).alias("endpoint_url_type"),
        F.coalesce(F.col("e.expected_signature_version"), F.lit(S.NEW_ENDPOINT_SIGNATURE_VERSION))
        .alias("expected_signature_version"),
        pick("avg_success_rate").alias("avg_success_rate"),
        pick("rate_limit_per_minute").alias("rate_limit_per_minute"),
        pick("active").alias("active"),
        pick("user_id").alias("user_id"),
        F.when(~known, "inserted").when(new, "updated").otherwise("unchanged").alias("change"))


def latest_payloads(docs: DataFrame, order: Column) -> DataFrame:
    """What M1 needs of some of an upload's documents: each endpoint's last one (by ``_ord``).  M1 on the rows of
    all parts of an upload gives what it gives on the whole upload."""
    last = F.max_by(F.struct("endpoint", "customer_id", "user_id", order.alias("_ord")), order)
    return (docs.where(F.col("endpoint.endpoint_id").isNotNull()).groupBy(F.col("endpoint.endpoint_id").alias("endpoint_id"))
            .agg(last.alias("_r")).select("_r.*"))


def endpoint_candidates(rows: DataFrame, uploader: Column) -> DataFrame:
    """What M2 needs of some of an upload's rows: each endpoint's first event, its customer and uploader.  M2 on
    the rows of all parts of an upload gives what it gives on the whole upload."""
    return _first_by(rows.where(F.col("endpoint_id").isNotNull()).withColumn("user_id", uploader), ["endpoint_id"], F.col("event_id"),
                     ["event_id", "customer_id", "user_id"])


def insert_endpoints_if_absent(existing: DataFrame, rows: DataFrame, uploader: Column) -> DataFrame:
    """M2 (CSV path): stored endpoints are never updated; an unknown one is
    added with rate 0.9, limit 100, active, and the customer of its first
    event in event-id order.  Returns stored + inserted, with ``inserted``."""
    new = (rows.where(F.col("endpoint_id").isNotNull())
           .groupBy("endpoint_id")
           .agg(F.min_by(F.struct("customer_id", uploader.alias("user_id")), F.col("event_id")).alias("f"))
           .join(existing.select("endpoint_id"), "endpoint_id", "left_anti")
           .select("endpoint_id", F.col("f.customer_id").alias("customer_id"),
                   F.lit(S.NEW_ENDPOINT_URL_TYPE).alias("endpoint_url_type"),
                   F.lit(S.NEW_ENDPOINT_SIGNATURE_VERSION).alias("expected_signature_version"),
                   F.lit(S.CSV_ENDPOINT_DEFAULTS["avg_success_rate"]).alias("avg_success_rate"),
                   F.lit(S.CSV_ENDPOINT_DEFAULTS["rate_limit_per_minute"]).alias("rate_limit_per_minute"),
                   F.lit(S.CSV_ENDPOINT_DEFAULTS["active"]).alias("active"),
                   F.col("f.user_id").alias("user_id"),
                   F.lit(True).alias("inserted")))
    cols = ["endpoint_id", "customer_id", "endpoint_url_type", "expected_signature_version",
            "avg_success_rate", "rate_limit_per_minute", "active", "user_id"]
    return existing.select(*cols, F.lit(False).alias("inserted")).unionByName(new)


def insert_events_if_absent(existing: DataFrame, rows: DataFrame, order: Column,
                            prune_by_batch: bool = True, load_ts: Column | None = None) -> DataFrame:
    """M3: a stored event is never changed; a new one takes type and
    customer from its first incoming row, payload 250.0, priority 'medium',
    an idempotency key derived from the id, the uploader as tenant, and
    ``load_ts`` (the ingest time) as creation time."""
    first = _first_by(rows.where(F.col("event_id").isNotNull()).withColumn("_ord", order), ["event_id"],
                      F.col("_ord"), ["event_type", "customer_id", "user_id"])
    stored_ids = existing.select("event_id")
    if prune_by_batch:  # a left anti join cannot broadcast its left side:
        # trim the stored ids to this batch's events first (see M4)
        stored_ids = stored_ids.join(first.select("event_id"), "event_id", "left_semi")
    new = (first.join(stored_ids, "event_id", "left_anti")
           .select("event_id", "event_type", "customer_id",
                   F.lit(None).cast("string").alias("invoice_id"),
                   F.lit(S.NEW_EVENT_PAYLOAD_KB).alias("payload_size_kb"),
                   F.concat(F.lit("idem_"), F.md5("event_id")).alias("idempotency_key"),
                   F.lit(S.NEW_EVENT_PRIORITY).alias("priority"),
                   "user_id",
                   (F.lit(None) if load_ts is None else load_ts).cast("timestamp_ntz").alias("created_at"),
                   F.lit(True).alias("inserted")))
    cols = [f.name for f in S.WEBHOOK_EVENTS.fields]
    return existing.select(*cols, F.lit(False).alias("inserted")).unionByName(new)


def insert_attempts_if_absent(existing: DataFrame, rows: DataFrame, order: Column,
                              mode: str = "strict", prune_by_batch: bool = True) -> DataFrame:
    """M4: attempts whose (event_id, attempt_number) is not stored yet (the
    original has no unique constraint, it looks the pair up); in-batch
    repeats follow M5's ``mode``.  Returns the rows to insert."""
    # only stored keys of events in this batch can match: a semi join on the
    # batch's event ids (broadcast by AQE when the batch is small) trims the
    # stored side in its scan stage, before anything is shuffled
    stored = existing.select("event_id", "attempt_number")
    if prune_by_batch:  # pays off when the batch is small next to the store
        batch_events = rows.select("event_id").where(F.col("event_id").isNotNull()).distinct()
        stored = stored.join(batch_events, "event_id", "left_semi")
    stored = stored.dropDuplicates()
    fresh = rows.join(stored, ["event_id", "attempt_number"], "left_anti")
    return dedupe_attempts_in_batch(fresh, order, mode)


def observed(metrics: Observation, name: str = "n") -> int:
    """An observed count.  Where the adaptive plan found the observed rows to
    be none it leaves the observation out, and an empty row comes back, which
    Spark's Python side answers with a failed assertion: the count is 0."""
    try:
        return metrics.get.get(name) or 0
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception.getClass()):
            raise
        return 0


def observed_report(rows: DataFrame, inserted: int, rejected: int) -> DataFrame:
    """M9: distinct events in the upload, events processed (rows with an
    id), rows rejected, attempts inserted, status.  The counts of rows are
    those observed while the merge wrote them; only the distinct events are
    counted here, from the staged rows."""
    return (rows.agg(F.count_distinct("event_id").alias("total_events"),
                     F.count_distinct(F.when(F.col("is_valid"), F.col("event_id"))).alias("events_processed"))
            .select(F.col("total_events").cast("bigint"), F.col("events_processed").cast("bigint"),
                    F.lit(rejected).cast("bigint").alias("rejected_rows"),
                    F.lit(inserted).cast("bigint").alias("attempts_inserted"), F.lit("complete").alias("status")))


def counted_report(spark: SparkSession, events: int, processed: int, rejected: int, inserted: int) -> DataFrame:
    """M9 from counts that the merge has made."""
    return spark.createDataFrame([(events, processed, rejected, inserted, "complete")],
                                 "total_events long, events_processed long, rejected_rows long, attempts_inserted long, status string")


def merge_with_report(rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(inserted rows, M9 report) of one merge: the upload's typed rows are
    computed once, and the merge's counts are observed while its result is
    written, so nothing is read again to be counted."""
    read, written = Observation(), Observation()
    typed = staged(rows.observe(read, F.count_if(~F.col("is_valid")).alias("rejected")), "typed")
    inserted = staged(merge(typed).observe(written, F.count(F.lit(1)).alias("n")), "inserted")
    return inserted, observed_report(typed, observed(written), observed(read, "rejected"))


def backfill_tenant(df: DataFrame, user_id: str = S.BACKFILL_USER) -> DataFrame:
    """Rows without a tenant get ``user_id``."""
    return df.withColumn("user_id", F.coalesce(F.col("user_id"), F.lit(user_id)))


# ---------------------------------------------------------------------------
# Q1-Q3: keys, foreign keys, duplicate events
# ---------------------------------------------------------------------------
# (table, key columns, primary): a primary key may not be null, a unique key may
KEYS = [
    ("users", ["user_id"], True),
    ("users", ["email"], False),
    ("webhook_events", ["event_id"], True),
    ("webhook_events", ["idempotency_key"], False),
    ("endpoints", ["endpoint_id"], True),
    ("delivery_attempts", ["attempt_id"], True),
    ("delivery_attempts", ["event_id", "attempt_number"], False),
    ("replay_actions", ["replay_id"], True),
]
NULL_KEY = "<null>"

FOREIGN_KEYS = [
    ("delivery_attempts", "event_id", "webhook_events", "event_id"),
    ("delivery_attempts", "endpoint_id", "endpoints", "endpoint_id"),
    ("delivery_attempts", "user_id", "users", "user_id"),
    ("replay_actions", "event_id", "webhook_events", "event_id"),
    ("replay_actions", "user_id", "users", "user_id"),
    ("webhook_events", "user_id", "users", "user_id"),
    ("endpoints", "user_id", "users", "user_id"),
]


def key_violations(t: Tables) -> DataFrame:
    """Q1: every key value held by more than one row, and nulls in a primary
    key.  Rows with a null in a unique key hold no key value."""
    d = t.as_dict()
    out = None
    for table, keys, primary in KEYS:
        null_key = F.lit(False)
        for k in keys:
            null_key = null_key | F.col(k).isNull()
        rows = d[table] if primary else d[table].where(~null_key)
        v = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
             .where((F.col("n_rows") > 1) | null_key)
             .select(F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
                     F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit(NULL_KEY)) for k in keys])
                     .alias("key_value"), "n_rows"))
        out = v if out is None else out.unionByName(v)
    return out


def fk_orphans(t: Tables) -> DataFrame:
    """Q2: child values (not null) with no parent row, with their row counts.
    Children and parents are counted together by value, so that a task holds
    one row for each value and needs no sorted copy of either side."""
    d = t.as_dict()
    out = None
    for child, col, parent, pcol in FOREIGN_KEYS:
        both = (d[child].where(F.col(col).isNotNull()).select(F.col(col).alias("fk_value"), F.lit(1).alias("child"), F.lit(None).cast("int").alias("parent"))
                .unionByName(d[parent].where(F.col(pcol).isNotNull()).select(F.col(pcol).alias("fk_value"), F.lit(None).cast("int").alias("child"), F.lit(1).alias("parent"))))
        v = (both.groupBy("fk_value").agg(F.count("child").alias("n_rows"), F.count("parent").alias("n_parents"))
             .where((F.col("n_parents") == 0) & (F.col("n_rows") > 0))
             .select(F.lit(child).alias("table_name"), F.lit(col).alias("column_name"), "fk_value", "n_rows"))
        out = v if out is None else out.unionByName(v)
    return out


def duplicate_events(events: DataFrame) -> DataFrame:
    """Q3: events sharing an idempotency key with at least one other, with
    the first event of the key and the delay to it in seconds."""
    # a null key is no key: such events are copies of nothing
    events = events.where(F.col("idempotency_key").isNotNull())
    first = (events.groupBy("idempotency_key")
             .agg(F.count(F.lit(1)).alias("group_size"),
                  F.min_by("event_id", F.struct("created_at", "event_id")).alias("first_event_id"),
                  F.min("created_at").alias("first_created_at"))
             .where(F.col("group_size") > 1))
    return (events.select("event_id", "idempotency_key", "created_at")
            .join(first, "idempotency_key")
            .select("event_id", "idempotency_key", "group_size", "first_event_id",
                    (F.col("event_id") == F.col("first_event_id")).alias("is_first"),
                    F.timestamp_diff("SECOND", F.col("first_created_at"), F.col("created_at"))
                    .alias("gap_seconds")))
