"""Listings, timelines, top-k and display views.

Paging and top-k use ``row_number() <= k`` / ``orderBy().limit(k)``: Spark
plans the first as a partial per-partition group limit before the shuffle
(so a tenant holding a third of all events still ships only k rows per map
task) and the second as a bounded take-ordered.  The limits are the
feature here (a page, a top-k report), never a way to skip rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import json_safe, round_to
from ..session import staged
from ..tables import Tables
from .features import first_endpoint


def event_lookup(events: DataFrame, requested_ids: DataFrame) -> DataFrame:
    """P1 in batch form: every requested id with its event, or not-found.

    ``requested_ids`` has one column ``event_id`` (repeats allowed; each
    distinct id is answered once).
    """
    req = requested_ids.select(F.col("event_id").alias("requested_id")).dropDuplicates()
    ev = events.select("event_id", "event_type", "created_at")
    return (req.join(ev, req["requested_id"] == ev["event_id"], "left")
            .select("requested_id", F.col("event_id").isNotNull().alias("found"),
                    "event_type", "created_at"))


def list_events(t: Tables, page: int = 1, limit: int = 10, user_id: str | None = None) -> DataFrame:
    """Each tenant's events, newest first (ties by event id), one page,
    with the time of day as shown (HH:mm), the endpoint of the event's first
    attempt and the UI badge."""
    lo, hi = (page - 1) * limit, page * limit
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("event_id"))
    paged = (P.tenant_events(t.events, user_id).select("user_id", "event_id", "event_type", "created_at")
             .withColumn("position", F.row_number().over(w).cast("bigint"))
             .where((F.col("position") > lo) & (F.col("position") <= hi)))
    # endpoint of the first attempt, only for the events on the page
    att = t.attempts.join(paged.select("event_id"), "event_id", "left_semi")
    return (paged.join(first_endpoint(att), "event_id", "left")
            .select("user_id", "position", "event_id", "event_type", "created_at",
                    F.date_format("created_at", "HH:mm").alias("shown_at"), "endpoint_id",
                    F.when(P.mentions_failed_cs(), "Failed").otherwise("OK").alias("badge")))


def event_timeline(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Every event's attempts as ordered timeline rows with the success
    flag and the display text; an event without attempts has one row without
    attempt fields.  ``ids`` (column event_id) asks for some events only.
    Rows, not a collected array: a globally sorted frame range-partitions a
    long timeline across tasks."""
    a = t.attempts.select("event_id", "attempt_id", "attempt_number", "http_status",
                          "response_time_ms", "timeout").withColumn("_attempt", F.lit(True))
    events = t.events.select("event_id", "event_type", "created_at")
    if ids is not None:
        wanted = ids.select("event_id").distinct()
        events, a = events.join(wanted, "event_id", "left_semi"), a.join(wanted, "event_id", "left_semi")
    detail = (F.when(F.col("_attempt").isNull(), F.lit(None).cast("string"))
              .when(F.coalesce(F.col("timeout"), F.lit(False)), F.lit("Connection timed out"))
              .when(F.col("response_time_ms").isNull(), F.lit("Response time unknown"))
              .otherwise(F.concat(F.lit("Response in "),
                                  F.round(F.col("response_time_ms")).cast("bigint").cast("string"),
                                  F.lit("ms"))))
    return (events.join(a, "event_id", "left")
            .select("event_id", "event_type", "created_at", "attempt_number", "attempt_id", "http_status",
                    "response_time_ms", "timeout", F.when(F.col("_attempt"), P.is_success()).alias("is_success"),
                    detail.alias("detail"))
            .orderBy("event_id", "attempt_number", "attempt_id"))


def timeline_pages(t: Tables, ids: DataFrame | None = None, page_size: int = 100) -> DataFrame:
    """J6 / E2 nested: each event with its attempts as sorted arrays, in pages
    of at most ``page_size``; an event without attempts has one empty page.

    No event is collected whole.  The flat timeline is range-partitioned by
    (event, attempt number, attempt id), so a long event lies in several
    partitions; its position in the event is its place in the partition plus
    the event's rows in the partitions before, which only the few events that
    cross a border have."""
    flat = event_timeline(t, ids)
    dealt = (flat.repartitionByRange("event_id", "attempt_number", "attempt_id")
             .withColumn("_part", F.spark_partition_id()))
    flat = staged(dealt, "timeline")  # the partition number is a stored column from here on
    counts = flat.groupBy("event_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # an event in one partition has no rows before; a window over an event's partitions, not over its rows
    before = Window.partitionBy("event_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .where(F.col("_before") > 0).select("event_id", "_part", "_before"))
    inside = Window.partitionBy("event_id", "_part").orderBy(F.asc_nulls_first("attempt_number"), F.asc_nulls_first("attempt_id"))
    placed = (flat.withColumn("_row", F.row_number().over(inside)).join(starts, ["event_id", "_part"], "left")
              .withColumn("_at", F.col("_row") + F.coalesce("_before", F.lit(0)) - 1)
              .withColumn("page", F.floor(F.col("_at") / page_size).cast("int")))
    attempt = F.struct("attempt_number", "attempt_id", "http_status", "response_time_ms", "timeout", "is_success", "detail")
    has = F.col("is_success").isNotNull()
    return (placed.groupBy("event_id", "page")
            .agg(F.first("event_type").alias("event_type"), F.first("created_at").alias("created_at"),
                 F.sort_array(F.collect_list(F.when(has, F.struct("_at", attempt.alias("a"))))).alias("_rows"))
            .select("event_id", "event_type", "created_at", "page", F.size("_rows").cast("bigint").alias("n_attempts"),
                    F.transform("_rows", lambda r: r["a"]).alias("attempts")))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """First k rows by ``order`` with a 1-based rank (take-ordered, bounded)."""
    top = df.orderBy(*order).limit(k)
    w = Window.orderBy(*order)  # over at most k rows
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_unstable(instability: DataFrame, k: int = 5) -> DataFrame:
    """The k most unstable endpoints (ties by endpoint id)."""
    return top_k(instability, k, F.desc("failure_rate"), F.asc_nulls_last("endpoint_id"))


def first_attempt_patterns(patterns: DataFrame, k: int = 4) -> DataFrame:
    """The retry pattern of the first k attempt numbers."""
    return top_k(patterns, k, F.asc("attempt_number"))


def instability_view(instability: DataFrame) -> DataFrame:
    """Failure percent (1 dp), latency (0 dp), red above 50% else amber."""
    return json_safe(instability).select(
        "endpoint_id", "timeout_count",
        round_to(F.col("failure_rate") * 100.0, 1).alias("fail_pct"),
        round_to("avg_response_time", 0).alias("latency_ms"),
        F.when(F.col("failure_rate") > 0.5, "red").otherwise("amber").alias("band"))


def retry_view(patterns: DataFrame) -> DataFrame:
    """Success percent (1 dp) with green > 70 > amber > 30 > red."""
    s = F.col("success_rate_percent")
    return json_safe(patterns).select(
        "attempt_number", "count",
        round_to(s, 1).alias("success_pct"),
        round_to("avg_response_time", 0).alias("latency_ms"),
        F.when(s > 70, "green").when(s > 30, "amber").otherwise("red").alias("band"))


def endpoint_view(tenant_eps: DataFrame) -> DataFrame:
    """Endpoint cards: health band (> 90 green, > 70 amber) and a
    failures flag."""
    h = F.col("health_score")
    return tenant_eps.select(
        "user_id", "endpoint_id", "total_requests", "failed_requests", "health_score",
        F.when(h > 90, "green").when(h > 70, "amber").otherwise("red").alias("band"),
        (F.col("failed_requests") > 0).alias("has_failures"))


def replay_view(freq: DataFrame) -> DataFrame:
    """Replay cards; a null or empty result shows as 'Unknown'."""
    return json_safe(freq).select(
        F.coalesce(F.nullif(F.col("replay_result"), F.lit("")), F.lit("Unknown")).alias("label"),
        "count", "duplicates_detected")


def system_status(overview: DataFrame) -> DataFrame:
    """Header status (> 80 stable) and anomaly flag per tenant."""
    return overview.select(
        "user_id", "health_score",
        F.when(F.col("health_score") > 80, "System Stable").otherwise("Degraded Performance").alias("status"),
        (F.col("active_anomalies") > 0).alias("anomalies_flagged"))


def ingest_summary(t: Tables, instability: DataFrame, patterns: DataFrame,
                   k_unstable: int = 3, k_retry: int = 4, scope: str = "all") -> DataFrame:
    """The ingest summary as rows (user_id, email, section, label, value)
    for every tenant with an email: its own event and attempt counts, then
    the top unstable endpoints and the first retry patterns.

    ``scope="all"`` ranks all tenants together, as the original report does;
    those rows are emitted once, with no tenant.  ``scope="tenant"`` ranks
    each tenant's own attempts (``instability``/``patterns`` unused), with a
    per-tenant top-k that Spark limits per map task before the shuffle.
    """
    contacts = (t.users.where(F.col("email").isNotNull() & (F.trim("email") != ""))
                .select("user_id", "email"))
    ev = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    att = (t.attempts.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
           .join(t.events.select("event_id", "user_id"), "event_id")
           .groupBy("user_id").agg(F.sum("n").alias("n_attempts")))
    counts = (contacts.join(ev, "user_id", "left").join(att, "user_id", "left")
              .select("user_id", "email", F.explode(F.array(
                  F.struct(F.lit("ingest").alias("section"), F.lit("unique_events").alias("label"),
                           F.coalesce("n_events", F.lit(0)).cast("double").alias("value")),
                  F.struct(F.lit("ingest").alias("section"), F.lit("attempts_stored").alias("label"),
                           F.coalesce("n_attempts", F.lit(0)).cast("double").alias("value")))).alias("r"))
              .select("user_id", "email", "r.*"))
    if scope == "tenant":
        return counts.unionByName(_tenant_rankings(t, contacts, k_unstable, k_retry))
    if scope != "all":
        raise ValueError(f"unknown scope {scope!r}")
    unstable = top_unstable(instability, k_unstable).select(
        F.lit("unstable_endpoints").alias("section"), F.col("endpoint_id").alias("label"),
        round_to(F.col("failure_rate") * 100.0, 4).alias("value"))
    retry = first_attempt_patterns(patterns, k_retry).select(
        F.lit("retry_effectiveness").alias("section"),
        F.concat(F.lit("attempt #"), F.col("attempt_number").cast("string")).alias("label"),
        round_to("success_rate_percent", 4).alias("value"))
    # the rankings are global: emitted once, with no tenant, not per contact
    ranked = unstable.unionByName(retry).select(
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("email"),
        "section", "label", "value")
    return counts.unionByName(ranked)


def _tenant_rankings(t: Tables, contacts: DataFrame, k_unstable: int, k_retry: int) -> DataFrame:
    owned = t.attempts.join(t.events.select("event_id", F.col("user_id").alias("owner")), "event_id")
    per_ep = (owned.groupBy("owner", "endpoint_id")
              .agg(F.count("attempt_id").alias("n"), P.count_if(P.is_delivery_failure()).alias("f"))
              .where(F.col("n") > 5)
              .withColumn("failure_rate", F.col("f").cast("double") / F.col("n").cast("double")))
    w1 = Window.partitionBy("owner").orderBy(F.desc("failure_rate"), F.asc_nulls_last("endpoint_id"))
    unstable = (per_ep.withColumn("rk", F.row_number().over(w1)).where(F.col("rk") <= k_unstable)
                .select("owner", F.lit("unstable_endpoints").alias("section"), F.col("endpoint_id").alias("label"),
                        round_to(F.col("failure_rate") * 100.0, 4).alias("value")))
    per_n = (owned.groupBy("owner", "attempt_number")
             .agg(F.count("attempt_id").alias("n"), P.count_if(P.is_success()).alias("ok")))
    w2 = Window.partitionBy("owner").orderBy("attempt_number")
    retry = (per_n.withColumn("rk", F.row_number().over(w2)).where(F.col("rk") <= k_retry)
             .select("owner", F.lit("retry_effectiveness").alias("section"),
                     F.concat(F.lit("attempt #"), F.col("attempt_number").cast("string")).alias("label"),
                     round_to(F.col("ok").cast("double") * 100.0 / F.col("n").cast("double"), 4).alias("value")))
    return (contacts.join(unstable.unionByName(retry), contacts["user_id"] == F.col("owner"))
            .select("user_id", "email", "section", "label", "value"))
