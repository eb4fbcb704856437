"""Decision rules (D1-D9) as native ``when`` chains.

The per-event answer of the scoring service becomes a batch job over all
events.  Per-event facts that need the event's attempts in order (first
failure, first attempt outcome, last attempt) are partial-aggregating
``min``/``max`` over structs, never a collected list: an event with a huge
number of attempts is still reduced map-side before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import predicates as P
from ..functions.scalars import bround_to
from ..functions.stats import exact_quantile_value


def failure_reason(timeout_ratio="timeout_ratio", error_ratio="error_ratio",
                   health="endpoint_health_score") -> Column:
    """Timeout > error > endpoint offline (health < 0.7) > unknown; a
    missing health gives unknown."""
    tr, er, h = (F.col(c) if isinstance(c, str) else c for c in (timeout_ratio, error_ratio, health))
    return (F.when(tr > 0, "timeout")
            .when(er > 0, "server_error")
            .when(h < 0.7, "endpoint_offline")
            .otherwise("unknown"))


def recommended_action(is_anomaly="is_anomaly", is_safe="safe_to_replay",
                       health="endpoint_health_score") -> Column:
    """Anomaly blocks; safe replays; weak endpoint (< 0.8) is monitored;
    else manual review."""
    a, s, h = (F.col(c) if isinstance(c, str) else c for c in (is_anomaly, is_safe, health))
    return (F.when(a, "block_source_anomaly_detected")
            .when(s, "trigger_auto_replay")
            .when(h < 0.8, "monitor_endpoint_health")
            .otherwise("manual_review_required"))


def delivery_state(is_safe="safe_to_replay") -> Column:
    """D3: safe -> recovered, else failed."""
    s = F.col(is_safe) if isinstance(is_safe, str) else is_safe
    return F.when(s, "recovered").otherwise("failed")


def apply_rules(scored: DataFrame) -> DataFrame:
    """D1-D3 + rounded metrics over rows carrying ``safe_to_replay`` and
    ``is_anomaly`` (from the models, or from the rule inputs of D5)."""
    return scored.select(
        "event_id",
        delivery_state().alias("delivery_state"),
        failure_reason().alias("failure_reason"),
        F.col("safe_to_replay"),
        F.col("is_anomaly"),
        recommended_action().alias("recommended_action"),
        bround_to("endpoint_health_score", 2).alias("endpoint_health"),
        bround_to("timeout_ratio", 2).alias("timeout_ratio"),
        F.lit(False).alias("is_fallback"),
    )


def intelligence_rules(fpe: DataFrame, anomaly_quantile: float = 0.95) -> DataFrame:
    """The rule half of event intelligence with transparent inputs:
    safe := recovered, anomaly := max response time above its exact
    ``anomaly_quantile`` over all events (a scalar subquery, no join)."""
    th = exact_quantile_value(fpe, "max_response_time", anomaly_quantile)
    scored = (fpe.withColumn("safe_to_replay", F.col("is_recovered") == 1)
              .withColumn("is_anomaly", F.coalesce(F.col("max_response_time") > th.scalar(), F.lit(False))))
    return apply_rules(scored)


def replay_gate(decisions: DataFrame) -> DataFrame:
    """The replay panel's labels, score and button state."""
    safe = F.col("safe_to_replay")
    return decisions.select(
        "event_id",
        F.when(safe, "Safe to Replay").otherwise("High Risk Event").alias("safety_label"),
        F.when(safe, 95).otherwise(15).alias("safety_score"),
        F.when(safe, "Execute Replay").otherwise("Replay Blocked").alias("replay_button"),
        F.when(F.col("is_anomaly"), "Detected").otherwise("Normal Traffic").alias("anomaly_label"),
    )


def response_category(status="http_status", timeout="timeout") -> Column:
    """HTTP status / timeout -> response category (inverse of the status
    map); anything unmapped is 'other'."""
    s = F.col(status) if isinstance(status, str) else status
    t = F.col(timeout) if isinstance(timeout, str) else timeout
    expr = F.when(F.coalesce(t, F.lit(False)), F.lit("timeout"))
    for cat, codes in S.HTTP_STATUS_MAP.items():
        expr = expr.when(s.isin(codes), F.lit(cat))
    return expr.otherwise(F.lit("other"))


def with_response_category(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("response_category", response_category())


def duplicate_flags(events: DataFrame) -> DataFrame:
    """Per event: is it a later copy of an event with the same idempotency
    key?  A grouped min_by + join back (the hot key is partially aggregated;
    the join back is split by AQE's skew handling)."""
    # null keys are no keys: they stay out of the grouping and match nothing in the join
    first = (events.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key")
             .agg(F.min_by("event_id", F.struct("created_at", "event_id")).alias("first_event_id"),
                  F.count(F.lit(1)).alias("group_size"),
                  F.min("created_at").alias("first_created_at")))
    return (events.select("event_id", "idempotency_key", "created_at")
            .join(first, "idempotency_key", "left")
            .withColumn("is_duplicate", F.coalesce(
                (F.col("group_size") > 1) & (F.col("event_id") != F.col("first_event_id")), F.lit(False))))


def label_delivery_outcome(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """Delivery state, failure reason, replay safety and action per
    event, from its attempts in (attempt_number, attempt_id) order.

    The state of an event without attempts is 'retrying' (its delivery is
    still due).  Otherwise it follows the last attempt: a success is 'delivered' when it was
    the only attempt and 'recovered' after earlier ones; a failing last
    attempt is 'expired' when every attempt found no endpoint, else
    'failed'; a later copy of an idempotency key is 'duplicate'.  Reason and
    action come from the first failing attempt's category."""
    a = with_response_category(attempts)
    order = F.struct("attempt_number", "attempt_id")
    cat = F.col("response_category")
    per = (a.groupBy("event_id")
           .agg(F.count(F.lit(1)).alias("n_attempts"),
                # ties on (attempt_number, attempt_id) count a success as later
                F.max_by((cat == "success").cast("int"),
                         F.struct("attempt_number", "attempt_id", (cat == "success").cast("int")))
                .alias("last_success"),
                F.min(F.when(cat != "success", F.struct("attempt_number", "attempt_id", "response_category")))
                .alias("first_fail"),
                F.min((cat == "endpoint_not_found").cast("int")).alias("all_not_found")))
    dup = duplicate_flags(events).select("event_id", "is_duplicate")
    df = per.join(dup, "event_id", "full_outer")
    fc = F.col("first_fail.response_category")
    state = (F.when(F.coalesce("is_duplicate", F.lit(False)), "duplicate")
             .when((F.col("last_success") == 1) & (F.col("n_attempts") == 1), "delivered")
             .when(F.col("n_attempts").isNull(), "retrying")
             .when(F.col("last_success") == 1, "recovered")
             .when(F.col("all_not_found") == 1, "expired")
             .otherwise("failed"))
    df = df.withColumn("delivery_state", state)
    st = F.col("delivery_state")
    reason = (F.when(st == "duplicate", "duplicate_event")
              .when(st == "delivered", "none")
              .when(fc == "timeout", F.when(st == "recovered", "none").otherwise("timeout"))
              .when(fc == "server_error", "customer_endpoint_down")
              .when(fc == "invalid_signature", "invalid_signature")
              .when(fc == "rate_limited", "rate_limited")
              .when(fc == "payload_too_large", "payload_too_large")
              .when(fc == "endpoint_not_found", "endpoint_deleted")
              .when(fc == "malformed_response", "malformed_response")
              .otherwise("none"))
    action = (F.when(st == "duplicate", "avoid_replay")
              .when(st == "delivered", "none")
              .when(fc == "timeout", "monitor_endpoint")
              .when(fc == "server_error", F.when(st == "recovered", "retry_later").otherwise("investigate_endpoint"))
              .when(fc == "invalid_signature", "rotate_signature")
              .when(fc == "rate_limited", "exponential_backoff")
              .when(fc == "payload_too_large", "reduce_payload")
              .when(fc == "endpoint_not_found", "contact_customer")
              .when(fc == "malformed_response", "inspect_endpoint")
              .otherwise("none"))
    safe = ((st == "delivered")
            | ((st == "failed") & F.coalesce(fc.isin("payload_too_large", "server_error"), F.lit(False))))
    return df.select("event_id", "delivery_state", reason.alias("failure_reason"),
                     safe.alias("safe_to_replay"), action.alias("recommended_action"))


def retry_scheduled(attempts: DataFrame) -> DataFrame:
    """An attempt schedules a retry when it did not succeed and is not
    its event's last attempt.  The event's last attempt number comes from a
    grouped max joined back (not a window over the whole event)."""
    last = attempts.groupBy("event_id").agg(F.max("attempt_number").alias("last_attempt"))
    return (attempts.select("attempt_id", "event_id", "attempt_number", "http_status")
            .join(last, "event_id")
            .select("attempt_id", "event_id", "attempt_number",
                    ((~P.is_success()) & (F.col("attempt_number") != F.col("last_attempt")))
                    .alias("retry_scheduled")))
