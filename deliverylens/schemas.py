"""Table schemas and fixed domain values.

The domain tables are: users, webhook_events, endpoints, delivery_attempts
and replay_actions.  Spark does not enforce keys; key and foreign-key facts
are checked by the data-quality jobs in ``operators.ingest``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; natural order)
# ---------------------------------------------------------------------------
PRIORITIES = ["low", "medium", "high", "critical"]
# response category -> HTTP status codes
HTTP_STATUS_MAP = {
    "success": [200, 201],
    "invalid_signature": [401, 403],
    "endpoint_not_found": [404],
    "rate_limited": [429],
    "server_error": [500, 502, 503],
    "timeout": [504],
    "payload_too_large": [413],
    "malformed_response": [520],
}
# Columns an uploaded attempts CSV must carry, in the order they are checked.
REQUIRED_CSV_COLUMNS = [
    "event_id",
    "event_type",
    "customer_id",
    "endpoint_id",
    "attempt_number",
    "http_status",
    "response_time_ms",
    "timeout",
    "signature_valid",
]

# Defaults written by the ingest paths.
CSV_ENDPOINT_DEFAULTS = {"avg_success_rate": 0.9, "rate_limit_per_minute": 100, "active": True}
NEW_ENDPOINT_URL_TYPE = "custom"
NEW_ENDPOINT_SIGNATURE_VERSION = "v1"
NEW_EVENT_PAYLOAD_KB = 250.0
NEW_EVENT_PRIORITY = "medium"
CSV_NULL_STATUS = 500
CSV_NULL_RESPONSE_MS = 1000.0
BACKFILL_USER = "user_1"

# Constant answer for an event that has no feature row.
FALLBACK_INTELLIGENCE = {
    "delivery_state": "failed",
    "failure_reason": "timeout",
    "safe_to_replay": True,
    "is_anomaly": False,
    "recommended_action": "trigger_auto_replay",
    "endpoint_health": 0.85,
    "timeout_ratio": 0.1,
}

# Leak/id columns the recovery model never sees.
MODEL_ID_COLUMNS = ["event_id", "event_type", "endpoint_id", "is_recovered"]
MODEL_LEAK_COLUMNS = [
    "total_attempts",
    "timeout_count",
    "server_error_count",
    "client_error_count",
    "success_count",
    "duplicate_count",
    "replay_count",
]

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
])

WEBHOOK_EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("invoice_id", T.StringType()),
    T.StructField("payload_size_kb", T.DoubleType()),
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ENDPOINTS = T.StructType([
    T.StructField("endpoint_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("endpoint_url_type", T.StringType()),
    T.StructField("expected_signature_version", T.StringType()),
    T.StructField("avg_success_rate", T.DoubleType()),
    T.StructField("rate_limit_per_minute", T.IntegerType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("user_id", T.StringType()),
])

DELIVERY_ATTEMPTS = T.StructType([
    T.StructField("attempt_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("endpoint_id", T.StringType()),
    T.StructField("attempt_number", T.IntegerType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("timeout", T.BooleanType()),
    T.StructField("signature_valid", T.BooleanType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("attempted_at", T.TimestampNTZType()),
])

# What the bulk files hold besides.
BULK_ENDPOINTS = T.StructType(ENDPOINTS.fields + [T.StructField("last_config_change_at", T.TimestampNTZType())])
BULK_DELIVERY_ATTEMPTS = T.StructType(DELIVERY_ATTEMPTS.fields + [
    T.StructField("response_body_category", T.StringType()),
    T.StructField("retry_scheduled", T.BooleanType()),
])

REPLAY_ACTIONS = T.StructType([
    T.StructField("replay_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("replay_result", T.StringType()),
    T.StructField("duplicate_detected", T.BooleanType()),
    T.StructField("manually_triggered", T.BooleanType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("replayed_at", T.TimestampNTZType()),
])

# Upload rows and documents that were not taken, with the reason and their text.
REJECTS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("rejected_at", T.TimestampNTZType()),
])

# Raw delivery-log document (one upload request).  ``attempt_id`` is an
# optional client id we accept in addition; it fixes input order and makes
# re-delivery of the same document idempotent.
RAW_ENDPOINT = T.StructType([
    T.StructField("endpoint_id", T.StringType()),
    T.StructField("avg_success_rate", T.DoubleType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("rate_limit_per_minute", T.IntegerType()),
])
RAW_ATTEMPT = T.StructType([
    T.StructField("attempt_number", T.IntegerType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("timeout", T.BooleanType()),
    T.StructField("signature_valid", T.BooleanType()),
    T.StructField("attempted_at", T.StringType()),
    T.StructField("attempt_id", T.StringType()),
])
RAW_REPLAY_HISTORY = T.StructType([
    T.StructField("previous_replays", T.IntegerType()),
    T.StructField("duplicate_detected", T.BooleanType()),
    T.StructField("manually_triggered", T.BooleanType()),
])
RAW_LOG = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("endpoint", RAW_ENDPOINT),
    T.StructField("delivery_attempts", T.ArrayType(RAW_ATTEMPT)),
    T.StructField("replay_history", RAW_REPLAY_HISTORY),
    T.StructField("user_id", T.StringType()),
])

# Flat CSV: every column read as text, typed afterwards (no inference).
RAW_CSV = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_CSV_COLUMNS])
