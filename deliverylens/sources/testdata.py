"""Domain tables derived from the driver's TPC-H-style parquet files.

The driver data has no webhook tables, so both the Spark jobs and the SQL
oracle build them from the same column expressions.  The expressions are
kept once, as portable SQL text: Spark applies them with ``selectExpr`` (so
Catalyst prunes the scan to the few source columns they touch) and the
oracle wraps them into a ``WITH`` prefix.

Ids are zero-padded with ``printf`` (pads, never truncates, unlike
``lpad``), so keys stay unique at any scale factor.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables

# Stored-versus-incoming split for the ingest jobs: rows before this instant
# are "already stored"; the incoming batch is every document (all rows), so
# the two overlap and the merge jobs do real work on whole tables.
STORED_BEFORE = "1998-06-01"

_Q = "cast(floor(l_quantity) as int) % 10"

ENDPOINTS_EXPRS = [
    "concat('ep_', printf('%06d', s_suppkey)) AS endpoint_id",
    "concat('cust_', printf('%06d', s_nationkey)) AS customer_id",
    "case s_suppkey % 4 when 0 then 'production' when 1 then 'staging' "
    "when 2 then 'sandbox' else 'internal' end AS endpoint_url_type",
    "concat('v', cast(s_suppkey % 3 + 1 as string)) AS expected_signature_version",
    "floor(greatest(0.15, least(0.999, s_acctbal / 10000)) * 1000) / cast(1000 as double) AS avg_success_rate",
    "case s_suppkey % 5 when 0 then 30 when 1 then 60 when 2 then 100 when 3 then 200 else 500 end "
    "AS rate_limit_per_minute",
    "s_suppkey % 12 <> 0 AS active",
    "concat('user_', cast(s_suppkey % 10 as string)) AS user_id",
]

EVENTS_EXPRS = [
    "concat('evt_', printf('%08d', o_orderkey)) AS event_id",
    "case o_orderkey % 6 when 0 then 'invoice.created' when 1 then 'invoice.validated' "
    "when 2 then 'invoice.rejected' when 3 then 'invoice.paid' when 4 then 'compliance.submitted' "
    "else 'compliance.failed' end AS event_type",
    "concat('cust_', printf('%06d', o_custkey)) AS customer_id",
    "concat('inv_', cast(o_orderkey as string)) AS invoice_id",
    "o_totalprice / 1000 AS payload_size_kb",
    "concat('idem_', cast(o_custkey as string), '_', cast(o_orderkey % 40 as string)) AS idempotency_key",
    "case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' "
    "when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' end AS priority",
    "concat('user_', cast(o_custkey % 10 as string)) AS user_id",
    "o_orderdate AS created_at",
]

ATTEMPTS_EXPRS = [
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string)) AS attempt_id",
    "concat('evt_', printf('%08d', l_orderkey)) AS event_id",
    "concat('ep_', printf('%06d', l_suppkey)) AS endpoint_id",
    "l_linenumber AS attempt_number",
    f"case when {_Q} < 5 then (case when l_tax < 0.04 then 200 else 201 end) "
    f"when {_Q} = 5 then 401 when {_Q} = 6 then 429 when {_Q} = 7 then 500 "
    f"when {_Q} = 8 then 504 end AS http_status",
    "case when l_tax = 0.08 then null else l_extendedprice / 10 end AS response_time_ms",
    f"{_Q} >= 8 and l_returnflag <> 'N' AS timeout",
    f"{_Q} <> 5 AS signature_valid",
    # legacy rows (returnflag N) carry no tenant of their own
    "case when l_returnflag = 'N' then null else concat('user_', cast(l_suppkey % 10 as string)) end AS user_id",
    "l_shipdate AS attempted_at",
]

REPLAYS_EXPRS = [
    "concat('rep_', printf('%08d', event_id)) AS replay_id",
    "concat('evt_', printf('%08d', cast(floor(event_id / 3) as bigint))) AS event_id",
    "case event_type when 'view' then 'success' when 'click' then 'failed' when 'signup' then 'recovered' "
    "when 'purchase' then 'duplicate_processed' when 'error' then 'unsafe' end AS replay_result",
    "event_type = 'purchase' and value > 10 AS duplicate_detected",
    "user_id % 2 = 1 AS manually_triggered",
    # one tenant in eleven is not in the users table: orphans for the foreign-key check
    "concat('user_', cast(user_id % 11 as string)) AS user_id",
    "ts AS replayed_at",
]

USERS_EXPRS = [
    "concat('user_', cast(c_custkey % 10 as string)) AS user_id",
    "concat('User ', cast(c_custkey % 10 as string)) AS name",
    "concat('user', cast(c_custkey % 10 as string), '@example.com') AS email",
]

SOURCES = {
    "endpoints": ("supplier", ENDPOINTS_EXPRS),
    "webhook_events": ("orders", EVENTS_EXPRS),
    "delivery_attempts": ("lineitem", ATTEMPTS_EXPRS),
    "replay_actions": ("events", REPLAYS_EXPRS),
    "users": ("customer", USERS_EXPRS),
}


def domain_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    src, exprs = SOURCES[table]
    df = spark.read.parquet(os.path.join(sf_dir, f"{src}.parquet")).selectExpr(*exprs)
    if table == "users":
        # one row per tenant: a grouped distinct (partial aggregation first)
        df = df.dropDuplicates(["user_id", "name", "email"])
    return df


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The five domain tables as lazy DataFrames over the parquet scans."""
    t = {name: domain_table(spark, sf_dir, name) for name in SOURCES}
    return Tables(
        users=t["users"],
        events=t["webhook_events"],
        endpoints=t["endpoints"],
        attempts=t["delivery_attempts"],
        replays=t["replay_actions"],
    )


def sql_prefix(tables: list[str] | None = None) -> str:
    """``WITH`` clause defining the domain tables for the DuckDB oracle."""
    names = tables or list(SOURCES)
    parts = []
    for name in names:
        src, exprs = SOURCES[name]
        body = f"SELECT {', '.join(exprs)} FROM {src}"
        if name == "users":
            body = f"SELECT DISTINCT * FROM ({body}) u"
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts)
