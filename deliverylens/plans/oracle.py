"""SQL twins of the registered queries, for the DuckDB oracle.

Each string starts with the domain-table ``WITH`` prefix (built from the
same expressions the Spark side uses) and then states the job in plain SQL,
written independently of the DataFrame code.  Conventions that make both
engines agree bit for bit: sums of flags cast to BIGINT; averages rounded as
``round(x * 10^4) / 10^4``; integer truncation by ``trunc`` before the cast.
"""

from __future__ import annotations

from ..sources.testdata import STORED_BEFORE, sql_prefix

PRE = sql_prefix()


def avgx(x: str) -> str:
    return f"(cast(sum(cast({x} as decimal(38,6))) as double) / nullif(cast(count({x}) as double), 0))"


def sid(prefix: str, *keys: str) -> str:
    """Key-derived id: md5 over each key written as length:text, '~' for null."""
    parts = " || ".join(f"coalesce(cast(length({k}) as varchar) || ':' || {k}, '~')" for k in keys)
    return f"concat('{prefix}_', md5({parts}))"


def r4(x: str) -> str:
    return f"round(({x}) * 10000.0) / cast(10000 as double)"


# --- shared CTE fragments ---------------------------------------------------
FAIL500 = "(coalesce(http_status >= 500 OR timeout, false))"
FAIL400 = "(coalesce(http_status >= 400, false))"
SUCCESS = "(coalesce(http_status >= 200 AND http_status < 300, false))"


def cnt(pred: str) -> str:
    return f"cast(sum(case when {pred} then 1 else 0 end) as bigint)"


FEATURE_CTES = f"""
att AS (
  SELECT event_id, count(attempt_id) AS total_attempts,
         {cnt('coalesce(timeout, false)')} AS timeout_count,
         {cnt('coalesce(http_status >= 500, false)')} AS server_error_count,
         {cnt('coalesce(http_status >= 400 AND http_status < 500, false)')} AS client_error_count,
         {cnt(SUCCESS)} AS success_count,
         {r4(avgx('response_time_ms'))} AS avg_response_time,
         max(response_time_ms) AS max_response_time
  FROM delivery_attempts GROUP BY event_id),
rep AS (
  SELECT event_id, count(replay_id) AS replay_count,
         {cnt('coalesce(duplicate_detected, false)')} AS duplicate_count
  FROM replay_actions GROUP BY event_id),
base_pairs AS (
  SELECT e.event_id, e.event_type, e.priority, e.payload_size_kb, ep.endpoint_id,
         ep.avg_success_rate AS endpoint_health_score, ep.rate_limit_per_minute
  FROM webhook_events e
  LEFT JOIN delivery_attempts da ON e.event_id = da.event_id
  LEFT JOIN endpoints ep ON da.endpoint_id = ep.endpoint_id
  GROUP BY e.event_id, e.event_type, e.priority, e.payload_size_kb, ep.endpoint_id,
           ep.avg_success_rate, ep.rate_limit_per_minute),
first_att AS (
  SELECT event_id, endpoint_id FROM (
    SELECT event_id, endpoint_id,
           row_number() OVER (PARTITION BY event_id ORDER BY attempt_number, attempt_id) AS rn
    FROM delivery_attempts) WHERE rn = 1),
base_event AS (
  SELECT e.event_id, e.event_type, e.priority, e.payload_size_kb, ep.endpoint_id,
         ep.avg_success_rate AS endpoint_health_score, ep.rate_limit_per_minute
  FROM webhook_events e
  LEFT JOIN first_att f ON e.event_id = f.event_id
  LEFT JOIN endpoints ep ON f.endpoint_id = ep.endpoint_id)"""


def derived(base: str) -> str:
    return f"""
  SELECT b.event_id, b.event_type, b.payload_size_kb, b.endpoint_id, b.endpoint_health_score,
         b.rate_limit_per_minute, a.total_attempts, a.timeout_count, a.server_error_count,
         a.client_error_count, a.success_count,
         coalesce(a.avg_response_time, 0.0) AS avg_response_time,
         coalesce(a.max_response_time, 0.0) AS max_response_time,
         cast(coalesce(r.replay_count, 0) as bigint) AS replay_count,
         cast(coalesce(r.duplicate_count, 0) as bigint) AS duplicate_count,
         case when a.total_attempts is null then null
              else cast(greatest(a.total_attempts - 1, 0) as bigint) end AS retry_count,
         coalesce(cast(a.timeout_count as double) / nullif(cast(a.total_attempts as double), 0), 0.0) AS timeout_ratio,
         coalesce(cast(a.server_error_count + a.client_error_count as double)
                  / nullif(cast(a.total_attempts as double), 0), 0.0) AS error_ratio,
         coalesce(cast(a.success_count > 0 as integer), 0) AS is_recovered,
         coalesce(b.priority = 'critical', false) AS priority_critical,
         coalesce(b.priority = 'high', false) AS priority_high,
         coalesce(b.priority = 'low', false) AS priority_low,
         coalesce(b.priority = 'medium', false) AS priority_medium
  FROM {base} b LEFT JOIN att a ON b.event_id = a.event_id
  LEFT JOIN rep r ON b.event_id = r.event_id"""


FEATURES_WITH = f"""{FEATURE_CTES},
features AS ({derived('base_pairs')}),
fpe AS ({derived('base_event')})"""


def q(body: str, ctes: str = "") -> str:
    """Full statement: domain prefix, optional extra CTEs, then the body."""
    extra = f",\n{ctes.strip().lstrip(',')}" if ctes.strip() else ""
    return f"{PRE}{extra}\n{body}"


SQL: dict[str, str] = {}

SQL["load_tables"] = q("""
SELECT 'users' AS table_name, count(*) AS n_rows FROM users
UNION ALL SELECT 'webhook_events', count(*) FROM webhook_events
UNION ALL SELECT 'endpoints', count(*) FROM endpoints
UNION ALL SELECT 'delivery_attempts', count(*) FROM delivery_attempts
UNION ALL SELECT 'replay_actions', count(*) FROM replay_actions""")

SQL["sketch_bounds"] = q("""
SELECT user_id, count(DISTINCT event_id) AS exact_count, count(response_time_ms) AS n_values,
       true AS count_ok, true AS q25_ok, true AS q50_ok, true AS q75_ok
FROM delivery_attempts WHERE user_id IS NOT NULL GROUP BY user_id""")

SQL["endpoint_instability"] = q(f"""
SELECT endpoint_id, count(attempt_id) AS total_attempts,
       {cnt(FAIL500)} AS failure_count,
       {cnt('coalesce(timeout, false)')} AS timeout_count,
       {r4(avgx('response_time_ms'))} AS avg_response_time,
       cast({cnt(FAIL500)} as double) / cast(count(attempt_id) as double) AS failure_rate,
       cast({cnt('coalesce(timeout, false)')} as double) / cast(count(attempt_id) as double) AS timeout_rate
FROM delivery_attempts GROUP BY endpoint_id HAVING count(attempt_id) > 5""")

SQL["retry_patterns"] = q(f"""
SELECT attempt_number, count(attempt_id) AS count,
       {r4(avgx('response_time_ms'))} AS avg_response_time,
       cast({cnt(SUCCESS)} as double) * 100.0 / cast(count(attempt_id) as double) AS success_rate_percent
FROM delivery_attempts GROUP BY attempt_number""")

SQL["replay_frequency"] = q(f"""
SELECT replay_result, count(replay_id) AS count,
       {cnt('coalesce(duplicate_detected, false)')} AS duplicates_detected
FROM replay_actions GROUP BY replay_result""")

TENANT_HEALTH = ("case when {t} > 0 then cast(trunc((1.0 - cast({f} as double) / cast({t} as double)) * 100.0) "
                 "as integer) else 100 end")

SQL["tenant_overview"] = q(f"""
SELECT u.user_id,
       {TENANT_HEALTH.format(t='coalesce(a.total, 0)', f='coalesce(a.failed, 0)')} AS health_score,
       cast(coalesce(ev.n_events, 0) * 3 as bigint) AS replays_prevented,
       cast(least(coalesce(ev.n_failed_type, 0), 15) as bigint) AS active_anomalies
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n_events,
                  {cnt("event_type ILIKE '%failed%'")} AS n_failed_type
           FROM webhook_events GROUP BY user_id) ev ON u.user_id = ev.user_id
LEFT JOIN (SELECT e.user_id, count(*) AS total, {cnt(FAIL400)} AS failed
           FROM delivery_attempts da JOIN webhook_events e ON da.event_id = e.event_id
           GROUP BY e.user_id) a ON u.user_id = a.user_id""")

SQL["tenant_endpoints"] = q(f"""
SELECT e.user_id, da.endpoint_id, count(da.attempt_id) AS total_requests,
       {cnt(FAIL400)} AS failed_requests,
       {TENANT_HEALTH.format(t='count(da.attempt_id)', f=cnt(FAIL400))} AS health_score
FROM delivery_attempts da JOIN webhook_events e ON da.event_id = e.event_id
WHERE da.endpoint_id IS NOT NULL
GROUP BY e.user_id, da.endpoint_id""")

SQL["tenant_event_counts"] = q("""
SELECT user_id, count(*) AS total, cast(10 as bigint) AS page_limit,
       cast((count(*) + 10 - 1) // 10 as bigint) AS total_pages
FROM webhook_events GROUP BY user_id""")

SQL["distinct_events"] = q("SELECT count(DISTINCT event_id) AS distinct_events FROM delivery_attempts")

SQL["event_base"] = q("SELECT * FROM base_pairs", FEATURE_CTES)

SQL["attempt_features"] = q("SELECT * FROM att", FEATURE_CTES)

SQL["replay_features"] = q("SELECT * FROM rep", FEATURE_CTES)

SQL["event_features"] = q("SELECT * FROM features", FEATURES_WITH)

SQL["features_per_event"] = q("SELECT * FROM fpe", FEATURES_WITH)

SQL["one_hot_priority"] = q("""
SELECT event_id, coalesce(priority = 'critical', false) AS priority_critical,
       coalesce(priority = 'high', false) AS priority_high,
       coalesce(priority = 'low', false) AS priority_low,
       coalesce(priority = 'medium', false) AS priority_medium
FROM webhook_events""")

SQL["class_balance"] = q(f"""
SELECT is_recovered, count(*) AS count,
       {r4('cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double)')} AS share_pct
FROM features GROUP BY is_recovered""", FEATURES_WITH)

_FEATURE_COLS = ["event_id", "event_type", "payload_size_kb", "endpoint_id", "endpoint_health_score",
                 "rate_limit_per_minute", "total_attempts", "timeout_count", "server_error_count",
                 "client_error_count", "success_count", "avg_response_time", "max_response_time",
                 "replay_count", "duplicate_count", "retry_count", "timeout_ratio", "error_ratio",
                 "is_recovered", "priority_critical", "priority_high", "priority_low", "priority_medium"]

SQL["null_counts"] = q("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, cast(count(*) - count({c}) as bigint) AS null_count FROM features"
    for c in _FEATURE_COLS), FEATURES_WITH)

_DESC = ["retry_count", "timeout_ratio", "avg_response_time", "endpoint_health_score"]
SQL["describe_features"] = q("\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, {r4(f'avg({c})')} AS mean,
       {r4(f'stddev_samp({c})')} AS std, {r4(f'min({c})')} AS min,
       {r4(f'quantile_cont({c}, 0.25)')} AS q25, {r4(f'quantile_cont({c}, 0.5)')} AS q50,
       {r4(f'quantile_cont({c}, 0.75)')} AS q75, {r4(f'max({c})')} AS max
FROM features""" for c in _DESC), FEATURES_WITH)

EVENT_SPLIT = """,
event_split AS (
  SELECT event_id, case when row_number() OVER (ORDER BY substr(md5(event_id), 1, 12))
                             <= count(*) OVER () - floor(count(*) OVER () * cast(0.8 as double))
                        then 'test' else 'train' end AS split
  FROM webhook_events)"""

LABEL_SPLIT = FEATURES_WITH + """,
label_hash AS (SELECT *, substr(md5(concat('label:', event_id)), 1, 12) AS lh FROM features),
label_cut AS (
  SELECT is_recovered, max(lh) AS cut FROM (
    SELECT is_recovered, lh, row_number() OVER (PARTITION BY is_recovered ORDER BY lh) AS rn,
           count(*) OVER (PARTITION BY is_recovered) AS n FROM label_hash)
  WHERE rn <= floor(n * cast(0.2 as double) + 0.5) GROUP BY is_recovered),
split_rows AS (
  SELECT f.*, case when f.lh <= c.cut then 'test' else 'train' end AS split
  FROM label_hash f LEFT JOIN label_cut c ON f.is_recovered = c.is_recovered)"""

SQL["stratified_split"] = q("SELECT event_id, endpoint_id, is_recovered, split FROM split_rows", LABEL_SPLIT)

SQL["shuffle_split"] = q("SELECT event_id, split FROM event_split", EVENT_SPLIT)

SQL["class_weight"] = q(f"""
SELECT {cnt('is_recovered = 0')} AS n_negative, {cnt('is_recovered = 1')} AS n_positive,
       cast({cnt('is_recovered = 0')} as double) / nullif(cast({cnt('is_recovered = 1')} as double), 0)
         AS scale_pos_weight
FROM split_rows WHERE split = 'train'""", LABEL_SPLIT)

SQL["select_model_columns"] = q("""
SELECT event_id, endpoint_id, is_recovered, payload_size_kb, endpoint_health_score, rate_limit_per_minute,
       avg_response_time, max_response_time, retry_count, timeout_ratio, error_ratio,
       cast(priority_critical as integer) AS priority_critical, cast(priority_high as integer) AS priority_high,
       cast(priority_low as integer) AS priority_low, cast(priority_medium as integer) AS priority_medium
FROM features""", FEATURES_WITH)

__all__ = ["SQL", "STORED_BEFORE", "FEATURES_WITH", "FEATURE_CTES", "q", "cnt", "r4"]

# ---------------------------------------------------------------------------
# decisions
# ---------------------------------------------------------------------------
def b2(x: str) -> str:
    return f"round_even(({x}) * 100.0, 0) / cast(100 as double)"


RULES_CTES = FEATURES_WITH + f""",
th AS (SELECT quantile_cont(max_response_time, 0.95) AS q FROM fpe),
scored AS (
  SELECT fpe.*, is_recovered = 1 AS safe_to_replay,
         coalesce(max_response_time > (SELECT q FROM th), false) AS is_anomaly FROM fpe),
rules AS (
  SELECT event_id,
         case when safe_to_replay then 'recovered' else 'failed' end AS delivery_state,
         case when timeout_ratio > 0 then 'timeout' when error_ratio > 0 then 'server_error'
              when endpoint_health_score < 0.7 then 'endpoint_offline' else 'unknown' end AS failure_reason,
         safe_to_replay, is_anomaly,
         case when is_anomaly then 'block_source_anomaly_detected'
              when safe_to_replay then 'trigger_auto_replay'
              when endpoint_health_score < 0.8 then 'monitor_endpoint_health'
              else 'manual_review_required' end AS recommended_action,
         {b2('endpoint_health_score')} AS endpoint_health,
         {b2('timeout_ratio')} AS timeout_ratio,
         false AS is_fallback
  FROM scored)"""

SQL["intelligence_rules"] = q("SELECT * FROM rules", RULES_CTES)
SQL["failure_reason"] = q("SELECT event_id, failure_reason FROM rules", RULES_CTES)
SQL["recommended_action"] = q("SELECT event_id, recommended_action FROM rules", RULES_CTES)
SQL["delivery_state"] = q("SELECT event_id, delivery_state FROM rules", RULES_CTES)
SQL["replay_gate"] = q("""
SELECT event_id,
       case when safe_to_replay then 'Safe to Replay' else 'High Risk Event' end AS safety_label,
       case when safe_to_replay then 95 else 15 end AS safety_score,
       case when safe_to_replay then 'Execute Replay' else 'Replay Blocked' end AS replay_button,
       case when is_anomaly then 'Detected' else 'Normal Traffic' end AS anomaly_label
FROM rules""", RULES_CTES)

CATEGORY = """case when coalesce(timeout, false) then 'timeout'
     when http_status IN (200, 201) then 'success'
     when http_status IN (401, 403) then 'invalid_signature'
     when http_status = 404 then 'endpoint_not_found'
     when http_status = 429 then 'rate_limited'
     when http_status IN (500, 502, 503) then 'server_error'
     when http_status = 504 then 'timeout'
     when http_status = 413 then 'payload_too_large'
     when http_status = 520 then 'malformed_response'
     else 'other' end"""

SQL["response_category"] = q(f"""
SELECT attempt_id, http_status, timeout, {CATEGORY} AS response_category FROM delivery_attempts""")

OUTCOME_CTES = f"""
cat AS (SELECT attempt_id, event_id, attempt_number, {CATEGORY} AS response_category FROM delivery_attempts),
ordered AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempt_number DESC, attempt_id DESC,
                                           response_category = 'success' DESC) AS rl
            FROM cat),
first_fail AS (
  SELECT event_id, response_category AS fc FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempt_number, attempt_id, response_category) AS r2
    FROM cat WHERE response_category <> 'success') WHERE r2 = 1),
per AS (
  SELECT event_id, count(*) AS n_attempts,
         max(case when rl = 1 and response_category = 'success' then 1 else 0 end) AS last_success,
         min(case when response_category = 'endpoint_not_found' then 1 else 0 end) AS all_not_found
  FROM ordered GROUP BY event_id),
dup AS (
  SELECT event_id,
         count(*) OVER (PARTITION BY idempotency_key) > 1
         AND event_id <> first_value(event_id) OVER (PARTITION BY idempotency_key ORDER BY created_at, event_id)
         AS is_duplicate
  FROM webhook_events),
st AS (
  SELECT coalesce(p.event_id, d.event_id) AS event_id, f.fc,
         case when coalesce(d.is_duplicate, false) then 'duplicate'
              when p.event_id IS NULL then 'retrying'
              when p.last_success = 1 and p.n_attempts = 1 then 'delivered'
              when p.last_success = 1 then 'recovered'
              when p.all_not_found = 1 then 'expired'
              else 'failed' end AS delivery_state
  FROM per p FULL JOIN dup d ON p.event_id = d.event_id LEFT JOIN first_fail f ON p.event_id = f.event_id),
outcome AS (
  SELECT event_id, delivery_state,
         case when delivery_state = 'duplicate' then 'duplicate_event'
              when delivery_state = 'delivered' then 'none'
              when fc = 'timeout' then (case when delivery_state = 'recovered' then 'none' else 'timeout' end)
              when fc = 'server_error' then 'customer_endpoint_down'
              when fc = 'invalid_signature' then 'invalid_signature'
              when fc = 'rate_limited' then 'rate_limited'
              when fc = 'payload_too_large' then 'payload_too_large'
              when fc = 'endpoint_not_found' then 'endpoint_deleted'
              when fc = 'malformed_response' then 'malformed_response'
              else 'none' end AS failure_reason,
         (delivery_state = 'delivered'
          OR (delivery_state = 'failed' AND coalesce(fc IN ('payload_too_large', 'server_error'), false)))
           AS safe_to_replay,
         case when delivery_state = 'duplicate' then 'avoid_replay'
              when delivery_state = 'delivered' then 'none'
              when fc = 'timeout' then 'monitor_endpoint'
              when fc = 'server_error' then
                   (case when delivery_state = 'recovered' then 'retry_later' else 'investigate_endpoint' end)
              when fc = 'invalid_signature' then 'rotate_signature'
              when fc = 'rate_limited' then 'exponential_backoff'
              when fc = 'payload_too_large' then 'reduce_payload'
              when fc = 'endpoint_not_found' then 'contact_customer'
              when fc = 'malformed_response' then 'inspect_endpoint'
              else 'none' end AS recommended_action
  FROM st)"""

SQL["label_delivery_outcome"] = q("SELECT * FROM outcome", OUTCOME_CTES)

SQL["labels_for_split"] = q("""
SELECT o.* FROM outcome o JOIN event_split e ON o.event_id = e.event_id WHERE e.split = 'train'""", OUTCOME_CTES + EVENT_SPLIT)

SQL["retry_scheduled"] = q(f"""
SELECT attempt_id, event_id, attempt_number,
       (NOT {SUCCESS}) AND attempt_number <> max(attempt_number) OVER (PARTITION BY event_id) AS retry_scheduled
FROM delivery_attempts""")

SQL["classification_report"] = q(f"""
SELECT label, {r4('precision')} AS precision, {r4('recall')} AS recall, {r4('f1_score')} AS f1_score, support
FROM (
  SELECT cast(c as varchar) AS label, precision, recall, f1_score, support FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, cast(sum(tp) as double) / cast(sum(support) as double),
                   cast(sum(support) as bigint) FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), cast(sum(support) as bigint) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), cast(sum(support) as bigint) FROM m) x""", LABEL_SPLIT + f""",
test AS (SELECT is_recovered AS y, coalesce(cast(endpoint_health_score >= 0.7 as integer), 0) AS p
         FROM split_rows WHERE split = 'test'),
conf AS (SELECT y, p, count(*) AS n FROM test GROUP BY y, p),
cls AS (SELECT y AS c FROM conf UNION SELECT p FROM conf),
pc AS (
  SELECT c,
         cast(coalesce((SELECT sum(n) FROM conf WHERE y = c), 0) as bigint) AS support,
         cast(coalesce((SELECT sum(n) FROM conf WHERE y = c AND p = c), 0) as bigint) AS tp,
         cast(coalesce((SELECT sum(n) FROM conf WHERE p = c), 0) as bigint) AS pred_n
  FROM cls),
pr AS (
  SELECT c, support, tp,
         coalesce(cast(tp as double) / nullif(cast(pred_n as double), 0), 0.0) AS precision,
         coalesce(cast(tp as double) / nullif(cast(support as double), 0), 0.0) AS recall
  FROM pc),
m AS (
  SELECT c, support, tp, precision, recall,
         coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score
  FROM pr)""")

# ---------------------------------------------------------------------------
# views
# ---------------------------------------------------------------------------
SQL["event_lookup"] = q("""
SELECT r.requested_id, e.event_id IS NOT NULL AS found, e.event_type, e.created_at
FROM (SELECT DISTINCT event_id AS requested_id FROM
        (SELECT event_id FROM replay_actions UNION ALL SELECT event_id FROM delivery_attempts)) r
LEFT JOIN webhook_events e ON r.requested_id = e.event_id""")

SQL["list_events"] = q("""
SELECT p.user_id, p.position, p.event_id, p.event_type, p.created_at, strftime(p.created_at, '%H:%M') AS shown_at, f.endpoint_id,
       case when contains(p.event_type, 'failed') then 'Failed' else 'OK' end AS badge
FROM (SELECT user_id, event_id, event_type, created_at,
             row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id) AS position
      FROM webhook_events) p
LEFT JOIN first_att f ON p.event_id = f.event_id
WHERE p.position > 0 AND p.position <= 5""", FEATURE_CTES)

SQL["event_timeline"] = q(f"""
SELECT e.event_id, e.event_type, e.created_at, da.attempt_number, da.attempt_id, da.http_status,
       da.response_time_ms, da.timeout, case when da.event_id IS NOT NULL then {SUCCESS} end AS is_success,
       case when da.event_id IS NULL then NULL when coalesce(da.timeout, false) then 'Connection timed out'
            when da.response_time_ms IS NULL then 'Response time unknown'
            else concat('Response in ', cast(cast(round(da.response_time_ms) as bigint) as varchar), 'ms') end
         AS detail
FROM webhook_events e LEFT JOIN delivery_attempts da ON e.event_id = da.event_id""")

SQL["timeline_pages"] = q("""
SELECT event_id, event_type, cast(floor(place / 2) AS integer) AS page, count(is_success) AS n_attempts,
       coalesce(string_agg(concat_ws(':', cast(attempt_number AS varchar), attempt_id, detail), '|' ORDER BY place)
                FILTER (WHERE is_success IS NOT NULL), '') AS attempts
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempt_number, attempt_id) - 1 AS place FROM timeline)
GROUP BY 1, 2, 3""", f"timeline AS ({SQL['event_timeline'].split(PRE, 1)[1]})")

INSTABILITY_CTE = f"""
inst AS ({SQL['endpoint_instability'].split(PRE, 1)[1]}),
pat AS ({SQL['retry_patterns'].split(PRE, 1)[1]})"""

SQL["top_unstable"] = q("""
SELECT *, row_number() OVER (ORDER BY failure_rate DESC, endpoint_id) AS rank
FROM (SELECT * FROM inst ORDER BY failure_rate DESC, endpoint_id LIMIT 5) t""", INSTABILITY_CTE)

SQL["first_attempt_patterns"] = q("""
SELECT *, row_number() OVER (ORDER BY attempt_number) AS rank
FROM (SELECT * FROM pat ORDER BY attempt_number LIMIT 4) t""", INSTABILITY_CTE)


def rd(x: str, d: int) -> str:
    return f"round(({x}) * {float(10 ** d)!r}) / cast({10 ** d} as double)"


SQL["instability_view"] = q(f"""
SELECT endpoint_id, timeout_count, {rd('failure_rate * 100.0', 1)} AS fail_pct,
       {rd('avg_response_time', 0)} AS latency_ms,
       case when failure_rate > 0.5 then 'red' else 'amber' end AS band
FROM inst""", INSTABILITY_CTE)

SQL["retry_view"] = q(f"""
SELECT attempt_number, count, {rd('success_rate_percent', 1)} AS success_pct,
       {rd('avg_response_time', 0)} AS latency_ms,
       case when success_rate_percent > 70 then 'green' when success_rate_percent > 30 then 'amber'
            else 'red' end AS band
FROM pat""", INSTABILITY_CTE)

SQL["endpoint_view"] = q(f"""
SELECT user_id, endpoint_id, total_requests, failed_requests, health_score,
       case when health_score > 90 then 'green' when health_score > 70 then 'amber' else 'red' end AS band,
       failed_requests > 0 AS has_failures
FROM ({SQL['tenant_endpoints'].split(PRE, 1)[1]}) t""")

SQL["replay_view"] = q(f"""
SELECT coalesce(nullif(replay_result, ''), 'Unknown') AS label, count, duplicates_detected
FROM ({SQL['replay_frequency'].split(PRE, 1)[1]}) t""")

SQL["system_status"] = q(f"""
SELECT user_id, health_score,
       case when health_score > 80 then 'System Stable' else 'Degraded Performance' end AS status,
       active_anomalies > 0 AS anomalies_flagged
FROM ({SQL['tenant_overview'].split(PRE, 1)[1]}) t""")

SQL["ingest_summary"] = q(f"""
SELECT c.user_id, c.email, 'ingest' AS section, 'unique_events' AS label,
       cast(coalesce(ev.n, 0) as double) AS value
FROM contacts c LEFT JOIN (SELECT user_id, count(*) AS n FROM webhook_events GROUP BY user_id) ev
  ON c.user_id = ev.user_id
UNION ALL
SELECT c.user_id, c.email, 'ingest', 'attempts_stored', cast(coalesce(a.n, 0) as double)
FROM contacts c LEFT JOIN (SELECT e.user_id, count(*) AS n FROM delivery_attempts da
                           JOIN webhook_events e ON da.event_id = e.event_id GROUP BY e.user_id) a
  ON c.user_id = a.user_id
UNION ALL
SELECT NULL, NULL, 'unstable_endpoints', endpoint_id, {r4('failure_rate * 100.0')}
FROM (SELECT * FROM inst ORDER BY failure_rate DESC, endpoint_id LIMIT 3) t
UNION ALL
SELECT NULL, NULL, 'retry_effectiveness', concat('attempt #', cast(attempt_number as varchar)),
       {r4('success_rate_percent')}
FROM (SELECT * FROM pat ORDER BY attempt_number LIMIT 4) t""", INSTABILITY_CTE + """,
contacts AS (SELECT user_id, email FROM users WHERE email IS NOT NULL AND trim(email) <> '')""")

SQL["endpoint_health_hourly"] = q(f"""
SELECT date_trunc('hour', attempted_at) AS window_start, endpoint_id, count(attempt_id) AS total_attempts,
       {cnt(FAIL500)} AS failure_count, {cnt('coalesce(timeout, false)')} AS timeout_count,
       {r4(avgx('response_time_ms'))} AS avg_response_time
FROM delivery_attempts WHERE attempted_at IS NOT NULL GROUP BY 1, 2""")

SQL["stream_endpoint_health"] = q(f"""
SELECT date_trunc('hour', attempted_at) AS window_start, endpoint_id, count(attempt_id) AS total_attempts,
       {cnt(FAIL500)} AS failure_count, {cnt('coalesce(timeout, false)')} AS timeout_count,
       {r4(avgx('response_time_ms'))} AS avg_response_time
FROM delivery_attempts WHERE attempted_at IS NOT NULL GROUP BY 1, 2
HAVING date_trunc('hour', attempted_at) + INTERVAL 1 HOUR
       <= (SELECT max(attempted_at) - INTERVAL 2 HOUR FROM delivery_attempts)""")

SQL["stream_dedupe_attempts"] = q("""
SELECT event_id, attempt_number, cast(1 AS bigint) AS kept FROM delivery_attempts GROUP BY 1, 2""")

BURST_CTES = f"""
retries AS (
  SELECT *, {FAIL500} AS failed,
         coalesce(attempted_at - lag(attempted_at) OVER (PARTITION BY endpoint_id ORDER BY attempted_at) <= INTERVAL 2 DAY, false) AS goes_on
  FROM delivery_attempts WHERE attempt_number > 1 AND attempted_at IS NOT NULL AND endpoint_id IS NOT NULL),
runs AS (
  SELECT *, sum(case when goes_on then 0 else 1 end) OVER (PARTITION BY endpoint_id ORDER BY attempted_at) AS run FROM retries),
bursts AS (
  SELECT endpoint_id, min(attempted_at) AS first_retry, max(attempted_at) AS last_retry, count(*) AS retries,
         {cnt('failed')} AS failures, max(attempt_number) AS max_attempt_number
  FROM runs GROUP BY endpoint_id, run HAVING count(*) >= 3)"""

SQL["retry_bursts"] = q("SELECT * FROM bursts", BURST_CTES)

SQL["stream_retry_bursts"] = q("""
SELECT * FROM bursts
WHERE last_retry + INTERVAL 2 DAY <= (SELECT max(attempted_at) - INTERVAL 2 HOUR FROM retries)""", BURST_CTES)

SPIKE_CTES = """
days AS (
  SELECT user_id, date_trunc('day', replayed_at) AS day, count(*) AS replays
  FROM replay_actions WHERE replayed_at IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2),
running AS (
  SELECT *, count(*) OVER w AS earlier_days, cast(coalesce(sum(replays) OVER w, 0) AS bigint) AS earlier_replays
  FROM days WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spikes AS (
  SELECT user_id, day, replays, earlier_days, earlier_replays FROM running
  WHERE earlier_days >= 3 AND 100 * replays * earlier_days >= 120 * earlier_replays)"""

SQL["replay_spikes"] = q("SELECT * FROM spikes", SPIKE_CTES)

SQL["stream_replay_spikes"] = q("""
SELECT * FROM spikes
WHERE day + INTERVAL 1 DAY <= (SELECT max(replayed_at) - INTERVAL 2 HOUR FROM replay_actions
                               WHERE user_id IS NOT NULL)""", SPIKE_CTES)

# ---------------------------------------------------------------------------
# ingest
# ---------------------------------------------------------------------------
CUT = f"TIMESTAMP '{STORED_BEFORE} 00:00:00'"

CSV_CTES = f"""
csv_rows AS (
  SELECT da.event_id, e.event_type, e.customer_id, da.endpoint_id,
         cast(da.attempt_number as varchar) AS attempt_number,
         cast(cast(da.http_status as double) as varchar) AS http_status,
         cast(da.response_time_ms as varchar) AS response_time_ms,
         case when da.timeout then 'True' else 'false' end AS timeout,
         cast(da.signature_valid as varchar) AS signature_valid,
         da.attempted_at, da.attempt_id, e.user_id AS uploader
  FROM delivery_attempts da LEFT JOIN webhook_events e ON da.event_id = e.event_id),
coerced AS (
  SELECT event_id, event_type, customer_id, endpoint_id,
         cast(trunc(try_cast(attempt_number as double)) as integer) AS attempt_number,
         coalesce(cast(trunc(try_cast(http_status as double)) as integer), 500) AS http_status,
         coalesce(try_cast(response_time_ms as double), 1000.0) AS response_time_ms,
         coalesce(lower(timeout) = 'true', false) AS timeout,
         coalesce(lower(signature_valid) = 'true', false) AS signature_valid,
         (try_cast(attempt_number as double) IS NOT NULL AND event_id IS NOT NULL) AS is_valid,
         attempted_at, attempt_id, uploader
  FROM csv_rows),
first_rows AS (
  SELECT event_id, endpoint_id AS f_endpoint_id, event_type AS f_event_type, customer_id AS f_customer_id
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempted_at, attempt_id) AS rn
        FROM coerced WHERE event_id IS NOT NULL) WHERE rn = 1),
m6 AS (
  SELECT c.attempt_id, c.event_id, c.attempt_number, f.f_endpoint_id AS endpoint_id,
         f.f_event_type AS event_type, f.f_customer_id AS customer_id, c.http_status, c.response_time_ms,
         c.timeout, c.signature_valid, c.is_valid, c.attempted_at, c.uploader
  FROM coerced c JOIN first_rows f ON c.event_id = f.event_id),
stored_att AS (SELECT * FROM delivery_attempts WHERE attempted_at < {CUT}),
stored_ev AS (SELECT * FROM webhook_events WHERE created_at < {CUT}),
stored_eps AS (SELECT * FROM endpoints WHERE endpoint_id IN (SELECT endpoint_id FROM stored_att)),
m4 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, attempt_number ORDER BY attempted_at, attempt_id, http_status, response_time_ms, timeout, signature_valid) AS rn
    FROM m6 WHERE NOT EXISTS (SELECT 1 FROM stored_att s
                              WHERE s.event_id = m6.event_id AND s.attempt_number = m6.attempt_number))
  WHERE rn = 1)"""

SQL["coerce_attempts"] = q("SELECT * FROM coerced", CSV_CTES)

SQL["first_row_per_event"] = q("""
SELECT attempt_id, event_id, attempt_number, endpoint_id, event_type, customer_id FROM m6""", CSV_CTES)

SQL["dedupe_attempts_in_batch"] = q("""
SELECT attempt_id, event_id, endpoint_id, attempt_number, http_status, response_time_ms, timeout, signature_valid
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, attempt_number ORDER BY attempted_at, attempt_id, http_status, response_time_ms, timeout, signature_valid) AS rn
      FROM m6) WHERE rn = 1""", CSV_CTES)

SQL["insert_endpoints_if_absent"] = q("""
SELECT endpoint_id, customer_id, endpoint_url_type, expected_signature_version, avg_success_rate,
       rate_limit_per_minute, active, user_id, false AS inserted FROM stored_eps
UNION ALL
SELECT endpoint_id, arg_min(customer_id, event_id), 'custom', 'v1', 0.9, 100, true, arg_min(uploader, event_id), true
FROM m6 WHERE endpoint_id IS NOT NULL AND endpoint_id NOT IN (SELECT endpoint_id FROM stored_eps)
GROUP BY endpoint_id""", CSV_CTES)

SQL["insert_events_if_absent"] = q("""
SELECT event_id, event_type, customer_id, invoice_id, payload_size_kb, idempotency_key, priority, user_id,
       created_at, false AS inserted FROM stored_ev
UNION ALL
SELECT f.event_id, f.event_type, f.customer_id, NULL, 250.0, concat('idem_', md5(f.event_id)),
       'medium', f.uploader, NULL, true
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempted_at, attempt_id) AS rn
                     FROM coerced WHERE event_id IS NOT NULL) WHERE rn = 1) f
WHERE f.event_id NOT IN (SELECT event_id FROM stored_ev)""", CSV_CTES)

SQL["insert_attempts_if_absent"] = q("""
SELECT attempt_id, event_id, endpoint_id, attempt_number, http_status, response_time_ms, timeout, signature_valid,
       uploader AS user_id FROM m4""", CSV_CTES)

SQL["ingest_report"] = q("""
SELECT cast(count(DISTINCT event_id) as bigint) AS total_events,
       cast(count(DISTINCT case when is_valid then event_id end) as bigint) AS events_processed,
       cast(coalesce(sum(case when NOT is_valid then 1 else 0 end), 0) as bigint) AS rejected_rows,
       cast((SELECT count(*) FROM m4) as bigint) AS attempts_inserted,
       'complete' AS status
FROM coerced""", CSV_CTES)

SQL["backfill_tenant"] = q("SELECT attempt_id, coalesce(user_id, 'user_1') AS user_id FROM delivery_attempts")

SQL["with_surrogate_id"] = q(f"""
SELECT attempt_id,
       {sid('att', 'event_id', 'cast(attempt_number as varchar)', 'attempt_id')} AS surrogate_id
FROM delivery_attempts""")

_DOC_ORDER = ("attempt_number NULLS FIRST, attempt_id NULLS FIRST, attempted_at NULLS FIRST, http_status NULLS FIRST, "
              "response_int NULLS FIRST, timeout NULLS FIRST, signature_valid NULLS FIRST, endpoint_id NULLS FIRST")
_DOC = "PARTITION BY event_id, chunk"
DOC_CTES = f"""
raw_entries AS (
  SELECT event_id, endpoint_id, attempt_number, attempt_id, attempted_at, http_status, timeout, signature_valid,
         cast(trunc(response_time_ms) as integer) AS response_int,
         cast(floor((attempt_number - 1) / cast(4 as double)) as integer) AS chunk
  FROM delivery_attempts),
entries AS (
  SELECT *, row_number() OVER ({_DOC} ORDER BY {_DOC_ORDER}) AS pos, count(*) OVER ({_DOC}) AS n_attempts,
         max(chunk) OVER (PARTITION BY event_id) AS last_chunk
  FROM raw_entries),
faults AS (
  SELECT event_id, chunk, bool_or(attempt_number IS NULL) AS no_number, bool_or(http_status IS NULL) AS no_status,
         bool_or(response_int IS NULL) AS no_time, bool_or(timeout IS NULL) AS no_timeout,
         bool_or(signature_valid IS NULL) AS no_signature, bool_or(attempted_at IS NULL) AS no_at,
         max(case when pos = n_attempts then http_status end) AS last_status,
         string_agg(concat_ws(':', coalesce(cast(attempt_number as varchar), '-'), coalesce(cast(http_status as varchar), '-'),
                              coalesce(cast(response_int as varchar), '-'), coalesce(cast(timeout as varchar), '-'),
                              coalesce(cast(signature_valid as varchar), '-'), coalesce(cast(attempted_at as varchar), '-'),
                              coalesce(attempt_id, '-')), ',' ORDER BY pos) AS attempts
  FROM entries GROUP BY event_id, chunk),
hist AS (
  SELECT event_id, cast(count(*) as integer) AS previous_replays,
         bool_or(duplicate_detected) AS duplicate_detected, bool_or(manually_triggered) AS manually_triggered
  FROM replay_actions GROUP BY event_id),
docs AS (
  SELECT a.event_id, a.chunk, e.event_type, e.customer_id, e.user_id,
         ep.endpoint_id AS ep_endpoint_id, ep.avg_success_rate, ep.active, ep.rate_limit_per_minute,
         cast(a.n_attempts as integer) AS n_attempts, f.attempts, f.last_status, a.attempt_id,
         cast(a.attempted_at as varchar) AS attempted_at,
         h.previous_replays, h.duplicate_detected, h.manually_triggered,
         case when a.event_id IS NULL then 'missing:event_id'
              when e.event_type IS NULL then 'missing:event_type'
              when e.customer_id IS NULL then 'missing:customer_id'
              when ep.avg_success_rate IS NULL then 'missing:endpoint'
              when ep.endpoint_id IS NULL then 'missing:endpoint.endpoint_id'
              when ep.active IS NULL then 'missing:endpoint.active'
              when ep.rate_limit_per_minute IS NULL then 'missing:endpoint.rate_limit_per_minute'
              when f.no_number then 'missing:delivery_attempts.attempt_number'
              when f.no_status then 'missing:delivery_attempts.http_status'
              when f.no_time then 'missing:delivery_attempts.response_time_ms'
              when f.no_timeout then 'missing:delivery_attempts.timeout'
              when f.no_signature then 'missing:delivery_attempts.signature_valid'
              when f.no_at then 'missing:delivery_attempts.attempted_at'
              end AS reject_reason
  FROM entries a JOIN faults f ON a.event_id = f.event_id AND a.chunk = f.chunk
  LEFT JOIN webhook_events e ON a.event_id = e.event_id
  LEFT JOIN endpoints ep ON a.endpoint_id = ep.endpoint_id
  LEFT JOIN hist h ON a.event_id = h.event_id AND a.chunk = a.last_chunk
  WHERE a.pos = 1),
valid_docs AS (SELECT * FROM docs WHERE reject_reason IS NULL),
doc_attempts AS (
  SELECT a.attempt_id, a.event_id, d.ep_endpoint_id AS endpoint_id, a.attempt_number, a.http_status,
         cast(a.response_int as double) AS response_time_ms, a.timeout, a.signature_valid, d.user_id,
         a.attempted_at, cast(a.pos - 1 as integer) AS doc_pos
  FROM entries a JOIN valid_docs d ON a.event_id = d.event_id AND a.chunk = d.chunk),
doc_replays AS (
  SELECT {sid('rep', 'd.event_id', 'cast(g.i as varchar)')} AS replay_id,
         d.event_id, case when d.last_status >= 400 then 'failed' else 'success' end AS replay_result,
         coalesce(d.duplicate_detected, false) AS duplicate_detected,
         coalesce(d.manually_triggered, false) AS manually_triggered, d.user_id
  FROM valid_docs d CROSS JOIN LATERAL generate_series(1, d.previous_replays) AS g(i)
  WHERE d.previous_replays > 0)"""

SQL["read_logs_json"] = q("""
SELECT event_id, event_type, customer_id, user_id, case when avg_success_rate IS NOT NULL then ep_endpoint_id end
       AS endpoint_id, avg_success_rate, active, rate_limit_per_minute, n_attempts, attempts, previous_replays,
       duplicate_detected, manually_triggered
FROM docs""", DOC_CTES)

SQL["validate_logs"] = q("SELECT event_id, attempt_id, reject_reason FROM docs", DOC_CTES)

SQL["explode_attempts"] = q("SELECT * FROM doc_attempts", DOC_CTES)

SQL["expand_replays"] = q("SELECT * FROM doc_replays", DOC_CTES)

SQL["ingest_csv_store"] = q(f"""
SELECT {sid('att', 'event_id', 'cast(attempt_number as varchar)', "'1'")} AS attempt_id, event_id, endpoint_id, attempt_number,
       http_status, response_time_ms, timeout, signature_valid, uploader AS user_id, attempted_at
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, attempt_number
                                   ORDER BY attempted_at, attempt_id, http_status, response_time_ms, timeout, signature_valid) AS rn
      FROM m6 WHERE is_valid) WHERE rn = 1""", CSV_CTES)

SQL["live_endpoint_instability"] = SQL["endpoint_instability"]
SQL["live_tenant_overview"] = SQL["tenant_overview"]

SQL["bulk_load_store"] = q("""
SELECT table_name, n AS rows_stored, n AS first_load, cast(0 AS bigint) AS second_load FROM (
  SELECT 'endpoints' AS table_name, count(DISTINCT endpoint_id) AS n FROM endpoints
  UNION ALL SELECT 'webhook_events', count(DISTINCT event_id) FROM webhook_events
  UNION ALL SELECT 'delivery_attempts', count(DISTINCT attempt_id) FROM delivery_attempts
  UNION ALL SELECT 'replay_actions', count(DISTINCT replay_id) FROM replay_actions)""")

SQL["stored_events_lookup"] = q("""
SELECT event_id, event_type, customer_id, user_id, created_at FROM webhook_events
WHERE event_id IN (SELECT event_id FROM replay_actions WHERE user_id = 'user_3')""")

SQL["stream_ingest_store"] = SQL["ingest_csv_store"]

SQL["ingest_json_store"] = q("""
SELECT 'attempt' AS kind, attempt_id AS id, event_id, attempt_number, cast(http_status as varchar) AS result, 'user_1' AS user_id
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, attempt_number
                                   ORDER BY attempted_at, attempt_id, doc_pos, http_status, response_time_ms, timeout, signature_valid) AS rn
      FROM doc_attempts) WHERE rn = 1
UNION ALL
SELECT 'replay', replay_id, event_id, NULL, replay_result, 'user_1' FROM doc_replays""", DOC_CTES)

SQL["upsert_endpoints"] = q("""
SELECT coalesce(s.endpoint_id, n.endpoint_id) AS endpoint_id,
       case when s.endpoint_id IS NOT NULL then s.customer_id else n.customer_id end AS customer_id,
       coalesce(s.endpoint_url_type, 'custom') AS endpoint_url_type,
       coalesce(s.expected_signature_version, 'v1') AS expected_signature_version,
       case when n.endpoint_id IS NOT NULL then n.avg_success_rate else s.avg_success_rate end AS avg_success_rate,
       case when n.endpoint_id IS NOT NULL then n.rate_limit_per_minute else s.rate_limit_per_minute end
         AS rate_limit_per_minute,
       case when n.endpoint_id IS NOT NULL then n.active else s.active end AS active,
       case when n.endpoint_id IS NOT NULL then n.user_id else s.user_id end AS user_id,
       case when s.endpoint_id IS NULL then 'inserted' when n.endpoint_id IS NOT NULL then 'updated'
            else 'unchanged' end AS change
FROM stored_eps s
FULL OUTER JOIN (
  SELECT ep_endpoint_id AS endpoint_id, avg_success_rate, rate_limit_per_minute, active, customer_id, user_id
  FROM (SELECT *, row_number() OVER (PARTITION BY ep_endpoint_id
                                     ORDER BY cast(attempted_at as timestamp) DESC, attempt_id DESC) AS rn
        FROM valid_docs) WHERE rn = 1) n ON s.endpoint_id = n.endpoint_id""",
                           DOC_CTES + f""",
stored_eps AS (SELECT * FROM endpoints
               WHERE endpoint_id IN (SELECT endpoint_id FROM delivery_attempts WHERE attempted_at < {CUT}))""")

# ---------------------------------------------------------------------------
# data quality
# ---------------------------------------------------------------------------
_KEYS = [("users", ["user_id"], True), ("users", ["email"], False), ("webhook_events", ["event_id"], True),
         ("webhook_events", ["idempotency_key"], False), ("endpoints", ["endpoint_id"], True),
         ("delivery_attempts", ["attempt_id"], True), ("delivery_attempts", ["event_id", "attempt_number"], False),
         ("replay_actions", ["replay_id"], True)]


def _key_sql(table: str, keys: list[str], primary: bool) -> str:
    anynull = " OR ".join(f"{k} IS NULL" for k in keys)
    value = ", ".join(f"coalesce(cast({k} as varchar), '<null>')" for k in keys)
    where = "" if primary else f"WHERE NOT ({anynull}) "
    return (f"SELECT '{table}' AS table_name, '{','.join(keys)}' AS key_columns, concat_ws('|', {value}) AS key_value, "
            f"count(*) AS n_rows FROM {table} {where}GROUP BY {', '.join(keys)} HAVING count(*) > 1 OR {anynull}")


SQL["key_violations"] = q("\nUNION ALL\n".join(_key_sql(*k) for k in _KEYS))

_FKS = [("delivery_attempts", "event_id", "webhook_events", "event_id"),
        ("delivery_attempts", "endpoint_id", "endpoints", "endpoint_id"),
        ("delivery_attempts", "user_id", "users", "user_id"),
        ("replay_actions", "event_id", "webhook_events", "event_id"),
        ("replay_actions", "user_id", "users", "user_id"),
        ("webhook_events", "user_id", "users", "user_id"),
        ("endpoints", "user_id", "users", "user_id")]
SQL["fk_orphans"] = q("\nUNION ALL\n".join(
    f"SELECT '{c}' AS table_name, '{col}' AS column_name, {col} AS fk_value, count(*) AS n_rows FROM {c} "
    f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL) GROUP BY {col}"
    for c, col, p, pc in _FKS))

SQL["duplicate_events"] = q("""
SELECT event_id, idempotency_key, group_size, first_event_id, event_id = first_event_id AS is_first,
       date_diff('second', first_created_at, created_at) AS gap_seconds
FROM (SELECT event_id, idempotency_key, created_at,
             count(*) OVER (PARTITION BY idempotency_key) AS group_size,
             first_value(event_id) OVER (PARTITION BY idempotency_key ORDER BY created_at, event_id) AS first_event_id,
             min(created_at) OVER (PARTITION BY idempotency_key) AS first_created_at
      FROM webhook_events WHERE idempotency_key IS NOT NULL) t
WHERE group_size > 1""")
