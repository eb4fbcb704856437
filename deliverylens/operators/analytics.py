"""Grouped analytics over the domain tables.

Every job is a declarative aggregate: Spark runs a partial (map-side)
aggregation before the shuffle, so a hot key -- one endpoint or tenant
holding a third of all attempts -- is reduced to one row per map task before
it moves.  Tenant jobs pre-aggregate attempts per event first, so the join
to events is one-to-one and the fact table is never joined row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import avg_exact, ceil_div, ratio, round_to, truncated_health
from ..functions.stats import exact_quantiles
from ..tables import Tables


def endpoint_instability(attempts: DataFrame, min_attempts: int = 5) -> DataFrame:
    """A1: per endpoint (a null endpoint is a group of its own): attempts,
    failures (>=500 or timeout), timeouts, mean latency; endpoints with more
    than ``min_attempts`` attempts; most unstable first."""
    g = (attempts.groupBy("endpoint_id")
         .agg(F.count("attempt_id").alias("total_attempts"),
              P.count_if(P.is_delivery_failure()).alias("failure_count"),
              P.count_if(P.is_timeout()).alias("timeout_count"),
              round_to(avg_exact("response_time_ms"), 4).alias("avg_response_time"))
         .where(F.col("total_attempts") > min_attempts))
    return (g.withColumn("failure_rate", ratio("failure_count", "total_attempts"))
            .withColumn("timeout_rate", ratio("timeout_count", "total_attempts"))
            .orderBy(F.desc("failure_rate"), F.asc_nulls_last("endpoint_id")))


def retry_patterns(attempts: DataFrame) -> DataFrame:
    """A2: per attempt number: volume, mean latency, success percentage."""
    return (attempts.groupBy("attempt_number")
            .agg(F.count("attempt_id").alias("count"),
                 round_to(avg_exact("response_time_ms"), 4).alias("avg_response_time"),
                 (P.count_if(P.is_success()).cast("double") * F.lit(100.0)
                  / F.count("attempt_id").cast("double")).alias("success_rate_percent"))
            .orderBy("attempt_number"))


def replay_frequency(replays: DataFrame) -> DataFrame:
    """A3: per replay result (null is a group): count and duplicates."""
    return (replays.groupBy("replay_result")
            .agg(F.count("replay_id").alias("count"),
                 P.count_if(F.coalesce(F.col("duplicate_detected"), F.lit(False))).alias("duplicates_detected")))


def _attempts_per_event(attempts: DataFrame, *extra_keys: str) -> DataFrame:
    """Pre-aggregate the fact table to (event, ...) before any join."""
    return (attempts.groupBy("event_id", *extra_keys)
            .agg(F.count("attempt_id").alias("n_attempts"),
                 P.count_if(P.is_http_failure()).alias("n_failed")))


def tenant_overview(t: Tables, user_id: str | None = None) -> DataFrame:
    """A4: per tenant: health (truncated percent of attempts under 400, 100
    with no attempts), replays prevented (3 x events), active anomalies
    (events whose type mentions 'failed', capped at 15).  Attempts belong to
    the tenant of their *event*."""
    per_event = _attempts_per_event(t.attempts)
    ev = P.tenant_events(t.events, user_id).select("event_id", "user_id", "event_type")
    att = (per_event.join(ev, "event_id")
           .groupBy("user_id")
           .agg(F.sum("n_attempts").alias("total"), F.sum("n_failed").alias("failed")))
    evs = (ev.groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("n_events"),
                P.count_if(P.mentions_failed_ci()).alias("n_failed_type")))
    return (P.tenant_events(t.users, user_id).select("user_id")
            .join(evs, "user_id", "left")
            .join(att, "user_id", "left")
            .select("user_id",
                    truncated_health(F.coalesce("failed", F.lit(0)), F.coalesce("total", F.lit(0)))
                    .alias("health_score"),
                    (F.coalesce("n_events", F.lit(0)) * 3).cast("bigint").alias("replays_prevented"),
                    F.least(F.coalesce("n_failed_type", F.lit(0)), F.lit(15)).cast("bigint")
                    .alias("active_anomalies")))


def tenant_endpoints(t: Tables, user_id: str | None = None) -> DataFrame:
    """A5: per (tenant of the event, endpoint not null): requests, failures
    (>=400) and truncated health."""
    per = _attempts_per_event(t.attempts.where(F.col("endpoint_id").isNotNull()), "endpoint_id")
    return (per.join(P.tenant_events(t.events, user_id).select("event_id", "user_id"), "event_id")
            .groupBy("user_id", "endpoint_id")
            .agg(F.sum("n_attempts").cast("bigint").alias("total_requests"),
                 F.sum("n_failed").cast("bigint").alias("failed_requests"))
            .withColumn("health_score", truncated_health("failed_requests", "total_requests")))


def tenant_event_counts(events: DataFrame, limit: int = 10, user_id: str | None = None) -> DataFrame:
    """Events per tenant and the page count for a page size."""
    return (P.tenant_events(events, user_id).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
            .withColumn("page_limit", F.lit(limit).cast("bigint"))
            .withColumn("total_pages", ceil_div(F.col("total"), F.col("page_limit"))))


def distinct_events(attempts: DataFrame, approx: bool = False) -> DataFrame:
    """Unique event ids among uploaded attempts (null not counted)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return attempts.agg(f("event_id").cast("bigint").alias("distinct_events"))


def class_balance(features: DataFrame, label: str = "is_recovered") -> DataFrame:
    """Share of each label value, in percent."""
    counts = features.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the aggregated frame: one row per label value
    n = F.sum("count").over(Window.partitionBy())
    return counts.select(label, "count",
                         round_to(F.col("count").cast("double") * F.lit(100.0) / n.cast("double"), 4)
                         .alias("share_pct"))


DESCRIBE_COLUMNS = ["retry_count", "timeout_ratio", "avg_response_time", "endpoint_health_score"]


def describe_features(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A10: count, mean, sample std, min, 25/50/75% (linear), max per column,
    as rows; quantiles are exact and computed distributed."""
    cols = columns or DESCRIBE_COLUMNS
    long = (features.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("kv")).select("kv.*"))
    moments = (long.groupBy("column_name")
               .agg(F.count("value").alias("count"),
                    round_to(F.avg("value"), 4).alias("mean"),
                    round_to(F.stddev_samp("value"), 4).alias("std"),
                    round_to(F.min("value"), 4).alias("min"),
                    round_to(F.max("value"), 4).alias("max")))
    q = (exact_quantiles(features.select(*cols), cols, [0.25, 0.5, 0.75])
         .groupBy("column_name")
         .agg(*[round_to(F.first(F.when(F.col("prob") == p, F.col("value")), ignorenulls=True), 4).alias(n)
                for p, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]]))
    return moments.join(q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def class_weight(labelled: DataFrame, label: str = "is_recovered") -> DataFrame:
    """Negatives / positives on the training rows (XGBoost-style
    ``scale_pos_weight``)."""
    return (labelled.agg(P.count_if(F.col(label) == 0).alias("n_negative"),
                         P.count_if(F.col(label) == 1).alias("n_positive"))
            .withColumn("scale_pos_weight", ratio("n_negative", "n_positive")))


def classification_report(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and
    weighted averages (0/0 -> 0), from one grouped confusion count."""
    conf = (scored.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    per_class = (conf.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support_n"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("pred_n")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support_n"),
                 F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("pred_n")))).alias("s"))
        .select("s.*")
        .groupBy("cls")
        .agg(F.sum("support_n").alias("support"), F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n")))
    pc = (per_class
          .withColumn("precision", F.coalesce(ratio("tp", "pred_n"), F.lit(0.0)))
          .withColumn("recall", F.coalesce(ratio("tp", "support"), F.lit(0.0)))
          .withColumn("f1_score", F.coalesce(
              F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                           F.col("precision") + F.col("recall")), F.lit(0.0))))
    totals = pc.agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"),
                    F.count(F.lit(1)).alias("k"),
                    F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                    (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                    (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                    (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = pc.select(F.col("cls").cast("string").alias("label"), "precision", "recall", "f1_score",
                     F.col("support").cast("bigint").alias("support"))
    acc = totals.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"),
                        ratio("correct", "n").alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    macro = totals.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                          F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                          F.col("n").cast("bigint").alias("support"))
    weighted = totals.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                             F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                             F.col("n").cast("bigint").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[round_to(c, 4).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")
