"""Per-event features (FE1-FE6).

Attempts and replays are aggregated to one row per event *before* they are
joined (no attempts x replays fan-out), and the (event, endpoint) pairs are
de-duplicated before the endpoint lookup, so every join after the first
aggregation is one-to-one or one-to-few.  The endpoint table is joined
without a broadcast hint: AQE broadcasts it only when its measured size is
under the threshold and keeps the shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import predicates as P
from ..functions.scalars import avg_exact, ratio, round_to
from ..tables import Tables


def _endpoint_attrs(endpoints: DataFrame) -> DataFrame:
    return endpoints.select(F.col("endpoint_id").alias("ep_id"),
                            F.col("avg_success_rate").alias("endpoint_health_score"),
                            "rate_limit_per_minute")


def _with_endpoint(pairs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(event_id, endpoint_id) -> the endpoint row; an id missing from the
    endpoint table becomes null, as a left join to it would give."""
    e = _endpoint_attrs(endpoints)
    return (pairs.join(e, pairs["endpoint_id"] == e["ep_id"], "left")
            .select("event_id", F.col("ep_id").alias("endpoint_id"),
                    "endpoint_health_score", "rate_limit_per_minute"))


def event_base(t: Tables) -> DataFrame:
    """FE1: events left-joined to their attempts' endpoints, one row per
    distinct (event, endpoint); events without attempts keep a null endpoint."""
    pairs = t.attempts.select("event_id", "endpoint_id").dropDuplicates()
    ep = _with_endpoint(pairs, t.endpoints).dropDuplicates()
    return (t.events.select("event_id", "event_type", "priority", "payload_size_kb")
            .join(ep, "event_id", "left"))


def attempt_features(attempts: DataFrame, with_first_endpoint: bool = False) -> DataFrame:
    """FE2: per event counts of attempts, timeouts, 5xx, 4xx, 2xx and latency
    (optionally also the endpoint of the first attempt, in the same pass)."""
    first = ([F.min_by("endpoint_id", F.struct("attempt_number", "attempt_id")).alias("first_endpoint_id")]
             if with_first_endpoint else [])
    return (attempts.groupBy("event_id")
            .agg(*first,
                 F.count("attempt_id").alias("total_attempts"),
                 P.count_if(P.is_timeout()).alias("timeout_count"),
                 P.count_if(P.is_server_error()).alias("server_error_count"),
                 P.count_if(P.is_client_error()).alias("client_error_count"),
                 P.count_if(P.is_success()).alias("success_count"),
                 round_to(avg_exact("response_time_ms"), 4).alias("avg_response_time"),
                 F.max("response_time_ms").alias("max_response_time")))


def replay_features(replays: DataFrame) -> DataFrame:
    """FE2b: per event replay count and duplicates detected."""
    return (replays.groupBy("event_id")
            .agg(F.count("replay_id").alias("replay_count"),
                 P.count_if(F.coalesce(F.col("duplicate_detected"), F.lit(False))).alias("duplicate_count")))


def one_hot(df: DataFrame, column: str, domain: list[str], prefix: str | None = None,
            drop: bool = True) -> DataFrame:
    """FE4: one boolean column per domain value (sorted, like get_dummies);
    null or unknown values give all-false.  The domain is declared, so the
    schema never depends on the data."""
    pre = prefix if prefix is not None else column
    cols = [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).alias(f"{pre}_{v}") for v in sorted(domain)]
    out = df.select("*", *cols)
    return out.drop(column) if drop else out


def _derive(base: DataFrame, att: DataFrame, rep: DataFrame) -> DataFrame:
    """FE3's derived columns over base + per-event aggregates."""
    return _finish(base.join(att, "event_id", "left").join(rep, "event_id", "left"))


def _finish(df: DataFrame) -> DataFrame:
    total = F.col("total_attempts")
    df = df.select(
        "event_id", "event_type", "priority", "payload_size_kb", "endpoint_id",
        "endpoint_health_score", "rate_limit_per_minute",
        "total_attempts", "timeout_count", "server_error_count", "client_error_count", "success_count",
        F.coalesce("avg_response_time", F.lit(0.0)).alias("avg_response_time"),
        F.coalesce("max_response_time", F.lit(0.0)).alias("max_response_time"),
        F.coalesce("replay_count", F.lit(0)).cast("bigint").alias("replay_count"),
        F.coalesce("duplicate_count", F.lit(0)).cast("bigint").alias("duplicate_count"),
        # clip(lower=0) keeps a missing count missing; greatest() would not
        F.when(total.isNotNull(), F.greatest(total - 1, F.lit(0))).cast("bigint").alias("retry_count"),
        F.coalesce(ratio("timeout_count", total), F.lit(0.0)).alias("timeout_ratio"),
        F.coalesce(ratio(F.col("server_error_count") + F.col("client_error_count"), total),
                   F.lit(0.0)).alias("error_ratio"),
        F.coalesce((F.col("success_count") > 0).cast("int"), F.lit(0)).alias("is_recovered"),
    )
    return one_hot(df, "priority", S.PRIORITIES)


def event_features(t: Tables) -> DataFrame:
    """FE3: the model table at (event, endpoint) grain."""
    return _derive(event_base(t), attempt_features(t.attempts), replay_features(t.replays))


def first_endpoint(attempts: DataFrame) -> DataFrame:
    """Endpoint of each event's lowest (attempt_number, attempt_id) attempt
    -- a partial-aggregating min_by, never a per-event sort."""
    return (attempts.groupBy("event_id")
            .agg(F.min_by("endpoint_id", F.struct("attempt_number", "attempt_id")).alias("endpoint_id")))


def features_per_event(t: Tables) -> DataFrame:
    """FE5: one row per event, using the endpoint of its first attempt.

    The first endpoint and the counters come from one aggregation over the
    attempts, and the rest is a single chain of joins: two consumers of that
    aggregate would each get their own pruned copy, and so their own pass
    over the fact table."""
    agg = attempt_features(t.attempts, with_first_endpoint=True)
    e = _endpoint_attrs(t.endpoints)
    per_event = (agg.join(e, agg["first_endpoint_id"] == e["ep_id"], "left")
                 .drop("first_endpoint_id").withColumnRenamed("ep_id", "endpoint_id"))
    df = (t.events.select("event_id", "event_type", "priority", "payload_size_kb")
          .join(per_event, "event_id", "left")
          .join(replay_features(t.replays), "event_id", "left"))
    return _finish(df)


MODEL_FEATURES = [
    "payload_size_kb", "endpoint_health_score", "rate_limit_per_minute", "avg_response_time",
    "max_response_time", "retry_count", "timeout_ratio", "error_ratio",
    "priority_critical", "priority_high", "priority_low", "priority_medium",
]


def select_model_columns(features: DataFrame) -> DataFrame:
    """FE6: ids + label + model inputs; leak columns dropped (a missing one
    is ignored), booleans as 0/1 ints."""
    df = features.drop(*[c for c in S.MODEL_LEAK_COLUMNS + ["event_type"] if c in features.columns])
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        out.append(c.cast("int").alias(f.name) if f.dataType.typeName() == "boolean" else c)
    df = df.select(*out)
    keep = ["event_id", "endpoint_id", "is_recovered"] + [c for c in MODEL_FEATURES if c in df.columns]
    return df.select(*keep)
