"""A1-A6 kept up to date: aggregate states that grow with the store's commits.

Every number of A1-A6 comes from sums and counts, so a small state row for each
group is enough: the sums of all rows so far.  ``refresh`` reads only the batches
that the store has committed since the version which the states hold, aggregates
them, adds the result to the states and commits those (in a folder of their own,
with the version that they now hold).  Tables joined in A4 and A5 follow the rule

    new (attempts x events) = new attempts x all events + old attempts x new events,

where the matching rows of the stored side are found by the key index.  A refresh
that fails has committed nothing; of two at the same time one gets
:class:`.jobs.ConcurrentCommit`.  Sums are whole numbers or decimals, so the views
equal a recomputation over all rows, whatever the batches were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.scalars import ceil_div, ratio, round_to, truncated_health
from ..session import staged
from . import jobs as JOBS

#: State tables: group columns, then sums.
STATES = {
    "endpoint_state": ("endpoint_id string", "total long, failures long, timeouts long, rt_sum decimal(38,6), rt_n long"),
    "attempt_number_state": ("attempt_number int", "total long, successes long, rt_sum decimal(38,6), rt_n long"),
    "replay_state": ("replay_result string", "n long, duplicates long"),
    "tenant_endpoint_state": ("user_id string, endpoint_id string", "total long, failed long"),
    "tenant_state": ("user_id string", "n_events long, n_failed_type long"),
}
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "decimal(38,6)": T.DecimalType(38, 6)}
SCHEMAS = {name: T.StructType([T.StructField(*c.split()[:1], _TYPES[c.split()[1]]) for c in f"{group}, {sums}, upto long".split(", ")])
           for name, (group, sums) in STATES.items()}


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _committed(spark: SparkSession, base: str, table: str, after: int, upto: int) -> DataFrame:
    """The rows that versions after ``after``, up to ``upto``, added to an append table."""
    log = JOBS.commits(spark, base).where((F.col("table_name") == table) & (F.col("version") > after) & (F.col("version") <= upto))
    paths = [f"{base}/{table}/batch={r.batch}" for r in log.select("batch").distinct().collect()]  # one row for each commit
    schema = JOBS.SCHEMAS[table]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/{table}").parquet(*sorted(paths))


def _rt():
    v = F.col("response_time_ms")
    return [F.sum(v.cast("decimal(18,6)")).alias("rt_sum"), F.count(v).alias("rt_n")]


def held_version(spark: SparkSession, views: str) -> int:
    """The store version that the states hold, -1 for none."""
    r = _states(spark, views, "tenant_state", raw=True).agg(F.max("upto").alias("v")).first()
    return -1 if r.v is None else int(r.v)


def _states(spark: SparkSession, views: str, name: str, raw: bool = False) -> DataFrame:
    """The latest committed states (a marker row, all of whose sums are null, keeps the version of empty ones)."""
    log = JOBS.commits(spark, views).where(F.col("table_name") == name).orderBy(F.desc("version")).limit(1).collect()
    if not log:
        return spark.createDataFrame([], SCHEMAS[name])
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{views}/{name}/batch={log[0].batch}")
    return df if raw else df.where(F.col(_names(STATES[name][1])[0]).isNotNull())


def deltas(spark: SparkSession, base: str, after: int, upto: int) -> dict[str, DataFrame]:
    """What the versions after ``after``, up to ``upto``, add to each state."""
    attempts = _committed(spark, base, "delivery_attempts", after, upto)
    events = _committed(spark, base, "webhook_events", after, upto)
    replays = _committed(spark, base, "replay_actions", after, upto)
    # attempts are summed to one row for each event and endpoint before they meet the events
    per_event = lambda a: (a.groupBy("event_id", "endpoint_id")
                           .agg(F.count("attempt_id").alias("total"), P.count_if(P.is_http_failure()).alias("failed")))
    owner = lambda e: e.select("event_id", "user_id")
    fresh = staged(per_event(attempts), "attempts")
    of_new_attempts = JOBS.read_keys(spark, base, "webhook_events", fresh.select(F.col("event_id").alias("key")))
    of_new_events = JOBS.read_keys(spark, base, "delivery_attempts", events.select(F.col("event_id").alias("key")))
    known = _versions(spark, base, "webhook_events", of_new_attempts, upto)
    old = _versions(spark, base, "delivery_attempts", of_new_events, after)
    met = (fresh.join(owner(known), "event_id").unionByName(per_event(old).join(owner(events), "event_id")))
    return {
        "endpoint_state": attempts.groupBy("endpoint_id").agg(
            F.count("attempt_id").alias("total"), P.count_if(P.is_delivery_failure()).alias("failures"),
            P.count_if(P.is_timeout()).alias("timeouts"), *_rt()),
        "attempt_number_state": attempts.groupBy("attempt_number").agg(
            F.count("attempt_id").alias("total"), P.count_if(P.is_success()).alias("successes"), *_rt()),
        "replay_state": replays.groupBy("replay_result").agg(
            F.count("replay_id").alias("n"), P.count_if(F.coalesce(F.col("duplicate_detected"), F.lit(False))).alias("duplicates")),
        "tenant_endpoint_state": met.groupBy("user_id", "endpoint_id").agg(F.sum("total").alias("total"), F.sum("failed").alias("failed")),
        "tenant_state": events.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n_events"), P.count_if(P.mentions_failed_ci()).alias("n_failed_type")),
    }


def _versions(spark: SparkSession, base: str, table: str, rows: DataFrame, upto: int) -> DataFrame:
    """Rows of an append table that versions up to ``upto`` hold; ``rows`` are from :func:`.jobs.read_keys`."""
    if upto < 0 or not rows.inputFiles():
        return rows.where("false")
    log = JOBS.commits(spark, base).where((F.col("table_name") == table) & (F.col("version") <= upto)).select("batch").distinct()
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=([^/]+)/", 1)
    return rows.withColumn("_batch", batch).join(log.select(F.col("batch").alias("_batch")), "_batch", "left_semi").drop("_batch")


def refresh(spark: SparkSession, base: str, views: str) -> int:
    """Bring the states under ``views`` up to the store's last version; returns that version."""
    after, upto, seen = held_version(spark, views), JOBS.last_version(spark, base), JOBS.last_version(spark, views)
    if upto <= after:
        return after
    writes = {}
    for name, delta in deltas(spark, base, after, upto).items():
        group, sums = (_names(x) for x in STATES[name])
        old = _states(spark, views, name).select(*group, *sums)
        new = (old.unionByName(delta.select(*group, *sums)).groupBy(*group)
               .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]))
        marker = spark.createDataFrame([(None,) * (len(group) + len(sums)) + (upto,)], SCHEMAS[name])
        types = {f.name: f.dataType for f in SCHEMAS[name].fields}
        writes[name] = new.select(*[F.col(c).cast(types[c]).alias(c) for c in group + sums], F.lit(upto).cast("long").alias("upto")).unionByName(marker)
    JOBS.commit_batch(spark, views, writes, seen, SCHEMAS)
    return upto


def _mean():
    return round_to(F.try_divide(F.col("rt_sum").cast("double"), F.col("rt_n").cast("double")), 4).alias("avg_response_time")


def endpoint_instability(spark: SparkSession, views: str, min_attempts: int = 5) -> DataFrame:
    """A1 from the states."""
    g = (_states(spark, views, "endpoint_state").where(F.col("total") > min_attempts)
         .select("endpoint_id", F.col("total").alias("total_attempts"), F.col("failures").alias("failure_count"),
                 F.col("timeouts").alias("timeout_count"), _mean()))
    return (g.withColumn("failure_rate", ratio("failure_count", "total_attempts"))
            .withColumn("timeout_rate", ratio("timeout_count", "total_attempts"))
            .orderBy(F.desc("failure_rate"), F.asc_nulls_last("endpoint_id")))


def retry_patterns(spark: SparkSession, views: str) -> DataFrame:
    """A2 from the states."""
    percent = F.try_divide(F.col("successes").cast("double") * F.lit(100.0), F.col("total").cast("double"))
    return (_states(spark, views, "attempt_number_state")
            .select("attempt_number", F.col("total").alias("count"), _mean(), percent.alias("success_rate_percent")).orderBy("attempt_number"))


def replay_frequency(spark: SparkSession, views: str) -> DataFrame:
    """A3 from the states."""
    return _states(spark, views, "replay_state").select("replay_result", F.col("n").alias("count"), F.col("duplicates").alias("duplicates_detected"))


def tenant_overview(spark: SparkSession, views: str, users: DataFrame) -> DataFrame:
    """A4 from the states."""
    att = _states(spark, views, "tenant_endpoint_state").groupBy("user_id").agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"))
    return (users.select("user_id").join(_states(spark, views, "tenant_state"), "user_id", "left").join(att, "user_id", "left")
            .select("user_id", truncated_health(F.coalesce("failed", F.lit(0)), F.coalesce("total", F.lit(0))).alias("health_score"),
                    (F.coalesce("n_events", F.lit(0)) * 3).cast("bigint").alias("replays_prevented"),
                    F.least(F.coalesce("n_failed_type", F.lit(0)), F.lit(15)).cast("bigint").alias("active_anomalies")))


def tenant_endpoints(spark: SparkSession, views: str) -> DataFrame:
    """A5 from the states."""
    return (_states(spark, views, "tenant_endpoint_state").where(F.col("endpoint_id").isNotNull())
            .select("user_id", "endpoint_id", F.col("total").alias("total_requests"), F.col("failed").alias("failed_requests"))
            .withColumn("health_score", truncated_health("failed_requests", "total_requests")))


def tenant_event_counts(spark: SparkSession, views: str, limit: int = 10) -> DataFrame:
    """A6 from the states."""
    return (_states(spark, views, "tenant_state").select("user_id", F.col("n_events").alias("total"))
            .withColumn("page_limit", F.lit(limit).cast("bigint")).withColumn("total_pages", ceil_div(F.col("total"), F.col("page_limit"))))
