"""Structured Streaming jobs (ST1-ST3).

* ST1 ``stream_ingest_csv`` / ``stream_ingest_json``: a file-source stream
  of uploads; each micro-batch runs the same set-based merge as the batch
  ingest job (``plans.jobs``) through ``foreachBatch``.  The merge is
  idempotent (key-derived ids, anti joins against stored keys), so a
  micro-batch replayed after a failure adds nothing twice.
* ST2 ``stream_dedupe_attempts``: (event_id, attempt_number) de-duplication
  across files, state bounded by an event-time watermark.
* ST3 ``stream_endpoint_health``: A1's counters per endpoint and hour,
  emitted once the watermark passes the window.

State and progress live under the checkpoint location, a folder in the
shared checkpoint directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions import predicates as P
from ..functions.scalars import avg_exact, round_to
from ..session import checkpoint_dir, freed_exchanges
from ..sources import files as FILES


def endpoint_health_windows(attempts: DataFrame, window: str = "1 hour") -> DataFrame:
    """A1's counters per (event-time window, endpoint); works on a batch
    frame (the oracle-checked twin) and on a stream."""
    return (attempts.groupBy(F.window("attempted_at", window).alias("w"), "endpoint_id")
            .agg(F.count("attempt_id").alias("total_attempts"),
                 P.count_if(P.is_delivery_failure()).alias("failure_count"),
                 P.count_if(P.is_timeout()).alias("timeout_count"),
                 round_to(avg_exact("response_time_ms"), 4).alias("avg_response_time"))
            .select(F.col("w.start").alias("window_start"), "endpoint_id", "total_attempts",
                    "failure_count", "timeout_count", "avg_response_time"))


def _ckpt(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    return checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)


def read_attempt_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Typed attempt rows from a folder that receives new files."""
    r = spark.readStream.schema(S.DELIVERY_ATTEMPTS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True)
    return r.format(fmt).load(path)


def _event_time(df: DataFrame) -> DataFrame:
    # watermarks need a zoned timestamp; the session zone is UTC
    return df.withColumn("attempted_at_ts", F.col("attempted_at").cast("timestamp"))


def deduped_attempts(attempts: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST2's plan: the first arrival per (event_id, attempt_number) within the watermark."""
    return (_event_time(attempts).withWatermark("attempted_at_ts", delay)
            .dropDuplicatesWithinWatermark(["event_id", "attempt_number"]).drop("attempted_at_ts"))


def live_endpoint_health(attempts: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """ST3's plan: endpoint health of the windows that the watermark has passed."""
    timed = _event_time(attempts).withWatermark("attempted_at_ts", delay)
    return endpoint_health_windows(timed.drop("attempted_at").withColumnRenamed("attempted_at_ts", "attempted_at"), window)


def stream_dedupe_attempts(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                           delay: str = "1 day", fmt: str = "parquet", available_now: bool = True
                           ) -> StreamingQuery:
    """ST2: first arrival per (event_id, attempt_number) within the
    watermark; late copies are dropped, state older than ``delay`` is
    purged.  Appends to a parquet sink."""
    out = deduped_attempts(read_attempt_stream(spark, source, fmt), delay)
    w = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", _ckpt(spark, "dedupe", checkpoint)).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_endpoint_health(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                           window: str = "1 hour", delay: str = "2 hours", fmt: str = "parquet",
                           available_now: bool = True) -> StreamingQuery:
    """ST3: hourly endpoint health, appended once each window is final."""
    agg = live_endpoint_health(read_attempt_stream(spark, source, fmt), window, delay)
    w = (agg.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", _ckpt(spark, "health", checkpoint)).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_ingest(spark: SparkSession, source: str, table_dir: str, user_id: str, fmt: str = "csv",
                  checkpoint: str | None = None, available_now: bool = True, mode: str = "strict") -> StreamingQuery:
    """ST1: upload files (flat CSV or JSON documents) of the tenant
    ``user_id`` merged into the parquet tables under ``table_dir`` one
    micro-batch at a time.

    CSV: the stream tells which files are new; the batch reader then checks
    each file's header (S2) and takes its columns by name."""
    from ..plans import jobs
    if fmt == "csv":
        reader = spark.readStream.text(source).select(F.col("_metadata.file_path").alias("file"))
    else:
        schema = T.StructType(S.RAW_LOG.fields + [T.StructField(FILES.CORRUPT, T.StringType())])
        reader = (spark.readStream.schema(schema).option("multiLine", True)
                  .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", FILES.CORRUPT).json(source))

    def merge(batch: DataFrame, batch_id: int) -> None:
        if fmt == "csv":
            files = [r.file for r in batch.distinct().collect()]  # the micro-batch's files
            if files:
                jobs.ingest_csv_job(spark, sorted(files), table_dir, user_id, mode=mode)
        else:
            jobs.ingest_json_batch(spark, batch, table_dir, user_id, mode=mode)

    w = (reader.writeStream.foreachBatch(merge)
         .option("checkpointLocation", _ckpt(spark, f"ingest_{fmt}", checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_ingest_rows(spark: SparkSession, rows: DataFrame, table_dir: str, checkpoint: str, user_id: str | None = None,
                       mode: str = "strict", available_now: bool = True) -> StreamingQuery:
    """ST1 on a stream of upload rows (all text, as a CSV reader gives them;
    ``ord`` is their input order): each micro-batch is merged and committed
    as one batch of the store.  Without ``user_id`` the rows name their tenant."""
    from ..plans import jobs

    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            jobs.ingest_csv_batch(spark, batch, table_dir, user_id, mode=mode)

    w = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def in_arrivals(spark: SparkSession, arrivals: list[DataFrame], folder: str, start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Run a stream over a table that arrives in parts.

    Each part is written to a folder that the stream watches, and the stream
    is started on what has arrived, runs to its end and stops; so every start
    but the first goes on from the checkpoint, with the state and the
    watermark of the one before.  ``start(stream of rows, checkpoint)`` starts it.
    A part that the stream has gone through is removed."""
    for i, part in enumerate(arrivals):
        arrived = os.path.join(folder, "in", f"arrival={i}")
        with freed_exchanges(part.sparkSession):
            part.write.option("compression", "zstd").parquet(arrived)
        rows = spark.readStream.schema(part.schema).parquet(os.path.join(folder, "in", "arrival=*"))
        query = start(rows, os.path.join(folder, "checkpoint"))
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        FILES.remove(spark, arrived)


def stream_ingest_csv(spark: SparkSession, source: str, table_dir: str, user_id: str, **kw) -> StreamingQuery:
    """ST1 for flat CSV uploads."""
    return stream_ingest(spark, source, table_dir, user_id, fmt="csv", **kw)


def stream_ingest_json(spark: SparkSession, source: str, table_dir: str, user_id: str, **kw) -> StreamingQuery:
    """ST1 for JSON log documents."""
    return stream_ingest(spark, source, table_dir, user_id, fmt="json", **kw)
