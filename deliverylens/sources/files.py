"""File sources and sinks.

Readers always declare the schema (no inference: a single 'yes' in a
boolean column would turn it into text); writers go through Spark's job
commit, so a failed task or executor leaves no partial output.
"""

from __future__ import annotations

import csv
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import json_safe
from ..tables import Tables

CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any storage Spark can read
    (asks the path's Hadoop file system; no local-disk assumption)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def any_match(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches a glob pattern, on any storage Spark can read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, on any storage Spark can write; False if it exists
    (the file system's create-without-overwrite decides between two writers)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def bytes_under(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files under a folder, on any storage Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job has made (none there: nothing to do), on any storage Spark can write."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def require_columns(columns: list[str], required: list[str] | None = None) -> None:
    """Raise naming the first missing required column, in list order."""
    for c in required or S.REQUIRED_CSV_COLUMNS:
        if c not in columns:
            raise ValueError(f"Missing required column: {c}")


def csv_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Header line -> the files that start with it.  One row per file reaches
    the driver; lines are reduced to each file's first in the map tasks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos"))
    out: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "pos").alias("header")).collect():
        out.setdefault(r.header, []).append(r.file)
    return out


def read_attempts_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S1 + S2: flat attempt CSV(s) with a header, every column as text.

    Every file's own header is checked and its columns are taken by name, so
    files of one folder may order them differently or add some (null in the
    other files).  ``ord`` is the row's input position (file, place of the
    split in the file, place in the split).
    """
    headers = csv_headers(spark, path)
    if not headers:
        raise ValueError(f"no CSV lines under {path}")
    out = None
    for header, files in sorted(headers.items()):
        columns = next(csv.reader([header]))
        require_columns(columns)
        ddl = ", ".join(f"`{c}` string" for c in columns)
        df = spark.read.option("header", True).schema(ddl).csv(path if len(headers) == 1 else files)
        df = df.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"),
                                           F.col("_metadata.file_block_start").alias("block"),
                                           F.monotonically_increasing_id().alias("pos")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_logs_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Log documents from JSON files -- one object or an array of
    objects per file (``multiline``), or one object per line.  Malformed
    documents keep their text in ``_corrupt_record``."""
    schema = T.StructType(S.RAW_LOG.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("multiLine", multiline)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def load_parquet_tables(spark: SparkSession, base: str) -> Tables:
    """The five tables from a folder of parquet tables; a table that
    was never written (the bulk dataset has no users) reads as empty."""
    schemas = {"users": S.USERS, "webhook_events": S.WEBHOOK_EVENTS, "endpoints": S.ENDPOINTS,
               "delivery_attempts": S.DELIVERY_ATTEMPTS, "replay_actions": S.REPLAY_ACTIONS}

    def r(name):
        path = os.path.join(base, name)
        if not path_exists(spark, path):
            return spark.createDataFrame([], schemas[name])
        return spark.read.parquet(path)
    return Tables(users=r("users"), events=r("webhook_events"), endpoints=r("endpoints"),
                  attempts=r("delivery_attempts"), replays=r("replay_actions"))


def load_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                    lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
                    properties: dict | None = None) -> DataFrame:
    """S6 over a relational store: a parallel JDBC read when a numeric
    partition column is given (one range per task), else a single read."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


# Bulk files, in foreign-key order (endpoints before events before attempts).
BULK_FILES = [
    ("endpoints", "endpoints.csv", S.BULK_ENDPOINTS),
    ("webhook_events", "webhook_events.csv", S.WEBHOOK_EVENTS),
    ("delivery_attempts", "delivery_attempts.csv", S.BULK_DELIVERY_ATTEMPTS),
    ("replay_actions", "replay_actions.csv", S.REPLAY_ACTIONS),
]


def bulk_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S7's reading of one bulk file: (typed rows, rejected rows).

    Columns are taken by the file's header; those that it lacks (the replay
    file has no id, no tenant) are derived or left null.  A row with a text
    that its column's type can't hold is rejected with the first such column
    as ``reason`` and its text as ``body``, instead of losing the value."""
    from ..functions.scalars import surrogate_id
    header = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in header)).csv(path)
    cols, reason = [], F.lit(None).cast("string")
    for f in reversed(schema.fields):
        if f.name in header:
            c = F.col(f.name)
            if f.dataType.typeName() == "boolean":
                typed, bad = F.lower(c) == "true", F.lit(False)
            else:
                typed = c.try_cast(f.dataType)
                bad = c.isNotNull() & typed.isNull()
            reason = F.when(bad, F.lit(f"bad:{f.name}")).otherwise(reason)
            cols.append(typed.alias(f.name))
        elif f.name == "replay_id":
            cols.append(surrogate_id("rep", "event_id", "replayed_at").alias("replay_id"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    judged = raw.withColumn("reason", reason)
    body = F.to_json(F.struct(*[F.col(c) for c in header]))
    return (judged.where(F.col("reason").isNull()).select(*cols[::-1]),
            judged.where(F.col("reason").isNotNull()).select("reason", body.alias("body")))


def write_features(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The feature table with a header (CSV) or as parquet."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_features(spark: SparkSession, path: str, fmt: str = "csv", schema=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read features back; booleans become 0/1 ints; the model's leak and
    id columns are dropped where present (missing ones are ignored), except
    those in ``keep`` (the label, or ids for a split)."""
    if fmt == "csv":
        r = spark.read.option("header", True)
        df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    for f in df.schema.fields:
        if f.dataType.typeName() == "boolean":
            df = df.withColumn(f.name, F.col(f.name).cast("int"))
    return df.drop(*[c for c in S.MODEL_LEAK_COLUMNS + S.MODEL_ID_COLUMNS if c not in keep])


def export_report(df: DataFrame, path: str) -> None:
    """Write a report frame as JSON lines (replaces the mail body);
    numbers that JSON lacks are made safe first."""
    json_safe(df).write.mode("overwrite").json(path)
