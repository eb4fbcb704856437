"""The bulk load, with a ledger of loaded files.

The four files of a dataset go to the tables of a store (see :mod:`.jobs`) in one
commit, together with the ledger rows (path, size, digest, rows) of the files that
the commit holds.  A file whose size and digest the ledger has is not loaded again,
so a rerun adds nothing; a load that crashes has committed nothing, and the next
one starts afresh; of two loads at the same time one commits and the other gets
:class:`.jobs.ConcurrentCommit`, and finds the files in the ledger when it is run
again.  Rows whose key a table holds already are not added (the original's primary
keys refuse them).  A changed file is another file: its new rows are added.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import ingest as M
from ..session import freed_exchanges
from ..sources import files as FILES
from ..tables import Tables
from . import jobs as JOBS

LOADS = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("digest", T.StringType()),
    T.StructField("rows_added", T.LongType()),
    T.StructField("loaded_at", T.TimestampNTZType()),
])
SCHEMAS = {**{table: schema for table, _, schema in FILES.BULK_FILES}, "rejects": S.REJECTS, "loads": LOADS}
#: The key by which a row is known, and the column by which the store's key index finds it.
ROW_KEYS = {"endpoints": "endpoint_id", "webhook_events": "event_id", "delivery_attempts": "attempt_id", "replay_actions": "replay_id"}


def file_digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """(bytes, digest) of a text file or folder: a sum over its lines' hashes, so no task reads more than its
    split and the order of splits doesn't matter."""
    lines = spark.read.text(path)
    r = lines.agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("a"),
                  F.sum(F.xxhash64("value", F.lit(1)).cast("decimal(38,0)")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(r.bytes or 0), f"{r.n}:{r.a or 0}:{r.b or 0}"


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """The loaded files."""
    return JOBS.read_table(spark, base, "loads", SCHEMAS)


def new_rows(spark: SparkSession, base: str, table: str, rows: DataFrame) -> DataFrame:
    """``rows`` whose key the table lacks, one of each key."""
    key = ROW_KEYS[table]
    # a null key is no key that a table could hold
    rows = rows.where(F.col(key).isNotNull())
    one = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    if table in JOBS.SNAPSHOT_TABLES:
        known = JOBS.read_table(spark, base, table, SCHEMAS)
    else:
        index = JOBS.KEYS.KEY_COLUMNS[table]
        known = JOBS.read_keys(spark, base, table, rows.select(F.col(index).alias("key")), SCHEMAS)
    return one.join(known.select(key), key, "left_anti").select(*rows.columns)


def bulk_load(spark: SparkSession, csv_dir: str, base: str) -> DataFrame:
    """Load the dataset's files that the ledger lacks; returns (table_name, rows_added), one row for each table."""
    with freed_exchanges(spark):
        return _load(spark, csv_dir, base)


def _load(spark: SparkSession, csv_dir: str, base: str) -> DataFrame:
    batch = JOBS.Batch(spark, base, schemas=SCHEMAS)
    loaded = {(r.bytes, r.digest, r.table_name) for r in ledger(spark, base).select("bytes", "digest", "table_name").collect()}
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    files, rejects, groups = [], None, None
    for table, name, schema in FILES.BULK_FILES:
        path = os.path.join(csv_dir, name)
        if not FILES.path_exists(spark, path):
            continue
        size, digest = file_digest(spark, path)
        if (size, digest, table) in loaded:
            continue
        rows, bad = FILES.bulk_rows(spark, path, schema)
        added = 0
        if table in JOBS.SNAPSHOT_TABLES:
            batch.add(table, JOBS.read_table(spark, base, table, SCHEMAS))
        with JOBS.Slices(rows, ROW_KEYS[table], table) as slices:
            for buckets in slices.groups:
                n = Observation()
                batch.add(table, new_rows(spark, base, table, slices.rows(buckets)).observe(n, F.count(F.lit(1)).alias("n")))
                added += M.observed(n)
                slices.merged(buckets)
        groups = max(groups or [], slices.groups, key=len)
        bad = bad.select(F.lit(name).alias("source"), "reason", "body", F.lit(None).cast("string").alias("user_id"), at.alias("rejected_at"))
        rejects = bad if rejects is None else rejects.unionByName(bad)
        files.append((table, path, size, digest, added))
    if files:
        batch.add("rejects", rejects)
        batch.add("loads", spark.createDataFrame([(*f, now) for f in files], LOADS))
        batch.commit(groups)
    added = {f[0]: f[4] for f in files}
    return spark.createDataFrame([(t, added.get(t, 0)) for t, _, _ in FILES.BULK_FILES], "table_name string, rows_added long")


def read_bulk_tables(spark: SparkSession, base: str) -> Tables:
    r = {t: JOBS.read_table(spark, base, t, SCHEMAS) for t, _, _ in FILES.BULK_FILES}
    return Tables(users=spark.createDataFrame([], S.USERS), events=r["webhook_events"], endpoints=r["endpoints"],
                  attempts=r["delivery_attempts"], replays=r["replay_actions"])
