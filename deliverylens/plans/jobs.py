"""End-to-end ingest jobs (M11, S7) over a versioned parquet table store.

Store layout under ``base`` (a folder in shared storage):

* ``<table>/batch=<id>/``: what one batch wrote to the table -- only the
  new rows for the append-only tables (events, attempts, replays, rejects),
  a full snapshot for ``endpoints`` (its rows are updated in place);
* ``<table>/batch=<id>/bucket=<n>/`` for the keyed ones (events, attempts,
  replays), with ``_index/<table>/batch=<id>``: see :mod:`.key_index`;
* ``_commits/<number>.json``: one file per committed version, a line for each
  table with the batch that wrote it.

A batch reads the store at some version, writes its tables under an id of
its own, and then creates the next commit file.  Creating a file that exists
fails, so of two writers that read the same version one commits and the
other gets :class:`ConcurrentCommit`; it reruns its batch on the new state.
Readers take only batches that a commit file names *for that table* (a
partition-pruned scan): a batch is visible whole or not at all, and folders
left by a crash are never read.  Merges are idempotent (anti joins on keys,
key-derived ids), so re-running a batch, or a micro-batch replayed after a
failure, adds nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import ingest as M
from ..session import freed_exchanges, staged_path
from ..sources import files as FILES
from ..tables import Tables
from . import key_index as KEYS

APPEND_TABLES = ["webhook_events", "delivery_attempts", "replay_actions", "rejects"]
SNAPSHOT_TABLES = ["endpoints"]
SCHEMAS = {"webhook_events": S.WEBHOOK_EVENTS, "delivery_attempts": S.DELIVERY_ATTEMPTS,
           "replay_actions": S.REPLAY_ACTIONS, "endpoints": S.ENDPOINTS, "users": S.USERS, "rejects": S.REJECTS}
#: Bytes of an upload's copy that are merged at a time.
SLICE_BYTES = 256 << 20
COMMITS = "_commits"
COMMIT_SCHEMA = "version long, table_name string, batch string, committed_at string"


class ConcurrentCommit(RuntimeError):
    """Another batch has committed since this one read the store."""


def _exists(spark: SparkSession, path: str) -> bool:
    return FILES.path_exists(spark, path)


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table written by bucket has any folder of rows."""
    return FILES.path_exists(spark, path) and FILES.any_match(spark, os.path.join(path, "bucket=*"))


def commits(spark: SparkSession, base: str) -> DataFrame:
    """One row per committed version and table."""
    p = os.path.join(base, COMMITS)
    if not _exists(spark, p):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).json(p)


def last_version(spark: SparkSession, base: str) -> int:
    """The highest commit number taken, -1 in an empty store."""
    p = os.path.join(base, COMMITS)
    if not _exists(spark, p):
        return -1
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(p).select("path")
    v = names.agg(F.max(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long"))).first()[0]  # a single number
    return -1 if v is None else int(v)


def read_table(spark: SparkSession, base: str, table: str, schemas: dict | None = None) -> DataFrame:
    """The committed state of a table (empty with its schema if none)."""
    schema = (schemas or SCHEMAS)[table]
    path = os.path.join(base, table)
    log = commits(spark, base).where(F.col("table_name") == table)
    if table in SNAPSHOT_TABLES:
        log = log.orderBy(F.desc("version")).limit(1)
    # the committed batches' own folders, one row each: what a crash has left behind is not even listed
    folders = [os.path.join(path, f"batch={r.batch}") for r in log.select("batch").distinct().collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", path).parquet(*sorted(folders))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def pruned_folders(spark: SparkSession, base: str, table: str, keys: DataFrame) -> tuple[list[str], int]:
    """(folders of committed files that may hold a row with one of ``keys`` (column key), folders in all)."""
    log = [r.batch for r in commits(spark, base).where(F.col("table_name") == table).select("batch").distinct().collect()]
    indexed = [b for b in log if _exists(spark, KEYS.index_path(base, table, b))]
    sidecar = KEYS.read_index(spark, base, table, indexed)
    hits = [(r.batch, r.bucket) for r in KEYS.folders_with(sidecar, keys).collect()] if indexed else []  # names of folders
    whole = [b for b in log if b not in set(indexed)]
    found = [os.path.join(base, table, f"batch={b}", f"bucket={n}") for b, n in sorted(hits)]
    return found + [os.path.join(base, table, f"batch={b}") for b in sorted(whole)], sidecar.count() + len(whole)


def read_keys(spark: SparkSession, base: str, table: str, keys: DataFrame, schemas: dict | None = None) -> DataFrame:
    """The committed rows of the files that may hold one of ``keys`` (column
    key): all rows with such a key, and few others."""
    folders, _ = pruned_folders(spark, base, table, keys)
    schema = (schemas or SCHEMAS)[table]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", os.path.join(base, table)).parquet(*folders)


def lookup(spark: SparkSession, base: str, table: str, keys: DataFrame) -> DataFrame:
    """P1 on the store: the committed rows with one of ``keys`` (column key)."""
    column = KEYS.KEY_COLUMNS[table]
    return read_keys(spark, base, table, keys).join(keys.select(F.col("key").alias(column)).distinct(), column, "left_semi")


def read_tables(spark: SparkSession, base: str, users: DataFrame | None = None) -> Tables:
    return Tables(users=users if users is not None else spark.createDataFrame([], S.USERS),
                  events=read_table(spark, base, "webhook_events"),
                  endpoints=read_table(spark, base, "endpoints"),
                  attempts=read_table(spark, base, "delivery_attempts"),
                  replays=read_table(spark, base, "replay_actions"))


class Batch:
    """One batch while it is written: each table's rows in one part or several,
    then the key index and the commit file.  Until then nobody reads it."""

    def __init__(self, spark: SparkSession, base: str, seen: int | None = None, schemas: dict | None = None):
        self.spark, self.base, self.schemas = spark, base, schemas or SCHEMAS
        self.seen = last_version(spark, base) if seen is None else seen  # the version that the batch read
        self.id = f"b{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def path(self, table: str) -> str:
        return os.path.join(self.base, table, f"batch={self.id}")

    def add(self, table: str, df: DataFrame) -> None:
        """Write rows of a table; a part that was added before stays."""
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schemas[table].fields])
        key = KEYS.KEY_COLUMNS.get(table)
        if table not in self.tables:
            self.tables.append(table)
        if key is None:
            out.write.mode("append").parquet(self.path(table))
            return
        # a bucket's rows go to few tasks; one that is too large for a task is split, small ones share one
        dealt = out.withColumn("bucket", KEYS.bucket_of(F.col(key))).hint("rebalance", "bucket")
        dealt.write.mode("append").partitionBy("bucket").parquet(self.path(table))

    def _index(self, table: str, key: str, groups: list[list[int]]) -> None:
        to, path = KEYS.index_path(self.base, table, self.id), self.path(table)
        if not _has_rows(self.spark, path):
            self.spark.createDataFrame([], KEYS.SIDECAR).write.mode("errorifexists").parquet(to)
            return
        for buckets in groups:
            rows = self.spark.read.schema(f"{key} string, bucket int").parquet(path)
            if len(groups) > 1:
                rows = rows.where(F.col("bucket").isin(buckets))
            KEYS.sidecar_of(rows, key).write.mode("append").parquet(to)

    def commit(self, groups: list[list[int]] | None = None) -> tuple[int, str]:
        """Index the tables, a group of buckets at a time, and create the commit file; returns (version, batch)."""
        for table in self.tables:
            if table in KEYS.KEY_COLUMNS:
                self._index(table, KEYS.KEY_COLUMNS[table], groups or [list(range(KEYS.BUCKETS))])
        version = self.seen + 1
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        lines = [json.dumps({"version": version, "table_name": t, "batch": self.id, "committed_at": now}) for t in self.tables]
        if not FILES.create_file(self.spark, os.path.join(self.base, COMMITS, f"{version:012d}.json"), "\n".join(lines) + "\n"):
            raise ConcurrentCommit(f"version {version} was committed by another batch; run this one again")
        return version, self.id


def commit_batch(spark: SparkSession, base: str, writes: dict[str, DataFrame], seen: int | None = None,
                 schemas: dict | None = None) -> tuple[int, str]:
    """Write each table's rows under a new batch id, then create the commit
    file after ``seen`` (the version the batch read); returns (version, batch)."""
    batch = Batch(spark, base, seen, schemas)
    for table, df in writes.items():
        batch.add(table, df)
    return batch.commit()


class Slices:
    """An upload's rows in the shared folder, cut by a key's bucket.

    A merge runs on one group of buckets at a time, with as many groups as make
    each about ``SLICE_BYTES`` (one for a small upload), and each group's copy is
    removed when it has been merged: the exchanges on disk at any time are those
    of one group, and the copy shrinks as the store grows."""

    def __init__(self, rows: DataFrame, key: str, name: str):
        self.spark, self.schema = rows.sparkSession, rows.schema
        self.path = staged_path(self.spark, name)
        dealt = rows.withColumn("_slice", KEYS.bucket_of(F.col(key).cast("string")))
        dealt.write.option("compression", "zstd").partitionBy("_slice").parquet(self.path)
        n = min(KEYS.BUCKETS, max(1, -(-FILES.bytes_under(self.spark, self.path) // SLICE_BYTES)))
        self.groups = [[b for b in range(KEYS.BUCKETS) if b * n // KEYS.BUCKETS == i] for i in range(n)]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        df = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(self.path)
        if buckets is not None and len(self.groups) > 1:
            df = df.where(F.col("_slice").isin(buckets))
        return df.drop("_slice")

    def merged(self, buckets: list[int]) -> None:
        """These buckets are not read again."""
        for b in buckets:
            FILES.remove(self.spark, os.path.join(self.path, f"_slice={b}"))

    def __enter__(self) -> Slices:
        return self

    def __exit__(self, *failure) -> None:
        FILES.remove(self.spark, os.path.dirname(self.path))


@contextmanager
def briefly_staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder, until the block ends."""
    path = staged_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        FILES.remove(df.sparkSession, os.path.dirname(path))


def _united(parts: list[DataFrame]) -> DataFrame:
    """The few rows that each slice has left for a table which is merged whole."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _order(df: DataFrame) -> Column:
    if "ord" in df.columns:
        return F.col("ord")
    # rows without a position: their own content orders them, so the result depends on nothing else
    return F.struct(*[F.col(c).cast("string") for c in sorted(df.columns)])


def _load_time(load_ts: dt.datetime | None) -> Column:
    """The ingest time given to rows that carry none (one value for the whole batch)."""
    at = load_ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def check_uploaders(uploaders: DataFrame, users: DataFrame | None) -> None:
    """Q2 for an upload: every uploading tenant must exist, else the whole
    batch is rejected (the original fails on the foreign key)."""
    if users is None:
        return
    unknown = (uploaders.select("user_id").where(F.col("user_id").isNotNull()).distinct()
               .join(users.select("user_id"), "user_id", "left_anti").limit(5).collect())
    if unknown:
        raise ValueError(f"unknown user_id in upload: {[r.user_id for r in unknown]}")


def _rejected(rows: DataFrame, source: str, reason: Column, load_ts: Column) -> DataFrame:
    """Rejected rows as data: reason and the row's own text."""
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns if not c.startswith("_") and c not in ("ord", "reject_reason")]))
    if FILES.CORRUPT in rows.columns:
        body = F.coalesce(F.col(FILES.CORRUPT), body)
    return rows.select(F.lit(source).alias("source"), reason.alias("reason"), body.alias("body"), "user_id",
                       load_ts.alias("rejected_at"))


def ingest_csv_batch(spark: SparkSession, raw: DataFrame, base: str, user_id: str | None = None,
                     users: DataFrame | None = None, mode: str = "strict",
                     load_ts: dt.datetime | None = None) -> DataFrame:
    """M11 (CSV path) on a frame of text rows: S3 -> M6 -> M2 -> M3 -> M4,
    committed as one batch; returns the M9 report.  The uploading tenant is
    ``user_id`` or, without it, the rows' own ``user_id`` column.  With
    ``users`` given, an upload by an unknown tenant is rejected before
    anything is written.  ``mode`` is M5's; ``load_ts`` dates rows without a
    time.  Rejected rows go to the ``rejects`` table."""
    if user_id is None and "user_id" not in raw.columns:
        raise ValueError("an upload needs a user_id")
    rows = raw.withColumn("_ord", _order(raw))
    if user_id is not None:
        rows = rows.withColumn("user_id", F.lit(user_id))
    if "ord" in rows.columns:
        rows = rows.drop("ord")  # it is _ord
    with freed_exchanges(spark, rows.sparkSession):
        return _ingest_csv(spark, rows, base, users, mode, load_ts)


def _ingest_csv(spark: SparkSession, rows: DataFrame, base: str, users: DataFrame | None, mode: str, load_ts: dt.datetime | None) -> DataFrame:
    check_uploaders(rows, users)
    batch, now = Batch(spark, base), _load_time(load_ts)
    endpoints, counts = [], dict.fromkeys(("events", "valid", "attempts"), 0)
    # the upload is read once: all tables, the rejects and the report come from this copy
    with ExitStack() as kept:
        upload = kept.enter_context(Slices(M.coerced_beside_text(rows), "event_id", "upload"))
        reason = F.when(F.col("event_id").isNull(), "missing:event_id").otherwise("bad:attempt_number")
        bad, rejected = upload.rows().where(~F.col("is_valid")).drop("is_valid"), Observation()
        batch.add("rejects", _rejected(bad, "csv", reason, now).observe(rejected, F.count(F.lit(1)).alias("n")))
        for buckets in upload.groups:
            typed = M.coerce_attempts(upload.rows(buckets).drop("is_valid"))
            valid = typed.where(F.col("is_valid"))
            with briefly_staged(M.first_of_event(valid, F.col("_ord"), "user_id"), "first") as first:
                # of the stored events and attempts only files that may hold this upload's keys are read
                keys = first.select(F.col("event_id").alias("key"))
                endpoints.append(kept.enter_context(briefly_staged(M.endpoint_candidates(first, F.col("user_id")), "endpoints")))
                events = M.insert_events_if_absent(read_keys(spark, base, "webhook_events", keys), first, F.lit(0), load_ts=now)
                batch.add("webhook_events", events.where(F.col("inserted")))
                given = F.col("attempted_at").try_cast("timestamp_ntz") if "attempted_at" in valid.columns else F.lit(None).cast("timestamp_ntz")
                rows = valid.select("event_id", *M.ATTEMPT_COLUMNS, "user_id", "_ord", F.coalesce(given, now).alias("attempted_at"))
                stored = read_keys(spark, base, "delivery_attempts", keys).join(first.select("event_id"), "event_id", "left_semi")
                new_attempts = M.insert_attempts_if_absent(stored, M.with_first_row(rows, first).drop("event_type", "customer_id"), F.col("_ord"), mode=mode,
                                                           prune_by_batch=False)
                # ids from the key and, among rows repeated under it (mode "reference"), their rank in input order
                new_attempts, inserted = M.with_attempt_ids(new_attempts, F.col("_ord")), Observation()
                batch.add("delivery_attempts", new_attempts.observe(inserted, F.count(F.lit(1)).alias("n")))
            counts["attempts"] += M.observed(inserted)
            ids = typed.groupBy("event_id").agg(F.max("is_valid").alias("v")).agg(F.count("event_id"), F.count(F.when(F.col("v"), F.col("event_id")))).first()
            counts["events"], counts["valid"] = counts["events"] + ids[0], counts["valid"] + ids[1]
            upload.merged(buckets)
        batch.add("endpoints", M.insert_endpoints_if_absent(read_table(spark, base, "endpoints"), _united(endpoints), F.col("user_id")))
    batch.commit(upload.groups)
    return M.counted_report(spark, counts["events"], counts["valid"], M.observed(rejected), counts["attempts"])


def ingest_json_batch(spark: SparkSession, docs: DataFrame, base: str, user_id: str,
                      users: DataFrame | None = None, mode: str = "strict",
                      load_ts: dt.datetime | None = None) -> DataFrame:
    """M11 (document path) on parsed documents: S5 -> M1 -> M3 -> M8 ->
    M4 -> M7, committed as one batch; returns per-table row counts plus
    the number of rejected documents.  Every row gets the uploading tenant
    ``user_id``; rejected documents go to the ``rejects`` table."""
    if user_id is None:
        raise ValueError("an upload needs a user_id")
    docs = docs.withColumn("user_id", F.lit(user_id))
    with freed_exchanges(spark, docs.sparkSession):
        return _ingest_json(spark, docs, base, user_id, users, mode, load_ts)


def _ingest_json(spark: SparkSession, docs: DataFrame, base: str, user_id: str, users: DataFrame | None, mode: str,
                 load_ts: dt.datetime | None) -> DataFrame:
    check_uploaders(spark.createDataFrame([(user_id,)], "user_id string"), users)
    batch, now = Batch(spark, base), _load_time(load_ts)
    corrupt = FILES.CORRUPT if FILES.CORRUPT in docs.columns else None
    endpoints, counts = [], {"webhook_events": 0, "delivery_attempts": 0, "replay_actions": 0}
    # the documents are parsed once: what passes and what doesn't are written before the tables are
    with ExitStack() as kept:
        judged = kept.enter_context(Slices(M.judge_logs(docs, corrupt), "event_id", "documents"))
        rejected, failed = Observation(), M.split_logs(judged.rows())[1]
        batch.add("rejects", _rejected(failed, "json", F.col("reject_reason"), now).observe(rejected, F.count(F.lit(1)).alias("n")))

        def add(table: str, df: DataFrame) -> None:
            n = Observation()
            batch.add(table, df.observe(n, F.count(F.lit(1)).alias("n")))
            counts[table] += M.observed(n)

        for buckets in judged.groups:
            ok, _ = M.split_logs(judged.rows(buckets))
            first = F.element_at("delivery_attempts", 1)
            # equal first attempts: the document's own text decides
            order = F.struct(first["attempted_at"].try_cast("timestamp_ntz"), first["attempt_id"],
                             F.to_json(F.struct("event_id", "event_type", "customer_id", "endpoint", "delivery_attempts", "replay_history")))
            ok = ok.withColumn("_ord", order)
            keys = ok.select(F.col("event_id").alias("key"))
            endpoints.append(kept.enter_context(briefly_staged(M.latest_payloads(ok, F.col("_ord")), "endpoints")))
            ev_rows = ok.select("event_id", "event_type", "customer_id", "user_id", "_ord")
            events = M.insert_events_if_absent(read_keys(spark, base, "webhook_events", keys), ev_rows, F.col("_ord"), load_ts=now)
            add("webhook_events", events.where(F.col("inserted")))
            att = M.explode_attempts(ok).withColumn("_ord", F.struct("attempted_at", "attempt_id", "doc_pos"))
            stored = read_keys(spark, base, "delivery_attempts", keys).join(keys.select(F.col("key").alias("event_id")).distinct(), "event_id", "left_semi")
            new_attempts = M.insert_attempts_if_absent(stored, att, F.col("_ord"), mode=mode, prune_by_batch=False)
            add("delivery_attempts", new_attempts.withColumn("attempted_at", F.coalesce("attempted_at", now)))
            replays = M.dedupe_replays(M.expand_replays(ok, ["_ord"]), F.col("_ord")).drop("_ord").withColumn("replayed_at", now)
            with briefly_staged(replays, "replays") as replays:
                known = read_keys(spark, base, "replay_actions", replays.select(F.col("replay_id").alias("key")))
                add("replay_actions", replays.join(known.select("replay_id"), "replay_id", "left_anti"))
            judged.merged(buckets)
        batch.add("endpoints", M.upsert_endpoints(read_table(spark, base, "endpoints"), _united(endpoints), F.col("_ord")).drop("change"))
    batch.commit(judged.groups)
    return spark.createDataFrame([*counts.items(), ("rejected_documents", M.observed(rejected))], "item string, n long")


def ingest_csv_job(spark: SparkSession, path: str | list[str], base: str, user_id: str,
                   users: DataFrame | None = None, **options) -> DataFrame:
    """S1 + S2 + M11: read an upload (file, folder or list of files) and ingest it."""
    return ingest_csv_batch(spark, FILES.read_attempts_csv(spark, path), base, user_id, users, **options)


def ingest_json_job(spark: SparkSession, path: str, base: str, user_id: str, multiline: bool = True,
                    users: DataFrame | None = None, **options) -> DataFrame:
    """S4 + M11: read log documents and ingest them."""
    return ingest_json_batch(spark, FILES.read_logs_json(spark, path, multiline), base, user_id, users, **options)
