"""Spark session settings and shared-folder helpers.

Everything heavy runs as DataFrame jobs; the settings here only make
those jobs behave well at scale (AQE, skew handling, UTC) and give the
iterative jobs a shared checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry.  AQE re-plans at runtime: it turns a
# sort-merge join into a broadcast join only when the measured side is under
# the broadcast threshold (a checked size, with the shuffle join beyond it),
# splits skewed join partitions, and coalesces small shuffle partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "deliverylens",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local/test session builder; on a cluster the submitter supplies master
    and sizes, and only BASE_CONF matters."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if master.startswith("local["):  # one JVM: no cluster names a shared folder, take a fresh one
        conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="deliverylens-ckpt-", dir="/tmp"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FALLBACK: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    (driver and executors in one JVM, as in tests) without that setting gets
    a fresh temporary folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        if not _LOCAL_FALLBACK:
            _LOCAL_FALLBACK.append(tempfile.mkdtemp(prefix="deliverylens-ckpt-", dir="/tmp"))
        path = _LOCAL_FALLBACK[0]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


#: Removes the exchange files of a write or an action when it ends, not when the driver's garbage is collected.
FREE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_exchanges(*sessions: SparkSession) -> Iterator[None]:
    """What is run in here leaves no exchange files behind, so a job of many
    steps needs the disk of its largest one.  No frame may be run twice in it."""
    before = [(s, s.conf.get(FREE_EXCHANGES, "false")) for s in sessions]
    for s in sessions:
        s.conf.set(FREE_EXCHANGES, "true")
    try:
        yield
    finally:
        for s, value in reversed(before):
            s.conf.set(FREE_EXCHANGES, value)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what several jobs
    read is computed once, and a lost executor costs one stage."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new place for a staged table."""
    return os.path.join(checkpoint_dir(spark), "staged", uuid.uuid4().hex, name)
