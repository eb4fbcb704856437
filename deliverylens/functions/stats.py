"""Distributed statistics: exact quantiles and one-pass null counts.

``exact_quantiles`` gives the linear-interpolation quantile (numpy's default,
pandas ``describe``, SQL ``quantile_cont``) without pulling a column into one
task.  (value, count) pairs are range-partitioned across the cluster and
written once to the shared folder with the number of their partition; the
partitions' totals (one row a column and partition) tell in which partition
each wanted rank lies, and only those partitions are read again to find the
values.  Spark's own exact ``percentile`` merges a value->count map of the
whole column in a single final task, which does not scale; use
``percentile_approx`` where an approximation is acceptable.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def order_statistics(df: DataFrame, columns: list[str], ranks_of: Callable[[int], list[int]],
                     num_partitions: int | None = None) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """(number of values of each column, value at each asked rank).

    ``ranks_of(n)`` gives the wanted 0-based ranks of a column with n values
    (nulls are ignored); they are few, whatever n is.  Duplicates collapse in
    the map-side partial aggregation first (a value holding a third of the
    rows becomes one row with its count).  The pairs are computed once; the
    partition number is a stored column, so nothing depends on an exchange
    being reused."""
    spark = df.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
        .alias("kv")).select("kv.*").where(F.col("value").isNotNull()))
    pairs = (long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))
             .repartitionByRange(p, "col", "value").withColumn("pid", F.spark_partition_id()))
    path = os.path.join(checkpoint_dir(spark), "quantiles", uuid.uuid4().hex)
    pairs.write.parquet(path)
    pairs = spark.read.schema(pairs.schema).parquet(path)
    totals = pairs.groupBy("col", "pid").agg(F.sum("cnt").alias("total")).collect()  # columns x partitions at most
    n: dict[int, int] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for r in sorted(totals, key=lambda r: (r.col, r.pid)):
        before = n.get(r.col, 0)
        n[r.col] = before + r.total
        spans.setdefault(r.col, []).append((before, n[r.col], r.pid))
    wanted: dict[tuple[int, int, int], set[int]] = {}  # (column, partition, rank of its first value) -> ranks
    for c, size in n.items():
        for rank in ranks_of(size):
            lo, _, pid = next(x for x in spans[c] if x[0] <= rank < x[1])
            wanted.setdefault((c, pid, lo), set()).add(rank)
    sizes = {columns[c]: size for c, size in n.items()}
    if not wanted:
        return sizes, {}
    # few partitions are read again, and a row for each wanted rank comes back
    asked = spark.createDataFrame([(*k, sorted(ranks)) for k, ranks in wanted.items()],
                                  "col int, pid int, before long, ranks array<long>")
    run = F.sum("cnt").over(Window.partitionBy("col", "pid").orderBy("value")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = (pairs.where(F.col("pid").isin(sorted({k for _, k, _ in wanted}))).join(F.broadcast(asked), ["col", "pid"])
            .withColumn("end", F.col("before") + run)
            .select("col", "value", F.explode(F.filter("ranks", lambda x: (x < F.col("end")) & (x >= F.col("end") - F.col("cnt"))))
                    .alias("rank")).collect())
    return sizes, {(columns[r.col], r.rank): r.value for r in hits}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    num_partitions: int | None = None) -> DataFrame:
    """One row per (column_name, prob): the exact linear-interpolation
    quantile of each column (nulls ignored; a column without values has no row)."""
    n, at = order_statistics(
        df, columns, lambda n: [f(q * (n - 1)) for q in probs for f in (math.floor, math.ceil)], num_partitions)
    rows = []
    for c, size in n.items():
        for q in probs:
            pos = float(q) * (size - 1)
            lo, hi = at[c, math.floor(pos)], at[c, math.ceil(pos)]
            rows.append((c, float(q), lo + (hi - lo) * (pos - math.floor(pos))))
    return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")


def exact_quantile_value(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Single-row frame with column ``q`` = the exact quantile of ``column``."""
    return exact_quantiles(df.select(column), [column], [prob]).select(F.col("value").alias("q"))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column in one pass, as rows (column_name, null_count)."""
    aggs = [F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, null_count)")
