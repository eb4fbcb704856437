"""Mergeable sketches for the approximate forms of A7 (distinct events) and A10 (quantiles).

A *state* row holds, for one tenant and day, an HLL sketch of the event ids, a KLL
sketch of the response times and the number of rows.  States of new days are added
to stored ones without reading old rows again, and any coarser level (a month, a
tenant, everything) is a merge of states, of merged ones too.  Both sketches have a size that does not grow with the data, and
Spark builds them in each task before the shuffle.

Bounds: a count is within ``COUNT_ERROR`` of the exact one and a quantile's rank
within ``RANK_ERROR`` of the asked one (about three standard errors of sketches
with ``LG_K`` and ``KLL_K``).  Nulls are not counted; a state without values has
null quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
COUNT_ERROR, RANK_ERROR = 0.05, 0.02


def daily_states(rows: DataFrame, group: str = "user_id", time: str = "attempted_at", distinct: str = "event_id",
                 value: str = "response_time_ms") -> DataFrame:
    """(group, day, distinct_state, value_state, rows)."""
    return (rows.groupBy(group, F.to_date(time).alias("day"))
            .agg(F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("distinct_state"),
                 F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("value_state"),
                 F.count(F.lit(1)).alias("rows")))


def merged(states: DataFrame, *keys) -> DataFrame:
    """States of a coarser level: one row for each value of ``keys`` (none: one row)."""
    return (states.groupBy(*keys)
            .agg(F.hll_union_agg("distinct_state").alias("distinct_state"), F.kll_merge_agg_double("value_state").alias("value_state"),
                 F.sum("rows").alias("rows")))


def estimates(states: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The states' other columns with distinct_count and a quantile for each of ``probs`` (q25, q50, ...)."""
    n = F.kll_sketch_get_n_double("value_state")
    quantiles = [F.when(n > 0, F.kll_sketch_get_quantile_double("value_state", F.lit(float(p)))).alias(f"q{round(100 * p)}") for p in probs]
    return states.select(*[c for c in states.columns if not c.endswith("_state")],
                         F.hll_sketch_estimate("distinct_state").alias("distinct_count"), n.alias("n_values"), *quantiles)


def against_exact(rows: DataFrame, estimated: DataFrame, group: str = "user_id", distinct: str = "event_id",
                  value: str = "response_time_ms") -> DataFrame:
    """For each group the exact count and whether the estimates keep their bounds."""
    q = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    est = estimated.select(F.col(group).alias("_g"), "distinct_count", *q)
    v = F.col(value).cast("double")
    exact = (rows.join(est, F.col(group) == F.col("_g")).groupBy(group, "distinct_count", *q)
             .agg(F.count_distinct(distinct).alias("exact_count"), F.count(value).alias("n_values"),
                  *[F.count_if(v < F.col(c)).alias(f"{c}_below") for c in q], *[F.count_if(v <= F.col(c)).alias(f"{c}_upto") for c in q]))
    near = F.abs(F.col("distinct_count") - F.col("exact_count")) <= COUNT_ERROR * F.col("exact_count")

    def ok(c: str, p: float):
        n = F.col("n_values")
        return ((F.col(f"{c}_below") <= (p + RANK_ERROR) * n + 1) & (F.col(f"{c}_upto") >= (p - RANK_ERROR) * n - 1)).alias(f"{c}_ok")

    return exact.select(group, "exact_count", "n_values", near.alias("count_ok"), *[ok(c, p) for c, p in q.items()])
