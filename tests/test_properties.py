"""Property checks: distributed exact quantiles equal numpy's, whatever the
duplicates, nulls and partition count."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from deliverylens.functions.scalars import truncated_health
from deliverylens.functions.stats import exact_quantiles

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)),
                  min_size=1, max_size=300)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, parts=st.integers(1, 9), probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_property(spark, vals, parts, probs):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {round(r.prob, 12): r.value for r in exact_quantiles(df, ["x"], probs, parts).collect()}
    clean = np.array([v for v in vals if v is not None])
    if clean.size == 0:
        assert got == {}
        return
    for q in probs:
        want = np.quantile(clean, q)
        assert abs(got[round(q, 12)] - want) <= 1e-9 * max(1.0, abs(want))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.integers(0, 1000).flatmap(lambda t: st.tuples(st.integers(0, t), st.just(t))),
                      min_size=1, max_size=50))
def test_truncated_health_property(spark, pairs):
    df = spark.createDataFrame(pairs, "f int, t int")
    got = [r[0] for r in df.select(truncated_health("f", "t")).collect()]
    want = [int((1 - f / t) * 100) if t > 0 else 100 for f, t in pairs]
    assert got == want


def test_label_split_gives_each_label_its_share(spark):
    from pyspark.sql import functions as F

    from deliverylens.ml.split import shuffle_split, stratified_split
    df = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") % 7 == 0).cast("int").alias("is_recovered"))
    got = {(r.is_recovered, r.split): r["count"] for r in stratified_split(df).groupBy("is_recovered", "split").count().collect()}
    assert got == {(1, "test"): 29, (1, "train"): 114, (0, "test"): 171, (0, "train"): 686}
    both = stratified_split(df).withColumnRenamed("split", "s1").join(shuffle_split(df.select("event_id")), "event_id")
    assert both.where("s1 = 'test' and split = 'test'").count() < 80  # independent splits overlap in about 40 rows
