"""Order-sensitive jobs give the same rows whatever the partitioning (the
"first"/"last" picks use total orders, never arrival order)."""
import pytest

import __spark_entry__ as E
from paths import SF0001
from tools.oracle_check import digest

ORDER_SENSITIVE = ["label_delivery_outcome", "dedupe_attempts_in_batch", "insert_attempts_if_absent",
                   "first_row_per_event", "upsert_endpoints", "list_events", "features_per_event",
                   "duplicate_events", "describe_features"]


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_same_rows_under_different_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = E.queries()[name](spark, SF0001)
            results.append(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
