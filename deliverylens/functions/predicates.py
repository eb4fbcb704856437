"""Row predicates (P3-P9) as native column expressions.

All of them stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_http_failure(status="http_status") -> Column:
    """Status >= 400; a null status is not a failure."""
    return F.coalesce(_c(status) >= 400, F.lit(False))


def is_delivery_failure(status="http_status", timeout="timeout") -> Column:
    """Status >= 500 or a timeout (three-valued: null status + timeout
    fails, null status without timeout does not)."""
    return F.coalesce((_c(status) >= 500) | _c(timeout), F.lit(False))


def is_success(status="http_status") -> Column:
    """P5: 200 <= status < 300."""
    return F.coalesce((_c(status) >= 200) & (_c(status) < 300), F.lit(False))


def is_client_error(status="http_status") -> Column:
    """400-499."""
    return F.coalesce((_c(status) >= 400) & (_c(status) < 500), F.lit(False))


def is_server_error(status="http_status") -> Column:
    """>= 500."""
    return F.coalesce(_c(status) >= 500, F.lit(False))


def is_timeout(timeout="timeout") -> Column:
    return F.coalesce(_c(timeout), F.lit(False))


def mentions_failed_ci(col="event_type") -> Column:
    """ILIKE '%failed%' (case-insensitive)."""
    return _c(col).ilike("%failed%")


def mentions_failed_cs(col="event_type") -> Column:
    """The UI badge test, case-sensitive ``includes('failed')``."""
    return _c(col).contains("failed")


def tenant_events(events, user_id: str | None):
    """The events of one tenant (all tenants when ``user_id`` is None).
    Applied to the events before any join, so the attempts that survive the
    join are only that tenant's (attempts follow their event's tenant)."""
    return events if user_id is None else events.where(F.col("user_id") == F.lit(user_id))


def count_if(pred: Column) -> Column:
    """Conditional count as a sum of 0/1 (bigint), the way the grouped SQL
    of the reference counts."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
