"""Scalar helpers: rounding, truncated health, safe ratios, ids, JSON-safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(col, digits: int) -> Column:
    """Round half away from zero on the binary value: ``round(x*10^d)/10^d``.

    Spark's ``round(x, d)`` rounds the decimal text of a double, which differs
    from binary rounding on values such as 1.005; scaling first and rounding
    to an integer gives the same answer in every engine.
    """
    scale = float(10 ** digits)
    return F.round(_c(col) * F.lit(scale)) / F.lit(scale)


def bround_to(col, digits: int) -> Column:
    """Half-to-even rounding (Python ``round``) on the binary value."""
    scale = float(10 ** digits)
    return F.bround(_c(col) * F.lit(scale)) / F.lit(scale)


def ratio(num, den) -> Column:
    """num / den as double; null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def avg_exact(col) -> Column:
    """Mean with an exact (decimal) sum: ``double(sum(decimal)) / count``.

    A double sum depends on the order partitions are merged in, so a mean
    sitting on a rounding tie could round either way from run to run; the
    decimal sum is order-free (6 decimals kept per value).  Values must be
    below 10^12 in size (``decimal(18,6)``, the compact form; beyond it the
    cast raises); the sum has ten more digits, room for 10^10 such values.
    """
    c = _c(col)
    s = F.sum(c.cast("decimal(18,6)")).cast("double")
    return F.try_divide(s, F.count(c).cast("double"))


def truncated_health(failed, total) -> Column:
    """``int((1 - failed/total) * 100)``, 100 when total is 0.

    Kept in double in that operation order, then truncated: 8 failures of
    10 give 19, not 20.
    """
    h = ((F.lit(1.0) - _c(failed).cast("double") / _c(total).cast("double")) * F.lit(100.0))
    return F.when(_c(total) > 0, F.floor(h).cast("int")).otherwise(F.lit(100))


def surrogate_id(prefix: str, *keys) -> Column:
    """``prefix_`` + the md5 of the key columns, each written with its
    length ('~' for null), so that different keys never encode alike.

    Derived from the key, so a re-run or a re-delivered batch produces the
    same id (idempotent merges); a random uuid would not.
    """
    texts = [_c(k).cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("~")) for x in texts]
    return F.concat(F.lit(prefix + "_"), F.md5(F.concat(*parts)))


def json_safe(df: DataFrame) -> DataFrame:
    """±inf and NaN to null, then numeric nulls to 0 (what the API layer
    does before serialising).  String keys stay null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)
            c = F.coalesce(c, F.lit(0.0))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.DecimalType)):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def ceil_div(n, d) -> Column:
    """Integer ceiling division, ``(n + d - 1) div d`` (n, d >= 0)."""
    return F.floor((_c(n) + _c(d) - F.lit(1)) / _c(d)).cast("bigint")


def with_surrogate_id(df: DataFrame, prefix: str, key_cols: list[str], name: str | None = None) -> DataFrame:
    """S11 as a frame operation: adds ``<prefix>_id`` (or ``name``) derived
    from the key columns."""
    return df.withColumn(name or f"{prefix}_id", surrogate_id(prefix, *key_cols))
