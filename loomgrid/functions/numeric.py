"""Column expressions that the operations share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half precision: largest finite value, the value from which rounding overflows, step of the subnormals. Fixed values.
HALF_MAX, HALF_OVERFLOW, HALF_STEP = 65504.0, 65520.0, 2.0**-24


def half(v: Column) -> Column:
    """``v`` rounded to half precision (11 significant bits, ties to even), as a double."""
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - 10), F.lit(HALF_STEP))
    rounded = F.bround(v / step) * step
    return F.when(v.isNull() | F.isnan(v) | (v == 0), v).when(F.abs(v) >= HALF_OVERFLOW, F.signum(v) * F.lit(float("inf"))).otherwise(rounded + F.lit(0.0))


def least(v: Column) -> Column:
    """Minimum where a NaN makes the result NaN."""
    return F.when(F.bool_or(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v))


def most(v: Column) -> Column:
    """Maximum where a NaN makes the result NaN (Spark orders NaN last)."""
    return F.max(v)
