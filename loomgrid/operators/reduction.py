"""Sums, means and extremes of a whole tensor or along an axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions.exact import exact_sums
from loomgrid.functions.numeric import least, most
from loomgrid.meta import Tensor


def _reduced(t: Tensor, how: Column, dim: int | None, keepdim: bool) -> Tensor:
    axis = None if dim is None else t.axis(dim)
    others = [] if axis is None else [c for c in t.index if c != f"i{axis}"]
    df = t.df.groupBy(*others).agg(how.alias("v")) if others else t.df.agg(how.alias("v"))
    return _shaped(t, df, axis, others, keepdim)


def _shaped(t: Tensor, df, axis: int | None, others: list[str], keepdim: bool) -> Tensor:
    if keepdim:
        zero = F.lit(0).cast("long")
        shape = tuple(1 if axis is None or k == axis else n for k, n in enumerate(t.shape))
        return Tensor(df.select(*[F.col(c) if c in others else zero.alias(c) for c in t.index], "v"), shape)
    shape = () if axis is None else tuple(n for k, n in enumerate(t.shape) if k != axis)
    return Tensor(df.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(others)], "v"), shape)


def _count(t: Tensor, dim: int | None) -> int:
    return t.size if dim is None else t.shape[t.axis(dim)]


def _with_zeros(t: Tensor, value: Column, dim: int | None, pick) -> Column:
    """An extreme that also sees the absent cells of a sparse tensor."""
    return F.when(F.count("*") < _count(t, dim), pick(value, F.lit(0.0))).otherwise(value) if t.sparse else value


def sum(t: Tensor, dim: int | None = None, keepdim: bool = False) -> Tensor:  # noqa: A001
    return _reduced(t, F.coalesce(F.sum("v"), F.lit(0.0)), dim, keepdim)


def mean(t: Tensor, dim: int | None = None, keepdim: bool = False) -> Tensor:
    return _reduced(t, F.coalesce(F.sum("v"), F.lit(0.0)) / F.lit(float(_count(t, dim))), dim, keepdim)


def max(t: Tensor, dim: int | None = None, keepdim: bool = False) -> Tensor:  # noqa: A001
    return _reduced(t, _with_zeros(t, most(F.col("v")), dim, F.greatest), dim, keepdim)


def min(t: Tensor, dim: int | None = None, keepdim: bool = False) -> Tensor:  # noqa: A001
    def lower(value: Column, zero: Column) -> Column:
        return F.when(F.isnan(value), value).otherwise(F.least(value, zero))

    return _reduced(t, _with_zeros(t, least(F.col("v")), dim, lower), dim, keepdim)


def sum_kahan(t: Tensor, dim: int | None = None, keepdim: bool = False) -> Tensor:
    """The exact sum, rounded once (``functions.exact``): better than compensated, and the same in any order of the rows."""
    axis = None if dim is None else t.axis(dim)
    others = [] if axis is None else [c for c in t.index if c != f"i{axis}"]
    df = exact_sums(t.df.select(*others, "v"), others, rows=_count(t, dim))
    if not others:
        # no rows at all sum to 0
        df = df.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))
    return _shaped(t, df, axis, others, keepdim)


def mean_kahan(t: Tensor, dim: int | None = None, keepdim: bool = False) -> Tensor:
    out = sum_kahan(t, dim, keepdim)
    return out.with_df(out.df.withColumn("v", F.col("v") / F.lit(float(_count(t, dim)))))
