"""Layouts of a tensor and the ways between them: coordinates, rows, blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.meta import Tensor


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """Every index of a shape, from one range."""
    total = int(np.prod(shape)) if shape else 1
    df, step, out = spark.range(total), total, []
    for k, n in enumerate(shape):
        step //= n
        out.append(F.pmod(F.floor(F.col("id") / F.lit(step)), F.lit(n)).cast("long").alias(f"i{k}"))
    return df.select(*out) if out else df.select(F.lit(0).cast("long").alias("unit"))


def coo(df: DataFrame, shape: tuple[int, ...], index: list[str], value: str = "v", sparse: bool = False) -> Tensor:
    """A tensor from rows of index columns and a value."""
    return Tensor(df.select(*[F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(index)], F.col(value).cast("double").alias("v")), tuple(shape), sparse)


def dense(t: Tensor) -> Tensor:
    """With a row for every cell; those that were absent are 0."""
    every = grid(t.df.sparkSession, t.shape)
    df = every.join(t.df, t.index, "left").select(*t.index, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in t.values])
    return t.with_df(df, sparse=False)


def sparse(t: Tensor) -> Tensor:
    """Without the cells that are 0."""
    return t.with_df(t.df.where(" or ".join(f"{c} <> 0" for c in t.values)), sparse=True)


def from_numpy(spark: SparkSession, array: np.ndarray) -> Tensor:
    """A small local array; large ones are read from tables."""
    array = np.asarray(array)
    index = np.indices(array.shape).reshape(array.ndim, -1).T.tolist()
    names = ", ".join(f"i{k} long" for k in range(array.ndim))
    flat = array.reshape(-1)
    if np.iscomplexobj(array):
        rows = [(*i, float(v.real), float(v.imag)) for i, v in zip(index, flat)]
        return Tensor(spark.createDataFrame(rows, f"{names}, re double, im double"), array.shape, complex=True)
    return Tensor(spark.createDataFrame([(*i, float(v)) for i, v in zip(index, flat)], f"{names}, v double"), array.shape)


def to_numpy(t: Tensor) -> np.ndarray:
    """A result gathered on the driver, on request."""
    out = np.zeros(t.shape, complex if t.complex else float)
    for r in t.df.select(*t.index, *t.values).collect():
        out[tuple(r[: t.rank])] = complex(r["re"], r["im"]) if t.complex else r["v"]
    return out


def from_rows(df: DataFrame, shape: tuple[int, ...], index: list[str], array: str) -> Tensor:
    """A tensor whose last axis is an array column."""
    keys = [F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(index)]
    last = f"i{len(index)}"
    out = df.select(*keys, F.posexplode(array).alias(last, "v"))
    return Tensor(out.select(*[f"i{k}" for k in range(len(index))], F.col(last).cast("long").alias(last), F.col("v").cast("double").alias("v")), tuple(shape))


def to_lines(t: Tensor, dim: int = -1) -> tuple[DataFrame, list[str]]:
    """(other index columns..., one array per value column) along ``dim``; absent cells are 0. Lines are as long as the axis."""
    axis = t.axis(dim)
    others = [c for c in t.index if c != f"i{axis}"]
    if t.sparse:
        return to_lines(dense(t), dim)
    lines = t.df.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(F.col(f"i{axis}").alias("at"), *t.values))).alias("cells"))
    return lines.select(*others, *[F.col("cells")[c].alias(c) for c in t.values]), others
