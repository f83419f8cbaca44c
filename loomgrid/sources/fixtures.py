"""Tensors made from the driver tables, with the SQL of the same tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.meta import Tensor
from loomgrid.sources.layouts import coo, dense, from_rows, grid


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> Tensor:
    """E[rows, 64]: all embeddings, by id from 0."""
    df = _table(spark, sf_dir, "embeddings")
    rows = (df.agg(F.max("vec_id")).first()[0] or 0) + 1
    return from_rows(df, (rows, 64), ["vec_id"], "embedding")


def images(spark: SparkSession, sf_dir: str, shape: tuple[int, ...]) -> Tensor:
    """All embeddings as images of ``shape`` (64 cells), rounded to halves so that sums are exact."""
    e = vectors(spark, sf_dir)
    step, index = 64, []
    for n in shape:
        step //= n
        index.append(F.pmod(F.floor(F.col("i1") / step), F.lit(n)).cast("long"))
    cells = e.df.select("i0", *[c.alias(f"i{k + 1}") for k, c in enumerate(index)], (F.floor(F.col("v") * 8) / 2).alias("v"))
    return Tensor(cells, (e.shape[0], *shape))


def images_sql(shape: tuple[int, ...], names: str) -> str:
    step, index = 64, []
    for n, c in zip(shape, names[1:], strict=True):
        step //= n
        index.append(f"(k // {step}) % {n} AS {c}")
    return f"(SELECT i AS {names[0]}, {', '.join(index)}, floor(v * 8) / 2 AS v FROM ({SQL['e']}))"


def _counted(spark: SparkSession, sf_dir: str, shape: tuple[int, ...], **columns) -> Tensor:
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), *[c.cast("long").alias(k) for k, c in columns.items()])
    sums = df.groupBy(*columns).agg(F.sum("q").cast("double").alias("v"))
    return dense(coo(sums, shape, list(columns)))


def matrix_a(spark: SparkSession, sf_dir: str) -> Tensor:
    return _counted(spark, sf_dir, (16, 16), i=F.col("l_orderkey") % 16, j=F.col("l_partkey") % 16)


def matrix_b(spark: SparkSession, sf_dir: str) -> Tensor:
    return _counted(spark, sf_dir, (16, 16), i=F.col("l_orderkey") % 16, j=F.col("l_suppkey") % 16)


def square(spark: SparkSession, sf_dir: str, n: int) -> Tensor:
    """Order and part numbers modulo n against summed quantities: n by n, most cells 0 in small tables."""
    return _counted(spark, sf_dir, (n, n), i=F.col("l_orderkey") % n, j=F.col("l_partkey") % n)


def profile(spark: SparkSession, sf_dir: str, n: int, key: str) -> DataFrame:
    """(i, q): the summed quantities of line items by a key modulo n, for every i below n."""
    sums = _counted(spark, sf_dir, (n,), i=F.col(key) % n)
    return sums.df.select(F.col("i0").alias("i"), F.col("v").cast("long").alias("q"))


def profile_sql(n: int, key: str) -> str:
    return f"SELECT i, CAST(v AS BIGINT) AS q FROM ({_counted_sql((n,), i=f'{key} % {n}')})"


def dense_lines(rows: DataFrame, columns: DataFrame, value) -> DataFrame:
    """(i, x) of a dense matrix: ``value`` of the profiles and places of its row and column, a column expression of (q, p, i, k).

    The columns' profile is one array, which every row reads.
    """
    across = columns.agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("across"))
    both = rows.crossJoin(F.broadcast(across))
    return both.select("i", F.transform("across", lambda c: value(F.col("q"), c["q"], F.col("i"), c["i"]).cast("double")).alias("x"))


def cube(spark: SparkSession, sf_dir: str) -> Tensor:
    return _counted(spark, sf_dir, (7, 8, 8), b=F.col("l_linenumber") - 1, i=F.col("l_orderkey") % 8, j=F.col("l_partkey") % 8)


def thinned(t: Tensor) -> Tensor:
    """About seven cells in ten set to 0."""
    return t.with_df(t.df.withColumn("v", F.when((F.col("i0") * 7 + F.col("i1") * 3) % 10 < 3, F.col("v")).otherwise(0.0)))


def polynomial(spark: SparkSession, shape: tuple[int, ...], factor: int) -> Tensor:
    """Small integers from the indices: (sum of (k + factor) * i_k * (i_k + 1)) mod 7 - 3."""
    index = [f"i{k}" for k in range(len(shape))]
    value = sum((F.lit(k + factor) * F.col(c) * (F.col(c) + 1) for k, c in enumerate(index)), F.lit(0)) % 7 - 3
    return Tensor(grid(spark, shape).withColumn("v", value.cast("double")), shape)


def polynomial_sql(shape: tuple[int, ...], factor: int, names: str) -> str:
    ranges = ", ".join(f"range({n}) t{k}({c})" for k, (n, c) in enumerate(zip(shape, names)))
    value = " + ".join(f"{k + factor} * {c} * ({c} + 1)" for k, c in enumerate(names))
    return f"(SELECT {', '.join(names)}, CAST(({value}) % 7 - 3 AS DOUBLE) AS v FROM {ranges})"


def _counted_sql(shape: tuple[int, ...], **columns: str) -> str:
    names = list(columns)
    ranges = ", ".join(f"range({n}) t{k}({c})" for k, (n, c) in enumerate(zip(shape, names)))
    keys = ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in columns.items())
    return (
        f"SELECT {', '.join(f'g.{c}' for c in names)}, CAST(coalesce(s.v, 0) AS DOUBLE) AS v FROM (SELECT {', '.join(names)} FROM {ranges}) g "
        f"LEFT JOIN (SELECT {', '.join(names)}, sum(q) AS v FROM (SELECT {keys}, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ALL) s USING ({', '.join(names)})"
    )


SQL = {
    "e": "SELECT vec_id AS i, CAST(unnest(range(64)) AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "a": _counted_sql((16, 16), i="l_orderkey % 16", j="l_partkey % 16"),
    "b": _counted_sql((16, 16), i="l_orderkey % 16", j="l_suppkey % 16"),
    "t": _counted_sql((7, 8, 8), b="l_linenumber - 1", i="l_orderkey % 8", j="l_partkey % 8"),
    "s": "SELECT i, j, CASE WHEN (i * 7 + j * 3) % 10 < 3 THEN v ELSE 0 END AS v FROM a",
}


def with_tensors(names: str, query: str) -> str:
    """``query`` after the definitions of the tensors it names."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + ("" if query.startswith(",") else " ") + query
