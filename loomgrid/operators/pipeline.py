"""Chunked products and all-reduce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError
from loomgrid.operators.matrix import matmul, strategy_of
from loomgrid.session import written
from loomgrid.sources.tiles import from_cells, product, tile_for, to_cells


def pipelined_matmul(a: Tensor, b: Tensor, num_chunks: int = 4, **how) -> Tensor:
    """The product in row ranges of A; Spark runs the ranges' tasks as they become free.

    Dense operands with many products are made into tiles once, which are written for all ranges; a range is rows of tiles.
    """
    if a.rank == b.rank == 2 and a.shape[1] == b.shape[0] and (how.get("strategy") or strategy_of(a, b)) == "block":
        tile = how.get("tile") or tile_for(a.shape[0], b.shape[1])
        left, right = (t.with_df(written(t.df, "tiles")) for t in (from_cells(a, tile), from_cells(b, tile)))
        rows, parts = left.grid[0], max(1, min(num_chunks, left.grid[0]))
        ranges = [product(left.with_df(left.df.where(F.col("bi").between(rows * k // parts, rows * (k + 1) // parts - 1))), right) for k in range(parts)]
        every = ranges[0].df
        for r in ranges[1:]:
            every = every.unionByName(r.df)
        return to_cells(ranges[0].with_df(every), sparse=a.sparse or b.sparse)
    chunks = max(1, min(num_chunks, a.shape[0]))
    out, ends = None, [a.shape[0] * k // chunks for k in range(chunks + 1)]
    for begin, end in zip(ends, ends[1:]):
        part = matmul(a.with_df(a.df.where(F.col("i0").between(begin, end - 1))), b, **how).df
        out = part if out is None else out.unionByName(part)
    return Tensor(out, (a.shape[0], b.shape[1]), sparse=a.sparse or b.sparse)


def pipelined_allreduce(contributions: DataFrame, shape: tuple[int, ...], num_chunks: int = 4) -> Tensor:
    """The sum over contributors of (rank, i0, ..., v); partial sums are made before the exchange.

    num_chunks is accepted for its meaning elsewhere: the exchange is cut by Spark's partitions.
    """
    if num_chunks < 1:
        raise TensorError("num_chunks is at least 1")
    index = [f"i{k}" for k in range(len(shape))]
    return Tensor(contributions.groupBy(*index).agg(F.sum("v").alias("v")), tuple(shape))
