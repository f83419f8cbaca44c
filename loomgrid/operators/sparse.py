"""Products of sparse matrices in compressed parts dealt by their non-zeros.

The rows of A are cut into ranges with about equally many non-zeros, the columns of B likewise: the cuts are quantiles of the places of the
non-zeros, so rows that are fuller than others make narrow ranges. A part is the non-zeros of a range in binary columns (row,
column, value), made where the cells are and moved as such. A range of rows meets a range of columns in one group, which expands its products a
bounded number at a time and sums them by place: in a dense array if the two ranges span a small one, else by sorted places. No result
is shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError
from loomgrid.sources.layouts import sparse
from loomgrid.sources.tiles import rows_of

#: Non-zeros of a part, products that are expanded at a time, cells of a dense sum.
PART, EXPANDED, DENSE = 1 << 17, 1 << 21, 1 << 22
#: Ranges of an axis at most; beyond, parts are larger.
RANGES = 4096


def products(a: Tensor, b: Tensor) -> tuple[int, int, int]:
    """(non-zeros of A, non-zeros of B, scalar products of non-zeros) of A @ B, in one job."""
    count = lambda t, axis, n: t.df.where("v <> 0").groupBy(F.col(axis).alias("k")).agg(F.count("*").alias(n))
    both = count(a, "i1", "a").join(count(b, "i0", "b"), "k", "full").fillna(0, ["a", "b"])
    row = both.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("a", "b")], F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()
    return tuple(row)


def cuts(t: Tensor, axis: str, count: int) -> np.ndarray:
    """First places of the ranges of an axis after the first one, for about ``PART`` non-zeros each."""
    ranges = min(RANGES, max(1, -(-count // PART)))
    if ranges == 1:
        return np.zeros(0, np.int64)
    at = F.percentile_approx(axis, [k / ranges for k in range(1, ranges)], 10 * ranges)
    return np.unique(np.array(t.df.agg(at).first()[0], np.int64))


def parts(t: Tensor, axis: int, ends: np.ndarray) -> DataFrame:
    """(range, rows, columns, values): the non-zeros of each range of an axis, as far as they stand together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = [b.column(c).to_numpy() for c in ("i0", "i1")]
            v = b.column("v").to_numpy()
            of = np.searchsorted(ends, index[axis], side="right")
            for r in np.unique(of):
                here = of == r
                data = [x[here].tobytes() for x in (*index, v)]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], ["range", "rows", "columns", "values"])

    return t.df.select(F.col("i0").cast("long"), F.col("i1").cast("long"), "v").mapInArrow(cut, "range int, rows binary, columns binary, values binary")


def expanded(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, sums) of the product of two sets of non-zeros (row, column, value)."""
    order = np.argsort(b[0], kind="stable")
    b = tuple(x[order] for x in b)
    first, last = np.searchsorted(b[0], a[1], "left"), np.searchsorted(b[0], a[1], "right")
    met = last > first
    ai, av, first, many = a[0][met], a[2][met], first[met], (last - first)[met]
    if not len(ai):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    top, left = ai.min(), b[1].min()
    high, wide = int(ai.max() - top) + 1, int(b[1].max() - left) + 1
    whole = high * wide <= DENSE
    total, seen, some = (np.zeros(high * wide), np.zeros(high * wide, bool), []) if whole else (None, None, [])
    ends = np.cumsum(many)
    at = 0
    while at < len(ai):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
        n = many[at:to]
        which = np.repeat(np.arange(at, to), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
        key = (ai[which] - top) * wide + (b[1][place] - left)
        value = av[which] * b[2][place]
        if whole:
            total += np.bincount(key, value, high * wide)
            seen[key] = True
        else:
            keys, back = np.unique(key, return_inverse=True)
            some.append((keys, np.bincount(back, value)))
        at = to
    if whole:
        keys = np.flatnonzero(seen)
        sums = total[keys]
    else:
        keys, back = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([v for _, v in some]))
    return keys // wide + top, keys % wide + left, sums


def sparse_product(a: Tensor, b: Tensor, nonzeros: tuple[int, int] | None = None) -> Tensor:
    """A @ B over non-zero cells alone; the result has the cells that any product falls on."""
    if a.rank != 2 or b.rank != 2 or a.shape[1] != b.shape[0]:
        raise TensorError(f"matmul of {a.shape} and {b.shape}")
    a, b = sparse(a), sparse(b)
    nonzeros = nonzeros or products(a, b)[:2]
    above, beside = cuts(a, "i0", nonzeros[0]), cuts(b, "i1", nonzeros[1])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    data = [F.col(c).alias(c) for c in ("rows", "columns", "values")]
    left = parts(a, 0, above).select(F.col("range").alias("bi"), every(len(beside)).alias("bj"), *data)
    right = parts(b, 1, beside).select(every(len(above)).alias("bi"), F.col("range").alias("bj"), *data)

    def joined(group: pa.Table) -> tuple[np.ndarray, ...]:
        found = list(rows_of([group], "rows", "columns", "values"))
        return tuple(np.concatenate([np.zeros(0, kind), *(np.frombuffer(f[k], kind) for f in found)]) for k, kind in enumerate((np.int64, np.int64, np.float64)))

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j, v = expanded(joined(x), joined(y))
        return pa.table({"i0": i, "i1": j, "v": v})

    made = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInArrow(multiply, "i0 long, i1 long, v double")
    return Tensor(made, (a.shape[0], b.shape[1]), sparse=True)
