"""Matrix products, transposition and addition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.numeric import half
from loomgrid.meta import Tensor, TensorError
from loomgrid.operators.contraction import einsum
from loomgrid.operators.sparse import products, sparse_product
from loomgrid.session import written
from loomgrid.sources.layouts import dense, sparse
from loomgrid.sources.tiles import CELLS, SHEET, bundled, cells_of, filled, from_cells, packed, product, rows_of, tile_for, to_cells, together, unbundled

#: Bytes of a coordinate row in a broadcast, and products from which dense operands are multiplied in tiles.
CELL, MANY = 40, 1 << 26
#: Products of non-zeros up to which cells are joined.
FEW = 1 << 16
#: Cells of a bucket of small matrices.
BUCKET = 1 << 18


def small(t: Tensor) -> bool:
    """Whether a tensor's shape bounds it below what the session lets be broadcast."""
    limit = t.df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return t.size * CELL <= limit


def many(a: Tensor, b: Tensor) -> bool:
    """Whether dense operands make so many products that no cells are joined."""
    return a.shape[0] * a.shape[1] * b.shape[1] >= MANY and not (a.sparse or b.sparse)


def strategy_of(a: Tensor, b: Tensor) -> str:
    """"block" for many products of dense operands, else "row" or "column" where a side is small, else "shuffle"."""
    if many(a, b):
        return "block"
    sides = [(t.size, how) for t, how in ((b, "row"), (a, "column")) if small(t)]
    return min(sides)[1] if sides else "shuffle"


def matmul(a: Tensor, b: Tensor, strategy: str | None = None, tile: int | None = None, digits: int | None = None) -> Tensor:
    """A[m, k] @ B[k, n]: "row" (B is broadcast), "column" (A is), "shuffle" (both by k), "block" (dense tiles), or ``strategy_of``.

    A side is broadcast only where its shape bounds it below the session's limit; otherwise the sides are shuffled by k. These ways join
    cells, a row for each product; from ``MANY`` products dense operands are multiplied in tiles whatever way is asked for.
    With ``digits`` the cells of the product are rounded to so many places.
    """
    if a.rank != 2 or b.rank != 2 or a.shape[1] != b.shape[0]:
        raise TensorError(f"matmul of {a.shape} and {b.shape}")
    strategy = strategy or strategy_of(a, b)
    if strategy in ("row", "column", "shuffle") and many(a, b):
        strategy = "block"
    if strategy == "block":
        return block_matmul(a, b, tile, digits=digits)
    if strategy not in ("row", "column", "shuffle"):
        raise TensorError(f"strategy {strategy}")
    if strategy == "row" and small(b):
        b = b.with_df(F.broadcast(b.df))
    if strategy == "column" and small(a):
        a = a.with_df(F.broadcast(a.df))
    out = einsum("ik,kj->ij", a, b)
    return out if digits is None else out.with_df(out.df.withColumn("v", F.round("v", digits) + F.lit(0.0)))


def block_matmul(a: Tensor, b: Tensor, tile: int | None = None, kind: str = "f8", digits: int | None = None) -> Tensor:
    """The product in dense tiles (``sources.tiles``), made once of the cells of either side and moved as they are.

    ``kind`` "f2" makes, moves and multiplies the values of half precision, in a quarter of the bytes. With ``digits`` cells are rounded
    where they are made.
    """
    tile = tile or tile_for(a.shape[0], b.shape[1])
    return to_cells(product(from_cells(a, tile, kind), from_cells(b, tile, kind)), a.sparse or b.sparse, digits)


def gram(df: DataFrame, id_col: str, vector_col: str, block: int | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, v) inner products of all pairs of rows; a pair of blocks of rows meets once, and its products are given both ways, some cells at a time.

    Rows are dealt into blocks by where they stand, so that null or repeated ids fill none. A block is moved as one row of arrays; it has as
    many rows as a task may hold (``HELD`` bytes) while pairs of blocks are enough, unless ``block`` gives their number. With ``digits``
    products are rounded to so many places where they are made (``cells_of``).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows.select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "x", F.xxhash64("at").alias("at")), "rows")
    count, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if block is None:
        block = 256 * together(-(-count // 256), -(-count // 256), 256 * 8 * max(1, width or 0))
    blocks = max(1, -(-count // block))

    def pack(group: pa.Table) -> pa.Table:
        column = lambda c, kind: group[c].combine_chunks().to_numpy(zero_copy_only=False).astype(kind)
        x = np.stack(column("x", object))
        return pa.table({"b": group["b"][:1], "id": [column("id", "i8").tobytes()], "none": [column("none", bool).tobytes()], "x": pa.array([x.tobytes()], pa.binary())})

    own = rows.withColumn("b", F.pmod("at", F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(pack, "b int, id binary, none binary, x binary")
    left = own.select("b", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("b2"), F.lit(0).alias("side"), "id", "none", "x")
    right = own.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b"), F.col("b").alias("b2"), F.lit(1).alias("side"), "id", "none", "x")

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for side, ids, none, x in rows_of(batches, "side", "id", "none", "x"):
            ids = np.frombuffer(ids, "i8")
            held[side] = ids, np.frombuffer(none, bool), np.frombuffer(x).reshape(len(ids), -1)
        if len(held) < 2:
            return
        (i, no_i, x), (j, no_j, y) = held[0], held[1]
        # squares of the size of a sheet, so that the cells of one are of few rows and columns
        edge = math.isqrt(SHEET)
        step = max(1, CELLS // min(edge, len(j)))
        corners = ((r, c) for at in range(0, len(i), edge) for c in range(0, len(j), edge) for r in range(at, min(len(i), at + edge), step))
        pieces = ((r, c, x[r : min(r + step, r - r % edge + edge)] @ y[c : c + edge].T) for r, c in corners)
        for r, c, v in cells_of(pieces, digits):
            one, two = (i[r], no_i[r]), (j[c], no_j[c])
            for (p, no_p), (q, no_q) in ((one, two), (two, one))[: 1 + (key[0].as_py() != key[1].as_py())]:
                yield pa.RecordBatch.from_arrays([p, q, no_p, no_q, v], ["i", "j", "no_i", "no_j", "v"])

    made = left.unionByName(right).groupBy("b", "b2").applyInArrow(product, "i long, j long, no_i boolean, no_j boolean, v double")
    return made.select(F.when(~F.col("no_i"), F.col("i")).alias("i"), F.when(~F.col("no_j"), F.col("j")).alias("j"), "v")


def batch_matmul(a: Tensor, b: Tensor) -> Tensor:
    """A[b, m, k] @ B[b, k, n], or one B[k, n] for all.

    Dense matrices are dealt into buckets of about ``BUCKET`` cells by their number, in bundles of cells; a bucket's matrices are multiplied at once, as arrays.
    A shared B is packed once and sent to every bucket. Sparse operands, and matrices above the size of a bucket, are joined cell by cell.
    """
    shared = b.rank == 2
    if a.rank != 3 or b.rank not in (2, 3) or a.shape[2] != b.shape[-2] or not shared and a.shape[0] != b.shape[0]:
        raise TensorError(f"batch_matmul of {a.shape} and {b.shape}")
    (count, m, k), n = a.shape, b.shape[-1]
    largest = max(m * k, k * n, m * n)
    if a.sparse or b.sparse or largest > BUCKET:
        return einsum("bik,kj->bij" if shared else "bik,bkj->bij", a, b)
    each = max(1, BUCKET // largest)
    bucket = F.floor(F.col("i0") / each).cast("long").alias("bucket")
    left = bundled(a.df.select(bucket, (((F.col("i0") % each) * m + F.col("i1")) * k + F.col("i2")).alias("at"), "v"), "bucket")
    if shared:
        right = packed(b.df.select(F.lit(0).cast("long").alias("one"), (F.col("i0") * n + F.col("i1")).alias("at"), "v"), "one")
        right = right.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-count // each) - 1).cast("long"))).alias("bucket"), "at", "v")
    else:
        right = bundled(b.df.select(bucket, (((F.col("i0") % each) * k + F.col("i1")) * n + F.col("i2")).alias("at"), "v"), "bucket")

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        number = x["bucket"][0].as_py()
        some = min(each, count - number * each)
        one = unbundled(x, each * m * k).reshape(each, m, k)[:some]
        two = filled(y, k * n).reshape(k, n) if shared else unbundled(y, each * k * n).reshape(each, k, n)[:some]
        out = one @ two
        i, r, c = np.unravel_index(np.arange(out.size), out.shape)
        return pa.table({"i0": i + number * each, "i1": r, "i2": c, "v": out.reshape(-1)})

    made = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(multiply, "i0 long, i1 long, i2 long, v double")
    return Tensor(made, (count, m, n))


def matmul_pairs(pairs: list[tuple[Tensor, Tensor]]) -> DataFrame:
    """(pair, i0, i1, v): the products of a list of pairs.

    Dense pairs up to ``BUCKET`` cells a side are multiplied as arrays, one group for each pair; if one is sparse or larger, all are joined by (pair, k).
    """
    for a, b in pairs:
        if a.rank != 2 or b.rank != 2 or a.shape[1] != b.shape[0]:
            raise TensorError(f"matmul of {a.shape} and {b.shape}")
    side = lambda n: _union([p[n].df.select(F.lit(k).cast("long").alias("pair"), *[F.col(c).alias(c) for c in ("i0", "i1", "v")]) for k, p in enumerate(pairs)])
    if all(not (a.sparse or b.sparse) and max(a.size, b.size, a.shape[0] * b.shape[1]) <= BUCKET for a, b in pairs):
        shapes = [(a.shape, b.shape) for a, b in pairs]

        def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
            pair = x["pair"][0].as_py()
            one, two = (np.zeros(s) for s in shapes[pair])
            for whole, part in ((one, x), (two, y)):
                whole[part["i0"].to_numpy(), part["i1"].to_numpy()] = part["v"].to_numpy()
            out = one @ two
            i, j = np.unravel_index(np.arange(out.size), out.shape)
            return pa.table({"pair": np.full(out.size, pair), "i0": i, "i1": j, "v": out.reshape(-1)})

        return side(0).groupBy("pair").cogroup(side(1).groupBy("pair")).applyInArrow(multiply, "pair long, i0 long, i1 long, v double")
    left, right = (side(n) for n in (0, 1))
    left, right = left.select("pair", "i0", F.col("i1").alias("k"), F.col("v").alias("x")), right.select("pair", F.col("i0").alias("k"), "i1", F.col("v").alias("y"))
    return left.join(right, ["pair", "k"]).groupBy("pair", "i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def transpose(t: Tensor, dim0: int = 0, dim1: int = 1) -> Tensor:
    """Swap two axes: index columns change names, nothing moves."""
    order = list(range(t.rank))
    a, b = t.axis(dim0), t.axis(dim1)
    order[a], order[b] = order[b], order[a]
    return t.with_df(t.df.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(order)], *t.values), shape=tuple(t.shape[k] for k in order))


def add(a: Tensor, b: Tensor) -> Tensor:
    """Cell by cell; absent cells of sparse tensors are 0."""
    if a.shape != b.shape or a.complex != b.complex:
        raise TensorError(f"add of {a.shape} and {b.shape}")
    if not (a.sparse or b.sparse):
        right = b.df.select(*a.index, *[F.col(c).alias(f"{c}_b") for c in b.values])
        return a.with_df(a.df.join(right, a.index).select(*a.index, *[(F.col(c) + F.col(f"{c}_b")).alias(c) for c in a.values]))
    both = a.df.unionByName(b.df).groupBy(*a.index).agg(*[F.sum(c).alias(c) for c in a.values])
    return a.with_df(both, sparse=a.sparse and b.sparse)


def matmul_mixed_precision(a: Tensor, b: Tensor, strategy: str | None = None, tile: int | None = None, digits: int | None = None) -> Tensor:
    """The product of the operands rounded to half precision, computed in double; tiles are moved in half precision. ``digits`` as in ``matmul``."""
    how = {"strategy": strategy, "tile": tile, "digits": digits}
    if a.rank == b.rank == 2 and (many(a, b) or (strategy or strategy_of(a, b)) == "block") and a.shape[1] == b.shape[0]:
        return block_matmul(a, b, tile, "f2", digits)
    return matmul(*[t.with_df(t.df.withColumn("v", half(F.col("v")))) for t in (a, b)], **how)


def sparsity(t: Tensor) -> float:
    """Share of the cells that are 0."""
    return 1 - t.df.where("v <> 0").count() / t.size


def matmul_sparse_aware(a: Tensor, b: Tensor, threshold: float = 0.5, dense_output: bool = True, **how) -> Tensor:
    """The product over non-zero cells alone if either operand is sparser than ``threshold``, else ``matmul``.

    One job counts the non-zeros of both and the products that they make; the non-zeros are multiplied in parts (``sparse``), or joined
    cell by cell where so few products are expected that no group is worth making.
    """
    if a.rank != 2 or b.rank != 2 or a.shape[1] != b.shape[0]:
        raise TensorError(f"matmul of {a.shape} and {b.shape}")
    ones, twos, met = products(a, b)
    if max(1 - ones / a.size, 1 - twos / b.size) <= threshold:
        return matmul(a, b, **how)
    out = sparse_product(a, b, (ones, twos)) if met > FEW else einsum("ik,kj->ij", sparse(a), sparse(b))
    return dense(out) if dense_output else out
