"""Named queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.meta import Tensor
from loomgrid.operators import contraction, convolution, fourier, matrix, pipeline, reduction, stencil
from loomgrid.session import ship
from loomgrid.sources import fixtures as fx
from loomgrid.sources import tiles
from loomgrid.sources.layouts import coo, from_rows, sparse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[name], ORACLE[name] = run, sql
        return f

    return add


def shown(t: Tensor, names: str, digits: int | None = None) -> DataFrame:
    """The cells with single-letter index names, values rounded where they are not exact."""
    value = lambda c: (F.round(c, digits) + F.lit(0.0) if digits is not None else F.col(c)).alias(c)
    return t.df.select(*[F.col(c).cast("long").alias(n) for c, n in zip(t.index, names, strict=True)], *map(value, t.values))


def both(spark: SparkSession, sf_dir: str) -> tuple[Tensor, Tensor]:
    return fx.matrix_a(spark, sf_dir), fx.matrix_b(spark, sf_dir)


# matrix products

_GRAM = fx.with_tensors("e", "SELECT x.i, y.i AS j, round(sum(x.v * y.v), 6) + 0.0 AS v FROM e x JOIN e y USING (k) GROUP BY ALL")


def _gram(strategy: str | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = fx.vectors(spark, sf_dir)
        return shown(matrix.matmul(e, matrix.transpose(e), strategy, digits=6), "ij")

    return run


for _name, _how in (("matmul_gram", None), ("matmul_row", "row"), ("matmul_column", "column"), ("matmul_block", "block"), ("matmul_shuffle", "shuffle")):
    query(_name, _GRAM)(_gram(_how))


@query("gram_all", "WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT x.i, y.i AS j, round(list_inner_product(x.v, y.v), 6) + 0.0 AS v FROM e x, e y")
def gram_all(spark, sf_dir):
    return matrix.gram(fx._table(spark, sf_dir, "embeddings"), "vec_id", "embedding", digits=6)


_MATMUL = fx.with_tensors("ab", "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL")


@query("matmul_int", _MATMUL)
def matmul_int(spark, sf_dir):
    return shown(matrix.matmul(*both(spark, sf_dir)), "ij")


@query(
    "matmul_1024",
    "WITH a AS (SELECT CAST(l_orderkey % 1024 AS BIGINT) AS i, CAST(l_partkey % 1024 AS BIGINT) AS k, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL) "
    "SELECT g.i, h.j, CAST(coalesce(p.v, 0) AS DOUBLE) AS v FROM range(1024) g(i) CROSS JOIN range(1024) h(j) LEFT JOIN (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y USING (k) GROUP BY ALL) p ON p.i = g.i AND p.j = h.j",
)
def matmul_1024(spark, sf_dir):
    a = fx.square(spark, sf_dir, 1024)
    return shown(matrix.matmul(a, matrix.transpose(a)), "ij")


#: Cells of the dense operands by the profiles and places of row and column: integers, and fractions that half precision rounds.
_WHOLE = (lambda q, p, i, k: (q * 7 + p * 3 + i * k) % 19 - 9, lambda q, p, i, k: (q * 5 + p * 11 + i * k * 2) % 17 - 8)
_PARTS = (lambda q, p, i, k: 1 + ((q * 31 + p * 17 + i * k) % 4999) / 997.0, lambda q, p, i, k: 1 + ((q * 13 + p * 29 + i + k) % 4999) / 997.0)


def _dense(n: int, how, kind: str = "f8"):
    """Both projections of the product of two dense n x n matrices: rows against 1 to 5, columns against 1 to 3."""

    def run(spark, sf_dir):
        orders, parts = (fx.profile(spark, sf_dir, n, key) for key in ("l_orderkey", "l_partkey"))
        tile = tiles.tile_for(n, n)
        a = tiles.from_lines(fx.dense_lines(orders, parts, how[0]), (n, n), "i", "x", tile, kind)
        b = tiles.from_lines(fx.dense_lines(parts, orders, how[1]), (n, n), "i", "x", tile, kind)
        return projections(tiles.product(a, b))

    return run


def projections(t: tiles.Tiled) -> DataFrame:
    """(side, i, v): sums of the cells of each row by j % 5 + 1 and of each column by i % 3 + 1."""
    of = t.handle()

    def project(batches):
        for bi, bj, data in tiles.rows_of(batches, "bi", "bj", "data"):
            x = of.array(bi, bj, data)
            i, j = np.arange(len(x)) + bi * of.tile, np.arange(x.shape[1]) + bj * of.tile
            for side, at, v in (("row", i, x @ (j % 5 + 1.0)), ("column", j, (i % 3 + 1.0) @ x)):
                yield pa.RecordBatch.from_pydict({"side": [side] * len(at), "i": at, "v": v})

    return t.df.mapInArrow(project, "side string, i long, v double").groupBy("side", "i").agg(F.sum("v").alias("v"))


def _dense_sql(n: int, how, half: bool = False) -> str:
    cells = [f"SELECT r.i, c.i AS k, CAST({f} AS DOUBLE) AS v FROM {r} r, {c} c" for f, r, c in ((how[0]("r.q", "c.q", "r.i", "c.i"), "o", "p"), (how[1]("r.q", "c.q", "r.i", "c.i"), "p", "o"))]
    cells = [f"SELECT i, k, {_HALF} AS v FROM ({c})" if half else c for c in cells]
    return (
        f"WITH o AS ({fx.profile_sql(n, 'l_orderkey')}), p AS ({fx.profile_sql(n, 'l_partkey')}), x AS ({cells[0]}), y AS ({cells[1]}) "
        "SELECT 'row' AS side, x.i, sum(x.v * s.v) AS v FROM x JOIN (SELECT i, sum(v * (k % 5 + 1)) AS v FROM y GROUP BY i) s ON x.k = s.i GROUP BY ALL "
        "UNION ALL SELECT 'column', y.k, sum(y.v * s.v) FROM y JOIN (SELECT k, sum(v * (i % 3 + 1)) AS v FROM x GROUP BY k) s ON y.i = s.k GROUP BY ALL"
    )


class _Sql(str):
    """Arithmetic on SQL text, so that the formulas of cells are stated once."""

    __mul__, __add__, __sub__, __mod__, __truediv__ = ((lambda self, x, op=op: _Sql(f"({self} {op} {x})")) for op in "*+-%/")
    __radd__ = lambda self, x: _Sql(f"({x} + {self})")


_names = lambda f: lambda *c: f(*map(_Sql, c))
_HALF = "CASE WHEN v = 0 THEN v WHEN abs(v) >= 65520 THEN sign(v) * 'Infinity'::DOUBLE ELSE round_even(v / greatest(pow(2, floor(log2(abs(v))) - 10), pow(2, -24)), 0) * greatest(pow(2, floor(log2(abs(v))) - 10), pow(2, -24)) + 0.0 END"
for _n in (2048, 4096):
    query(f"matmul_{_n}", _dense_sql(_n, [_names(f) for f in _WHOLE]))(_dense(_n, _WHOLE))
query("matmul_mixed_2048", _dense_sql(2048, [_names(f) for f in _PARTS], half=True))(_dense(2048, _PARTS, "f2"))


@query("batch_matmul", fx.with_tensors("t", "SELECT x.b, x.i, y.j, sum(x.v * y.v) AS v FROM t x JOIN t y ON x.b = y.b AND x.j = y.i GROUP BY ALL"))
def batch_matmul(spark, sf_dir):
    t = fx.cube(spark, sf_dir)
    return shown(matrix.batch_matmul(t, t), "bij")


@query("batch_matmul_shared_b", fx.with_tensors("t", "SELECT x.b, x.i, y.j, sum(x.v * y.v) AS v FROM t x JOIN t y ON y.b = 0 AND x.j = y.i GROUP BY ALL"))
def batch_matmul_shared_b(spark, sf_dir):
    t = fx.cube(spark, sf_dir)
    return shown(matrix.batch_matmul(t, coo(t.df.where("i0 = 0"), (8, 8), ["i1", "i2"])), "bij")


_ORDERS = ("(o_orderkey * (i + 1) + o_custkey * (j + 2)) % 17 - 8", "(o_orderkey * (j + 3) + o_custkey * (i + 1)) % 13 - 6")


@query(
    "batch_matmul_orders",
    "WITH " + ", ".join(f"{n} AS (SELECT o_orderkey AS b, i, j, CAST({v} AS DOUBLE) AS v FROM orders, range(8) r(i), range(8) s(j))" for n, v in zip("xy", _ORDERS))
    + " SELECT x.b, x.i, y.j, sum(x.v * y.v) AS v FROM x JOIN y ON x.b = y.b AND x.j = y.i GROUP BY ALL",
)
def batch_matmul_orders(spark, sf_dir):
    """Two 8 x 8 matrices for each order."""
    orders = fx._table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    orders = orders.select("o_orderkey", "o_custkey", F.floor(F.col("at") / 8).alias("i"), (F.col("at") % 8).cast("long").alias("j"))
    shape = (orders.agg(F.max("o_orderkey")).first()[0] + 1, 8, 8)
    a, b = (coo(orders.withColumn("v", F.expr(v)), shape, ["o_orderkey", "i", "j"]) for v in _ORDERS)
    return shown(matrix.batch_matmul(a, b), "bij")


@query("transpose_2d", fx.with_tensors("a", "SELECT j AS i, i AS j, v FROM a"))
def transpose_2d(spark, sf_dir):
    return shown(matrix.transpose(fx.matrix_a(spark, sf_dir)), "ij")


@query("transpose_3d", fx.with_tensors("t", "SELECT j AS b, i, b AS j, v FROM t"))
def transpose_3d(spark, sf_dir):
    return shown(matrix.transpose(fx.cube(spark, sf_dir), 0, -1), "bij")


@query("add_dense", fx.with_tensors("ab", "SELECT i, j, a.v + b.v AS v FROM a JOIN b USING (i, j)"))
def add_dense(spark, sf_dir):
    return shown(matrix.add(*both(spark, sf_dir)), "ij")


@query("add_sparse", fx.with_tensors("as", "SELECT i, j, s.v * 2 AS v FROM s WHERE v <> 0"))
def add_sparse(spark, sf_dir):
    s = sparse(fx.thinned(fx.matrix_a(spark, sf_dir)))
    return shown(matrix.add(s, s), "ij")


@query("matmul_mixed", fx.with_tensors("e", f", h AS (SELECT i, k, {_HALF} AS v FROM e) SELECT x.i, y.i AS j, round(sum(x.v * y.v), 6) + 0.0 AS v FROM h x JOIN h y USING (k) GROUP BY ALL"))
def matmul_mixed(spark, sf_dir):
    e = fx.vectors(spark, sf_dir)
    return shown(matrix.matmul_mixed_precision(e, matrix.transpose(e), digits=6), "ij")


@query("matmul_sparse", fx.with_tensors("abs", "SELECT s.i, b.j, sum(s.v * b.v) AS v FROM s JOIN b ON s.j = b.i GROUP BY ALL"))
def matmul_sparse(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return shown(matrix.matmul_sparse_aware(fx.thinned(a), b), "ij")


def _sides(cells: DataFrame, name: str, **sides) -> DataFrame:
    """(side, name, v): sums of the cells by each side's place, times its weights, from one pass over the cells."""
    each = [F.struct(F.lit(side).alias("side"), at.alias(name), (F.col("v") * weight).alias("v")) for side, (at, weight) in sides.items()]
    return cells.select(F.explode(F.array(*each)).alias("c")).groupBy("c.side", f"c.{name}").agg(F.sum("c.v").alias("v"))


#: Cells of the sparse operands: in each 100 of a row, so many are not 0; the first 16 rows and columns are full.
_THIN = (lambda q, p, i, k: (q * 3 + p * 5 + i * 7 + k * 13) % 100, lambda q, p, i, k: (q + p * 3 + i * 11 + k * 17) % 100)


def _thin(n: int, share: int):
    """Both projections of the product of two sparse n x n matrices."""

    def run(spark, sf_dir):
        profiles = [fx.profile(spark, sf_dir, n, key) for key in ("l_orderkey", "l_partkey")]
        sides = []
        for f, rows, columns, full in ((_THIN[0], *profiles, 0), (_THIN[1], *profiles[::-1], 1)):
            lines = fx.dense_lines(rows, columns, f).select("i", F.filter(F.transform("x", lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda c: (c["v"] < share) | ((F.col("i") if full == 0 else c["k"]) < 16)).alias("x"))
            cells = lines.select(F.col("i").alias("i0"), F.explode("x").alias("c")).select("i0", F.col("c.k").cast("long").alias("i1"), (F.col("c.v") % 7 + 1).alias("v"))
            sides.append(Tensor(cells, (n, n), sparse=True))
        out = matrix.matmul_sparse_aware(*sides, dense_output=False).df
        return _sides(out, "i", row=(F.col("i0"), F.col("i1") % 5 + 1), column=(F.col("i1"), F.col("i0") % 3 + 1))

    return run


def _thin_sql(n: int, share: int) -> str:
    cells = [
        f"SELECT i, k, CAST(v % 7 + 1 AS DOUBLE) AS v FROM (SELECT r.i, c.i AS k, {_names(f)('r.q', 'c.q', 'r.i', 'c.i')} AS v FROM {r} r, {c} c) WHERE v < {share} OR {full} < 16"
        for f, r, c, full in ((_THIN[0], "o", "p", "i"), (_THIN[1], "p", "o", "k"))
    ]
    return (
        f"WITH o AS ({fx.profile_sql(n, 'l_orderkey')}), p AS ({fx.profile_sql(n, 'l_partkey')}), x AS ({cells[0]}), y AS ({cells[1]}) "
        "SELECT 'row' AS side, x.i, sum(x.v * s.v) AS v FROM x JOIN (SELECT i, sum(v * (k % 5 + 1)) AS v FROM y GROUP BY i) s ON x.k = s.i GROUP BY ALL "
        "UNION ALL SELECT 'column', y.k, sum(y.v * s.v) FROM y JOIN (SELECT k, sum(v * (i % 3 + 1)) AS v FROM x GROUP BY k) s ON y.i = s.k GROUP BY ALL"
    )


for _share in (10, 1):
    query(f"matmul_sparse_{100 - _share}", _thin_sql(2048, _share))(_thin(2048, _share))


@query("sparsity_stats", fx.with_tensors("as", "SELECT count(*) FILTER (v <> 0) AS nonzero, count(*) AS cells FROM s"))
def sparsity_stats(spark, sf_dir):
    return fx.thinned(fx.matrix_a(spark, sf_dir)).df.agg(F.count_if(F.col("v") != 0).alias("nonzero"), F.count("*").alias("cells"))


@query("matmul_batch", fx.with_tensors("ab", "SELECT p.k AS pair, x.i, y.j, sum(x.v * y.v) AS v FROM (VALUES (CAST(0 AS BIGINT)), (1)) p(k) JOIN a x ON TRUE JOIN (SELECT 0 AS k, * FROM b UNION ALL SELECT 1, * FROM a) y ON y.k = p.k AND y.i = x.j GROUP BY ALL"))
def matmul_batch(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return matrix.matmul_pairs([(a, b), (a, a)]).select("pair", F.col("i0").alias("i"), F.col("i1").alias("j"), "v")


# convolutions

def _conv_sql(image: tuple, w: tuple, stride: tuple, padding: tuple, dilation: tuple, groups: int, bias: bool) -> str:
    axes, per, outs = len(image) - 1, w[1], w[0]
    s, k, o = "pqr"[:axes], "def"[:axes], "xyz"[:axes]
    size = [(n + 2 * p - d * (m - 1) - 1) // t + 1 for n, m, t, p, d in zip(image[1:], w[2:], stride, padding, dilation)]
    ranges = ", ".join(["(SELECT DISTINCT vec_id AS n FROM embeddings)", *(f"range({n}) {c}_({c})" for n, c in zip((outs, *size), "o" + o))])
    meet = " AND ".join(f"xs.{a} = g.{c} * {t} - {p} + ws.{b} * {d}" for a, b, c, t, p, d in zip(s, k, o, stride, padding, dilation))
    return (
        f"SELECT g.n, g.o, {', '.join(f'g.{c}' for c in o)}, coalesce(sum(xs.v * ws.v), 0) + {'any_value(g.o)' if bias else '0'} AS v FROM (SELECT * FROM {ranges}) g "
        f"LEFT JOIN ({fx.polynomial_sql(w, 2, 'uc' + k)} ws JOIN {fx.images_sql(image, 'mh' + s)} xs ON xs.h = ws.c + (ws.u // {outs // groups}) * {per}) ON ws.u = g.o AND xs.m = g.n AND {meet} GROUP BY ALL"
    )


def _conv(name: str, image: tuple, w: tuple, stride: tuple, padding: tuple, dilation: tuple, groups: int = 1, bias: bool = False) -> None:
    @query(name, _conv_sql(image, w, stride, padding, dilation, groups, bias))
    def run(spark, sf_dir):
        shift = coo(spark.range(w[0]).withColumn("v", F.col("id").cast("double")), (w[0],), ["id"]) if bias else None
        out = convolution.convolve(fx.images(spark, sf_dir, image), fx.polynomial(spark, w, 2), shift, stride, padding, dilation, groups)
        return shown(out, "no" + "xyz"[: len(image) - 1])


_conv("conv2d_pad", (4, 4, 4), (4, 4, 3, 3), (1, 1), (1, 1), (1, 1))
_conv("conv2d_stride_dil", (1, 8, 8), (4, 1, 3, 3), (2, 1), (2, 3), (1, 2))
_conv("conv2d_groups_bias", (4, 4, 4), (4, 2, 3, 3), (1, 1), (0, 1), (1, 1), 2, True)
_conv("conv3d", (1, 4, 4, 4), (2, 1, 2, 3, 3), (1, 1, 1), (0, 1, 1), (1, 1, 1))
_conv("conv3d_stride_bias", (2, 2, 4, 4), (2, 2, 2, 3, 3), (1, 2, 2), (1, 1, 0), (2, 1, 1), 1, True)


#: Cells of a grid and of a right-hand side by the profiles and places of row and column.
_GRID = (lambda q, p, i, k: (q * 3 + p * 5 + i * k) % 101, lambda q, p, i, k: (q + p * 7 + i + k) % 11)


def _plane(spark, sf_dir, n: int, value) -> Tensor:
    """A dense n x n grid by the profiles of orders and parts."""
    rows = fx.dense_lines(*(fx.profile(spark, sf_dir, n, key) for key in ("l_orderkey", "l_partkey")), value)
    return from_rows(rows, (n, n), ["i"], "x")


#: Cells of the images of a network's layer, by the profiles of 512 planes and of 3136 pixels.
_LAYER, _PLANES, _SIDE, _OUTS = (lambda q, p, i, k: (q * 3 + p * 7 + i * k) % 23 - 11), 64, 56, 128


@query(
    "conv2d_64_128",
    f"WITH o AS ({fx.profile_sql(512, 'l_orderkey')}), p AS ({fx.profile_sql(3136, 'l_partkey')}), "
    f"layer AS MATERIALIZED (SELECT r.i // 64 AS n, r.i % 64 AS c, c.i // 56 AS y, c.i % 56 AS x, CAST({_names(_LAYER)('r.q', 'c.q', 'r.i', 'c.i')} AS DOUBLE) AS v FROM o r, p c), w AS {fx.polynomial_sql((_OUTS, _PLANES, 3, 3), 2, 'ocab')}, "
    "tapped AS (SELECT x.n, x.c, x.v, r.a, s.b, x.y + 1 - r.a AS y, x.x + 1 - s.b AS x FROM layer x, range(3) r(a), range(3) s(b) WHERE x.y + 1 - r.a BETWEEN 0 AND 55 AND x.x + 1 - s.b BETWEEN 0 AND 55) "
    "SELECT 'pixel' AS side, CAST(t.n * 3136 + t.y * 56 + t.x AS BIGINT) AS at, sum(t.v * k.v) AS v FROM tapped t JOIN (SELECT c, a, b, sum(v * (o % 7 + 1)) AS v FROM w GROUP BY ALL) k USING (c, a, b) GROUP BY t.n, t.y, t.x "
    "UNION ALL SELECT 'channel', CAST(w.o AS BIGINT), sum(w.v * k.v) FROM w JOIN (SELECT c, a, b, sum(v * ((n + y + x) % 5 + 1)) AS v FROM tapped GROUP BY ALL) k USING (c, a, b) GROUP BY w.o",
)
def conv2d_64_128(spark, sf_dir):
    """A network's layer: 8 images of 64 channels of 56 x 56, 128 kernels of 3 x 3; both projections of all 3.2 million cells."""
    rows = fx.dense_lines(fx.profile(spark, sf_dir, 512, "l_orderkey"), fx.profile(spark, sf_dir, 3136, "l_partkey"), _LAYER)
    cells = rows.select("i", F.posexplode("x").alias("at", "v"))
    split = lambda c, n: (F.floor(F.col(c) / n).cast("long"), (F.col(c) % n).cast("long"))
    x = Tensor(cells.select(*[c.alias(f"i{k}") for k, c in enumerate((*split("i", _PLANES), *split("at", _SIDE)))], "v"), (8, _PLANES, _SIDE, _SIDE))
    out = convolution.conv2d(x, fx.polynomial(spark, (_OUTS, _PLANES, 3, 3), 2), padding=(1, 1)).df
    pixel, channel = F.col("i0") * 3136 + F.col("i2") * 56 + F.col("i3"), F.col("i1")
    return _sides(out, "at", pixel=(pixel, channel % 7 + 1), channel=(channel, (F.col("i0") + F.col("i2") + F.col("i3")) % 5 + 1))


#: Cells of a grid and of a right-hand side by the profiles and places of row and column.
_GRID = (lambda q, p, i, k: (q * 3 + p * 5 + i * k) % 101, lambda q, p, i, k: (q + p * 7 + i + k) % 11)


def _plane(spark, sf_dir, n: int, value) -> Tensor:
    """A dense n x n grid by the profiles of orders and parts."""
    rows = fx.dense_lines(*(fx.profile(spark, sf_dir, n, key) for key in ("l_orderkey", "l_partkey")), value)
    return from_rows(rows, (n, n), ["i"], "x")


#: Cells of the images of a network's layer, by the profiles of 512 planes and of 3136 pixels.
_LAYER, _PLANES, _SIDE, _OUTS = (lambda q, p, i, k: (q * 3 + p * 7 + i * k) % 23 - 11), 64, 56, 128


@query(
    "conv2d_64_128",
    f"WITH o AS ({fx.profile_sql(512, 'l_orderkey')}), p AS ({fx.profile_sql(3136, 'l_partkey')}), "
    f"layer AS MATERIALIZED (SELECT r.i // 64 AS n, r.i % 64 AS c, c.i // 56 AS y, c.i % 56 AS x, CAST({_names(_LAYER)('r.q', 'c.q', 'r.i', 'c.i')} AS DOUBLE) AS v FROM o r, p c), w AS {fx.polynomial_sql((_OUTS, _PLANES, 3, 3), 2, 'ocab')}, "
    "tapped AS (SELECT x.n, x.c, x.v, r.a, s.b, x.y + 1 - r.a AS y, x.x + 1 - s.b AS x FROM layer x, range(3) r(a), range(3) s(b) WHERE x.y + 1 - r.a BETWEEN 0 AND 55 AND x.x + 1 - s.b BETWEEN 0 AND 55) "
    "SELECT 'pixel' AS side, CAST(t.n * 3136 + t.y * 56 + t.x AS BIGINT) AS at, sum(t.v * k.v) AS v FROM tapped t JOIN (SELECT c, a, b, sum(v * (o % 7 + 1)) AS v FROM w GROUP BY ALL) k USING (c, a, b) GROUP BY t.n, t.y, t.x "
    "UNION ALL SELECT 'channel', CAST(w.o AS BIGINT), sum(w.v * k.v) FROM w JOIN (SELECT c, a, b, sum(v * ((n + y + x) % 5 + 1)) AS v FROM tapped GROUP BY ALL) k USING (c, a, b) GROUP BY w.o",
)
def conv2d_64_128(spark, sf_dir):
    """A network's layer: 8 images of 64 channels of 56 x 56, 128 kernels of 3 x 3; both projections of all 3.2 million cells."""
    rows = fx.dense_lines(fx.profile(spark, sf_dir, 512, "l_orderkey"), fx.profile(spark, sf_dir, 3136, "l_partkey"), _LAYER)
    cells = rows.select("i", F.posexplode("x").alias("at", "v"))
    split = lambda c, n: (F.floor(F.col(c) / n).cast("long"), (F.col(c) % n).cast("long"))
    x = Tensor(cells.select(*[c.alias(f"i{k}") for k, c in enumerate((*split("i", _PLANES), *split("at", _SIDE)))], "v"), (8, _PLANES, _SIDE, _SIDE))
    out = convolution.conv2d(x, fx.polynomial(spark, (_OUTS, _PLANES, 3, 3), 2), padding=(1, 1)).df
    pixels = out.groupBy((F.col("i0") * 3136 + F.col("i2") * 56 + F.col("i3")).alias("at")).agg(F.sum(F.col("v") * (F.col("i1") % 7 + 1)).alias("v"))
    channels = out.groupBy(F.col("i1").alias("at")).agg(F.sum(F.col("v") * ((F.col("i0") + F.col("i2") + F.col("i3")) % 5 + 1)).alias("v"))
    return pixels.select(F.lit("pixel").alias("side"), "at", "v").unionByName(channels.select(F.lit("channel").alias("side"), "at", "v"))


# Fourier transforms: the SQL is the plain sum

def _dft(source: str, n: int, length: int, bins: int, sign: int, scale: str, value: str = "v") -> str:
    angle = f"2 * pi() * ((f.k * x.k) % {n}) / {n}"
    re, im = (f"x.{value} * cos({angle})", f"{sign} * x.{value} * sin({angle})") if value == "v" else (f"x.re * cos({angle}) - {sign} * x.im * sin({angle})", f"x.im * cos({angle}) + {sign} * x.re * sin({angle})")
    return f"SELECT x.i, CAST(f.k AS BIGINT) AS k, round(sum({re}) * {scale}, 4) + 0.0 AS re, round(sum({im}) * {scale}, 4) + 0.0 AS im FROM {source} x, range({bins}) f(k) WHERE x.k < {length} GROUP BY ALL"


@query("fft", fx.with_tensors("e", _dft("e", 64, 64, 64, -1, "1")))
def fft(spark, sf_dir):
    return shown(fourier.fft(fx.vectors(spark, sf_dir)), "ik", 4)


@query("rfft", fx.with_tensors("e", _dft("e", 64, 64, 33, -1, "1")))
def rfft(spark, sf_dir):
    return shown(fourier.rfft(fx.vectors(spark, sf_dir)), "ik", 4)


@query("ifft", fx.with_tensors("e", _dft("(SELECT i, k, v AS re, v * 0.5 AS im FROM e)", 64, 64, 64, 1, "(1 / 64.0)", "z").replace("x.z", "x.v")))
def ifft(spark, sf_dir):
    e = fx.vectors(spark, sf_dir)
    z = e.with_df(e.df.select("i0", "i1", F.col("v").alias("re"), (F.col("v") * 0.5).alias("im")), complex=True)
    return shown(fourier.ifft(z), "ik", 4)


@query("fft_norms", fx.with_tensors("e", " UNION ALL ".join(f"SELECT '{norm}' AS norm, * FROM ({_dft('e', n, min(n, 64), n, -1, scale)})" for norm, n, scale in (("ortho", 48, "(1 / sqrt(48.0))"), ("forward", 80, "(1 / 80.0)")))))
def fft_norms(spark, sf_dir):
    parts = [shown(fourier.fft(fx.vectors(spark, sf_dir), n, norm=norm), "ik", 4).select(F.lit(norm).alias("norm"), "i", "k", "re", "im") for norm, n in (("ortho", 48), ("forward", 80))]
    return parts[0].unionByName(parts[1])


_FFT_DIM0 = "SELECT CAST(f.k AS BIGINT) AS i, a.j, round(sum(a.v * cos(2 * pi() * ((f.k * a.i) % 16) / 16)), 4) + 0.0 AS re, round(-sum(a.v * sin(2 * pi() * ((f.k * a.i) % 16) / 16)), 4) + 0.0 AS im FROM a, range(16) f(k) GROUP BY ALL"


@query("fft_dim0", fx.with_tensors("a", _FFT_DIM0))
def fft_dim0(spark, sf_dir):
    return shown(fourier.fft(fx.matrix_a(spark, sf_dir), dim=0), "ij", 4)


def _dft2(source: str, keys: str, n: int, m: int) -> str:
    angle = f"2 * pi() * (((f.k * x.i) % {n}) / {n}.0 + ((g.k * x.j) % {m}) / {m}.0)"
    return f"SELECT {keys}CAST(f.k AS BIGINT) AS i, CAST(g.k AS BIGINT) AS j, round(sum(x.v * cos({angle})), 4) + 0.0 AS re, round(-sum(x.v * sin({angle})), 4) + 0.0 AS im FROM {source} x, range({n}) f(k), range({m}) g(k) GROUP BY ALL"


@query("fft2d", fx.with_tensors("t", _dft2("t", "x.b, ", 8, 8)))
def fft2d(spark, sf_dir):
    return shown(fourier.fft2d(fx.cube(spark, sf_dir)), "bij", 4)


@query("fft2d_pencil", fx.with_tensors("a", _dft2("a", "", 16, 16)))
def fft2d_pencil(spark, sf_dir):
    return shown(fourier.fft2d_pencil(fx.matrix_a(spark, sf_dir)), "ij", 4)


def _butterflies(source: str, bits: int, high: int) -> str:
    """The transform of (i, v) by halves: one stage per bit of i, those below and those from bit ``high`` on being axes of their own."""
    sql = f"WITH {source}, b0 AS MATERIALIZED (SELECT i, v AS re, 0.0::DOUBLE AS im FROM source)"
    for s in range(bits):
        bit = bits - 1 - s
        low = high if bit >= high else 0
        half, angle = 1 << bit, f"(-pi() * (((x.i % {1 << bit}) >> {low})::DOUBLE / {1 << (bit - low)}))"
        upper = f"(x.i & {half}) <> 0"
        re, im = (f"CASE WHEN {upper} THEN y.{c} - x.{c} ELSE x.{c} + y.{c} END" for c in ("re", "im"))
        sql += (
            f", m{s} AS (SELECT x.i, {upper} AS turns, {re} AS re, {im} AS im, cos({angle}) AS c, sin({angle}) AS s FROM b{s} x JOIN b{s} y ON y.i = xor(x.i, {half}))"
            f", b{s + 1} AS MATERIALIZED (SELECT i, CASE WHEN turns THEN re * c - im * s ELSE re END AS re, CASE WHEN turns THEN re * s + im * c ELSE im END AS im FROM m{s})"
        )
    place = " + ".join(f"((i >> {b}) & 1) * {1 << ((bits - 1 + high - b) if b >= high else high - 1 - b)}" for b in range(bits))
    return sql + f", done AS (SELECT {place} AS k, re, im FROM b{bits})"


#: Length of the long axis.
_LONG = 1 << 20
_PRICES = f"source AS (SELECT r.i, coalesce(s.v, 0.0::DOUBLE) AS v FROM range({_LONG}) r(i) LEFT JOIN (SELECT (l_orderkey * 7 + l_linenumber) % {_LONG} AS i, CAST(sum(CAST(l_extendedprice AS DECIMAL(38, 2))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) s USING (i))"


@query("fft_long", _butterflies(_PRICES, 20, 0) + f" SELECT CAST(k AS BIGINT) AS k, round(re / {_LONG}, 3) + 0.0 AS re, round(im / {_LONG}, 3) + 0.0 AS im FROM done")
def fft_long(spark, sf_dir):
    """One line of 2^20 cells: the prices of line items by the place that their order and line number give."""
    at = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % _LONG).cast("long").alias("i0")
    sums = fx._table(spark, sf_dir, "lineitem").groupBy(at).agg(F.sum(F.col("l_extendedprice").cast("decimal(38,2)")).cast("double").alias("v"))
    return shown(fourier.fft(Tensor(sums, (_LONG,), sparse=True), norm="forward"), "k", 3)


def _square_sql(n: int, value) -> str:
    return f"o AS ({fx.profile_sql(n, 'l_orderkey')}), p AS ({fx.profile_sql(n, 'l_partkey')}), source AS (SELECT r.i * {n} + c.i AS i, CAST({_names(value)('r.q', 'c.q', 'r.i', 'c.i')} AS DOUBLE) AS v FROM o r, p c)"


@query("fft2d_1024", _butterflies(_square_sql(1024, _GRID[0]), 20, 10) + " SELECT CAST(k // 1024 AS BIGINT) AS i, CAST(k % 1024 AS BIGINT) AS j, round(re / 1024, 3) + 0.0 AS re, round(im / 1024, 3) + 0.0 AS im FROM done")
def fft2d_1024(spark, sf_dir):
    return shown(fourier.fft2d_pencil(_plane(spark, sf_dir, 1024, _GRID[0]), norm="ortho"), "ij", 3)


# Einstein sums

@query("einsum_chain", fx.with_tensors("ab", "SELECT x.i, z.j AS l, sum(x.v * y.v * z.v) AS v FROM a x JOIN b y ON x.j = y.i JOIN a z ON y.j = z.i GROUP BY ALL"))
def einsum_chain(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return shown(contraction.einsum("ij,jk,kl->il", a, b, a), "il")


@query("einsum_trace", fx.with_tensors("a", "SELECT sum(v) AS v FROM a WHERE i = j"))
def einsum_trace(spark, sf_dir):
    return contraction.einsum("ii->", fx.matrix_a(spark, sf_dir)).df


@query("einsum_outer", fx.with_tensors("a", "SELECT x.j AS i, y.j, x.v * y.v AS v FROM (SELECT j, sum(v) AS v FROM a GROUP BY j) x, (SELECT j, sum(v) AS v FROM a GROUP BY j) y"))
def einsum_outer(spark, sf_dir):
    a = fx.matrix_a(spark, sf_dir)
    return shown(contraction.einsum("ai,bj->ij", a, a), "ij")


@query("einsum_4d", fx.with_tensors("t", "SELECT x.b, x.i, y.b AS c, y.j, sum(x.v * y.v) AS v FROM t x JOIN t y ON x.j = y.i GROUP BY ALL"))
def einsum_4d(spark, sf_dir):
    t = fx.cube(spark, sf_dir)
    return shown(contraction.einsum("bik,ckj->bicj", t, t), "bicj")


@query("einsum_path", fx.with_tensors("ab", "SELECT x.i, z.j AS l, sum(x.v * y.v * z.v) AS v FROM a x JOIN b y ON x.j = y.i JOIN a z ON y.j = z.i GROUP BY ALL"))
def einsum_path(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return shown(contraction.einsum("ij,jk,kl->il", a, b, a, path=[(1, 2), (0, 1)]), "il")


@query("tensordot", fx.with_tensors("t", "SELECT x.b, y.b AS c, sum(x.v * y.v) AS v FROM t x JOIN t y ON x.i = y.i AND x.j = y.j GROUP BY ALL"))
def tensordot(spark, sf_dir):
    t = fx.cube(spark, sf_dir)
    return shown(contraction.tensordot(t, Tensor(t.df.select(F.col("i1").alias("i0"), F.col("i2").alias("i1"), F.col("i0").alias("i2"), "v"), (8, 8, 7)), 2), "bc")


#: Operands of the chain whose orders are compared.
_CHAIN = 16


def _chain_sql(n: int) -> str:
    """The cheapest order of a chain by dynamic programming over its parts, and the cost of taking the operands in turn."""
    sql = f"WITH d AS MATERIALIZED (SELECT CAST(l_quantity AS BIGINT) % {n + 1} AS k, 1 + count(*) % 50 AS n FROM lineitem GROUP BY ALL), m1 AS (SELECT k AS i, k AS j, CAST(0 AS BIGINT) AS cost FROM range({n}) r(k))"
    for size in range(2, n + 1):
        parts = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, size))
        sql += (
            f", m{size} AS MATERIALIZED (WITH p AS ({parts}) SELECT a.i, b.j, CAST(min(a.cost + b.cost + x.n * y.n * z.n) AS BIGINT) AS cost "
            f"FROM p a JOIN p b ON b.i = a.j + 1 AND b.j - a.i = {size - 1} JOIN d x ON x.k = a.i JOIN d y ON y.k = b.i JOIN d z ON z.k = b.j + 1 GROUP BY ALL)"
        )
    turn = f"SELECT CAST(sum(x.n * y.n * z.n) AS BIGINT) FROM d x, d y, d z WHERE x.k = 0 AND z.k = y.k + 1 AND y.k BETWEEN 1 AND {n - 1}"
    return sql + f" SELECT 'dp' AS strategy, CAST({n - 1} AS BIGINT) AS steps, (SELECT cost FROM m{n}) AS flops UNION ALL SELECT 'left', {n - 1}, ({turn})"


@query("contraction_path", _chain_sql(_CHAIN))
def contraction_path(spark, sf_dir):
    """A chain of 16 matrices, whose lengths are counts of line items: the best order by subsets, and the operands in turn."""
    k = (F.col("l_quantity").cast("long") % (_CHAIN + 1)).alias("k")
    lengths = [r["n"] for r in fx._table(spark, sf_dir, "lineitem").groupBy(k).agg((1 + F.count("*") % 50).alias("n")).orderBy("k").collect()]
    labels = "abcdefghijklmnopq"
    equation = ",".join(map("".join, zip(labels, labels[1:]))) + f"->{labels[0]}{labels[_CHAIN]}"
    return contraction.compare_strategies(spark, equation, *zip(lengths, lengths[1:]), strategies=("dp", "left")).select("strategy", "steps", "flops")


# reductions

def _reduce(name: str) -> None:
    f, sql = getattr(reduction, name), {"sum": "sum(v)", "mean": "sum(v) / count(*)", "max": "max(v)", "min": "min(v)"}[name]
    query(f"{name}_all", fx.with_tensors("a", f"SELECT {sql} AS v FROM a"))(lambda spark, sf_dir: f(fx.matrix_a(spark, sf_dir)).df)
    query(f"{name}_dim0", fx.with_tensors("a", f"SELECT j, {sql} AS v FROM a GROUP BY j"))(lambda spark, sf_dir: shown(f(fx.matrix_a(spark, sf_dir), 0), "j"))
    query(f"{name}_dim1", fx.with_tensors("a", f"SELECT i, {sql} AS v FROM a GROUP BY i"))(lambda spark, sf_dir: shown(f(fx.matrix_a(spark, sf_dir), -1), "i"))
    query(f"{name}_keepdim", fx.with_tensors("t", f"SELECT b, CAST(0 AS BIGINT) AS i, j, {sql} AS v FROM t GROUP BY b, j"))(lambda spark, sf_dir: shown(f(fx.cube(spark, sf_dir), 1, keepdim=True), "bij"))


for _name in ("sum", "mean", "max", "min"):
    _reduce(_name)


def _cancelling(spark, sf_dir) -> Tensor:
    prices = fx._table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v"))
    up, down = (spark.range(1).select(F.lit(v).alias("v")) for v in (1e16, -1e16))
    both_ = up.unionByName(prices).unionByName(down)
    return Tensor(both_.select(F.lit(0).cast("long").alias("i0"), "v"), (prices.count() + 2,))


_EXACT = "(SELECT CAST(CAST(l_extendedprice AS DECIMAL(38, 2)) AS DECIMAL(38, 2)) AS v FROM lineitem UNION ALL VALUES (CAST(10000000000000000 AS DECIMAL(38, 2))), (CAST(-10000000000000000 AS DECIMAL(38, 2))))"


@query("sum_kahan", f"SELECT round(CAST(sum(v) AS DOUBLE), 2) + 0.0 AS v FROM {_EXACT}")
def sum_kahan(spark, sf_dir):
    return reduction.sum_kahan(_cancelling(spark, sf_dir)).df.select((F.round("v", 2) + F.lit(0.0)).alias("v"))


@query("mean_kahan", f"SELECT round(CAST(sum(v) AS DOUBLE) / count(*), 4) + 0.0 AS v FROM {_EXACT}")
def mean_kahan(spark, sf_dir):
    return reduction.mean_kahan(_cancelling(spark, sf_dir)).df.select((F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("sum_kahan_dim", fx.with_tensors("t", "SELECT i, j, sum(v) AS v FROM t GROUP BY ALL"))
def sum_kahan_dim(spark, sf_dir):
    return shown(reduction.sum_kahan(fx.cube(spark, sf_dir), 0), "ij")


_PARTS_EXACT = "SELECT l_partkey AS i, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(38, 2))) AS DOUBLE), 2) + 0.0 AS v FROM lineitem GROUP BY l_partkey"


@query("sum_kahan_parts", _PARTS_EXACT)
def sum_kahan_parts(spark, sf_dir):
    """Prices by part, among values of 1e16 that cancel within each part."""
    lines = fx._table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i0"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i1"), F.col("l_extendedprice").alias("v"))
    parts = lines.select("i0").distinct()
    huge = [parts.select("i0", F.lit(-k).cast("long").alias("i1"), F.lit(v).alias("v")) for k, v in ((1, 1e16), (2, -1e16))]
    shape = (1 << 31, 1 << 31)
    return shown(reduction.sum_kahan(Tensor(huge[0].unionByName(lines).unionByName(huge[1]), shape, sparse=True), 1), "i", 2)


# stencils

def _step_sql(source: str, kernel, boundary: str) -> str:
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    taps = ", ".join(f"({a - h}, {b - w}, CAST({kernel[a][b]!r} AS DOUBLE))" for a in range(len(kernel)) for b in range(len(kernel[0])) if kernel[a][b] or (a, b) == (h, w))
    if boundary == "periodic":
        on = "x.i = (g.i + k.a + 16) % 16 AND x.j = (g.j + k.b + 16) % 16"
    else:
        on = "x.i = g.i + k.a AND x.j = g.j + k.b"
    return f"SELECT g.i, g.j, sum(x.v * k.w) AS v FROM {source} g CROSS JOIN (VALUES {taps}) k(a, b, w) JOIN {source} x ON {on} GROUP BY ALL"


def _stencil(name: str, kernel, boundary: str, iterations: int) -> None:
    steps = "".join(f", s{k} AS ({_step_sql('a' if k == 1 else f's{k - 1}', kernel, boundary)})" for k in range(1, iterations + 1))
    sql = fx.with_tensors("a", steps + f" SELECT i, j, round(v, 4) + 0.0 AS v FROM s{iterations}")
    query(name, sql)(lambda spark, sf_dir: shown(stencil.stencil_2d(fx.matrix_a(spark, sf_dir), kernel, boundary, iterations), "ij", 4))


_stencil("stencil_5pt", stencil.LAPLACIAN_5, "zero", 1)
_stencil("stencil_9pt", stencil.LAPLACIAN_9, "zero", 1)
_stencil("stencil_periodic", stencil.LAPLACIAN_5, "periodic", 1)
_stencil("stencil_iter3", stencil.LAPLACIAN_5, "zero", 3)
_stencil("stencil_wide", ((1.0, 0.0, 2.0, 0.0, -1.0), (0.0, 1.0, -3.0, 1.0, 0.0), (2.0, 0.0, 1.0, 0.0, 2.0)), "periodic", 2)


def _jacobi_sql(boundary: str, iterations: int) -> str:
    steps = ""
    kernel = ((0.0, 0.25, 0.0), (0.25, 0.0, 0.25), (0.0, 0.25, 0.0))
    for k in range(1, iterations + 1):
        source = "a" if k == 1 else f"u{k - 1}"
        steps += f", m{k} AS ({_step_sql(source, kernel, boundary)}), u{k} AS (SELECT m{k}.i, m{k}.j, m{k}.v - f.v / 4 AS v FROM m{k} JOIN a f ON f.i = m{k}.j AND f.j = m{k}.i)"
    return fx.with_tensors("a", steps + f" SELECT i, j, round(v, 4) + 0.0 AS v FROM u{iterations}")


for _name, _boundary in (("jacobi_5", "zero"), ("jacobi_periodic", "periodic")):
    query(_name, _jacobi_sql(_boundary, 5))(lambda spark, sf_dir, boundary=_boundary: shown(stencil.jacobi_2d(fx.matrix_a(spark, sf_dir), matrix.transpose(fx.matrix_a(spark, sf_dir)), boundary=boundary, iterations=5, tol=None)[0], "ij", 4))


#: Step change at which jacobi_tol stops, as a part of the largest value of the grid.
JACOBI_TOL = 0.6

_JACOBI_TOL = fx.with_tensors("t", f"""
, start AS (SELECT list(v ORDER BY i, j) AS u FROM t WHERE b = 0), source AS (SELECT list(v ORDER BY i, j) AS f FROM t WHERE b = 1),
""".strip() + f" goal AS (SELECT {JACOBI_TOL}::DOUBLE * list_max(u) AS tol FROM start), " + """
steps(n, u, gap) AS (SELECT 0, u, 'Infinity'::DOUBLE FROM start UNION ALL
  SELECT n, w, sqrt(list_sum(list_transform(range(1, 65), lambda k: (w[k] - u[k]) * (w[k] - u[k])))) FROM (
    SELECT n + 1 AS n, u, list_transform(range(64), lambda k: (CASE WHEN k >= 8 THEN u[k - 7] ELSE 0 END + CASE WHEN k < 56 THEN u[k + 9] ELSE 0 END
      + CASE WHEN k % 8 > 0 THEN u[k] ELSE 0 END + CASE WHEN k % 8 < 7 THEN u[k + 2] ELSE 0 END - 0.1::DOUBLE * 0.1::DOUBLE * f[k + 1]) / 4) AS w
    FROM steps, source, goal WHERE gap >= tol AND n < 200))
SELECT CAST(k // 8 AS BIGINT) AS i, CAST(k % 8 AS BIGINT) AS j, round(u[k + 1], 4) + 0.0 AS v, CAST(n AS BIGINT) AS steps FROM (SELECT * FROM steps ORDER BY n DESC LIMIT 1), range(64) r(k)""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("jacobi_tol", _JACOBI_TOL)
def jacobi_tol(spark, sf_dir):
    """Steps until the change is below a tolerance."""
    t = fx.cube(spark, sf_dir)
    slab = lambda k: coo(t.df.where(F.col("i0") == k), (8, 8), ["i1", "i2"])
    tol = JACOBI_TOL * slab(0).df.agg(F.max("v")).first()[0]
    u, steps = stencil.jacobi_2d(slab(0), slab(1), dx=0.1, iterations=200, tol=tol)
    return shown(u, "ij", 4).withColumn("steps", F.lit(steps).cast("long"))


_HEAT = ((0.0, 0.125, 0.0), (0.125, 0.5, 0.125), (0.0, 0.125, 0.0))


def _lines_sql(n: int, steps: int, cell: str, periodic: bool, extra: str = "") -> str:
    """``steps`` steps over the rows of a grid as lists: ``cell`` is the new value from the rows a (above), u, b (below), f and the place k from 1."""
    grid = [f"SELECT r.i, list(CAST({_names(f)('r.q', 'c.q', 'r.i', 'c.i')} AS DOUBLE) ORDER BY c.i) AS u FROM o r, p c GROUP BY r.i" for f in _GRID]
    zero = "list_transform(u, lambda x: 0.0::DOUBLE)"
    side = (lambda f, end: f"coalesce({f}(u) OVER (ORDER BY i), {end}(u) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))") if periodic else (lambda f, end: f"coalesce({f}(u) OVER (ORDER BY i), {zero})")
    sql = f"WITH o AS ({fx.profile_sql(n, 'l_orderkey')}), p AS ({fx.profile_sql(n, 'l_partkey')}), s0 AS MATERIALIZED ({grid[0]}), f AS MATERIALIZED (SELECT i, u AS f FROM ({grid[1]}))"
    for s in range(steps):
        sql += f", s{s + 1} AS MATERIALIZED (SELECT i, list_transform(range(1, {n + 1}), lambda k: {cell}) AS u FROM (SELECT i, u, {side('lag', 'last')} AS a, {side('lead', 'first')} AS b FROM s{s}) JOIN f USING (i))"
    return sql + f" SELECT CAST(i AS BIGINT) AS i, CAST(unnest(range({n})) AS BIGINT) AS j, round(unnest(u), 4) + 0.0 AS v FROM s{steps}"


@query("stencil_1024", _lines_sql(1024, 50, "a[k] * 0.125 + u[(k + 1022) % 1024 + 1] * 0.125 + u[k] * 0.5 + u[k % 1024 + 1] * 0.125 + b[k] * 0.125", True))
def stencil_1024(spark, sf_dir):
    """50 steps of diffusion on a periodic 1024 x 1024 grid."""
    return shown(stencil.stencil_2d(_plane(spark, sf_dir, 1024, _GRID[0]), _HEAT, "periodic", 50), "ij", 4)


@query("jacobi_1024", _lines_sql(1024, 50, "(a[k] + b[k] + CASE WHEN k > 1 THEN u[k - 1] ELSE 0 END + CASE WHEN k < 1024 THEN u[k + 1] ELSE 0 END - f[k]) / 4", False))
def jacobi_1024(spark, sf_dir):
    grid, rhs = (_plane(spark, sf_dir, 1024, f) for f in _GRID)
    return shown(stencil.jacobi_2d(grid, rhs, iterations=50, tol=None)[0], "ij", 4)


# pipelines and plans

@query("pipelined_matmul", _MATMUL)
def pipelined_matmul(spark, sf_dir):
    return shown(pipeline.pipelined_matmul(*both(spark, sf_dir), num_chunks=4), "ij")


@query("pipelined_allreduce", "SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT l_linenumber % 4 AS rank, CAST(l_orderkey % 16 AS BIGINT) AS i, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY ALL) GROUP BY i")
def pipelined_allreduce(spark, sf_dir):
    lines = fx._table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).alias("rank"), (F.col("l_orderkey") % 16).alias("i0"), F.col("l_quantity").cast("long").alias("q"))
    parts = lines.groupBy("rank", "i0").agg(F.sum("q").cast("double").alias("v"))
    return shown(pipeline.pipelined_allreduce(parts, (16,)), "i")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
