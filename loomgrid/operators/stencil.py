"""Iterated stencils and the Jacobi solver on a plane grid.

The grid is cut into tiles of about ``TILE`` cells a side. A tile is one row with its cells, and gives each of its up to eight neighbours the strip
that is as wide as the steps of one exchange reach; with all strips a tile takes that many steps by itself, in an Arrow batch.
So there is one shuffle for ``TILE`` / ``DEEP`` steps, and it moves the cells once as binary values. An axis of one tile needs no strips, and a grid of one tile
takes all steps at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError
from loomgrid.session import drop, written
from loomgrid.sources.tiles import CELLS, rows_of

# fixed values: the two kernels of the discrete Laplacian
LAPLACIAN_5 = ((0.0, 1.0, 0.0), (1.0, -4.0, 1.0), (0.0, 1.0, 0.0))
LAPLACIAN_9 = tuple(tuple(x / 6 for x in row) for row in ((1.0, 4.0, 1.0), (4.0, -20.0, 4.0), (1.0, 4.0, 1.0)))
BOUNDARIES = ("zero", "periodic")
#: Cells of a tile's side, and how many of them go to one step of an exchange.
TILE, DEEP = 256, 16
#: Exchanges after which the tiles are written and their lineage cut.
CUT = 8

_ROWS = "bi int, bj int, dy int, dx int, data binary, gaps array<double>"
_ARROW = pa.schema({"bi": pa.int32(), "bj": pa.int32(), "dy": pa.int32(), "dx": pa.int32(), "data": pa.binary(), "gaps": pa.list_(pa.float64())})


@dataclass(frozen=True)
class Cut:
    """How a grid is cut: its shape, reach of a step per axis, boundary, planes of values, and tiles per axis."""

    shape: tuple[int, int]
    reach: tuple[int, int]
    periodic: bool
    planes: int
    tiles: tuple[int, int]

    @property
    def deep(self) -> int | None:
        """Steps of one exchange; None for any number."""
        sides = [n // k // r // DEEP for n, k, r in zip(self.shape, self.tiles, self.reach) if k > 1 and r]
        return max(1, min(sides)) if sides else None

    def edges(self, axis: int, at: int) -> tuple[int, int]:
        n, k = self.shape[axis], self.tiles[axis]
        return n * at // k, n * (at + 1) // k

    def sizes(self, bi: int, bj: int) -> tuple[int, int]:
        return tuple(b - a for a, b in (self.edges(0, bi), self.edges(1, bj)))

    def tile_of(self, axis: int, column: str):
        n, k = self.shape[axis], self.tiles[axis]
        return F.floor(((F.col(column) + 1) * k - 1) / n).cast("int")

    def borders(self, steps: int) -> tuple[int, int]:
        return tuple(steps * r for r in self.reach)

    def neighbour(self, bi: int, bj: int, dy: int, dx: int) -> tuple[int, int] | None:
        """The tile beside; None where there is none, or where the axis is one tile that looks after itself."""
        out = []
        for at, d, k in zip((bi, bj), (dy, dx), self.tiles):
            if d and k == 1 or d and not self.periodic and not 0 <= at + d < k:
                return None
            out.append((at + d) % k)
        return tuple(out)


def cut_of(shape: tuple[int, int], reach: tuple[int, int], boundary: str, planes: int) -> Cut:
    tiles = tuple(max(1, n // max(TILE, r)) for n, r in zip(shape, reach))
    return Cut(shape, reach, boundary == "periodic", planes, tiles)


def _given(cut: Cut, bi: int, bj: int, x: np.ndarray, steps: int, gaps: list[float] | None = None) -> pa.RecordBatch:
    """A tile and, if there are more steps, the strips that its neighbours need for them."""
    rows = [(bi, bj, 0, 0, x.tobytes(), gaps)]
    by, bx = cut.borders(steps)
    part = lambda d, b: slice(None) if d == 0 else slice(0, b) if d < 0 else slice(-b, None)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            to = cut.neighbour(bi, bj, dy, dx)
            if steps and (dy or dx) and to is not None and not (dy and not by or dx and not bx):
                # the neighbour sees this tile from the other side
                rows.append((*to, -dy, -dx, np.ascontiguousarray(x[:, part(dy, by), part(dx, bx)]).tobytes(), None))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def tiles_of(cut: Cut, planes: list[DataFrame], steps: int) -> DataFrame:
    """The tiles of planes of cells (i0, i1, v), and the strips for the first exchange."""
    cells = None
    for k, df in enumerate(planes):
        some = df.select(cut.tile_of(0, "i0").alias("bi"), cut.tile_of(1, "i1").alias("bj"), F.lit(k).alias("plane"), F.col("i0").cast("int").alias("i"), F.col("i1").cast("int").alias("j"), "v")
        cells = some if cells is None else cells.unionByName(some)

    def fill(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        x = np.zeros((cut.planes, *cut.sizes(bi, bj)))
        x[group["plane"].to_numpy(), group["i"].to_numpy() - cut.edges(0, bi)[0], group["j"].to_numpy() - cut.edges(1, bj)[0]] = group["v"].to_numpy()
        return pa.Table.from_batches([_given(cut, bi, bj, x, steps)])

    return cells.groupBy("bi", "bj").applyInArrow(fill, _ROWS)


def advanced(cut: Cut, tiles: DataFrame, step: Callable[[np.ndarray], np.ndarray], steps: int, after: int, measured: bool = False) -> DataFrame:
    """The tiles after ``steps`` steps, with strips for ``after`` more; measured: with the sums of squared changes of each step."""
    by, bx = cut.borders(steps)

    def run(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        h, w = cut.sizes(bi, bj)
        x = np.zeros((cut.planes, h + 2 * by, w + 2 * bx))
        at = lambda d, b, n: slice(b, b + n) if d == 0 else slice(0, b) if d < 0 else slice(b + n, None)
        for dy, dx, data in rows_of([group], "dy", "dx", "data"):
            here = x[:, at(dy, by, h), at(dx, bx, w)]
            here[...] = np.frombuffer(data).reshape(here.shape)
        if cut.periodic:
            for axis, b, n, k in ((1, by, h, cut.tiles[0]), (2, bx, w, cut.tiles[1])):
                if k == 1:
                    x = np.take(x, b + np.arange(-b, n + b) % n, axis)
        inside = [np.arange(a - b, e + b) for (a, e), b in ((cut.edges(0, bi), by), (cut.edges(1, bj), bx))]
        inside = [(i >= 0) & (i < n) | cut.periodic for i, n in zip(inside, cut.shape)]
        outside = None if all(i.all() for i in inside) else ~np.outer(*inside)
        gaps = []
        for _ in range(steps):
            new = step(x)
            if outside is not None:
                new[outside] = 0.0
            if measured:
                gaps.append(float(np.square(new[by : by + h, bx : bx + w] - x[0, by : by + h, bx : bx + w]).sum()))
            x[0] = new
        return pa.Table.from_batches([_given(cut, bi, bj, np.ascontiguousarray(x[:, by : by + h, bx : bx + w]), after, gaps if measured else None)])

    return tiles.groupBy("bi", "bj").applyInArrow(run, _ROWS)


def cells_of(cut: Cut, tiles: DataFrame) -> DataFrame:
    """(i0, i1, v) of the first plane of tiles without strips."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, data in rows_of(batches, "bi", "bj", "data"):
            h, w = cut.sizes(bi, bj)
            x, (top, _), (left, end) = np.frombuffer(data).reshape(cut.planes, h, w)[0], cut.edges(0, bi), cut.edges(1, bj)
            rows = max(1, CELLS // w)
            for r in range(0, h, rows):
                some = x[r : r + rows]
                yield pa.RecordBatch.from_arrays([np.repeat(np.arange(top + r, top + r + len(some)), w), np.tile(np.arange(left, end), len(some)), some.reshape(-1)], ["i0", "i1", "v"])

    return tiles.select("bi", "bj", "data").mapInArrow(give, "i0 long, i1 long, v double")


def exchanges(cut: Cut, steps: int, most: int | None = None) -> list[int]:
    """The steps of each exchange, ``most`` at most."""
    deep = min(cut.deep or max(1, steps), most or steps or 1)
    return [deep] * (steps // deep) + ([steps % deep] if steps % deep else [])


def repeated(cut: Cut, planes: list[DataFrame], step: Callable, steps: int) -> DataFrame:
    """(i0, i1, v) after a number of steps. Long runs are cut by written tables, of which only the last is kept."""
    runs = exchanges(cut, steps)
    tiles, table = tiles_of(cut, planes, runs[0] if runs else 0), None
    for k, n in enumerate(runs):
        tiles = advanced(cut, tiles, step, n, runs[k + 1] if k + 1 < len(runs) else 0)
        if (k + 1) % CUT == 0 and k + 1 < len(runs):
            tiles = written(tiles, "grid")
            drop(*[table] if table is not None else [])
            table = tiles
    return cells_of(cut, tiles)


def _checked(t: Tensor, boundary: str) -> None:
    if t.rank != 2 or boundary not in BOUNDARIES:
        raise TensorError(f"a stencil on {t.shape} with boundary {boundary}")


def _tap(x: np.ndarray, a: int, b: int, reach: tuple[int, int]) -> np.ndarray:
    """A plane as seen at an offset, without the outermost cells that a step reaches."""
    (ry, rx), (h, w) = reach, x.shape
    return x[ry + a : h - ry + a, rx + b : w - rx + b]


def _placed(inner: np.ndarray, x: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    out = np.zeros_like(x)
    out[reach[0] : x.shape[0] - reach[0], reach[1] : x.shape[1] - reach[1]] = inner
    return out


def stencil_2d(grid: Tensor, kernel=LAPLACIAN_5, boundary: str = "zero", iterations: int = 1) -> Tensor:
    """Repeated cross-correlation of the same size, padded by half the kernel on either axis."""
    _checked(grid, boundary)
    k = np.asarray(kernel, float)
    reach = (k.shape[0] // 2, k.shape[1] // 2)
    taps = [(a - reach[0], b - reach[1], float(k[a, b])) for a in range(k.shape[0]) for b in range(k.shape[1]) if k[a, b]]

    def step(x: np.ndarray) -> np.ndarray:
        inner = sum((_tap(x[0], a, b, reach) * w for a, b, w in taps), np.zeros_like(_tap(x[0], 0, 0, reach)))
        return _placed(inner, x[0], reach)

    cut = cut_of(grid.shape, reach, boundary, 1)
    return grid.with_df(repeated(cut, [grid.df], step, iterations), sparse=False)


def jacobi_2d(grid: Tensor, rhs: Tensor, dx: float = 1.0, boundary: str = "zero", iterations: int = 100, tol: float | None = 1e-6) -> tuple[Tensor, int]:
    """(u, steps): u' = (up + down + left + right - dx^2 f) / 4 until the step's L2 norm is below ``tol``.

    Without ``tol`` all steps are taken and none is measured. With it, every exchange is written, and its steps' norms are observed
    by that write. Once the number of steps is known, the result is planned anew from the grid, as far as ``repeated`` needs no table, and all tables are deleted.
    """
    _checked(grid, boundary)
    if grid.shape != rhs.shape:
        raise TensorError("grid and right-hand side have different shapes")
    cut, around = cut_of(grid.shape, (1, 1), boundary, 2), ((-1, 0), (1, 0), (0, -1), (0, 1))

    def step(x: np.ndarray) -> np.ndarray:
        u, f = x
        return _placed((sum(_tap(u, a, b, (1, 1)) for a, b in around) - dx * dx * _tap(f, 0, 0, (1, 1))) / 4, u, (1, 1))

    planes = [grid.df, rhs.df]
    steps = iterations if tol is None else steps_to(cut, planes, step, iterations, tol)
    return grid.with_df(repeated(cut, planes, step, steps), sparse=False), steps


def steps_to(cut: Cut, planes: list[DataFrame], step: Callable, most: int, tol: float) -> int:
    """The number of steps after which a step's L2 norm is below ``tol``, at most ``most``."""
    runs, done, table = exchanges(cut, most, TILE // DEEP), 0, None
    tiles = tiles_of(cut, planes, runs[0] if runs else 0)
    for k, n in enumerate(runs):
        tiles = advanced(cut, tiles, step, n, runs[k + 1] if k + 1 < len(runs) else 0, measured=True)
        seen = Observation()
        new = written(tiles.observe(seen, *[F.sum(F.get("gaps", F.lit(s))).alias(f"gap_{s}") for s in range(n)]), "grid")
        drop(*[table] if table is not None else [])
        tiles = table = new
        gaps = [math.sqrt(seen.get[f"gap_{s}"] or 0.0) for s in range(n)]
        found = next((s + 1 for s, g in enumerate(gaps) if g < tol), None)
        done += found or n
        if found:
            break
    drop(*[table] if table is not None else [])
    return done
