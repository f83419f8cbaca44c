"""Convolutions (cross-correlations) of two or three spatial axes, as products of patch matrices.

Images are cut into tiles: several small images, or a band of a large one along its first spatial axis with the input rows that its
output rows see, so neighbouring bands overlap. Kernels are cut into blocks of output channels. A tile and a block meet by a shuffle on
both their numbers: in an Arrow batch the tile's patches become a matrix that is multiplied with the block. Tiles are
at least as large as blocks, so sending every block to every tile moves no more than the images times the number of blocks. Neither side is broadcast, and no key
is a channel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError
from loomgrid.sources.tiles import CELLS, filled, packed, rows_of

#: Cells of a tile of images and of a block of kernels.
TILE, BLOCK = 1 << 17, 1 << 19


@dataclass(frozen=True)
class Shapes:
    """Images, kernels and how they meet. Spatial tuples are (first axis, ...)."""

    images: int
    channels: int
    space: tuple[int, ...]
    outs: int
    per: int
    kernel: tuple[int, ...]
    stride: tuple[int, ...]
    padding: tuple[int, ...]
    dilation: tuple[int, ...]
    groups: int
    #: Cells of a tile and of a block.
    tile: int
    block: int

    @property
    def size(self) -> tuple[int, ...]:
        """The output's spatial shape."""
        return tuple((s + 2 * p - d * (k - 1) - 1) // t + 1 for s, k, t, p, d in zip(self.space, self.kernel, self.stride, self.padding, self.dilation))

    @property
    def at_once(self) -> int:
        """Whole images of a tile; 1 where an image is cut into bands."""
        return max(1, self.most // (self.channels * prod(self.space)))

    @property
    def most(self) -> int:
        return max(self.tile, min(self.block, self.outs * self.taps))

    @property
    def taps(self) -> int:
        return self.per * prod(self.kernel)

    @property
    def rows(self) -> int:
        """Output rows of a band; all of them where tiles hold whole images."""
        row = self.channels * prod(self.space[1:])
        return self.size[0] if row * self.space[0] <= self.most else max(1, self.most // (row * self.stride[0]))

    @property
    def bands(self) -> int:
        return -(-self.size[0] // self.rows)

    @property
    def group_outs(self) -> int:
        return self.outs // self.groups

    @property
    def out_block(self) -> int:
        """Output channels of a block: within one group, or whole groups."""
        most = max(1, self.block // self.taps)
        if most < self.group_outs:
            return max(d for d in range(1, most + 1) if self.group_outs % d == 0)
        return min(self.groups, most // self.group_outs) * self.group_outs

    @property
    def blocks(self) -> int:
        return -(-self.outs // self.out_block)

    def seen(self, band: int) -> tuple[int, int]:
        """The padded input rows, from and to, that a band's output rows see."""
        first, last = band * self.rows, min((band + 1) * self.rows, self.size[0]) - 1
        return first * self.stride[0], last * self.stride[0] + self.dilation[0] * (self.kernel[0] - 1) + 1


def _tiles(x: Tensor, s: Shapes) -> DataFrame:
    """(tile, at, v): cells by tile; ``at`` is the place in the tile's padded array."""
    row, deep = F.col("i2") + s.padding[0], s.dilation[0] * (s.kernel[0] - 1)
    if s.bands > 1:
        # the bands whose first and last seen rows have the cell between them
        step = s.rows * s.stride[0]
        low = F.greatest(F.lit(0), F.ceil((row - deep - step + s.stride[0]) / step))
        high = F.least(F.lit(s.bands - 1), F.floor(row / step))
        cells = x.df.withColumn("band", F.explode(F.when(low <= high, F.sequence(low, high))))
        ends = F.least((F.col("band") + 1) * s.rows, F.lit(s.size[0])) * s.stride[0] - s.stride[0] + deep
        cells = cells.where(row <= ends).withColumn("row", row - F.col("band") * step)
    else:
        cells = x.df.withColumn("band", F.lit(0)).withColumn("row", row)
    wide = [n + 2 * p for n, p in zip(s.space[1:], s.padding[1:])]
    at = (F.col("i0") % s.at_once) * s.channels + F.col("i1")
    at = at * _height(s) + F.col("row")
    for k, n in enumerate(wide):
        at = at * n + F.col(f"i{k + 3}") + s.padding[k + 1]
    tile = F.floor(F.col("i0") / s.at_once) * s.bands + F.col("band")
    return cells.select(tile.cast("long").alias("tile"), at.cast("long").alias("at"), "v")


def _height(s: Shapes) -> int:
    """Padded rows of a tile's array."""
    return s.space[0] + 2 * s.padding[0] if s.bands == 1 else (s.rows - 1) * s.stride[0] + s.dilation[0] * (s.kernel[0] - 1) + 1


def patches(x: np.ndarray, s: Shapes, rows: int) -> np.ndarray:
    """(images, channels, output places..., kernel places...): a view of a padded array."""
    size = (rows, *s.size[1:])
    strides = (*x.strides[:2], *[a * t for a, t in zip(x.strides[2:], s.stride)], *[a * d for a, d in zip(x.strides[2:], s.dilation)])
    return np.lib.stride_tricks.as_strided(x, (*x.shape[:2], *size, *s.kernel), strides, writeable=False)


def convolve(x: Tensor, w: Tensor, bias: Tensor | None, stride: tuple, padding: tuple, dilation: tuple, groups: int) -> Tensor:
    """x[N, C, ...] with w[O, C / groups, ...]; absent cells of either are 0."""
    axes = x.rank - 2
    if w.rank != x.rank or x.shape[1] != w.shape[1] * groups or w.shape[0] % groups or not len(stride) == len(padding) == len(dilation) == axes:
        raise TensorError(f"convolution of {x.shape} with {w.shape} in {groups} groups")
    s = Shapes(x.shape[0], x.shape[1], tuple(x.shape[2:]), w.shape[0], w.shape[1], tuple(w.shape[2:]), tuple(stride), tuple(padding), tuple(dilation), groups, TILE, BLOCK)
    if min(s.size) < 1:
        raise TensorError("the kernel is larger than the padded input")
    spark, axes_of_kernel = x.df.sparkSession, [F.col(f"i{k + 2}") for k in range(axes)]
    tap = F.col("i1")
    for n, c in zip(s.kernel, axes_of_kernel):
        tap = tap * n + c
    # a block's last column is the bias
    taps = w.df.select(F.floor(F.col("i0") / s.out_block).cast("long").alias("block"), ((F.col("i0") % s.out_block) * (s.taps + 1) + tap).cast("long").alias("at"), "v")
    if bias is not None:
        taps = taps.unionByName(bias.df.select(F.floor(F.col("i0") / s.out_block).cast("long").alias("block"), ((F.col("i0") % s.out_block) * (s.taps + 1) + s.taps).cast("long").alias("at"), "v"))
    count = -(-s.images // s.at_once) * s.bands
    tiles, blocks = packed(_tiles(x, s), "tile"), packed(taps, "block")
    # tiles and blocks without a cell are there, with zeros
    none = lambda n, name: spark.range(n).select(F.col("id").alias(name), *[F.lit(None).cast("binary").alias(c) for c in ("at", "v")])
    tiles, blocks = tiles.unionByName(none(count, "tile")), blocks.unionByName(none(s.blocks, "block"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left, right = tiles.withColumn("block", every(s.blocks)), blocks.withColumn("tile", every(count))

    def multiply(tile: pa.Table, block: pa.Table) -> pa.Table:
        number, o = tile["tile"][0].as_py(), tile["block"][0].as_py()
        first, band = number // s.bands * s.at_once, number % s.bands
        images, rows = min(s.at_once, s.images - first), min(s.rows, s.size[0] - band * s.rows)
        outs = min(s.out_block, s.outs - o * s.out_block)
        kernel = filled(block, s.out_block * (s.taps + 1)).reshape(s.out_block, -1)[:outs]
        padded = [_height(s), *[n + 2 * p for n, p in zip(s.space[1:], s.padding[1:])]]
        cells = filled(tile, s.at_once * s.channels * prod(padded)).reshape(s.at_once, s.channels, *padded)[:images]
        view = patches(cells, s, rows)
        out = np.empty((outs, images, rows, *s.size[1:]))
        per_group = min(s.group_outs, outs)
        for a in range(0, outs, per_group):
            g = (o * s.out_block + a) // s.group_outs
            own = np.moveaxis(view[:, g * s.per : (g + 1) * s.per], 1, 1 + axes)
            flat = own.reshape(images * rows * prod(s.size[1:]), s.taps)
            out[a : a + per_group] = (kernel[a : a + per_group, :-1] @ flat.T + kernel[a : a + per_group, -1:]).reshape(per_group, *out.shape[1:])
        return pa.table({"tile": pa.array([number], pa.int64()), "block": pa.array([o], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, o, data in rows_of(batches, "tile", "block", "data"):
            first, band = number // s.bands * s.at_once, number % s.bands
            images, rows = min(s.at_once, s.images - first), min(s.rows, s.size[0] - band * s.rows)
            shape = (min(s.out_block, s.outs - o * s.out_block), images, rows, *s.size[1:])
            flat, starts = np.frombuffer(data), (o * s.out_block, first, band * s.rows, *[0] * (axes - 1))
            for at in range(0, len(flat), CELLS):
                some = flat[at : at + CELLS]
                index = np.unravel_index(np.arange(at, at + len(some)), shape)
                index = [i + a for i, a in zip(index, starts)]
                yield pa.RecordBatch.from_arrays([index[1], index[0], *index[2:], some], [*[f"i{k}" for k in range(axes + 2)], "v"])

    made = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(multiply, "tile long, block long, data binary")
    schema = "".join(f"i{k} long, " for k in range(x.rank)) + "v double"
    return Tensor(made.mapInArrow(give, schema), (s.images, s.outs, *s.size))


def conv2d(x: Tensor, w: Tensor, bias: Tensor | None = None, stride=(1, 1), padding=(0, 0), dilation=(1, 1), groups: int = 1) -> Tensor:
    return convolve(x, w, bias, stride, padding, dilation, groups)


def conv3d(x: Tensor, w: Tensor, bias: Tensor | None = None, stride=(1, 1, 1), padding=(0, 0, 0), dilation=(1, 1, 1), groups: int = 1) -> Tensor:
    return convolve(x, w, bias, stride, padding, dilation, groups)
