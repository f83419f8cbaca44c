"""The tile layout of large dense matrices: one row per tile, its cells one binary value.

A tile row is (bi, bj, data): the tile's place in the grid of tiles and its cells by rows, as doubles, or as half precision where
a product is asked for in it. Tiles are made once, from cells or from array rows, and moved as they are; the last tile of a row or
column is smaller. An absent tile is one of zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError

#: Largest and smallest edge of a tile, and tiles of a result below which edges are halved.
LARGEST, SMALLEST, ENOUGH = 1024, 128, 16
#: Cells given out at a time, bytes of a side that a task of a product holds, groups below which fewer tiles go to a task.
CELLS, HELD, GROUPS = 1 << 18, 1 << 24, 48
#: Rounded cells that are ordered at once, and the bits of their places.
PLACE = 24
SHEET = 1 << PLACE
TILE_SCHEMA = "bi int, bj int, data binary"
_ARROW = pa.schema({"bi": pa.int32(), "bj": pa.int32(), "data": pa.binary()})


@dataclass(frozen=True)
class Tiled:
    df: DataFrame
    shape: tuple[int, int]
    tile: int
    kind: str = "f8"

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of tiles."""
        return -(-self.shape[0] // self.tile), -(-self.shape[1] // self.tile)

    def extent(self, bi: int, bj: int) -> tuple[int, int]:
        """Rows and columns of a tile."""
        return min(self.tile, self.shape[0] - bi * self.tile), min(self.tile, self.shape[1] - bj * self.tile)

    def with_df(self, df: DataFrame, **changes) -> Tiled:
        return replace(self, df=df, **changes)

    def array(self, bi: int, bj: int, data) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(self.extent(bi, bj)).astype(np.float64, copy=False)

    def handle(self) -> Tiled:
        """What a task needs of it: everything but the rows."""
        return replace(self, df=None)


def tile_for(rows: int, columns: int) -> int:
    """The edge of the tiles of a result: the largest with enough tiles to share out."""
    tile = LARGEST
    while tile > SMALLEST and -(-rows // tile) * -(-columns // tile) < ENOUGH:
        tile //= 2
    return tile


def rows_of(tables, *names: str) -> Iterator[tuple]:
    """Rows of Arrow tables; binary values stay where they are."""
    for t in tables:
        columns = [t.column(n) for n in names]
        for k in range(t.num_rows):
            yield tuple(c[k].as_buffer() if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c[k].as_py() for c in columns)


def packed(cells: DataFrame, key: str) -> DataFrame:
    """(key, at, v): the places and values of a key's cells as one row of binary values."""

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({key: group[key][:1], "at": pa.array([group["at"].to_numpy().astype("i8").tobytes()], pa.binary()), "v": pa.array([group["v"].to_numpy().astype("f8").tobytes()], pa.binary())})

    return cells.groupBy(key).applyInArrow(pack, f"{key} long, at binary, v binary")


def filled(group: pa.Table, size: int) -> np.ndarray:
    """The array of a group's cells, packed or one by one; absent cells, and packed rows that are null, are 0."""
    out = np.zeros(size)
    if not pa.types.is_binary(group["at"].type):
        out[group["at"].to_numpy()] = group["v"].to_numpy()
        return out
    for at, v in rows_of([group], "at", "v"):
        if at is not None:
            out[np.frombuffer(at, np.int64)] = np.frombuffer(v)
    return out


def tile_batch(bi: int, bj: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bi": [bi], "bj": [bj], "data": [data.tobytes()]}, _ARROW)


def bundled(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., at, v) of cells (keys..., at, v), which are long: the cells of a key that a batch holds are one row of compressed binary values, so that a shuffle moves few bytes a cell."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy() for k in (*keys, "at")]
            v = b.column("v").to_numpy(zero_copy_only=False)
            # cells often come in order; a step back in any column but where one before it goes on is none
            back = np.zeros(len(v) - 1, bool)
            for c in columns[::-1]:
                back = (c[1:] < c[:-1]) | (c[1:] == c[:-1]) & back
            if back.any():
                order = np.lexsort(columns[::-1])
                columns, v = [c[order] for c in columns], v[order]
            *own, at = columns
            cuts = np.nonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in own])]))[0]
            ends = [*cuts[1:], len(v)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[cuts]) for c in own], pa.array([deflated(np.diff(at[s:e], prepend=0)) for s, e in zip(cuts, ends)], pa.binary()), pa.array([deflated(v[s:e]) for s, e in zip(cuts, ends)], pa.binary())],
                [*keys, "at", "v"],
            )

    return cells.select(*keys, "at", "v").mapInArrow(bundle, "".join(f"{k} long, " for k in keys) + "at binary, v binary")


def deflated(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first bytes of all first."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes(), 1)


def inflated(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def unbundled(group: pa.Table, size: int) -> np.ndarray:
    """The array of a key's bundles; absent cells are 0."""
    out = np.zeros(size)
    for at, v in rows_of([group], "at", "v"):
        out[np.cumsum(inflated(at, "i8"))] = inflated(v, "f8")
    return out


def from_cells(t: Tensor, tile: int, kind: str = "f8") -> Tiled:
    """Tiles of a matrix of cells: each cell is shuffled once, in bundles of places in the tile and values."""
    if t.rank != 2 or t.complex:
        raise TensorError("tiles are made of real matrices")
    out = Tiled(None, t.shape, tile, kind)
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    cells = bundled(t.df.select(at("i0").alias("bi"), at("i1").alias("bj"), ((F.col("i0") % tile) * tile + F.col("i1") % tile).cast("long").alias("at"), F.col("v").cast("double").alias("v")), "bi", "bj")

    def fill(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        whole = unbundled(group, tile * tile)
        nr, nc = out.extent(bi, bj)
        return pa.Table.from_batches([tile_batch(bi, bj, whole.reshape(tile, tile)[:nr, :nc].astype(kind))])

    return out.with_df(cells.groupBy("bi", "bj").applyInArrow(fill, TILE_SCHEMA))


def from_lines(df: DataFrame, shape: tuple[int, int], index: str, array: str, tile: int, kind: str = "f8") -> Tiled:
    """Tiles of rows (index, array): a row is cut into one piece per column of tiles, and pieces are stacked."""
    out = Tiled(None, shape, tile, kind)
    rows = df.select(F.col(index).cast("long").alias("i"), F.col(array).cast("array<double>").alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column("i").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(len(i), shape[1])
            for bi in np.unique(i // tile):
                here = i // tile == bi
                for bj in range(out.grid[1]):
                    piece = np.ascontiguousarray(x[here, bj * tile : (bj + 1) * tile]).astype(kind)
                    yield pa.RecordBatch.from_pydict({"bi": [bi], "bj": [bj], "rows": [(i[here] % tile).astype(np.int32).tobytes()], "data": [piece.tobytes()]}, pa.schema({"bi": pa.int32(), "bj": pa.int32(), "rows": pa.binary(), "data": pa.binary()}))

    def stack(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        whole = np.zeros(out.extent(bi, bj), kind)
        for rows_, data in rows_of([group], "rows", "data"):
            at = np.frombuffer(rows_, np.int32)
            whole[at] = np.frombuffer(data, kind).reshape(len(at), -1)
        return pa.Table.from_batches([tile_batch(bi, bj, whole)])

    pieces = rows.mapInArrow(cut, "bi int, bj int, rows binary, data binary")
    return out.with_df(pieces.groupBy("bi", "bj").applyInArrow(stack, TILE_SCHEMA))


def rounded(x: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values as whole units of the last of ``digits`` places, halves away from zero, and as rounded values; what is not finite, or too large for units, stays."""
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(x) * scale
        units = np.floor(size)
        units += size - units >= 0.5
        units = np.copysign(units, x)
        return units, np.where(np.isfinite(units), units / scale, x) + 0.0


def cells_of(pieces: Iterator[tuple[int, int, np.ndarray]], digits: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, v) arrays, up to ``CELLS`` long, of the cells of pieces (first row, first column, cells by rows).

    With ``digits`` values are rounded to so many places, and cells come in order of their values, up to ``SHEET`` of them at a time, where
    rounded values repeat: a columnar file holds runs of a value and short numbers of rows and columns in half the bytes that the
    values take in order of their places. Where the middle nine tenths cannot repeat twice on average, cells come as they are.
    """
    keys, some, n = np.empty(SHEET if digits is not None else 0, np.int64), [], 0

    def ordered() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        low, high = np.quantile(keys[: n : -(-n // 65_536) | 1] >> PLACE, [0.05, 0.95])
        if 2 * (high - low) <= 0.9 * n:
            keys[:n].sort()
        start, first, column, width = np.array(some).T
        for at in range(0, n, CELLS):
            key = keys[at : min(n, at + CELLS)]
            place = key & (SHEET - 1)
            of = np.searchsorted(start, place, "right") - 1
            i, j = np.divmod(place - start[of], width[of])
            yield i + first[of], j + column[of], (key >> PLACE) / 10.0**digits

    for first, column, x in pieces:
        step = max(1, CELLS // x.shape[1])
        for r in range(0, len(x), step):
            v = x[r : r + step]
            if digits is not None:
                units, v = rounded(v, digits)
                # a key has the units above the place
                if v.size <= SHEET and np.abs(units).max() < 1 << 62 - PLACE:
                    if n + v.size > SHEET:
                        yield from ordered()
                        some, n = [], 0
                    some.append((n, first + r, column, v.shape[1]))
                    keys[n : n + v.size] = units.reshape(-1).astype(np.int64) << PLACE | np.arange(n, n + v.size)
                    n += v.size
                    continue
            yield np.repeat(np.arange(first + r, first + r + len(v)), v.shape[1]), np.tile(np.arange(column, column + v.shape[1]), len(v)), v.reshape(-1)
    if n:
        yield from ordered()


def to_cells(t: Tiled, sparse: bool = False, digits: int | None = None) -> Tensor:
    """The cells of tiles, a few at a time, rounded to ``digits`` places if that is given (``cells_of``)."""
    of = t.handle()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = ((bi * of.tile, bj * of.tile, of.array(bi, bj, data)) for bi, bj, data in rows_of(batches, "bi", "bj", "data"))
        for cells in cells_of(tiles, digits):
            yield pa.RecordBatch.from_arrays([*cells], ["i0", "i1", "v"])

    return Tensor(t.df.mapInArrow(give, "i0 long, i1 long, v double"), t.shape, sparse)


def to_lines(t: Tiled) -> DataFrame:
    """(i0, j0, x): the rows of the tiles as arrays, j0 is the first column of each."""
    of = t.handle()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, data in rows_of(batches, "bi", "bj", "data"):
            x = of.array(bi, bj, data)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([np.arange(bi * of.tile, bi * of.tile + len(x)), np.full(len(x), bj * of.tile), lists], ["i0", "j0", "x"])

    return t.df.mapInArrow(give, "i0 long, j0 long, x array<double>")


def transposed(t: Tiled) -> Tiled:
    """Tiles change places and are turned where they are: nothing is shuffled."""
    of = t.handle()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, data in rows_of(batches, "bi", "bj", "data"):
            yield tile_batch(bj, bi, np.ascontiguousarray(np.frombuffer(data, of.kind).reshape(of.extent(bi, bj)).T))

    return t.with_df(t.df.mapInArrow(turn, TILE_SCHEMA), shape=(t.shape[1], t.shape[0]))


def together(rows: int, columns: int, size: int) -> int:
    """Tiles of a side that meet in one task, where a side has ``rows`` or ``columns`` tiles of ``size`` bytes: as many as it may hold while tasks are enough."""
    some = 1
    while 2 * some * size <= HELD and -(-rows // (2 * some)) * -(-columns // (2 * some)) >= GROUPS:
        some *= 2
    return some


def product(a: Tiled, b: Tiled, panel: int = 4) -> Tiled:
    """A @ B: some rows of tiles of A meet some columns of tiles of B, so a tile goes once to each group of the other side.

    A key is a group of rows, one of columns and a panel of the common axis of ``panel`` tiles. ``together`` bounds what a task holds:
    short common axes make large groups, so that less is moved. A task gives out one tile of the result at a time; panels of a tile
    are summed as arrays after one more shuffle.
    """
    if a.shape[1] != b.shape[0] or a.tile != b.tile:
        raise TensorError(f"product of {a.shape} and {b.shape} in tiles of {a.tile} and {b.tile}")
    (rows, depth), columns = a.grid, b.grid[1]
    one, two, out = a.handle(), b.handle(), Tiled(None, (a.shape[0], b.shape[1]), a.tile)
    some = together(rows, columns, a.tile * min(a.shape[1], panel * a.tile) * np.dtype(a.kind).itemsize)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(-(-n // some) - 1)))
    part = lambda c, n: F.floor(F.col(c) / n).cast("int")
    left = a.df.select(part("bi", some).alias("gi"), every(columns).alias("gj"), part("bj", panel).alias("p"), F.lit(0).alias("side"), F.col("bi").alias("at"), F.col("bj").alias("k"), "data")
    right = b.df.select(every(rows).alias("gi"), part("bj", some).alias("gj"), part("bi", panel).alias("p"), F.lit(1).alias("side"), F.col("bj").alias("at"), F.col("bi").alias("k"), "data")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[dict, dict] = {}, {}
        for side, at, k, data in rows_of(batches, "side", "at", "k", "data"):
            held[side].setdefault(at, {})[k] = data
        for bi, x in held[0].items():
            for bj, y in held[1].items():
                total = None
                for k in x.keys() & y.keys():
                    piece = one.array(bi, k, x[k]) @ two.array(k, bj, y[k])
                    total = piece if total is None else np.add(total, piece, out=total)
                if total is not None:
                    yield tile_batch(bi, bj, total)

    made = left.unionByName(right).groupBy("gi", "gj", "p").applyInArrow(multiply, TILE_SCHEMA)
    return summed(out.with_df(made)) if depth > panel else out.with_df(made)


def summed(t: Tiled) -> Tiled:
    """The sum of the tiles of one place."""
    of = t.handle()

    def add(group: pa.Table) -> pa.Table:
        bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
        total = np.zeros(of.extent(bi, bj))
        for (data,) in rows_of([group], "data"):
            total += of.array(bi, bj, data)
        return pa.Table.from_batches([tile_batch(bi, bj, total)])

    return t.with_df(t.df.groupBy("bi", "bj").applyInArrow(add, TILE_SCHEMA))
