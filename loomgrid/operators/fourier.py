"""Discrete Fourier transforms along any axis.

Short axes are gathered as lines by key and transformed in Arrow batches. A large plane is two passes over array blocks: bands of
rows are transformed along the row and cut into blocks of columns, which are exchanged as binary values, stacked, and transformed along the
column. A long axis is folded into such a plane, n = N2 n1 + n2, with a factor between the passes (the four-step transform), so no group
holds more than a band of about the root of the length, and the exchange is one shuffle of arrays. A length without a factor
near its root is brought to a power of two by Bluestein's convolution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.meta import Tensor, TensorError
from loomgrid.sources.layouts import to_lines
from loomgrid.sources.tiles import CELLS, rows_of

NORMS = ("backward", "ortho", "forward")
#: Cells of an axis, or of a plane, from which they are transformed in blocks, and of a band of such a plane.
LONG, PLANE, BAND = 1 << 14, 1 << 15, 1 << 17
#: How much longer than the other one side of a folded axis may be.
ASKEW = 64


def blocks(cells: DataFrame, others: list[str], shape: tuple[int, int], kind: str, norm: str, turned: int | None = None) -> DataFrame:
    """(others..., i, j, re, im): planes of cells (others..., i, j, re, im) transformed along j and then along i; absent cells are 0.

    turned: the length of the folded axis; what is between the passes is then multiplied by its roots of unity to the power i j.
    """
    high, wide = shape
    rows, columns = max(1, BAND // wide), max(1, BAND // high)
    transform, sign = getattr(np.fft, kind), -1 if kind == "fft" else 1
    keys = pa.schema([*[(c, pa.int64()) for c in others], ("block", pa.int64())])
    named = "".join(f"{c} long, " for c in others)

    def first(group: pa.Table) -> pa.Table:
        own = [group[c][0].as_py() for c in others]
        top = group["band"][0].as_py() * rows
        x = np.zeros((min(rows, high - top), wide), complex)
        x[group["i"].to_numpy() - top, group["j"].to_numpy()] = group["re"].to_numpy() + 1j * group["im"].to_numpy()
        y = transform(x, axis=1, norm=norm)
        if turned:
            y *= np.exp(sign * 2j * np.pi / turned * (np.outer(np.arange(top, top + len(y), dtype=np.int64), np.arange(wide, dtype=np.int64)) % turned))
        pieces = [(*own, b, top, np.ascontiguousarray(y[:, b * columns : (b + 1) * columns]).tobytes()) for b in range(-(-wide // columns))]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*pieces)], schema=keys.append(pa.field("top", pa.int64())).append(pa.field("data", pa.binary())))

    def second(group: pa.Table) -> pa.Table:
        own, block = [group[c][0].as_py() for c in others], group["block"][0].as_py()
        x = np.zeros((high, min(columns, wide - block * columns)), complex)
        for top, data in rows_of([group], "top", "data"):
            some = np.frombuffer(data, complex).reshape(-1, x.shape[1])
            x[top : top + len(some)] = some
        y = transform(x, axis=0, norm=norm)
        return pa.Table.from_arrays([pa.array([v]) for v in (*own, block, y.tobytes())], schema=keys.append(pa.field("data", pa.binary())))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *own, block, data in rows_of(batches, *others, "block", "data"):
            y = np.frombuffer(data, complex).reshape(high, -1)
            j, step = np.arange(y.shape[1]) + block * columns, max(1, CELLS // y.shape[1])
            for top in range(0, high, step):
                some = y[top : top + step].reshape(-1)
                n = len(some) // len(j)
                yield pa.RecordBatch.from_arrays([*[np.full(len(some), v, np.int64) for v in own], np.repeat(np.arange(top, top + n), len(j)), np.tile(j, n), some.real.copy(), some.imag.copy()], [*others, "i", "j", "re", "im"])

    banded = cells.select(*others, F.floor(F.col("i") / rows).cast("long").alias("band"), "i", "j", "re", "im")
    pieces = banded.groupBy(*others, "band").applyInArrow(first, named + "block long, top long, data binary")
    done = pieces.groupBy(*others, "block").applyInArrow(second, named + "block long, data binary")
    return done.mapInArrow(give, named + "i long, j long, re double, im double")


def folded(n: int) -> tuple[int, int] | None:
    """(N1, N2) with N1 N2 = n and sides near each other; None where no factors are."""
    side = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return (side, n // side) if n // side <= ASKEW * side else None


def long_axis(cells: DataFrame, others: list[str], n: int, kind: str, norm: str) -> DataFrame:
    """(others..., at, re, im): lines of cells (others..., at, re, im), of length n, transformed; absent cells are 0."""
    sides = folded(n)
    if sides is None:
        return chirped(cells, others, n, kind, norm)
    n1, n2 = sides
    plane = cells.select(*others, (F.col("at") % n2).alias("i"), F.floor(F.col("at") / n2).cast("long").alias("j"), "re", "im")
    done = blocks(plane, others, (n2, n1), kind, norm, turned=n)
    return done.select(*others, (F.col("j") + F.col("i") * n1).alias("at"), "re", "im")


def chirped(cells: DataFrame, others: list[str], n: int, kind: str, norm: str) -> DataFrame:
    """``long_axis`` of any length, as a convolution with a chirp of the next power of two: k m = (k^2 + m^2 - (k - m)^2) / 2."""
    whole, sign = 1 << (2 * n - 2).bit_length(), -1.0 if kind == "fft" else 1.0
    angle = lambda k: F.lit(sign * np.pi / n) * ((k * k) % (2 * n))
    times = lambda a, b: ((a[0] * b[0] - a[1] * b[1]).alias("re"), (a[0] * b[1] + a[1] * b[0]).alias("im"))
    own, at = (F.col("re"), F.col("im")), F.col("at")
    turn: tuple[Column, Column] = (F.cos(angle(at)), F.sin(angle(at)))
    one = long_axis(cells.select(*others, "at", *times(own, turn)), others, whole, "fft", "backward")
    ring = cells.sparkSession.range(whole).select(F.col("id").alias("at"), F.least("id", F.lit(whole) - F.col("id")).alias("k")).where(F.col("k") < n)
    two = long_axis(ring.select("at", F.cos(angle(F.col("k"))).alias("re"), (-F.sin(angle(F.col("k")))).alias("im")), [], whole, "fft", "backward")
    both = one.join(two.select("at", F.col("re").alias("x"), F.col("im").alias("y")), "at")
    met = long_axis(both.select(*others, "at", *times(own, (F.col("x"), F.col("y")))), others, whole, "ifft", "backward").where(at < n)
    scale = {"backward": 1.0 if kind == "fft" else 1 / n, "ortho": n**-0.5, "forward": 1 / n if kind == "fft" else 1.0}[norm]
    return met.select(*others, "at", *times(own, turn)).select(*others, "at", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def _parts(t: Tensor) -> list[Column]:
    """The real and imaginary columns of a tensor."""
    return [F.col("re"), F.col("im")] if t.complex else [F.col("v").alias("re"), F.lit(0.0).alias("im")]


def _along(t: Tensor, kind: str, n: int | None, dim: int, norm: str) -> Tensor:
    if norm not in NORMS:
        raise TensorError(f"norm {norm}")
    if kind == "rfft" and t.complex:
        raise TensorError("rfft takes real tensors")
    axis = t.axis(dim)
    length = n or t.shape[axis]
    bins = length // 2 + 1 if kind == "rfft" else length
    shape = tuple(bins if k == axis else s for k, s in enumerate(t.shape))
    if length > LONG:
        others = [c for c in t.index if c != f"i{axis}"]
        cells = t.df.where(F.col(f"i{axis}") < length).select(*others, F.col(f"i{axis}").alias("at"), *_parts(t))
        done = long_axis(cells, others, length, "ifft" if kind == "ifft" else "fft", norm).where(F.col("at") < bins)
        return Tensor(done.select(*[F.col("at").alias(c) if c == f"i{axis}" else F.col(c) for c in t.index], "re", "im"), shape, complex=True)
    lines, others = to_lines(t, axis)
    values = t.values

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f[values[0]].to_numpy())
            if len(values) == 2:
                x = x + 1j * np.stack(f["im"].to_numpy())
            y = getattr(np.fft, kind)(x, n, axis=-1, norm=norm)
            yield f[others].assign(re=list(y.real), im=list(y.imag))

    schema = "".join(f"{c} long, " for c in others) + "re array<double>, im array<double>"
    made = lines.mapInPandas(run, schema)
    cells = made.select(*others, F.posexplode(F.arrays_zip("re", "im")).alias("at", "z"))
    out = cells.select(*[F.col("at").cast("long").alias(c) if c == f"i{axis}" else F.col(c) for c in t.index], F.col("z.re").alias("re"), F.col("z.im").alias("im"))
    return Tensor(out, shape, complex=True)


def fft(t: Tensor, n: int | None = None, dim: int = -1, norm: str = "backward") -> Tensor:
    return _along(t, "fft", n, dim, norm)


def ifft(t: Tensor, n: int | None = None, dim: int = -1, norm: str = "backward") -> Tensor:
    return _along(t, "ifft", n, dim, norm)


def rfft(t: Tensor, n: int | None = None, dim: int = -1, norm: str = "backward") -> Tensor:
    return _along(t, "rfft", n, dim, norm)


def fft2d(t: Tensor, s: tuple[int, int] | None = None, dim: tuple[int, int] = (-2, -1), norm: str = "backward") -> Tensor:
    """Both axes: large planes in blocks with one exchange of arrays, small or very long ones axis by axis."""
    rows, columns = t.axis(dim[0]), t.axis(dim[1])
    if rows == columns:
        raise TensorError("the two axes are one")
    high, wide = s if s is not None else (t.shape[rows], t.shape[columns])
    if high * wide < PLANE or max(high, wide) > BAND or norm not in NORMS:
        return _along(_along(t, "fft", wide, dim[1], norm), "fft", high, dim[0], norm)
    others = [c for k, c in enumerate(t.index) if k not in (rows, columns)]
    cells = t.df.select(*others, F.col(f"i{rows}").alias("i"), F.col(f"i{columns}").alias("j"), *_parts(t)).where((F.col("i") < high) & (F.col("j") < wide))
    names = {f"i{rows}": "i", f"i{columns}": "j"}
    done = blocks(cells, others, (high, wide), "fft", norm).select(*[F.col(names.get(c, c)).alias(c) for c in t.index], "re", "im")
    return Tensor(done, tuple({rows: high, columns: wide}.get(k, n) for k, n in enumerate(t.shape)), complex=True)


def fft2d_pencil(t: Tensor, norm: str = "backward") -> Tensor:
    """A whole matrix: rows, exchange by column, columns. Any shape."""
    if t.rank != 2:
        raise TensorError("a pencil transform takes a matrix")
    return fft2d(t, norm=norm)
