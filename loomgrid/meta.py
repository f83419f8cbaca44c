"""Tensors as DataFrames: a lazy handle with a shape."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


class TensorError(ValueError):
    """A tensor, index or argument that an operation does not accept."""


@dataclass(frozen=True)
class Tensor:
    """Coordinate form: index columns i0, i1, ... (BIGINT, from 0) and the value column v, or re and im if complex.

    A dense tensor has a row for every cell. Where ``sparse`` is set, cells without a row are 0.
    """

    df: DataFrame
    shape: tuple[int, ...]
    sparse: bool = False
    complex: bool = False

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def index(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.complex else ["v"]

    @property
    def size(self) -> int:
        out = 1
        for n in self.shape:
            out *= n
        return out

    def with_df(self, df: DataFrame, **changes) -> Tensor:
        return replace(self, df=df, **changes)

    def axis(self, dim: int) -> int:
        """The axis that ``dim`` names, negative ones counted from the last."""
        if not -self.rank <= dim < self.rank:
            raise TensorError(f"axis {dim} of a tensor with {self.rank} axes")
        return dim % self.rank

    def named(self, *names: str) -> DataFrame:
        """The rows with index columns renamed."""
        return self.df.select(*[self.df[c].alias(n) for c, n in zip(self.index, names, strict=True)], *self.values)
