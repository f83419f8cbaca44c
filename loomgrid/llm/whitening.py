"""Whitening of embeddings by two passes over exact integers.

An entry c becomes the long x = floor(64 c) + 1,000,000. The first pass sums x by dimension in integers, which is exact in any
order. The second pass centres every vector before it multiplies: with n vectors and sums S, n x - S is an exact
integer, and its outer products divided by n twice are summed in doubles by one matrix product for each batch. ``treeAggregate``
merges the tasks' matrices, so the driver gets one matrix of dimensions x dimensions however many tasks there are.
The symmetric eigenproblem is solved by LAPACK on that matrix. The projection, one column for each component, is
broadcast. A third pass measures the covariance of what is returned.

Rows without a part: null vectors, vectors with a null, NaN or infinite entry, vectors with an entry of 2^46 or more either way
(64 c would not be an exact integer), and vectors whose length is not the most frequent one (the longer one of a tie); empty
vectors are vectors of length 0, without components. Ids may be null or repeat, equal vectors count as often as they occur, columns besides the
two are ignored. An empty table gives an empty result. Vectors may be of any length whose square fits in memory as doubles.

Components whose variance is below the rounding of the largest one cannot be whitened and are not returned: equal vectors
alone give no rows, few vectors give fewer components. ``deviation`` is null where the exact sum does not fit in a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, written

STEP, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**46
COMPONENTS = 32
#: Vectors that are multiplied or given out at a time.
BATCH = 4096
LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """n vectors, their sums, the projection on unit eigenvectors over sqrt(e), and each component's part of the variance."""

    n: int
    sums: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors with finite entries only."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(LIMIT)))
    return df.where(x.isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], length: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the long x of their vectors as a matrix; with ``length``, of the vectors of that length only."""
    for batch in batches:
        lists = batch.column("x")
        if length is not None:
            fit = pc.equal(pc.list_value_length(lists), length)
            batch = batch.filter(fit)
            lists = batch.column("x")
        for at in range(0, batch.num_rows, BATCH):
            part = lists.slice(at, BATCH)
            c = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield batch.slice(at, BATCH), np.floor(STEP * c).astype(np.int64).reshape(len(part), -1) + SHIFT


def counted(vectors: DataFrame) -> tuple[int, int, np.ndarray]:
    """(length, n, sums): the most frequent length, and the exact sums of its vectors by dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("x"))
            for length in pc.unique(lengths).to_pylist():
                for _, x in matrices([batch], length):
                    n, s = held.get(length, (0, np.zeros(length, np.int64)))
                    held[length] = n + len(x), s + x.sum(axis=0)
        rows = [{"length": k, "n": n, "sums": s.tolist()} for k, (n, s) in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"length": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.int64())}))

    parts = vectors.mapInArrow(summed, "length long, n long, sums array<long>")
    # place -1 has the number of vectors, the others the sums: all are added up in longs
    cells = parts.select("length", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "s"))
    sums = written(cells.groupBy("length", (F.col("at") - 1).alias("at")).agg(F.sum("s").alias("s")), "sums")
    most = sums.where("at = -1").orderBy(F.col("s").desc(), F.col("length").desc()).first()
    if most is None:
        return 0, 0, np.zeros(0, np.int64)
    rows = sums.where((F.col("length") == most["length"]) & (F.col("at") >= 0)).orderBy("at").collect()
    drop(sums)
    return most["length"], most["s"], np.array([r["s"] for r in rows], np.int64)


def merged(vectors: DataFrame, length: int, size: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``product`` (size x size) over all batches: one matrix for each task, merged by treeAggregate."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in matrices(batches, length):
            total += product(x)
        yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]}, pa.schema({"sum": pa.binary()}))

    parts = vectors.mapInArrow(multiplied, "sum binary").rdd
    add = lambda total, part: total + (np.frombuffer(part["sum"]) if not isinstance(part, np.ndarray) else part)
    return parts.treeAggregate(np.zeros(size * size), add, add).reshape(size, size)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in longs, or in Python's integers where longs might not hold it."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums.tolist()), default=0) > LONG_MAX:
        return x.astype(object) * n - sums.astype(object)
    return x * n - sums


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> tuple[int, Whitening]:
    """The length of the vectors and their whitening."""
    length, n, sums = counted(vectors)

    def outer(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums).astype(np.float64) / n
        return c.T @ c

    none = Whitening(n, sums, np.zeros((length, 0)), np.zeros(0), 0.0)
    if not n or not length:
        return length, none
    covariance = merged(vectors, length, length, outer) / n
    values, unit = np.linalg.eigh(covariance)
    values, unit = values[::-1], unit[:, ::-1]
    kept = int(np.sum(values[:components] > values[0] * length * np.finfo(float).eps))
    if not kept or values[0] <= 0:
        return length, none
    unit = unit[:, :kept]
    unit = unit * np.where(unit[np.abs(unit).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    projection = unit / np.sqrt(values[:kept])

    def whitened(x: np.ndarray) -> np.ndarray:
        w = np.c_[centred(x, n, sums).astype(np.float64) / n @ projection, np.ones(len(x))]
        return w.T @ w

    moments = merged(vectors, length, kept + 1, whitened) / n
    # the last row has the means of what is returned
    error = float(np.abs(moments[:kept, :kept] - np.outer(moments[kept, :kept], moments[kept, :kept]) - np.eye(kept)).max())
    return length, Whitening(n, sums, projection, values[:kept] / np.trace(covariance), error)


def deviations(d: np.ndarray) -> list[int | None]:
    """The exact sums of squares of integer rows; None where a long cannot hold one."""
    about = np.square(d.astype(np.float64)).sum(axis=1)
    if d.dtype != object and (about < 0.99 * LONG_MAX).all():
        return np.square(d).sum(axis=1).tolist()
    exact = [sum(v * v for v in map(int, row)) for row in d]
    return [v if v <= LONG_MAX else None for v in exact]


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    vectors = usable(df, id_col, vector_col)
    length, w = fitted(vectors, components)
    k = len(w.explained)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(w)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch, x in matrices(batches, length):
            d = centred(x, w.n, w.sums)
            values = d.astype(np.float64) / w.n @ w.projection
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) * k + 1, k, dtype=np.int32), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(d), pa.int64()), lists], ["vec_id", "deviation", "values"])

    schema = f"vec_id {kind}, deviation long, values array<double>"
    rows = vectors.mapInArrow(given, schema) if k else vectors.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("values"))
    cells = rows.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in w.explained]) if k else F.array().cast("array<double>")
    return cells.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
