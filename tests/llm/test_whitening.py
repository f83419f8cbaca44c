"""Whitening against NumPy on whole arrays."""

import math

import numpy as np
import pytest

from loomgrid.llm import whitening as m

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA).repartition(4)


def plain(rows, components=32):
    """(sorted ids, x, eigenvalues, projection) of the usable vectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = x * n - sums
    c = d.astype(float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    return d, c, e[::-1][:components], u[:, ::-1][:, :components], np.trace(v)


def check(found, rows, components=32):
    d, c, e, u, trace = plain(rows, components)
    k = int(np.sum(e > e[0] * d.shape[1] * np.finfo(float).eps))
    assert len(found) == len(rows) * k
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    w = np.array([[by[i][j + 1]["whitened"] for j in range(k)] for i, _ in rows])
    want = c @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, atol=1e-7, rtol=1e-6)
    assert np.allclose([by[rows[0][0]][j + 1]["explained"] for j in range(k)], e[:k] / trace, rtol=1e-9)
    assert all(by[i][1]["deviation"] == sum(int(v) ** 2 for v in d[a]) for a, (i, _) in enumerate(rows))
    cov = w.T @ w / len(w) - np.outer(w.mean(0), w.mean(0))
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and abs(max(errors) - np.abs(cov - np.eye(k)).max()) < 1e-9 and max(errors) < 1e-4
    assert {r["n"] for r in found} == {len(rows)}


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(40, 40))
    rows = [(i, (rng.normal(size=40) @ mix).astype(np.float32).tolist()) for i in range(700)]
    bad = [(1000, None), (1001, [None] + [1.0] * 39), (1002, [float("nan")] * 40), (1003, [float("inf")] + [0.0] * 39), (1004, [1e30] * 40), (1005, [1.0] * 39), (1006, [])]
    check(m.whitened(frame(spark, rows + bad)).collect(), rows)


def test_fewer_components_than_asked(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(60, 3))
    rows = [(i, [*map(float, np.float32(v)), 0.5, 0.0]) for i, v in enumerate(flat)]
    check(m.whitened(frame(spark, rows)).collect(), rows)
    check(m.whitened(frame(spark, rows), components=2).collect(), rows, 2)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [0.0, 5.0]), (3, [4.0, -1.0]), (4, [0.25, 0.25])]
    found = m.whitened(frame(spark, rows)).collect()
    assert len(found) == 10 and sum(r["vec_id"] is None for r in found) == 4 and found[0]["n"] == 5
    for k in (1, 2):
        w = np.array([r["whitened"] for r in found if r["component"] == k])
        assert abs(w.mean()) < 1e-12 and abs((w**2).mean() - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    df = m.whitened(frame(spark, rows))
    assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_tie_of_lengths_and_other_columns(spark):
    found = m.whitened(frame(spark, [(1, [1.0]), (2, [2.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])])).collect()
    assert {r["vec_id"] for r in found} == {3, 4}


def test_exact_where_longs_end():
    x = np.array([[2**60, 5], [-(2**60), 7]], np.int64)
    d = m.centred(x, 2, np.array([0, 12], np.int64) + np.array([0, 0]))
    assert [int(v) for v in d[0]] == [2**61, -2]
    assert m.deviations(d) == [None, None] and m.deviations(np.array([[3, 4]], np.int64)) == [25]
    big = np.array([[2**31, 2**31], [2**31, 2**31 - 1]], np.int64)
    assert m.deviations(big) == [2**63 if 2**63 <= m.LONG_MAX else None, 2**62 + (2**31 - 1) ** 2]


def test_whole_table(spark, sf_dir):
    import __spark_entry__ as entry

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(entry.queries()["op13_whitening"](spark, sf_dir).collect(), [(r["vec_id"], r["embedding"]) for r in table])
