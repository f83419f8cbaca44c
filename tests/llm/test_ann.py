"""The multi-index against brute force."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import ann

SCHEMA = "vec_id long, embedding array<float>, key string, rank int"


def brute(rows, k, every):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = sorted((i, np.array(v, np.float32).astype(float)) for i, v in good)
    return {i: heapq.nsmallest(k, ((-float(v @ w), j) for j, w in good if j != i)) for i, v in good if i % every == 0}


def test_recall_ties_and_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).round(3).tolist(), "x", 1) for i in range(3000)]
    rows += [(5000 + i, rows[20][1], "x", 1) for i in range(400)]
    rows += [(9000, None, "x", 1), (9020, [0.0] * 8, "x", 1), (9040, [float("nan")] * 8, "x", 1), (9060, [1.0] * 7, "x", 1), (9080, [None] + [1.0] * 7, "x", 1), (None, [1.0] * 8, "x", 1), (9100, [float("inf")] * 8, "x", 1), rows[20], (40, rows[40][1], "y", 2)]
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want = brute(rows, 20, 20)
    assert set(found) == set(want)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n for n, *_ in near] == list(range(1, 21)) and q not in [i for _, i, _ in near]
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(near, near[1:]))
        hits += len({i for _, i, _ in near} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    copies = [i for _, i, _ in found[5000] if i == 20 or i >= 5000]
    assert len(copies) > 1 and copies == [20, *range(5001, 5020)][: len(copies)]


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0], "x", 1), (1, [0.5, 0.5], "x", 1), (2, [3.0, -1.0], "x", 1)]
    found = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 2 == 0, 20).collect())
    assert found == [(0, 1, 1, 1.5), (0, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.lit(True), 5).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.lit(True), 5).count() == 0


def test_cells_are_visited_in_order():
    rng = np.random.default_rng(1)
    a, b, counts = rng.standard_normal(6), rng.standard_normal(5), rng.integers(0, 4, (6, 5))
    sums = (a[:, None] + b[None, :]).reshape(-1)
    full = [c for c in np.argsort(-sums, kind="stable") if counts.reshape(-1)[c]]
    for wanted in (1, 10, counts.sum()):
        cells, held = ann.visit(a, b, counts, wanted)
        assert cells.tolist() == full[: len(cells)] and held == counts.reshape(-1)[cells].sum() >= wanted
        assert held - counts.reshape(-1)[cells[-1]] < wanted


def test_bands_are_bounded():
    counts = np.array([3, 3, 3, 25, 1, 0, 9, 10])
    band, parts = ann.bands(counts, 10)
    assert band.tolist() == [0, 0, 0, 1, 2, 2, 2, 3] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]


@pytest.mark.parametrize("kind,most", [("clustered", 0.2), ("structureless", 0.8)])
def test_recall_and_visited_part_of_many(spark, kind, most):
    rng, n = np.random.default_rng(7), 20_000
    x = rng.standard_normal((n, 16))
    if kind == "clustered":
        x = rng.standard_normal((150, 16))[rng.integers(0, 150, n)] + 0.4 * x
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    rows, visited = ann.searched(docs, F.col("id") % 100 == 0, 20)
    found = rows.groupBy("query_id").agg(F.collect_list("id").alias("ids")).collect()
    hits = 0
    for r in found:
        score = x @ x[r.query_id]
        score[r.query_id] = -np.inf
        hits += len(set(np.argpartition(-score, 19)[:20].tolist()) & set(r.ids))
    assert len(found) == n // 100
    assert hits / (20 * len(found)) >= 0.9 and visited < most


def test_fit_and_traversal_stay_small_at_any_size():
    import time
    import tracemalloc

    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 8))
    tracemalloc.start()
    model = ann.fit(x, 20, 100_000_000)
    counts = rng.integers(0, 3, (len(model["first"]), len(model["second"]))).astype(np.int32)
    began = time.process_time()
    cells, held = ann.visit(model["first"] @ x[0, :4], model["second"] @ x[0, 4:], counts, 2000)
    assert time.process_time() - began < 0.5 and held >= 2000
    assert len(model["first"]) == 2500 and tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_recall_of_200000_vectors():
    rng, n = np.random.default_rng(8), 200_000
    x = rng.standard_normal((500, 16))[rng.integers(0, 500, n)] + 0.5 * rng.standard_normal((n, 16))
    model = ann.fit(x[rng.permutation(n)[: ann.SAMPLE]], 20, n)
    columns = len(model["second"])
    cell = ann.assigned(x[:, :8], model["first"]) * columns + ann.assigned(x[:, 8:], model["second"])
    counts = np.bincount(cell, minlength=len(model["first"]) * columns).astype(np.int32).reshape(-1, columns)
    hits = part = 0
    for q in x[:50]:
        cells, held = ann.visit(model["first"] @ q[:8], model["second"] @ q[8:], counts, model["part"] * n)
        score = x @ q
        hits += np.isin(cell[np.argpartition(-score, 20)[:21]], cells).sum()
        part += held / n
    assert hits / (21 * 50) >= 0.9 and part / 50 < 0.3
