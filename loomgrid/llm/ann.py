"""Approximate nearest neighbours by an inverted multi-index, largest inner product first.

The two halves of a vector are quantised separately by k-means; a pair of centroids is a cell. A query visits cells in
order of their summed nearness, by a heap over the two sorted lists of centroids, until the cells visited hold the
wanted part of all entries; those are reranked by exact inner products in double precision.

The codebooks are fitted on at most ``SAMPLE`` vectors (by hash of the vector); every vector is indexed. Their size grows with
the root of the entries, to ``PER_CELL`` entries a cell (as far as the sample can fit centroids, ``SAMPLE / 8`` a half). The part
of the entries to visit is what the sample needs to find ``RECALL`` of its own true neighbours, so structured vectors
are cheap and structureless ones are searched widely, at any size.

Equal vectors are one entry with its smallest ids (one more than asked for, which is all that a result can show), and
equal queries are searched once, so copies cost nothing. Queries are dealt into blocks of ``QUERIES`` by their own first
centroid, so that queries of a block visit much the same cells; entries into bands of ``SHARD`` by theirs, where a centroid
with more is split by hash. An entry is sent to the blocks that visit its cell, and within a block and band each cell is
multiplied with the queries that visit it and no others. Only the codebooks and the cell counts, 4 bytes for each of at most
(``SAMPLE / 8``)^2 cells, reach the driver; the traversal reads a count when its cell comes up.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, and
neither do rows with a null id. Rows with equal id and vector count once. Other columns are ignored. If there are fewer
candidates than asked for, all that are found are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import written

SAMPLE, PER_CELL, ROUNDS, RECALL = 20_000, 16, 12, 0.95
SHARD, QUERIES = 8192, 512


def entries(table: DataFrame, ids: int, id_col: str, vector_col: str) -> DataFrame:
    """(key, vector, ids): the distinct usable vectors, each with its ``ids`` smallest ids."""
    v = F.col("vector")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(good).withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0)))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (usual["n"] if usual else 0)).distinct()
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= ids)
    made = rows.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return made.select(F.concat_ws(":", F.get("ids", F.lit(0)).cast("string"), F.xxhash64("vector").cast("string")).alias("key"), "vector", "ids")


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = assigned(x, centres)
        for c in range(k):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, for some rows at a time."""
    norms, step = (centres**2).sum(1), max(1, (1 << 20) // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *((norms - 2 * x[at : at + step] @ centres.T).argmin(1) for at in range(0, len(x), step))])


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> tuple[np.ndarray, int]:
    """(cells in order, entries in them) that a query visits: pairs by summed nearness until they hold ``wanted`` entries.

    A cell is numbered by its first centroid, then its second; those without entries are left out.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    rows, columns, of_row, of_column = len(a), len(b), a.tolist(), b.tolist()
    seen, heap, held, reach = [], [(-(x[0] + y[0]), 0, 0)], 0, [0] * rows
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        size = counts.item(of_row[i], of_column[j])
        if size:
            seen.append(of_row[i] * columns + of_column[j])
            held += size
        reach[i] = j + 1
        if j + 1 < columns and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if i + 1 < rows and reach[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
    return np.array(seen, np.int64), held


def fit(x: np.ndarray, k: int, total: int, recall: float = RECALL, queries: int = 200) -> dict:
    """Codebooks for ``total`` entries, and the part of the entries to visit, from sample vectors (rows of ``x``)."""
    half = x.shape[1] // 2
    own = max(1, min(round((total / PER_CELL) ** 0.5), len(x) // 8))
    model = {"half": half, "first": kmeans(x[:, :half], own), "second": kmeans(x[:, half:], own)}
    q = x[np.random.default_rng(5).permutation(len(x))[:queries]]
    scores = q @ x.T
    most = min(k + 1, len(x))
    true = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    one, two = assigned(x[:, :half], model["first"]), assigned(x[:, half:], model["second"])
    parts = []
    for v, own in zip(q, true):
        # the sample's vectors in cells that are visited before a neighbour's, or with it
        near = (model["first"] @ v[:half])[one] + (model["second"] @ v[half:])[two]
        parts.append(1 - np.searchsorted(np.sort(near), near[own], side="left") / len(x))
    model["part"] = float(np.quantile(np.concatenate(parts), recall))
    return model


def bands(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(band, parts) of every centroid: neighbours share a band of about ``most``; one with more has ``parts`` of its own."""
    parts = np.maximum(1, -(-counts // most))
    band, held, out = 0, 0, []
    for n in counts.tolist():
        if held and held + n > most:
            band, held = band + 1, 0
        out.append(band)
        held += n
    return np.array(out, np.int64), parts


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found rows of ``table`` for its rows where ``is_query`` (of ``id``) holds."""
    return searched(table, is_query, k, id_col, vector_col)[0]


def searched(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, float]:
    """The rows of ``nearest``, and the part of the entries that a query visits on average."""
    found = written(entries(table, k + 1, id_col, vector_col), "vectors")
    spark, total = table.sparkSession, found.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double"), 0.0
    sample = found.orderBy(F.xxhash64("vector"), "key").limit(SAMPLE).select("vector").toPandas()
    model = fit(np.stack(sample["vector"].to_numpy()), k, total)
    columns = len(model["second"])
    shape = (len(model["first"]), columns)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["vector"].to_numpy())
            i, j = assigned(x[:, : model["half"]], model["first"]), assigned(x[:, model["half"] :], model["second"])
            yield f[["key", "vector"]].assign(cell=(i * columns + j).astype(np.int32))

    placed = written(found.select("key", "vector").mapInPandas(place, "key string, vector array<double>, cell int"), "cells")
    filled = placed.groupBy("cell").agg(F.count("*").cast("int").alias("n")).toArrow()
    counts = np.zeros(shape[0] * columns, np.int32)
    counts[filled["cell"].to_numpy()] = filled["n"].to_numpy()
    counts = counts.reshape(shape)
    wanted = max(model["part"] * total, k + 1)

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(is_query & F.col("id").isNotNull()).distinct()
    asked = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).join(found, "vector").select("id", "key")
    asked = written(asked, "queries")
    questions = written(asked.select("key").distinct().join(placed, "key").select("key", "vector", "cell"), "questions")
    of_queries = np.zeros(shape[0], np.int64)
    for r in questions.groupBy(F.floor(F.col("cell") / columns).cast("int").alias("i")).count().collect():
        of_queries[r["i"]] = r["count"]
    dealt = lambda centroids, most, key: _dealt(bands(centroids, most), F.floor(F.col("cell") / columns).cast("int"), key)
    band_of, parts_of = bands(counts.sum(1), SHARD)

    def probe(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["vector"].to_numpy())
        one, two = x[:, : model["half"]] @ model["first"].T, x[:, model["half"] :] @ model["second"].T
        out, any_of = [], np.zeros(counts.size, bool)
        for n, (key, vector) in enumerate(zip(own["key"], own["vector"])):
            cells, held = visit(one[n], two[n], counts, wanted)
            any_of[cells] = True
            band = band_of[cells // columns]
            order = np.argsort(band, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(band[order]))[0] + 1):
                out.append((band[part[0]], key, vector, cells[part], held))
        out.append((-1, None, None, np.nonzero(any_of)[0], 0))
        made = pd.DataFrame(out, columns=["band", "key", "vector", "cells", "held"])
        return made.assign(block=own["block"].iloc[0], part=own["part"].iloc[0])

    blocks = questions.select("key", "vector", *dealt(of_queries, QUERIES, "block"))
    probes = blocks.groupBy("block", "part").applyInPandas(probe, "band int, key string, vector array<double>, cells array<int>, held long, block int, part int")
    probes = written(probes, "probes")
    visited = probes.where("band >= 0").groupBy("key").agg(F.first("held").alias("held")).agg(F.avg("held")).first()[0] or 0
    sent = placed.join(probes.where("band < 0").select("block", "part", F.explode("cells").alias("cell")), "cell")
    sent = sent.select(F.col("block").alias("to_block"), F.col("part").alias("to_part"), "key", "vector", "cell", *dealt(counts.sum(1), SHARD, "band"))
    sent = sent.withColumnsRenamed({"band": "to_band", "band_part": "to_band_part"})
    copies = F.element_at(F.array(*[F.lit(int(parts_of[band_of == b].max())) for b in range(int(band_of.max()) + 1)]), F.col("band") + 1)
    asks = probes.where("band >= 0").withColumn("band_part", F.explode(F.sequence(F.lit(0), copies - 1)))

    def rerank(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": str, "key": str, "score": float})
        if not len(own) or not len(asks):
            return none
        own = own.sort_values("cell")
        x, keys = np.stack(own["vector"].to_numpy()), own["key"].to_numpy()
        cells, begin = np.unique(own["cell"].to_numpy(), return_index=True)
        end, out = np.append(begin[1:], len(own)), []
        for at in range(0, len(asks), 256):
            part = asks.iloc[at : at + 256]
            q, score = np.stack(part["vector"].to_numpy()), np.full((len(part), len(x)), -np.inf)
            who, cell = np.repeat(np.arange(len(part)), part["cells"].map(len)), np.concatenate(part["cells"].to_numpy())
            order = np.argsort(cell, kind="stable")
            low, high = (np.searchsorted(cell[order], cells, side=s) for s in ("left", "right"))
            for a, b, c, d in zip(begin, end, low, high):
                score[who[order[c:d]], a:b] = q[who[order[c:d]]] @ x[a:b].T
            for n, key in enumerate(part["key"]):
                line = score[n]
                best = np.arange(len(line))
                if len(line) > k + 1:  # all that tie with the last stay; the window over all bands breaks ties by id
                    best = np.nonzero(line >= -np.partition(-line, k)[k])[0]
                best = best[line[best] > -np.inf]
                out.append(pd.DataFrame({"query": key, "key": keys[best], "score": line[best]}))
        return pd.concat(out) if out else none

    group = ["block", "part", "band", "band_part"]
    ranked = sent.groupBy(*[f"to_{c}" for c in group]).cogroup(asks.groupBy(*group)).applyInPandas(rerank, "query string, key string, score double")
    by_key = ranked.join(found.select("key", "ids"), "key")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    top = by_key.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = top.select("query", "score", F.explode("ids").alias("id")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("id")))).alias("near"))
    own = asked.join(lists.withColumnRenamed("query", "key").withColumn("near", F.slice("near", 1, k + 1)), "key")
    shown = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("rank", "hit"))
    shown = shown.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.far")).alias("score"))
    return shown, visited / total


def _dealt(where: tuple[np.ndarray, np.ndarray], centroid: Column, name: str) -> list[Column]:
    """Columns of the band of a row's centroid and of its part of it, by the hash of its key."""
    at = lambda values: F.element_at(F.array(*map(F.lit, values.tolist())), centroid + 1)
    part = F.pmod(F.xxhash64(F.lit(name), "key"), at(where[1])).cast("int")
    return [at(where[0]).cast("int").alias(name), part.alias("part" if name == "block" else f"{name}_part")]
