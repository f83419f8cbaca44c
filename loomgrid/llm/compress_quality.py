"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A bounded sample of labelled documents (``SAMPLE`` per label, chosen by the hash of the id) is split in two by that
hash. One part trains a dictionary for each label; the other calibrates. Every whole text is cut into blocks of
``BLOCK`` bytes and each block is compressed with either dictionary, so that a dictionary speaks for all of a text and
not only for its beginning. The difference of the two sizes over the plain size is turned into a probability by
logistic regression on the calibration part.

Labels, language, source and id never enter a score. Only ``SAMPLE_BYTES`` of training texts for each label, the sizes of the
calibration part and the two dictionaries (``DICTIONARY`` bytes each) pass through the driver; scoring is a map over
partitions without a shuffle.

Nulls: null and empty texts get the share of label 1 in the calibration part. Without texts of both labels every score
is that share (0.5 if there are no labels). Labels that are null are ignored; a document with labels of both kinds
counts for each. Of several texts of one id the smallest is learned from. Repeated rows are scored one by one; other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import written

#: Documents per label that are learned from, bytes of their texts that train a dictionary, bytes of a dictionary, of a block, level.
SAMPLE, SAMPLE_BYTES, DICTIONARY, BLOCK, LEVEL = 1500, 24 << 20, 112 * 1024, 4096, 3


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(labelled, label, h, calibrates, text) of at most ``size`` documents per label, by the hash of their ids; whole texts, written."""
    chosen = labels.select(F.col(id_col).cast("long").alias("labelled"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and labelled is not null").distinct()
    chosen = chosen.withColumn("h", F.xxhash64(F.lit("quality"), "labelled"))
    picked = None
    for label in (0, 1):
        own = chosen.where(F.col("label") == label).join(docs.select(F.col(id_col).cast("long").alias("labelled")), "labelled", "left_semi").orderBy("h", "labelled").limit(size)
        picked = own if picked is None else picked.unionByName(own)
    rows = docs.select(F.col(id_col).cast("long").alias("labelled"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # at most two times ``size`` ids are broadcast
    rows = rows.join(F.broadcast(picked), "labelled").groupBy("labelled", "label", "h").agg(F.min("text").alias("text"))
    return written(rows.withColumn("calibrates", F.col("h") % 3 == 0), "sample")


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Gap:
    """(size with the bad dictionary - size with the good one) / plain size of a text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.packers = []
        for d in (good, bad):
            own = zstandard.ZstdCompressionDict(d)
            own.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, data: bytes) -> float:
        good, bad = (sum(len(p.compress(b)) for b in blocks(data)) for p in self.packers)
        return (bad - good) / max(1, len(data))


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of at most DICTIONARY bytes; the texts themselves where there is too little to train on."""
    import zstandard

    parts = [p for t in texts for i in range(0, len(t), 1024) if (p := t[i : i + 1024])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, parts)) // 4)), parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that maximise the likelihood, with a weak prior on the slope (Newton's method)."""
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + np.array([1e-2, 1e-6]) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def learn(rows: DataFrame) -> dict:
    """A model from a sample: dictionaries, slope and offset, and the share of label 1.

    Dictionaries are trained on whole texts in the order of their hash while their sum is within ``SAMPLE_BYTES`` for a label;
    a label whose first text is longer than that trains on it alone. Calibration compresses whole texts in tasks.
    """
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    model = {"prior": good / n if n else 0.5}
    filled = rows.where("text <> ''")
    line = Window.partitionBy("label").orderBy("h", "labelled").rowsBetween(Window.unboundedPreceding, 0)
    sizes = filled.where("not calibrates").select("labelled", "label", "h", F.octet_length("text").alias("bytes"))
    within = sizes.withColumn("sum", F.sum("bytes").over(line)).where((F.col("sum") <= SAMPLE_BYTES) | (F.col("sum") == F.col("bytes"))).select("labelled", "label")
    texts = {0: [], 1: []}
    for r in sorted(filled.join(within, ["labelled", "label"]).collect(), key=lambda r: (r["h"], r["labelled"])):
        texts[r["label"]].append(r["text"].encode("utf-8", "replace"))
    check = filled.where("calibrates") if filled.where("calibrates").limit(1).count() else filled
    if not texts[0] or not texts[1] or check.select("label").distinct().count() < 2:
        return model
    model["good"], model["bad"] = dictionary(texts[1]), dictionary(texts[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = Gap(model["good"], model["bad"])
        for f in frames:
            yield f[["labelled", "label"]].assign(gap=[gap(t.encode("utf-8", "replace")) for t in f["text"]])

    made = sorted(map(tuple, check.select("labelled", "label", "text").mapInPandas(run, "labelled long, label int, gap double").collect()))
    model["slope"], model["offset"] = logistic(np.array([g for *_, g in made]), np.array([float(label) for _, label, _ in made]))
    return model


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = Gap(model["good"], model["bad"]) if "good" in model else None

        def score(text: str | None) -> float:
            if not text or gap is None:
                return model["prior"]
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, model["slope"] * gap(text.encode("utf-8", "replace")) + model["offset"]))))

        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": [score(t) for t in f["text"]]})

    # ids travel as decimal text: nulls among numbers would make them floating-point in Python
    made = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id string, score double")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "score")
