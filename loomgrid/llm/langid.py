"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of characters that are not letters become one blank, and the n-grams of 1 to ``LONGEST``
characters are hashed to ``SLOTS`` features. Document frequencies are counted over all training documents, in every
partition first (``SLOTS`` sums at most from each). The weights are learned by follow-the-regularised-leader with
elastic-net penalties from at most ``SAMPLE`` documents per language and ``SAMPLE_ALL`` in all, taken by the hash of their ids; a part of the
sample is kept for the temperature that calibrates the probabilities. The sample's whole texts become features in
tasks; only the features (``SLOTS`` at most of each document) reach the driver. Prediction is a map over partitions.

Nulls: documents without text or language are not learned from. Of several texts of one id and language the smallest is
learned from. A text that is null or has no letter (a character of the Unicode category L) is "und" with
score 0; so is every text when nothing was learned. One language alone is predicted with score 1. Repeated rows are
predicted one by one, texts of any length as a whole; of languages that are equally likely the first by name is predicted.
Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS, LONGEST = 1 << 15, 3
SAMPLE, SAMPLE_ALL, EPOCHS, STEP, BETA, L1, L2 = 800, 20_000, 4, 0.5, 1.0, 0.02, 0.02
OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams of a text and how often each occurs."""
    code = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found = np.zeros(SLOTS, np.int64)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + code[n - 1 :] + np.uint64(n)
        found += np.bincount(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64), minlength=SLOTS)
    slots = np.nonzero(found)[0]
    return slots, found[slots]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots, counts = grams(text)
    values = (1 + np.log(counts)) * idf[slots]
    return slots, values / (np.sqrt((values**2).sum()) or 1.0)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of ``docs`` (text) that have each slot, and all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(SLOTS, np.int64), 0
        for f in frames:
            for text in f["text"]:
                seen[grams(text)[0]] += 1
                rows += 1
        own = np.nonzero(seen)[0]
        yield pd.DataFrame({"slot": [*own.tolist(), -1], "n": [*seen[own].tolist(), rows]})

    sums = docs.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = {r["slot"]: r["n"] for r in sums}
    out = np.zeros(SLOTS)
    for k, v in found.items():
        if k >= 0:
            out[k] = v
    return out, found.get(-1, 0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a multinomial logistic regression; a weight stays 0 until its evidence exceeds L1."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def weights(s: np.ndarray) -> np.ndarray:
        zs, ns = z[s], n[s]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / STEP + L2))

    for i in order:
        slots, values, label = rows[i]
        s, x = np.append(slots, SLOTS), np.append(values, 1.0)
        w = weights(s)
        logit = x @ w
        p = np.exp(logit - logit.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p[None, :]
        z[s] += g - (np.sqrt(n[s] + g**2) - np.sqrt(n[s])) / STEP * w
        n[s] += g**2
    w = weights(np.arange(SLOTS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss of the kept-back part, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        own = logits / np.exp(t)
        own = own - own.max(1, keepdims=True)
        return float((np.log(np.exp(own).sum(1)) - own[np.arange(len(own)), labels]).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learn(docs: DataFrame, size: int = SAMPLE) -> dict:
    """A model from documents (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen, rows = frequencies(known)
    marked = known.select("doc_id", "lang", F.xxhash64(F.lit("language"), "doc_id").alias("h"))
    languages = max(1, known.select("lang").distinct().count())
    size = max(2, min(size, SAMPLE_ALL // languages))
    # the first of every part of a language, then the first of those
    for parts in (["lang", "part"], ["lang"]):
        marked = marked.withColumn("part", F.pmod("h", F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy("h", "doc_id"))).where(F.col("rank") <= size)
    first = marked
    idf = np.log((1 + rows) / (1 + seen)) + 1
    chosen = first.select("doc_id", "lang").distinct()
    # at most SAMPLE_ALL ids unless there are more languages than half of that
    chosen = F.broadcast(chosen) if size * languages <= SAMPLE_ALL else chosen
    picked = known.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [features(t, idf) for t in f["text"]]
            yield f[["doc_id", "lang"]].assign(slots=[s.astype("<u2").tobytes() for s, _ in made], weights=[v.astype("<f4").tobytes() for _, v in made])

    picked = picked.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text").mapInPandas(run, "doc_id string, lang string, slots binary, weights binary").collect()
    picked.sort(key=lambda r: (int(r["doc_id"]), r["lang"]))
    names = sorted({r["lang"] for r in picked})
    model = {"names": names, "idf": idf}
    if len(names) < 2:
        return model
    made = [(np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(float), names.index(r["lang"])) for r in picked]
    shuffled = np.random.default_rng(7).permutation(len(made))
    kept, train = (shuffled[::5], np.delete(shuffled, np.s_[::5])) if len(made) >= 50 else (shuffled, shuffled)
    model["weights"], model["offset"] = ftrl(made, len(names), np.concatenate([np.random.default_rng(k).permutation(train) for k in range(EPOCHS)]))
    logits = np.array([made[i][1] @ model["weights"][made[i][0]] + model["offset"] for i in kept])
    model["temperature"] = temperature(logits, np.array([made[i][2] for i in kept]))
    return model


def predicted(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def one(text: str | None) -> tuple[str, float]:
        if not isinstance(text, str) or not model["names"] or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if "weights" not in model:
            return model["names"][0], 1.0
        slots, values = features(text, model["idf"])
        logits = (values @ model["weights"][slots] + model["offset"]) / model["temperature"]
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        return model["names"][k], float(p[k] / p.sum())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [one(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": [n for n, _ in out], "score": [s for _, s in out]})

    # ids travel as decimal text: nulls among numbers would make them floating-point in Python
    made = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id string, lang_pred string, score double")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "lang_pred", "score")
