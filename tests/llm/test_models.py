"""Learned scorers: recursions against enumeration, counts against plain Python, accuracy on held-out rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import compress_quality, langid, lattice_lm
from loomgrid.llm.queries import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(vocab, word):
    """(pieces, with None for a character in bytes) of every segmentation."""
    text, known = lattice_lm.MARK + word, {p: k for k, p in enumerate(vocab.pieces)}
    out = []
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, start = [], 0
        for at, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(text[start:at])
                start = at
        options = [([known[p]] if p in known else []) + ([("bytes", len(p.encode()))] if len(p) == 1 else []) for p in parts]
        out += itertools.product(*options)
    return out


def text_log10(vocab, text, temperature, end):
    """log10 probability of a whole text: the sum over all segmentations of all its words, then the end."""
    logp = vocab.weights(temperature, end)
    weigh = lambda x: logp[x] if isinstance(x, int) else x[1] * (logp[-1] - math.log(256))
    words = [segmentations(vocab, w.decode()) for w in text.encode().lower().split()]
    return sum(math.log10(math.fsum(math.exp(sum(map(weigh, way))) for way in ways)) for ways in words) + math.log10(end)


def test_weights_are_a_distribution():
    vocab = lattice_lm.vocabulary(PATH)
    for temperature in (500.0, 16000.0):
        logp = vocab.weights(temperature, 0.1)
        assert math.isclose(np.exp(logp).sum(), 0.9)
        assert np.allclose(np.diff(logp[:-1]), np.diff(vocab.scores) / temperature)


def test_scores_equal_enumeration_of_whole_documents(spark):
    vocab = lattice_lm.vocabulary(PATH)
    texts = ["the cat sat", "A été! 日x zq&", "", "the the\tcat", "catmats on"]
    docs = spark.createDataFrame([(k, t, k != 2) for k, t in enumerate(texts)], "doc_id long, text string, train boolean")
    made = {}
    for temperature in (1000.0, 8000.0):
        found = {r.doc_id: r.score for r in lattice_lm.scored(docs, F.col("train"), PATH, temperature).collect()}
        end = 4 / (3 + 4 + 3 + 2 + 4)
        for k, t in enumerate(texts):
            assert math.isclose(found[k], text_log10(vocab, t, temperature, end), rel_tol=1e-9)
        made[temperature] = found
    assert made[1000.0][0] != made[8000.0][0]  # the scores of the vocabulary decide


def test_temperature_is_the_likeliest(spark):
    vocab = lattice_lm.vocabulary(PATH)
    words = ["of", "the", "and", "to", "in", "hydrolysis", "quartz", "zebra"]
    counts = Counter(w for k in range(40) for w in words[: k % 9])
    best = lattice_lm.best_temperature(spark.createDataFrame([*counts.items(), ("unseen", 0)], "word string, n long"), PATH, 0.2)
    loss = lambda t: -(lattice_lm.word_scores(vocab, list(counts), [vocab.weights(t, 0.2)])[0] @ np.array(list(counts.values())))
    assert 499 < best < 16001 and all(loss(best) <= loss(t) + 1e-9 * abs(loss(t)) or abs(math.log(best / t)) < 0.7 for t in lattice_lm.TEMPERATURES)


def test_scores_and_base(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "ON", "mats", f"n{i}"]) for _ in range(rng.randint(0, 30))), i % 4 != 1, "x", 3) for i in range(50)]
    rows += [(90, None, True, "x", 3), (91, "", False, "x", 3), (None, "cat " * 20000, False, "x", 3), (92, "ü" * 3000 + " " + "word", False, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, words string, k int")
    found = {r.doc_id: r for r in lattice_lm.scored(docs, F.col("train"), PATH).collect()}
    low = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for _, t, train, *_ in rows if train for w in [*low(t), None])
    total, kinds = counts.total(), len(counts)
    assert len(found) == len(rows)
    for i, t, train, *_ in rows:
        tokens = [*low(t), None]
        r = found[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.training) == (len(tokens), sum(counts[w] > 0 for w in tokens), total, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    none = lattice_lm.scored(docs, F.lit(False), PATH).collect()
    assert all(r.train_tokens == 0 and r.base_score is None and math.isfinite(r.score) for r in none)
    assert lattice_lm.scored(docs.limit(0), F.lit(True), PATH).count() == 0


def test_expected_pieces_equal_enumeration():
    vocab = lattice_lm.vocabulary(PATH)
    logp, words, plain = vocab.weights(3000.0, 0.0), ["the", "été", "日x", "of"], Counter()
    weigh = lambda x: logp[x] if isinstance(x, int) else x[1] * (logp[-1] - math.log(256))
    for w in words:
        ways = segmentations(vocab, w)
        p = [math.exp(sum(map(weigh, way))) for way in ways]
        for way, q in zip(ways, p):
            for x in way:
                plain[x if isinstance(x, int) else len(logp) - 1] += (1 if isinstance(x, int) else x[1]) * q / sum(p)
    found = lattice_lm.expected(vocab, words, logp)
    assert np.allclose(found[list(plain)], list(plain.values())) and math.isclose(found.sum(), sum(plain.values()))


def test_words_share_what_the_ends_leave(spark):
    vocab = lattice_lm.vocabulary(PATH)
    docs = spark.createDataFrame([(1, "the the cat", True), (2, "cat zq", True), (3, "cat", False), (4, "zqx", False)], "doc_id long, text string, train boolean")
    found = {r.doc_id: 10**r.score / (2 / 7) for r in lattice_lm.scored(docs, F.col("train"), PATH).collect()}
    counts = spark.createDataFrame([("the", 2), ("cat", 2), ("zq", 1)], "word string, n long")
    logp = lattice_lm.learned(counts, PATH, lattice_lm.best_temperature(counts, PATH, 2 / 7))
    assert math.isclose(np.exp(logp).sum(), 1)
    cat, new = np.exp(lattice_lm.word_scores(vocab, ["cat", "zqx"], [logp])[0])
    assert math.isclose(found[3], (2 - 0.75) / 7 + 0.75 * 3 / 7 * cat, rel_tol=1e-6) and math.isclose(found[4], 0.75 * 3 / 7 * new, rel_tol=1e-6)


def test_held_out_scores_come_near_the_base(spark):
    rows = queries()["op6_lattice_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert all(math.isfinite(r.score) for r in rows) and sum(r.score for r in rows) > 1.4 * sum(r.base_score for r in rows)


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries()["op7_language"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_language_edges(spark):
    rows = [(1, "the cat sat", "en", 1), (2, "der hund lief", "de", 1), (3, None, "de", 1), (4, "some text", None, 1), (5, "123 !?", "en", 1), (6, "", "de", 1), (None, "hund " * 100_000, "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    found = {r.doc_id: r for r in langid.predicted(docs, langid.learn(docs)).collect()}
    assert found[1].lang_pred == "en" and found[None].lang_pred == "de" and [found[k].lang_pred for k in (3, 5, 6)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in found.values())
    one = {r.doc_id: r.lang_pred for r in langid.predicted(docs, langid.learn(docs.where("lang = 'de'"))).collect()}
    assert one[1] == "de" and one[3] == "und"
    assert {r.lang_pred for r in langid.predicted(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.predicted(docs.limit(0), langid.learn(docs)).count() == 0


def test_quality_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = queries()["op2_compression"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (1, 0), (None, 1), (2, None)], [(1, 1), (2, 0), (3, 1), (4, 0)]])
def test_quality_edges(spark, labels):
    rows = [(1, "good words here " * 50, 1), (2, "### *** ### " * 50, 1), (3, None, 1), (4, "", 1), (None, "x" * 300_000, 1), (1, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = compress_quality.learn(compress_quality.sample(docs, spark.createDataFrame(labels, "doc_id long, quality int")))
    found = compress_quality.scored(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert compress_quality.scored(docs.limit(0), model).count() == 0


def test_ftrl_equals_the_plain_rule():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(50, 4, replace=False)), rng.random(4), int(rng.integers(0, 3))) for _ in range(30)]
    order = rng.permutation(30)
    weights, offset = langid.ftrl(rows, 3, order)
    z, n = {}, {}

    def weight(k, c):
        a, b = z.get((k, c), 0.0), n.get((k, c), 0.0)
        return 0.0 if abs(a) <= langid.L1 else -(a - math.copysign(langid.L1, a)) / ((langid.BETA + math.sqrt(b)) / langid.STEP + langid.L2)

    for i in order:
        slots, values, label = rows[i]
        x = [*zip(slots.tolist(), values.tolist()), (langid.SLOTS, 1.0)]
        logit = [sum(v * weight(k, c) for k, v in x) for c in range(3)]
        total = sum(math.exp(v) for v in logit)
        gradients = {(k, c): v * (math.exp(logit[c]) / total - (c == label)) for k, v in x for c in range(3)}
        own = {key: weight(*key) for key in gradients}
        for key, g in gradients.items():
            z[key] = z.get(key, 0.0) + g - (math.sqrt(n.get(key, 0.0) + g * g) - math.sqrt(n.get(key, 0.0))) / langid.STEP * own[key]
            n[key] = n.get(key, 0.0) + g * g
    for c in range(3):
        assert math.isclose(offset[c], weight(langid.SLOTS, c), abs_tol=1e-12)
        assert all(math.isclose(weights[k, c], weight(k, c), abs_tol=1e-12) for k in range(50))
    assert (weights == 0).any()


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(5)
    logits, labels = 6 * rng.standard_normal((200, 3)), rng.integers(0, 3, 200)
    labels[:150] = logits[:150].argmax(1)
    found = langid.temperature(logits, labels)

    def loss(t):
        return -np.mean([x[k] / t - math.log(np.exp(x / t).sum()) for x, k in zip(logits, labels)])

    assert all(loss(found) <= loss(found * f) + 1e-12 for f in (0.9, 0.99, 1.01, 1.1))


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund lief", "de")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["²", "½ ¾", "①", "Ⅷ", "_ 12", "é", "日"])], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in langid.predicted(asked, model).collect()}
    assert [found[k] == "und" for k in range(7)] == [True] * 5 + [False] * 2


def test_gap_is_the_difference_of_compressed_sizes():
    import zstandard

    good, bad = [b"the quick brown fox jumps over the lazy dog. " * 200], [b"### buy now !!! $$$ click here " * 300]
    one, two = compress_quality.dictionary(good), compress_quality.dictionary(bad)
    for text in (b"", b"x", b"the lazy fox " * 900, b"click now $$$ " * 20):
        sizes = []
        for d in (one, two):
            pack = zstandard.ZstdCompressor(level=compress_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(pack.compress(text[k : k + compress_quality.BLOCK])) for k in range(0, len(text), compress_quality.BLOCK)))
        assert abs(compress_quality.Gap(one, two)(text) - (sizes[1] - sizes[0]) / max(1, len(text))) < 0.02
    assert compress_quality.Gap(one, two)(good[0]) > 0 > compress_quality.Gap(one, two)(bad[0])


def test_logistic_is_the_likeliest():
    rng = np.random.default_rng(6)
    x = rng.standard_normal(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(float)
    slope, offset = compress_quality.logistic(x, y)
    loss = lambda a, b: -np.mean(y * -np.logaddexp(0, -(a * x + b)) + (1 - y) * -np.logaddexp(0, a * x + b))
    assert all(loss(slope, offset) <= loss(slope + a, offset + b) + 1e-5 for a, b in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_long_words_in_windows(monkeypatch):
    import tracemalloc

    vocab = lattice_lm.vocabulary(PATH)
    logps = [vocab.weights(t, 0.1) for t in (0.5, 2.0)]
    words = ["the" * 30 + "é" * 9 + "quality" * 20, "x" * 200, "ab" * 60]
    whole = lattice_lm.word_scores(vocab, words, logps)
    for window in (18, 40, 100):
        monkeypatch.setattr(lattice_lm, "WINDOW", window)
        assert np.allclose(lattice_lm.word_scores(vocab, words, logps), whole, rtol=1e-12)
    monkeypatch.setattr(lattice_lm, "WINDOW", 4096)
    tracemalloc.start()
    lattice_lm.long_word(vocab, "word" * 25_000, logps[:1])
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
