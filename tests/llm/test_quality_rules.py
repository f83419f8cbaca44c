"""Base counts and the log-likelihood ratio against plain Python."""

import math
import re
from collections import Counter

import xxhash

from loomgrid.llm import quality_rules as q

TEXTS = [
    "a b c a b c a b c d", "x", "", None, "  \n \t", "one two\nthree\none two\n\nthree\nfour", "# * $ % & | < > ##ab", "é\xa0ü é\xa0ü é\xa0ü é\xa0ü é\xa0ü",
    " ".join(f"w{i % 70}" for i in range(60)), " ".join(f"w{i % 7}" for i in range(200)), " ".join(f"u{i}" for i in range(5000)), "z y x z y x " * 30 + " ".join(f"u{i}" for i in range(400)),
]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def slots(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, words[1:])]
    return [signed(h) % q.SLOTS for h in one + two]


def test_equal_to_plain_python(spark):
    rows = [(i, t, "s", i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8], None, None), (3, TEXTS[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, row int")
    trusted = spark.createDataFrame([(8,), (8,), (10,), (77,), (None,)], "doc_id long")
    found = q.with_verdict(docs, trusted).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept").collect()
    assert len(found) == len(rows)
    raw, good = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(slots(t))
        good.update(slots(t) if i in (8, 10) else [])
    ratio = {k: math.log((good[k] + q.SMOOTHING) / (raw[k] * good.total() / raw.total() + q.SMOOTHING)) for k in raw}
    expected = []
    for i, t, *_ in rows:
        own, grams = base(t), slots(t)
        score = sum(ratio[g] for g in grams) / len(grams) if grams else None
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        expected.append((i, *own, failed, score, not failed and score >= q.THRESHOLD))
    key = lambda r: (r[0] is None, r[0], r[1])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key)):
        assert a[:7] == b[:7] and a[8] == b[8]
        assert a[7] is None and b[7] is None or abs(a[7] - b[7]) < 1e-6


def test_without_trusted_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [r.kept for r in q.with_verdict(docs, none).collect()] == [True]
    assert q.with_verdict(docs.limit(0), none).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    from loomgrid.llm.queries import op1_quality_rules

    assert "Python" not in op1_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
