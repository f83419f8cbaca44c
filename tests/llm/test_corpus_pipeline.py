"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_bwt_dedup import brute as without_repeats
from test_mixing import plain as mixed
from test_quality_rules import base, slots
from test_simhash import brute_similar
from tokenizers import Tokenizer

from loomgrid.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n):
    rng = random.Random(8)
    return [" ".join(f"t{i}w{rng.randrange(10**6)}" for _ in range(40)) for i in range(n)]


def test_near_duplicates_keeps_one_row_per_component(spark):
    t = texts(9)
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]), (1, t[2]), (1, t[3]), (7, t[3]), (7, t[4]), (7, t[5]), (7, t[5]), (8, None), (8, ""), (9, t[6]), (None, t[6] + " x")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], SCHEMA)
    made = corpus_pipeline.near_duplicates(spark, docs, "")
    assert made.columns == docs.columns
    found = sorted(((r.doc_id, r.text or "") for r in made.collect()), key=repr)
    assert found == sorted([(None, t[0]), (None, t[1]), (1, t[2]), (1, t[3]), (7, t[4]), (7, t[5]), (8, ""), (9, t[6])], key=repr)
    many = [(None, x, "en", "s", 1) for x in texts(60)]
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame(many * 2, SCHEMA), "").count() == 60


def test_pairs_on_a_common_stem_are_all_linked(spark):
    """Texts of a pair are 0.8 alike or more, texts of different pairs are not, and all share most of their shingles."""
    rng = random.Random(12)
    stem = [f"s{rng.randrange(10**6)}" for _ in range(440)]
    rows = []
    for k in range(40):
        for m in range(2):
            own = [f"p{k}w{j}" for j in range(16)] + [f"p{k}m{m}w{j}" for j in range(40)]
            rows.append((2 * k + m, " ".join([*stem, *own]), None, None))
    want = brute_similar(rows, 5, 0.8)
    assert len({c for _, c in want}) == 40
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x, *_ in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {c for _, c in want}


def corpus():
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [f"q{k}" for k in range(60)]
    rows = []
    for k in range(45):
        body = [word() for _ in range(rng.randrange(55, 160))]
        if k % 5 == 0:
            body = body[:30] + passage + body[30:]
        rows.append((3 * k + 1, " ".join(body)))
        if k % 6 == 0:
            rows.append((3 * k + 2, " ".join(body)))
        if k % 7 == 0:
            rows.append((3 * k + 3, " ".join([*body[:-3], "other", "end"])))
    rows += [(900, None), (901, ""), (902, "too short"), (903, "again " * 80), (None, " ".join(word() for _ in range(70)))]
    rows += [(904, "é " * 3 + " ".join(f"junk{k}" for k in range(80)))]
    return [(i, t, "en", ("a", "b", None)[n % 3], 1) for n, (i, t) in enumerate(rows)]


def good(rows, labels):
    raw, trusted = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(slots(t))
        trusted.update(slots(t) if i in labels else [])
    ratio = {k: math.log((trusted[k] + quality_rules.SMOOTHING) / (raw[k] * trusted.total() / raw.total() + quality_rules.SMOOTHING)) for k in raw}
    out = []
    for r in rows:
        own, grams = base(r[1]), slots(r[1])
        if own[0] >= 50 and 100 * own[4] <= 50 * own[0] and sum(ratio[g] for g in grams) / len(grams) >= quality_rules.THRESHOLD:
            out.append(r)
    return out


def cut(rows):
    """Rows without what occurred earlier, for ids that differ."""
    seen, out = set(), []
    for i, text, *rest in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if (w := data[s : s + 100]) in seen:
                gone[s : s + 100] = True
            seen.add(w)
        left = bytes(x for x, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        if left.strip():
            out.append((i, left, *rest))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in corpus()[:30]] + [(902, 1, 0), (904, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage_and_the_run_equal_plain_python(spark, folder):
    rows = corpus()
    labels = {r[0] for r in rows[:30]} | {902}
    want = [good(rows, labels)]
    component = dict(brute_similar([(10**6 if r[0] is None else r[0], *r[1:]) for r in want[0]], 5, 0.8))
    want.append([r for r in want[0] if component[10**6 if r[0] is None else r[0]] == (10**6 if r[0] is None else r[0])])
    want.append(cut(want[1]))
    assert {i: n for i, n, *_ in without_repeats([r[:2] for r in want[1]]).values()} and len(rows) > len(want[0]) > len(want[1]) >= len(want[2]) > 30
    shown = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        assert shown(made.collect()) == shown(expected), name
        docs = spark.createDataFrame(expected, SCHEMA)
    taken = mixed([(r[0], r[1], r[3]) for r in want[2]])
    copies = []
    for r, (_, size, *_, n) in zip(want[2], taken):
        copies += [r[:2]] * (n // size) + ([(r[0], " ".join(r[1].split()[: n % size]))] if n % size else [])
    made = corpus_pipeline.mix(spark, docs, folder)
    assert shown(r[:2] for r in made.collect()) == shown(copies)

    encode, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in copies:
        ids = [*encode.encode(t, add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            data = np.array(ids[s : s + 4096], "<u4").tobytes()
            pieces[i, k, s, len(data) // 4, zlib.crc32(data)] += 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(n for *_, n, _ in pieces.elements()) // 4096) + 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
