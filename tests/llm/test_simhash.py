"""SimHash near-duplicates against a brute-force comparison of all pairs."""

import random

import numpy as np
import xxhash

from loomgrid.llm import simhash

SCHEMA = "doc_id long, text string, fp string, key int"


def brute(rows, width):
    fps = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {(r[0], fps[i], least[find(i)]) for i, r in enumerate(rows)}


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        for _ in range(rng.choice([1, 1, 3, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 + 1, rng.choice([" ", "\n\t"]).join(text).replace("w1", "W1"), "x", 1))
    rows += [(5, None, None, None), (6, "", None, None), (2, " \x0b ", None, 1), (900, "é\xa0b Ü c d e f g h", None, 1), (901, "word " * 60000, None, 1)]
    for width in (3, 5):
        found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width).collect()
        assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in found} == brute(rows, width)
        assert len(found) == len(rows)


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    near = fps.copy()
    for i in range(len(fps)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    row, key, side = simhash.keys(fps)
    other, other_key, other_side = simhash.keys(near)
    left = {(r, k) for r, k, s in zip(row, key, side) if s == 0}
    right = {(r, k) for r, k, s in zip(other, other_key, other_side) if s == 1}
    assert {r for r, _ in left & right} == set(range(500))
    assert len(row) <= 84 * 500


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_similar(rows, width, similarity):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or ({b" ".join(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {(r[0], least[find(i)]) for i, r in enumerate(rows)}


def test_similar_documents_equal_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(80):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 60, 400]))]
        for _ in range(rng.choice([1, 1, 3, 5])):
            text = list(base)
            for _ in range(rng.randrange(1 + len(text) // 20)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 + 1, rng.choice([" ", "\n\t"]).join(text).replace("w1", "W1"), "x", 1))
    rows += [(5, None, None, None), (6, "", None, None), (2, " \x0b ", None, 1), (901, "word " * 60000, None, 1), (902, "word word word word word", None, 1)]
    found = simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == brute_similar(rows, 5, 0.8)
    assert len(found) == len(rows)


def test_large_group_of_near_copies_and_nulls(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(5000)}" for _ in range(300)]
    rows = [(1, " ".join(base), None, 1)]
    for i in range(400):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((10 + i, " ".join(text), None, 1))
    rows += [(None, " ".join(base), None, 1), (1, " ".join(base), None, 1)]
    found = simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and {r.component_id for r in found} == {1}
    assert simhash.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(300), 4 + seed % 2 * rng.randrange(2)):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((10 + i, " ".join(text), None, 1))
    return rows


def test_large_group_without_its_original(spark):
    for seed in (6, 7):
        rows = near_copies(600, seed)
        found = simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {(r.doc_id, r.component_id) for r in found} == brute_similar(rows, 5, 0.8)


def test_blocks_and_forest():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 9000, rng.integers(1, 4000)).astype(np.int32) for _ in range(30)]
    both = simhash.common(sets[:12], sets[12:])
    assert all(both[i, j] == len(set(sets[i]) & set(sets[12 + j])) for i in range(12) for j in range(18))
    assert not simhash.common([np.array([1], np.int32)], [np.array([2], np.int32)]).any()
    for share in (0.0, 0.03, 0.1, 0.6):
        linked = rng.random((40, 25)) < share
        pairs = simhash.forest(linked)
        assert len(pairs) < 65 and all(linked[p] for p in pairs)

        def groups(edges):
            root = list(range(65))
            for i, j in edges:
                one, two = root[i], root[40 + j]
                root = [one if x == two else x for x in root]
            return [root.index(x) for x in root]

        assert groups(pairs) == groups(zip(*map(list, np.nonzero(linked))))


def test_no_side_that_grows_passes_through_the_driver(spark, monkeypatch):
    plans, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 4 * 7 + j * (k % 4 + 1)) % 50}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    plans.append(simhash.near_duplicates(docs, 3)._jdf.queryExecution().executedPlan().toString())
    simhash.similar_documents(docs)
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
