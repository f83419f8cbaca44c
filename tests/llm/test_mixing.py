"""The mix against plain Python."""

import hashlib
import random
import re

import pytest

from loomgrid.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, bucket string"


def plain(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(total.values()), {}, list(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    line = []
    for s in names:
        own = sorted(((hashlib.md5(f"{'' if r[0] is None else r[0]} {'' if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest(), r[0] or 0, size(r[1]), k) for k, r in enumerate(rows) if r[2] == s), key=lambda x: x[:3])
        done = 0
        for _ in range(2):
            for _, _, n, k in own:
                done += n
                line.append((done / target[s] if target[s] else 0, s is None, s or "", n, k))
    left, taken = int(budget), [0] * len(rows)
    for _, _, _, n, k in sorted(x for x in line if x[3]):
        taken[k] += min(n, left)
        left -= min(n, left)
    return [(r[0], size(r[1]), total[r[2]], target[r[2]], taken[k]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "B", "é", None, "tiny"] if seed == 1 else ["x", "y"]), 5, "b") for i in range(120)]
    rows += [(500, None, "a", 1, "b"), (501, "", "only empty", 1, "b"), (502, "one two", "zz", 1, "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.queue(docs).collect())
    want = sorted((i, n, s, round(t, 6), k) for i, n, s, t, k in plain(rows))
    assert found == want
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    words = sum(len(r.text.split()) for r in made.collect())
    assert words == sum(w[4] for w in want) == int(1.5 * sum(w[1] for w in want))


def test_null_and_repeated_ids_and_empty(spark):
    rows = [(None, "a b c", None, 1, "x"), (None, "a b c", None, 1, "x"), (1, "d e", "s", 1, "x"), (1, "d e", "s", 1, "x")]
    found = mixing.queue(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 4 and sum(r.taken for r in found) == 15
    assert mixing.queue(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.queue(spark.createDataFrame([(1, None, "s", 1, "x")], SCHEMA).select("doc_id", "text", "source")).first().taken == 0


def test_mixed_documents_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, None, 1, 2, i]), " ".join([f"w{i}"] * rng.choice([0, 1, 5, 40])), rng.choice(["a", "B", None]), i, "b") for i in range(80)]
    rows = rows + rows[:30] + [(None, None, "a", 1, None), (1, "x y", "a", None, "2"), (1, "x y", "a", 2, None), (1, "x y", "a", 2, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = mixing.mixed_documents(docs).collect()
    took = mixing.queue(docs.withColumn("body", docs["text"]), keep=("body",))
    words, want = {}, {}
    for r in made:
        words[r.doc_id, r.source, r.text.split()[0]] = words.get((r.doc_id, r.source, r.text.split()[0]), 0) + len(r.text.split())
    for r in took.where("taken > 0").collect():
        key = r.doc_id, r.source, r.body.split()[0]
        want[key] = want.get(key, 0) + r.taken
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(words.values()) == int(1.5 * total)
    assert {r[:2] for r in words} <= {(r[0], r[2]) for r in rows}
    whole = set(rows)
    cut = [r for r in made if tuple(r) not in whole]
    assert len(cut) <= 1
    assert sum(abs(words.get(k, 0) - want.get(k, 0)) for k in words.keys() | want.keys()) <= 2 * 40


def test_no_python_in_the_plans(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, "x")], SCHEMA)
    for made in (mixing.queue(docs), mixing.mixed_documents(docs)):
        plan = made._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_third_of_all_rows_are_equal(spark):
    rows = [(None, "a b c", "s", 1, "x")] * 200 + [(i, f"w{i} x y z", "s", 1, "x") for i in range(300)] + [(i, "one", "t", 1, "x") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = mixing.queue(docs).collect()
    assert len(found) == 600 and sum(r.taken for r in found) == int(1.5 * (600 + 1200 + 100))
    assert all(r.taken <= 2 * r.size for r in found)
    assert sorted(map(tuple, mixing.queue(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_clashing_names(spark):
    names = ("_text_key", "_row_key", "taken_words", "taken_of", "doc", "size", "finish_1")
    rows = [(i, f"w{i} " * (i + 1), "ab"[i % 2], *names) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    plain = mixing.mixed_documents(docs.select("doc_id", "text", "source")).collect()
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted((r["doc_id"], r["text"]) for r in plain)
    assert all(tuple(r[3:]) == names for r in found.collect())
