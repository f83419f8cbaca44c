"""Repeated strings against brute force, and the merged transforms against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

from loomgrid.llm import bwt_dedup as b

SCHEMA = "doc_id long, text string, at int, mark string"


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if (w := data[s : s + 100]) in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i] = (i, len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.randint(90, 400)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = "".join(rng.choice([text(rng.randint(0, 200)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :]]) for _ in range(rng.randint(0, 5)))
        rows.append((i * 3, t))
    rows += [(1, None), (2, ""), (4, "a" * 700), (7, "ab" * 300), (500, "x" * 99), (501, "x" * 100), (502, "x" * 101), (None, passages[0] * 2), (900, rows[5][1]), (901, rows[5][1])]
    rows += [(3000 + i, text(rng.randint(0, 40)) + passages[3] + text(rng.randint(0, 40))) for i in range(60)]  # a hot passage
    rows += [(1000, passages[1] + text(130_000) + passages[2]), (1001, text(70_000) + passages[1] + text(50))]
    return rows


@pytest.mark.parametrize("seed,most", [(1, 1024), (2, 2)])
def test_equal_to_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(b, "MOST", most)
    monkeypatch.setattr(b, "BUCKET", 5000)
    monkeypatch.setattr(b, "SHARD", 600)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "m") for i, t in rows], SCHEMA).repartition(5)
    found = {r.doc_id: tuple(r) for r in b.spans(docs).collect()}
    assert found == brute(rows)


def test_merge_finds_the_repeated_intervals():
    rng = random.Random(4)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(40)]
    groups = [segments[:7], segments[7:8], segments[8:25], segments[25:]]
    shards = [b.transform(g) for g in groups]
    now, interval, common = b.merge(shards, np.array([len(s) for s in segments]), 12)
    places = [(s, o) for s, d in enumerate(segments) for o in range(len(d) + 1)]
    base = np.cumsum([0] + [sum(len(d) + 1 for d in g) for g in groups])
    order = np.concatenate([o + x for (_, _, o), x in zip(shards, base)])
    suffix = lambda p: segments[p[0]][p[1] :]
    found = [places[k] for k in order[now]]
    by_string = {}
    for p in places:
        if len(suffix(p)) >= 12:
            by_string.setdefault(suffix(p)[:12], []).append(p)
    want = {k: v for k, v in by_string.items() if len(v) > 1}
    assert len(want) > 20
    assert [suffix(p)[:12] for p in found] == sorted(suffix(p)[:12] for p in found)  # merged order
    groups = {}
    for p, g in zip(found, interval.tolist()):
        groups.setdefault(g, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    ends = {}  # strings of an even length that end where a window ends
    for s, d in enumerate(segments):
        for e in range(12, len(d) + 1):
            for n in range(2, 13, 2):
                ends.setdefault(d[e - n : e], set()).add((s, e))
    for k, p in enumerate(order):
        s, o = places[p]
        own = [n for n in range(2, 13, 2) if 12 <= o + n <= len(segments[s]) and len(ends[segments[s][o : o + n]]) > 1]
        assert common[k] == max(own, default=0)


def test_shards_are_in_suffix_order():
    rng = random.Random(5)
    segments = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 400))) for _ in range(20)]
    symbols, to_first, order = b.transform(segments)
    text = b"".join(s.translate(b._UP) + b"\0" for s in segments)
    assert all(text[x : x + 100] <= text[y : y + 100] for x, y in zip(order, order[1:]))
    for rank in range(len(text)):
        if symbols[rank]:
            assert order[to_first[rank]] == order[rank] - 2 and symbols[rank] == text[order[rank] - 2] << 8 | text[order[rank] - 1]


def test_suffixes_are_sorted_three_times(monkeypatch):
    rng, sorts, argsort = random.Random(8), [], np.argsort
    text = "".join(rng.choices("abcd ", k=500)).encode() * 60
    monkeypatch.setattr(b.np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    order = b.suffix_order(np.frombuffer(text + b"\0", np.uint8))
    assert len(sorts) == 3
    assert all(text[x : x + 100] <= text[y : y + 100] for x, y in zip(order, order[1:]))


def test_repeated_rows_of_one_id(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(5, t, 0, "m"), (5, t, 0, "m"), (5, t + "tail", 0, "m"), (6, t, 0, "m")]
    found = sorted((r.doc_id, r.n_removed) for r in b.spans(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found in ([(5, 0), (5, 0), (5, 300), (6, 300)], [(5, 0), (5, 300), (5, 300), (6, 300)])
    assert b.spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_at_the_end_of_the_range(spark):
    t = "".join(random.Random(2).choices("abcdefgh ", k=300))
    rows = [(2**63 - 1, t, 0, "m"), (None, t + "x", 0, "m"), (2**53 + 1, t + "y", 0, "m"), (2**53 + 2, t, 0, "m"), (None, "other", 0, "m")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in b.spans(docs).collect()), key=repr) == sorted([(2**63 - 1, 300, 300), (None, 301, 300), (2**53 + 1, 301, 0), (2**53 + 2, 300, 300), (None, 5, 0)], key=repr)


def test_many_equal_rows_of_one_id(spark):
    t = "".join(random.Random(3).choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(5, t + t, 0, "m")] * 60, SCHEMA)
    assert {(r.n_removed, r.n_spans) for r in b.spans(docs).collect()} == {(300, 1)}
    assert b.spans(docs).count() == 60


def test_cleaned_keeps_the_other_columns(spark):
    t = "".join(random.Random(6).choices("abcdefgh ", k=300))
    rows = [(None, t, 7, "m"), (None, None, 8, "m"), (3, t + "é tail", 9, None), (3, "  ", 1, "m"), (3, t, 2, "z")]
    found = sorted(map(tuple, b.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert found in (sorted([(3, t, 2, "z"), (3, "é tail", 9, None)], key=repr), [(3, t + "é tail", 9, None)])


@pytest.mark.parametrize("few,most", [(1024, 1024), (2, 5), (1, 1)])
def test_anchors_that_are_dealt_in_many_batches(spark, monkeypatch, few, most):
    for name, value in {"FEW": few, "MOST": most, "BATCH": 50, "GROUPS": 7, "BUCKET": 5000, "SHARD": 600}.items():
        monkeypatch.setattr(b, name, value)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 0, "m") for i, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id: tuple(r) for r in b.spans(docs).collect()} == brute(rows)


def test_entries_of_an_anchor_meet_once():
    rng = np.random.default_rng(7)
    entries = np.stack([rng.integers(0, 400, 5000), rng.integers(0, 9, 5000), rng.integers(-5, 5, 5000), np.full(5000, -1), rng.permutation(5000) * 128 + 3])
    entries[1] += entries[0] * 100  # stretches of an anchor
    entries[1, :2000], entries[0, :2000] = np.arange(2000) + 10**6, 17  # very many of one
    want = {}
    for a, s, *owner in entries.T.tolist():
        want.setdefault(a, {}).setdefault(s, []).append(tuple(owner))
    batches = [b.dealt(np.ascontiguousarray(x)) for x in np.array_split(entries, 4, axis=1)]
    group, dealt = (np.concatenate(x, axis=-1) for x in zip(*batches))
    assert np.array_equal(b.unbundled([b.bundle(dealt[:, :9]), b.bundle(dealt[:, 9:])]), dealt)
    found = [x for g in np.unique(group) for x in zip(*(c.tolist() for c in b.met(dealt[:, group == g].copy())))]
    later, hot = (sorted(tuple(x[1:4]) for x in found if x[4] == k) for k in (b.LATER, b.HOT))
    crowded = {o for s in want[17].values() for o in s}
    assert crowded == {*hot, *later} & crowded and {min(s) for s in want[17].values()} <= set(hot) <= crowded
    assert [o for o in later if o not in crowded] == sorted(o for a, kinds in want.items() if a != 17 for s in kinds.values() for o in sorted(s)[1:])
    firsts = [min(s) for a, kinds in want.items() if a != 17 and len(kinds) > 1 for s in kinds.values()]
    assert sorted(tuple(x[1:4]) for x in found if x[4] == 0) == sorted(firsts)
    assert np.bincount(group).max() < 600  # the many stretches of one anchor are no group


def test_texts_are_shuffled_twice_and_anchors_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(b, "written", lambda df, name: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or _written(df, name))
    from loomgrid.llm.common import written as _written

    docs = spark.createDataFrame([(i, t, 0, "m") for i, t in corpus(4)], SCHEMA)
    b.spans(docs).count()
    assert [name for name, _ in written] == ["anchors", "repeats"]  # no table of all anchors, of windows or of verdicts
    assert not any("Join" in plan for name, plan in written if name == "anchors")
    assert sum(plan.count("Join ") for _, plan in written) == 1  # the texts with their stretches
