"""Packing: plans against the optimum, and the token ids of packed documents against the tokenizer."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgrid.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, number long"


def fewest(items, capacity):
    """The least number of sequences, by search over subsets."""
    n = len(items)
    full = {m for m in range(1 << n) if sum(items[i] for i in range(n) if m >> i & 1) <= capacity}
    best = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        first = m & -m
        s = m
        while s:
            if s & first and s in full:
                best[m] = min(best[m], best[m ^ s] + 1)
            s = (s - 1) & m
    return best[-1]


def test_plan_is_valid_and_near_the_optimum():
    rng = random.Random(2)
    over = 0
    for _ in range(60):
        capacity = rng.choice([10, 20, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        plan = packing.plan(Counter(items), capacity)
        assert sum((Counter({w: n * k for w, n in Counter(p).items()}) for p, k in plan), Counter()) == Counter(items)
        assert all(sum(p) <= capacity for p, _ in plan)
        over += sum(k for _, k in plan) - fewest(items, capacity)
    assert over <= 3


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(60):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        free, fixed = dict(Counter(items)), Counter()
        while packing.reduce_once(free, 30, fixed):
            pass
        assert sum(fixed.values()) + fewest(list(Counter(free).elements()), 30) == fewest(items, 30)


def test_large_counts_are_planned_by_group():
    rng = random.Random(1)
    counts = {w: rng.randint(1, 10**9) for w in range(1, 4097)}
    plan = packing.plan(counts, 4096)
    assert len(plan) < 20_000
    places = packing.places(plan)
    assert len(places["length"]) < 80_000 and sum(sum(p) * k for p, k in plan) == sum(w * n for w, n in counts.items())


def test_packed_documents(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "Hello World's <|endoftext|> ...\n\tÉté 12", "same text", "same text", "x " * 9000, "日本語 text more", " non breaking é"]
    texts += [" ".join(rng.choice(["alpha", "beta", "gammaDelta", "42", "don't"]) for _ in range(rng.randint(1, 3000))) for _ in range(40)]
    rows = [(i, t, 7, 7) for i, t in enumerate(texts)] + [(None, "no id", 1, 1), (3, "again", 1, 1), (3, "again", 1, 1)]
    made = packing.packed_documents(spark.createDataFrame(rows, SCHEMA), PATH, keep_ids=True).collect()
    plain, want = Tokenizer.from_file(PATH), Counter()
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            data = np.array(ids[s : s + 4096], "<u4").tobytes()
            want[i, k, s, len(data) // 4, zlib.crc32(data), data] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in made) == want
    by = {}
    for r in made:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in made)
    assert len(by) <= -(-total // 4096) + 1
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_dominating_sets_by_hand():
    assert packing.plan({100: 2}, 100) == [((100,), 2)]
    assert dict(packing.plan({60: 3, 40: 3}, 100)) == {(60, 40): 3}
    assert sum(k for _, k in packing.plan({50: 3}, 100)) == 2
