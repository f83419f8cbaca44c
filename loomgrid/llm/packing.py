"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Every text becomes token ids by a public tokenizer and an end id; only longer ones are cut, into pieces of the
capacity. Pieces of one length are interchangeable, so the packing instance is the histogram of piece lengths: one
count for each length up to the capacity, whatever the number of documents. On that histogram ``plan`` runs

1. the reduction of Martello and Toth: for each item, largest first, look for a set of at most three items that
   dominates every other set with that item (it fits alone; it fits one more at most; another fills the sequence
   exactly; or the best partner outweighs the best pair). Such sets are part of some optimal packing and are fixed;
2. best fit, longest first, for the items that are left.

The plan is a list of patterns with multiplicities. Its size is bounded by the capacity: every step of either part
uses up a length or a group of equal open sequences. Pieces find their place by their number among pieces of their
length, which is counted within (length, bucket) and shifted by the counts of the buckets before, so a length that
a third of all pieces share is dealt over ``BUCKETS`` tasks. No step sees all pieces in one place.

Nulls: a null text is packed as an empty one (its end id alone). Null or repeated ids are packed like others.
Columns other than the id and the text are ignored. An empty table gives an empty result. A text of any length is encoded
as a whole by the task that reads it, and gives as many pieces as it needs.
"""

from __future__ import annotations

import ctypes
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import written

#: Sub-groups over which pieces of one length are numbered, at least, and pieces for each more.
BUCKETS, PER_BUCKET = 256, 1_000_000
#: Words whose ids a Python worker remembers; beyond it, it starts anew. Memory only, never results.
REMEMBERED = 1_200_000
#: The first of them, which it keeps between tasks: words that are met early are frequent.
KEPT = 100_000
#: Words that are encoded as one line.
TOGETHER = 64

_tokenizers: dict = {}


class WordIds:
    """Token ids of whole texts, remembered by word.

    For tokenizers that drop white space and never join over it, the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        known = self.known
        every = set().union(*split)
        new = every.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = every
        ordered = list(new)
        for at in range(0, len(ordered), 20_000):
            part = ordered[at : at + 20_000]
            known.update(zip(part, self.of_words([w.decode() for w in part])))
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def of_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word; words are encoded many at a time, and a token belongs to the word in which it begins."""
        lines = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False)):
            begins = np.cumsum([0] + [len(w) + 1 for w in line])
            cuts = np.searchsorted([b for b, _ in e.offsets], begins).tolist()
            ids = np.array(e.ids, "<u4").tobytes()
            yield from (ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:]))

    def rest(self) -> None:
        """Forget all but the first words, at the end of a task, and give back the memory: the worker may idle beside others for long."""
        self.known = dict(islice(self.known.items(), KEPT))
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(tokenizer_path)
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                out: list[tuple] = []
                for doc, ids in zip(part["doc_id"], encode([t if isinstance(t, str) else "" for t in part["text"]])):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[s : s + 4 * capacity]
                        out.append((doc, k, s // 4, len(cut) // 4, zlib.crc32(cut), *[cut] * keep_ids))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
        encode.rest()

    # ids travel as decimal text: nulls among numbers would make them floating-point in Python
    made = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, longest first in the fixed part) and how many sequences follow each."""
    free = {w: n for w, n in counts.items() if n > 0}
    if any(not 0 < w <= capacity for w in free):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed: Counter = Counter()
    while reduce_once(free, capacity, fixed):
        pass
    return [*fixed.items(), *best_fit(free, capacity).items()]


def _take(free: dict[int, int], order: list[int], items: tuple[int, ...], times: int) -> None:
    for w, n in Counter(items).items():
        free[w] -= n * times
        if not free[w]:
            del free[w]
            order.pop(bisect_left(order, w))


def reduce_once(free: dict[int, int], capacity: int, fixed: Counter) -> bool:
    """One pass over all lengths, longest first: take dominating sets from ``free`` into ``fixed``."""
    order, changed = sorted(free), False
    for w in sorted(free, reverse=True):
        while free.get(w):
            found = dominating(free, order, w, capacity)
            if not found:
                break
            items, times = found
            fixed[items] += times
            _take(free, order, items, times)
            changed = True
    return changed


def dominating(free: dict[int, int], order: list[int], w: int, capacity: int) -> tuple[tuple[int, ...], int] | None:
    """A set with an item of length ``w`` that dominates all others, and how often it does so in a row."""
    gap, own = capacity - w, free[w]
    left = lambda x: free[x] - (x == w)
    smallest: list[int] = []
    for x in order:
        smallest += [x] * min(left(x), 3 - len(smallest))
        if len(smallest) == 3:
            break
    fits = sum(s <= gap for s in np.cumsum(smallest))
    if not fits:
        return (w,), own
    at = bisect_left(order, gap + 1) - 1
    while not left(order[at]):
        at -= 1
    best = order[at]
    pairs = own // 2 if best == w else min(own, free[best])
    if fits == 1 or best == gap:
        return (w, best), pairs
    if fits > 2:
        return None
    top, low, high = (0, 0, 0), 0, at
    while low <= high:
        a, b = order[high], order[low]
        if a + b > gap or not left(a):
            high -= 1
        else:
            if left(b) >= 1 + (a == b):
                top = max(top, (a + b, a, b))
            low += 1
    total, a, b = top
    if best >= total:
        return (w, best), pairs
    above = [x for k in range(bisect_left(order, b) + 1, len(order)) for x in [order[k]] * min(2, left(order[k]))][:2]
    if best == a and (len(above) < 2 or w + sum(above) > capacity):
        once = Counter((w, a, b))
        return (w, a, b), max(1, min(free[x] // n - 2 * (x == a) for x, n in once.items()))
    return None


def best_fit(free: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, for whole groups of equal items and equal open sequences at a time."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append([items, times])

    for w in sorted(free, reverse=True):
        n = free[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                group = open_by_room[room][-1]
                times = min(n, group[1])
                group[1] -= times
                if not group[1]:
                    open_by_room[room].pop()
                    if not open_by_room[room]:
                        del open_by_room[room]
                        rooms.pop(at)
                put(room - w, (*group[0], w), times)
                n -= times
            else:
                each = capacity // w
                if n >= each:
                    put(capacity - each * w, (w,) * each, n // each)
                if n % each:
                    put(capacity - n % each * w, (w,) * (n % each), 1)
                n = 0
    out: Counter = Counter()
    for groups in open_by_room.values():
        for items, times in groups:
            out[items] += times
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For every length, runs of pieces by number: where a run begins, its first sequence, and the place in it."""
    taken: Counter = Counter()
    rows, base = [], 0
    for items, times in patterns:
        offset = 0
        for w in items:
            rows.append((w, taken[w], base, offset))
            taken[w] += times
            offset += w
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), columns))


def numbered(parts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(length, number, row): the place of each piece among those of its length, from 0; ``row`` has all columns of ``parts``.

    Pieces of one length are interchangeable, so they are dealt by where they stand and not by what they hold.
    """
    dealt = written(parts.select("length", F.struct(*parts.columns).alias("row"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket")), "dealt")
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("skip", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row.doc_id", "row.piece", "row.ids_crc32")) - 1
    return dealt.withColumn("within", within).join(before, ["length", "bucket"]).select("length", (F.col("skip") + F.col("within")).alias("number"), "row")


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces (written, as they are read twice) with ``sequence_id`` and ``offset``."""
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    where = places(plan(histogram, capacity))
    starts = (where["length"] << 44) + where["first"]
    numbers = numbered(parts, max(BUCKETS, sum(histogram.values()) // PER_BUCKET))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        own = (length.to_numpy(np.int64) << 44) + number.to_numpy(np.int64)
        run_of = np.searchsorted(starts, own, side="right") - 1
        return pd.DataFrame({"sequence_id": where["sequence"][run_of] + own - starts[run_of], "offset": where["offset"][run_of]})

    placed = numbers.select("row.*", place("length", "number").alias("_place"))
    return placed.select(*parts.columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and its gapless place there."""
    return pack(written(pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col), "pieces"), capacity)
