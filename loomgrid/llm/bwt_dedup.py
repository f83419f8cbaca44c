"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte is removed if it is covered by a string of ``WINDOW`` bytes that also starts earlier: in a row with a smaller
id, or earlier in the same row. Matches never cross rows.

1. Anchors deal the text. Each window names its least ``GRAM``-byte gram by hash, leftmost of equals. Equal windows name
   equal grams at equal places, so windows can only repeat where an anchor does; about one position in 39 is one.
   They are dealt in bundles to groups by their hash, once; no group takes more than ``FEW`` stretches of an anchor from a batch.
2. Segments. An anchor's windows are one stretch of text. Of equal stretches of an anchor (equal XXH64 of their bytes, besides
   the 48-bit hash of their anchor) all but the first repeat: that is decided by the group. An anchor's windows name it at
   different places, so one stretch holds no window twice, and an anchor with a single different stretch is done with.
3. Transforms. The different stretches of the other anchors, one owner each, are segments. They are dealt into buckets by
   anchor and cut into shards. Every shard gets its suffix order and
   transform; the transforms of a bucket are merged by refining their interleave, two symbols in a round, and intervals that
   are down to one suffix leave, so that work is spent on what still repeats. What is left after ``WINDOW`` symbols are the
   repeated intervals: all but the first owner of an interval repeat. The segments of an anchor with more than ``MOST`` of them
   are cut into their single windows, which are dealt by their own hash: a passage that very many rows share
   with different surroundings fills no bucket. Of equal windows of a batch, compared byte by byte, one goes on.
4. Spans. The repeats of a row are collected (they are bounded by its own length) and joined with its text.

Nulls: a null text is empty. Null ids come after all others. Rows with equal id are ordered by a hash of their text; rows
with equal id and equal text are one document, shown once for each row, and none of them is earlier than the
other. Texts of any length are read in overlapping parts. Extra columns are ignored by ``spans`` and kept by
``cleaned``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, written

WINDOW, GRAM = 100, 24
REACH = WINDOW - GRAM + 1
#: Bytes of a bucket and of a shard, different stretches of an anchor beyond which its windows are dealt one by one.
BUCKET, SHARD, MOST = 1 << 17, 1 << 15, 1024
LAST = (1 << 63) - 1
#: Groups that anchors are dealt into and anchors that are dealt at once; different stretches of an anchor in these beyond which
#: its windows are dealt one by one; kinds of entries.
GROUPS, BATCH, FEW = 2048, 200_000, 256
HOT, LATER = 1, 2
_UP = bytes((b + 1) % 256 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(17, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, stretch hash) of texts laid end to end in ``data``, 65,000 bytes at most.

    ends: where each text ends. Anchors are 48-bit hashes of their gram; stretches have the XXH64 of their bytes, seeded with
    the anchor's place in them.
    """
    n = len(data)
    if n < WINDOW:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (grams & ~np.uint64(0xFFFF)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[REACH - size :][: n - WINDOW + 1])
    starts = np.arange(n - WINDOW + 1)
    row = np.searchsorted(ends, starts, side="right")
    inside = starts + WINDOW <= ends[row]
    starts, row, least = starts[inside], row[inside], least[inside]
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at = np.nonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))[0]
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    place = (least[at] & np.uint64(0xFFFF)).astype(np.int64) - first
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    stretch = np.fromiter((digest(raw[f:e], k) for f, e, k in zip(first.tolist(), (first + count + WINDOW - 1).tolist(), place.tolist())), np.uint64, len(at))
    return row[at], first, count, (least[at] >> np.uint64(16)).astype(np.int64), stretch.view(np.int64)


def chunks(texts: list[bytes], most: int = 60_000) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(rows, where each part begins in its text, parts laid end to end): whole texts together, long ones in overlapping parts."""
    rows, begins, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        if size and size + len(t) > most:
            yield rows, begins, parts
            rows, begins, parts, size = [], [], [], 0
        if len(t) > most:
            for s in range(0, len(t) - WINDOW + 1, most - WINDOW + 1):
                yield [i], [s], [t[s : s + most]]
            continue
        rows, begins, parts, size = [*rows, i], [*begins, 0], [*parts, t], size + len(t)
    if rows:
        yield rows, begins, parts


def located(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(id, mark, text, keep...) of every row and of the different ones, with what orders rows: the id, null last, and a mark.

    The mark tells rows of one id apart by a hash of their text; it is negative where there is an id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    again = docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
    h = F.xxhash64(text)
    mark = F.when(F.col(id_col).isNull(), F.shiftrightunsigned(h, 1)).otherwise(h.bitwiseOR(F.lit(-(1 << 63))) if again else F.lit(-1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), mark.cast("long").alias("mark"), text.alias("text"), *keep)
    once = rows.select("id", "mark", "text")
    return rows, once.dropDuplicates(["id", "mark"]) if again else once


def bundle(columns: np.ndarray) -> bytes:
    """A (5, n) array of longs as planes of their bytes, most of which are constant or nearly so."""
    n = columns.shape[1]
    return np.ascontiguousarray(columns).view(np.uint8).reshape(5, n, 8).transpose(0, 2, 1).tobytes()


def unbundled(bundles: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(d, np.uint8).reshape(5, 8, -1).transpose(0, 2, 1).reshape(5, -1) for d in bundles]
    return np.concatenate(parts, axis=1).view(np.int64)


def _equals(sorted_: np.ndarray) -> np.ndarray:
    """Mask of the values of a sorted array that it holds more than once."""
    out, equal = np.zeros(len(sorted_), bool), sorted_[1:] == sorted_[:-1]
    out[1:] = equal
    out[:-1] |= equal
    return out


def dealt(entries: np.ndarray, groups: int = GROUPS, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """(group, entries) of the anchors of some texts: rows anchor, stretch, id, mark, at; the anchor gets its kind above it.

    Of equal stretches all but the first are ``LATER`` whatever other texts hold, and need no anchor more. An anchor's entries are of one group, but for those that are decided and for those of an anchor with more than ``few``
    different stretches here, of which one tells its group: no group grows with what very many texts share.
    """
    kind = np.zeros(entries.shape[1], np.int64)
    order = np.argsort(entries[1])
    order = order[_equals(entries[1][order])]
    order = order[np.lexsort([*entries[4:1:-1, order], entries[1, order], entries[0, order]])]
    same = (entries[:2, order[1:]] == entries[:2, order[:-1]]).all(axis=0)
    kind[order[1:][same]] = LATER
    group = entries[0] % groups
    left = np.sort(entries[0][kind != LATER])
    if (many := np.unique(left[few:][left[few:] == left[:-few]])).size:
        hot = np.nonzero((kind != LATER) & np.isin(entries[0], many))[0]
        kind[hot] = HOT
        rest = np.delete(hot, np.unique(entries[0, hot], return_index=True)[1])
        group[rest] = entries[1, rest] % groups
    later = np.nonzero(kind == LATER)[0]
    group[later] = (entries[2, later] + (entries[4, later] >> 7)) % groups
    entries[:2, later] = 0
    entries[0] |= kind << 48
    return group, entries


def met(entries: np.ndarray, most: int = MOST) -> tuple[np.ndarray, ...]:
    """(a, id, mark, at, kind) from all entries of some groups.

    Stretches with an earlier equal one are ``LATER``. The others are of kind 0, or ``HOT`` where their anchor has more than
    ``most`` of them; the only one of an anchor is left out.
    """
    kind, entries[0] = entries[0] >> 48, entries[0] & ((1 << 48) - 1)
    passed, entries, kind = entries[:, kind == LATER], entries[:, kind != LATER], kind[kind != LATER]
    order = np.argsort(entries[0])
    order = order[_equals(entries[0][order]) | (kind[order] == HOT)]
    order = order[np.lexsort(entries[::-1, order])]
    entries, kind = entries[:, order], kind[order]
    anchor = np.append(True, entries[0, 1:] != entries[0, :-1])[: len(order)]
    first = anchor | np.append(True, entries[1, 1:] != entries[1, :-1])[: len(order)]
    of = np.cumsum(anchor) - 1
    kinds, hot = np.bincount(of, first), np.bincount(of, kind == HOT) > 0
    kind = np.where(first, np.where((hot | (kinds > most))[of], HOT, 0), LATER)
    stay = ~first | (hot | (kinds > 1))[of]
    out = [np.concatenate([entries[i, stay], passed[i]]) for i in (0, 2, 3, 4)]
    return *out, np.concatenate([kind[stay], np.full(passed.shape[1], LATER)])


def find_anchors(rows: DataFrame) -> DataFrame:
    """(part, data): the anchors of ``rows`` in bundles of one group each, as ``dealt`` makes them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def rest() -> pd.DataFrame:
            group, entries = dealt(np.concatenate(held, axis=1), GROUPS, FEW)
            order = np.argsort(group.astype(np.uint16), kind="stable")
            group, entries = group[order], entries[:, order]
            cuts = np.append(np.nonzero(np.diff(group, prepend=-1))[0], len(group))
            return pd.DataFrame({"part": group[cuts[:-1]], "data": [bundle(entries[:, b:e]) for b, e in zip(cuts, cuts[1:])]})

        for f in frames:
            ids, marks = f["id"].to_numpy(np.int64), f["mark"].to_numpy(np.int64)
            for own, begins, parts in chunks([t.encode("utf-8", "surrogatepass") for t in f["text"]]):
                data = np.frombuffer(b"".join(parts), np.uint8)
                row, first, count, anchor, stretch = anchors(data, np.cumsum([len(p) for p in parts]))
                if not len(row):
                    continue
                offset = np.array(begins) - np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
                own = np.array(own)[row]
                held.append(np.stack([anchor, stretch, ids[own], marks[own], (first + offset[row]) * 128 + count]))
                size += len(row)
                if size >= BATCH:
                    yield rest()
                    held, size = [], 0
        if held:
            yield rest()

    return rows.mapInPandas(run, "part long, data binary")


def meetings(bundles: DataFrame) -> DataFrame:
    """(a, id, mark, at, kind) of ``met``, from all bundles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        names = ("a", "id", "mark", "at", "kind")
        for f in frames:
            for part, data in zip(f["part"], f["data"]):
                if part != last and size >= 40 * BATCH:
                    yield pd.DataFrame(dict(zip(names, met(unbundled(held), MOST))))
                    held, size = [], 0
                held.append(data)
                size, last = size + len(data), part
        if held:
            yield pd.DataFrame(dict(zip(names, met(unbundled(held), MOST))))

    return bundles.repartition("part").sortWithinPartitions("part").mapInPandas(run, "a long, id long, mark long, at long, kind long")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (bytes; 0 ends a segment) by ``WINDOW`` symbols at least, by ranks of ever longer prefixes; equal ones in any order.

    What lies beyond the end of a segment may decide between suffixes that are shorter than a window.
    """
    n = len(text)
    wide = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)[:n]
    key, step = np.ascontiguousarray(wide).view(">u8").reshape(-1).astype(np.uint64), 8
    bits = n.bit_length()  # of a rank and of its successor; a key takes as many ranks as fit
    while True:
        order = np.argsort(key)
        own = key[order]
        rank = np.empty(n, np.uint64)
        rank[order[0]] = 1
        rank[order[1:]] = np.cumsum(own[1:] != own[:-1]) + 1
        if step >= WINDOW or rank[order[-1]] == n:
            return order
        key = rank
        for k in range(1, 64 // bits):
            key = key << np.uint64(bits)
            key[: max(0, n - k * step)] |= rank[k * step :]
        step *= 64 // bits


def transform(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, last-to-first map, suffix order) of segments laid end to end, each with an end.

    The transform has the two symbols before a suffix as one number (a byte b is b + 1, which UTF-8 keeps below 256), and 0
    where the segment has fewer than two; the map leads to the suffix that begins with them.
    """
    text = np.frombuffer(b"".join(bytes(s).translate(_UP) + b"\0" for s in segments), np.uint8)
    order = suffix_order(text)
    rank = np.empty(len(text), np.int32)
    rank[order] = np.arange(len(text), dtype=np.int32)
    two, one = order - 2, order - 1  # before the first symbol stands the last segment's end
    symbols = np.where((text[two] > 0) & (text[one] > 0), text[two].astype(np.uint16) << 8 | text[one], 0).astype(np.uint16)
    return symbols, rank[two], order


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, interval of each, common): the repeated intervals of ``window`` symbols (an even number) over all shards.

    Members are places in the transforms laid end to end; ``lengths`` are those of the segments. The interleave of the
    transforms begins in their order, with the suffixes that stand at the end of a window; each round sorts it stably by the
    transform's symbols and follows the map, so that after h rounds it is in order of 2 h symbols. An interval that is down
    to one member is settled and leaves; ``common`` has the symbols that a suffix had in common with another before that.
    """
    sizes = np.cumsum([0, *(len(s) for s, _, _ in shards)])
    symbols = np.concatenate([s for s, _, _ in shards])
    to_first = np.concatenate([f + b for (_, f, _), b in zip(shards, sizes)])
    common = np.zeros(len(symbols), np.int16)
    place = np.concatenate([o + b for (_, _, o), b in zip(shards, sizes)])
    at_end = np.concatenate([np.arange(n + 1) >= window for n in lengths]) if len(lengths) else np.zeros(0, bool)
    now = np.nonzero(at_end[place])[0]
    group = np.zeros(len(now), np.int32)
    for h in range(window // 2):
        c = symbols.take(now)
        order = np.argsort(c, kind="stable")
        c, now, group = c.take(order), to_first.take(now.take(order)), group.take(order)
        new = np.ones(len(now) + 1, bool)
        np.not_equal(c[1:], c[:-1], out=new[1:-1])
        new[1:-1] |= group[1:] != group[:-1]
        alone = new[:-1] & new[1:]
        group = np.cumsum(new[:-1], dtype=np.int32)
        if alone.any():
            stay = np.nonzero(~alone)[0]
            now, group = now.take(stay), group.take(stay)
        common[now] = 2 * h + 2
        if not len(now):
            break
    return now, group, common


def repeated(segments: pd.DataFrame) -> pd.DataFrame:
    """(id, mark, at): the windows that an earlier segment has too, of segments (id, mark, at, data) of a bucket, whose first owners are (id, mark, at).

    Rows without data are known to repeat.
    """
    known, segments = segments.loc[segments["data"].isna(), ["id", "mark", "at"]], segments[segments["data"].notna()]
    if not len(segments):
        return known
    data = segments["data"].tolist()
    lengths = np.fromiter(map(len, data), np.int64, len(data)) + 1
    cuts = np.nonzero(np.diff(np.cumsum(lengths) // SHARD, prepend=-1))[0]
    shards = [transform(data[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)])]
    now, interval, _ = merge(shards, lengths - 1)
    # suffix orders are within shards; all segments lie end to end
    begin = np.cumsum(lengths) - lengths
    place = np.concatenate([o + b for (_, _, o), b in zip(shards, begin[cuts])])[now]
    segment = np.searchsorted(begin, place, side="right") - 1
    ids, marks, first = (segments[c].to_numpy(np.int64) for c in ("id", "mark", "at"))
    at = (first[segment] >> 7) + place - begin[segment]
    order = np.lexsort((at, marks[segment], ids[segment], interval))
    later = np.nonzero(np.diff(interval[order], prepend=-1) == 0)[0]
    keep = order[later]
    return pd.concat([runs(pd.DataFrame({"id": ids[segment[keep]], "mark": marks[segment[keep]], "at": at[keep]})), known])


def runs(found: pd.DataFrame) -> pd.DataFrame:
    """(id, mark, at): neighbouring windows (at: starts) as stretches (at = 128 * first + windows, 127 at most)."""
    found = found.drop_duplicates().sort_values(["id", "mark", "at"])
    i, m, at = (found[c].to_numpy(np.int64) for c in ("id", "mark", "at"))
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    run = np.cumsum(new)
    inside = np.arange(len(at)) - np.nonzero(new)[0][run - 1] if len(at) else at
    cut = np.nonzero(new | (inside % 127 == 0))[0]
    return pd.DataFrame({"id": i[cut], "mark": m[cut], "at": at[cut] * 128 + np.diff(np.append(cut, len(at)))})


def pressed(rows: DataFrame) -> DataFrame:
    """(id, mark, text) with the text as zstandard-compressed bytes, for the shuffles that move whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for f in frames:
            yield f.assign(text=[pack.compress(t.encode("utf-8", "surrogatepass")) for t in f["text"]])

    return rows.mapInPandas(run, "id long, mark long, text binary")


def cut_out(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, id, mark, at, data): the bytes of ``wanted`` (a, id, mark, at), each window by itself, with its own hash, where ``a`` is negative.

    Single windows that a window before them in the same batch equals repeat; they come without data.
    """
    lists = wanted.groupBy("id", "mark").agg(F.collect_list("a").alias("a"), F.collect_list("at").alias("at"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack, held, data = zstandard.ZstdDecompressor(), [], []

        def rest() -> pd.DataFrame:
            a, i, m, at = (np.concatenate(x) for x in zip(*held))
            made = pd.DataFrame({"a": a, "id": i, "mark": m, "at": at, "data": data})
            if not len(single := np.nonzero(a < 0)[0]):
                return made
            a[single] = np.fromiter((xxhash.xxh64_intdigest(data[k]) for k in single.tolist()), np.uint64, len(single)).view(np.int64)
            order = single[np.lexsort((at[single], m[single], i[single], a[single]))]
            near = np.nonzero(a[order[1:]] == a[order[:-1]])[0]
            later = np.array([q for p, q in zip(order[near].tolist(), order[near + 1].tolist()) if data[p] == data[q]], np.int64)
            again = runs(pd.DataFrame({"id": i[later], "mark": m[later], "at": at[later] >> 7}))
            return pd.concat([made.assign(a=a).drop(index=later), again.assign(a=again["id"] + again["at"], data=None)])[["a", "id", "mark", "at", "data"]]

        for f in frames:
            for i, m, packed, a, at in zip(f["id"], f["mark"], f["text"], f["a"], f["at"]):
                text, first, count = unpack.decompress(packed), at >> 7, at & 127
                if (a < 0).any():
                    times = np.where(a < 0, count, 1)
                    which = np.repeat(np.arange(len(a)), times)
                    first = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    a, count = a[which], np.where(a < 0, 1, count)[which]
                    at = first * 128 + count
                data += [text[b:e] for b, e in zip(first.tolist(), (first + count + WINDOW - 1).tolist())]
                held.append((a, np.full(len(at), i), np.full(len(at), m), at))
                if len(data) > 50_000:
                    yield rest()
                    held, data = [], []
        if held:
            yield rest()

    return pressed(rows).join(lists, ["id", "mark"]).mapInPandas(run, "a long, id long, mark long, at long, data binary")


def repeats(rows: DataFrame) -> DataFrame:
    """(id, mark, at): stretches of windows (at = 128 * first + windows) that have an earlier equal one; written."""
    kept = written(meetings(find_anchors(rows)), "anchors")
    crowded, windows = F.col("kind") == HOT, F.col("at").bitwiseAND(127)
    firsts = kept.where(F.col("kind") != LATER)
    total = firsts.agg(F.sum(F.when(crowded, windows * (WINDOW + 1)).otherwise(windows + WINDOW))).first()[0] or 0
    segments = cut_out(rows, firsts.select(F.when(crowded, -1).otherwise(F.col("a")).alias("a"), "id", "mark", "at"))
    bucket = F.pmod(F.xxhash64("a"), F.lit(max(1, -(-total // BUCKET))))
    merged = segments.withColumn("bucket", bucket).drop("a").groupBy("bucket").applyInPandas(repeated, "id long, mark long, at long")
    out = written(merged.unionByName(kept.where(F.col("kind") == LATER).select("id", "mark", "at")), "repeats")
    drop(kept)
    return out


def removed(text: bytes, at: np.ndarray) -> np.ndarray:
    """Mask of the bytes under windows that start at the stretches ``at``."""
    first, count = at >> 7, at & 127
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + WINDOW - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def spans(docs: DataFrame, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text]) per row of ``docs``; text without the removed bytes."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * keep_text
    schema = "id long, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            out = []
            for packed, ats in zip(f["text"], f["ats"]):
                text = unpack.decompress(packed)
                gone = removed(text, np.array(ats, np.int64)) if ats is not None and len(ats) else np.zeros(len(text), bool)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                number = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), number, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * keep_text))
            made = pd.DataFrame(out, columns=names)
            yield pd.concat([f[["id", "mark"]].reset_index(drop=True), made], axis=1)

    rows, once = located(docs, id_col, text_col)
    found = repeats(once).groupBy("id", "mark").agg(F.collect_list("at").alias("ats"))
    made = pressed(rows).join(found, ["id", "mark"], "left").mapInPandas(run, schema)
    return made.select(F.when((F.col("id") < LAST) | (F.col("mark") < 0), F.col("id")).alias("doc_id"), *names)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut out of the text; rows with nothing but white space left go.

    Characters that a cut divides are left out too. Other columns are unchanged, and travel with their row's text.
    """
    others = [c for c in docs.columns if c != text_col]
    rows, once = located(docs.withColumn("_rest", F.struct(*others)), id_col, text_col, "_rest")
    found = repeats(once).groupBy("id", "mark").agg(F.collect_list("at").alias("ats"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, ats in zip(texts, lists):
            if ats is not None and len(ats):
                data = t.encode("utf-8", "surrogatepass")
                t = np.frombuffer(data, np.uint8)[~removed(data, np.array(ats, np.int64))].tobytes().decode("utf-8", "ignore")
            out.append(t if t.strip() else None)
        return pd.Series(out, dtype=object)

    # the filter below would else be pushed through, and cut every text twice
    without = without.asNondeterministic()
    made = rows.join(found, ["id", "mark"], "left").select("_rest", without("text", "ats").alias("left")).where(F.col("left").isNotNull())
    return made.select(*[F.col("left").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])
