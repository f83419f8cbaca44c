"""SimHash near-duplicates by Golay-code fuzzy hashing.

Every text becomes a 64-bit fingerprint: a bit is 1 where it is set in over half of the XXH64 hashes of its word
shingles. Fingerprints at most ``RADIUS`` = 3 bits apart are linked, links are closed to components.

A fingerprint is cut into three segments, each padded to a word of the perfect (23, 12) Golay code. Decoding a word,
and each word one flip away from it, gives at most six codeword indices; two segments that differ in one bit at most
share the index of either among the six of the other. Three errors over three segments leave two cases:

* some segment is equal and another has one error at most: key = (equal segment, index of the other), for six ordered
  pairs of segments;
* one error in each segment: key = the three indices.

One side of the join carries the several indices and the other the single one, and for the last case the several
indices are shared between the sides, so that a fingerprint has 84 keys of 35 or 36 bits. Candidates that share a key
are verified on the 64 bits.

Equal fingerprints are collapsed before keys are made, so a group of copies is one row whatever its size. A key
with many different fingerprints is split: its rows are dealt by the position of the left fingerprint, by the join's
skew handling, and only pairs within 3 bits leave the join.

``similar_documents`` links by similarity of shingle sets instead. At a similarity of 0.8 two fingerprints differ in
about ten bits, which no pigeonhole on three segments reaches, so the fuzzy keys are joined there by min-wise band keys,
and every candidate is verified by the exact similarity of the sets.

Nulls: a null text has no words, so its fingerprint is zero, as for empty texts; rows with equal ids are kept as
they are; a null id is kept, never the smallest of its component unless all ids of it are null. Columns other than
the id and the text are ignored, whatever their names. Texts of any length are read as a whole. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, pressed, written

RADIUS = 3
#: Bits of the three segments of a fingerprint, lowest first.
SEGMENTS = (22, 21, 21)
#: Band keys of a text and min-wise hashes of each: all but 0.3 % of pairs of similarity 0.8 share a key.
BANDS, ROWS = 18, 6
#: Members of a key that all others are held against first: all of them up to FEW, else the MOST_SHARED that share most.
FEW, MOST_SHARED = 8, 3
#: Nodes and shingles of a block of a key whose nodes are compared block against block, and shingles at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 19, 4096
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. A fixed value.
GENERATOR = 0b101011100011


def text_fingerprint(text: str | None, width: int, seed: int) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles of a text, repeats included."""
    if text is None:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) < width:
        return digest(b" ".join(tokens), seed)
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - width + 1].tolist()
    hashes = np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = np.fromiter((text_fingerprint(t, width, seed) for t in f["text"]), np.uint64, len(f))
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fps.view(np.int64)})

    # ids travel as decimal text: nulls among numbers would make them floating-point in Python
    made = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id string, fp long")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def _errors() -> np.ndarray:
    """Error pattern of weight 3 at most for each of the 2048 syndromes."""
    ones = [1 << i for i in range(23)]
    patterns = [0, *ones]
    patterns += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    patterns += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    words = np.array(patterns, np.int64)
    table = np.empty(2048, np.int64)
    table[_syndrome(words)] = words
    return table


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the word by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


_ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_syndrome(words)]) >> 11


def near_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of the words within one flip of each word, and which of them count (the rest repeat)."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    found = np.sort(decode((words[:, None] ^ flips[None, :]).reshape(-1)).reshape(len(words), -1), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rank = np.where(first, np.cumsum(first, axis=1) - 1, 6)
    out = np.zeros((len(words), 7), np.int64)
    np.put_along_axis(out, rank, found, axis=1)
    return out[:, :6], np.arange(6)[None, :] < first.sum(1)[:, None]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the fingerprint, key, side) of every key of the fingerprints; side 0 joins side 1."""
    n, words, at = len(fps), [], 0
    for bits in SEGMENTS:
        words.append(((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    index = [decode(w) for w in words]
    near = [near_indices(w, b) for w, b in zip(words, SEGMENTS)]
    rows, out, sides = [], [], []

    def emit(key: np.ndarray, used: np.ndarray, side: int) -> None:
        where = np.nonzero(used)
        rows.append(where[0])
        out.append(key[where])
        sides.append(np.full(len(where[0]), side, np.int8))

    always, tag = np.ones((n, 1), bool), 0
    for i in range(3):
        for j in range(3):
            if i != j:
                base = (np.int64(tag) << 40) | (words[i] << 12)
                emit(base[:, None] | near[j][0], near[j][1], 0)
                emit((base | index[j])[:, None], always, 1)
                tag += 1
    base = np.int64(tag) << 40
    emit(base | (near[0][0] << 24) | ((index[1] << 12) | index[2])[:, None], near[0][1], 0)
    wide = (near[1][0][:, :, None] << 12) | near[2][0][:, None, :]
    emit((base | (index[0] << 24)[:, None, None] | wide).reshape(n, 36), (near[1][1][:, :, None] & near[2][1][:, None, :]).reshape(n, 36), 1)
    return np.concatenate(rows), np.concatenate(out), np.concatenate(sides)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the input: neither is broadcast, so neither passes through the driver, however small it is thought to be."""
    return left.join(right.hint("merge"), on, how)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v), u < v: the pairs of different fingerprints of ``distinct`` (column fp) at most 3 bits apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 4096):
                part = f["fp"].to_numpy(np.int64)[at : at + 4096]
                row, key, side = keys(part.view(np.uint64))
                yield pd.DataFrame({"key": key, "side": side, "fp": part[row]})

    keyed = distinct.select("fp").mapInPandas(run, "key long, side byte, fp long")
    left = keyed.where("side = 0").select("key", F.col("fp").alias("u"))
    right = keyed.where("side = 1").select("key", F.col("fp").alias("v"))
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    return met(left, right, "key").where(close).select("u", "v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches, by alternating large and small stars.

    Every round is two joins with a per-node minimum and is written to the shared folder.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = met(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before = now
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        drop(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest id that its links reach."""
    marked = written(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(classes))
    roots = met(classes, joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = met(roots, smallest, "root").select("fp", "component_id")
    return met(marked, named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct 64-bit hashes of the ``width``-word shingles of a text, ascending; none for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return np.array([digest(b" ".join(tokens), seed)] if tokens else [], np.uint64)
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - width + 1].tolist()
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


_FACTORS = _factors()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes; sets of similarity s share each with probability s ** ROWS."""
    factor, shift = _FACTORS
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = (hashes[at : at + 4096, None] ^ shift[None, :]) * factor[None, :]
        np.minimum(least, part.min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ (least[r::ROWS] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, node, size, members): the band keys of ``classes`` (node, size, bands) that more than one node has; written."""
    keyed = classes.select("node", "size", F.explode("bands").alias("key")).distinct()
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "keys")
    shared = written(met(keyed, sizes, "key"), "shared")
    drop(sizes)
    return shared


def possible(u: str, v: str, similarity: float) -> Column:
    """Whether sets of these sizes (columns) can have the similarity at all."""
    return F.least(u, v) >= F.lit(similarity) * F.greatest(u, v)


def band_candidates(shared: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of nodes of ``shared`` keys, in number proportional to the nodes.

    Of a key with many nodes, each is paired with those whose keys have most nodes in all: the common origin of near
    copies has the most frequent key in every band. What that leaves apart, ``rest_links`` compares.
    """
    score = shared.groupBy("node").agg(F.sum("members").alias("score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))
    first = met(shared, score, "node").withColumn("rank", rank).where(F.col("rank") <= FEW)
    first = first.where((F.col("members") <= FEW) | (F.col("rank") <= MOST_SHARED)).select("key", F.col("node").alias("v"), F.col("size").alias("size_v"))
    pairs = met(shared.select("key", F.col("node").alias("u"), F.col("size").alias("size_u")), first, "key").where((F.col("u") != F.col("v")) & possible("size_u", "size_v", similarity))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """(len(one), len(two)) numbers of common values of the sets of either list."""

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = [np.unique(x) for x in sets]
        return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)

    (row, x), (column, y) = flat(one), flat(two)
    values = np.intersect1d(x, y)
    sides = []
    for at, v in ((row, x), (column, y)):
        place = np.searchsorted(values, v)
        known = place < len(values)
        known[known] = values[place[known]] == v[known]
        order = np.argsort(place[known], kind="stable")
        sides.append((at[known][order], place[known][order]))
    out = np.zeros((len(one), len(two)), np.float64)
    for start in range(0, len(values), COLUMNS):
        parts = []
        for (at, place), n in zip(sides, out.shape):
            low, high = np.searchsorted(place, [start, start + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(values) - start)), np.float32)
            part[at[low:high], place[low:high] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of ``linked`` that join the same rows and columns as all its pairs, fewer than its rows and columns."""
    new_row, new_column, out = linked.any(1), linked.any(0), []
    for start in range(len(linked)):
        rows = np.array([start]) if new_row[start] else np.array([], int)
        new_row[start] = False
        while len(rows):
            columns = np.nonzero(linked[rows].any(0) & new_column)[0]
            new_column[columns] = False
            out += zip(rows[linked[np.ix_(rows, columns)].argmax(0)].tolist() if len(columns) else [], columns.tolist())
            rows = np.nonzero(linked[:, columns].any(1) & new_row)[0]
            new_row[rows] = False
            out += zip(rows.tolist(), columns[linked[np.ix_(rows, columns)].argmax(1)].tolist() if len(rows) else [])
    return out


def rest_links(shared: DataFrame, joined: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the roots of ``joined`` (node, root) that its keys with over FEW nodes still hold.

    Pairs within a component need no comparison. Of a key, every node outside its largest component is held against all
    its nodes: both sides are dealt to blocks by a hash, bounded in nodes and in shingles, and every block meets every
    block of the other side in a group of its own, which yields only as many links as join its nodes.
    """
    big = shared.where(F.col("members") > FEW)
    named = met(big, joined.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    per = named.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    last = F.max(F.struct("n", "s", "root")).alias("main")
    open_keys = per.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("s").alias("s"), last).where("roots > 1")
    blocks = lambda n, s: F.ceil(F.greatest(n / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES), F.lit(1.0))).cast("int")
    open_keys = open_keys.select(
        "key", F.col("main.root").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("lefts"), blocks(F.col("n"), F.col("s")).alias("rights")
    )
    members = written(met(named, open_keys, "key"), "open")
    drop(named)
    if members.isEmpty():
        return members.select(F.col("root").alias("u"), F.col("root").alias("v"))
    whole = met(members, sets, "node").withColumn("at", F.xxhash64("node", "key"))
    dealt = lambda parts: F.pmod("at", F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = whole.where("root <> main").select("key", dealt("lefts").alias("i"), every("rights").alias("j"), F.col("root").alias("u"), F.col("hashes").alias("one"))
    right = whole.select(F.col("key").alias("key_2"), every("lefts").alias("i_2"), dealt("rights").alias("j_2"), F.col("root").alias("v"), F.col("hashes").alias("two"))

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        a, b = one["u"].to_numpy(np.int64), two["v"].to_numpy(np.int64)
        both = common(list(one["one"]), list(two["two"]))
        total = one["one"].map(len).to_numpy()[:, None] + two["two"].map(len).to_numpy()[None, :]
        pairs = forest((both >= similarity * (total - both)) & (a[:, None] != b[None, :]))
        return pd.DataFrame({"u": a[[p[0] for p in pairs]] if pairs else a[:0], "v": b[[p[1] for p in pairs]] if pairs else b[:0]})

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key_2", "i_2", "j_2")).applyInPandas(compare, "u long, v long").distinct()


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of the id and the whole text of a row; a null text counts as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(" "), F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, row, root): one row per input row; links are similarities of ``similarity`` or more of shingle sets.

    Equal sets are one node. All nodes that share a key are compared, but for those that other links join already; sets
    are those of 64-bit hashes, and links are exact on them. Texts without words are one group; ids as in
    ``near_duplicates``. ``row`` is the row's ``row_key``; ``root`` names the component where ids repeat or are null.

    Only keys and sizes are kept of every text. The sets are made again, from the whole texts, of nodes that have a candidate.
    """

    def marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                sets = [shingles(t if isinstance(t, str) else None, width, seed) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "row": part["row"],
                        "size": np.fromiter(map(len, sets), np.int32, len(part)),
                        "node": [xxhash.xxh64_intdigest(s.tobytes(), seed) - (1 << 63) for s in sets],
                        "fp": np.fromiter((text_fingerprint(t if isinstance(t, str) else None, width, seed) for t in part["text"]), np.uint64, len(part)).view(np.int64),
                        "bands": [band_keys(s) for s in sets],
                    }
                )

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                yield pd.DataFrame({"node": part["node"], "hashes": [shingles(unpack.decompress(t).decode("utf-8", "surrogatepass"), width, seed).view(np.int64) for t in part["text"]]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text.alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row"))
    marked = written(own.mapInPandas(marks, "doc_id string, row binary, size int, node long, fp long, bands array<long>").withColumn("doc_id", F.col("doc_id").cast("long")), "shingles")
    # rows of a node have equal sets, so that any of them will do
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("size", "bands")])
    nodes = written(nodes, "nodes")
    by_fp = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("n")).select("fp", F.col("n.node").alias("first"), F.col("n.size").alias("size")), "prints")
    named = by_fp.select(F.col("fp").alias("f"), "first", F.col("size").alias("s"))
    fuzzy = met(links(by_fp), named.withColumnsRenamed({"f": "u", "first": "a", "s": "size_a"}), "u")
    fuzzy = met(fuzzy, named.withColumnsRenamed({"f": "v", "first": "b", "s": "size_b"}), "v")
    fuzzy = fuzzy.where(possible("size_a", "size_b", similarity)).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    equal = met(nodes, named, nodes["fp"] == named["f"]).where((F.col("node") != F.col("first")) & possible("size", "s", similarity)).select(F.least("node", "first").alias("u"), F.greatest("node", "first").alias("v"))
    keyed = shared_keys(nodes.select("node", "size", "bands"))
    pairs = written(band_candidates(keyed, similarity).unionByName(fuzzy).unionByName(equal).distinct(), "candidates")
    drop(by_fp)
    # the rest of a large key needs the sets of all its nodes
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(keyed.where(F.col("members") > FEW).select("node")).distinct()
    wanted = written(met(nodes.select("node", "row"), wanted, "node", "left_semi"), "wanted")
    sets = met(own.select("row", pressed(F.col("text")).alias("text")), wanted, "row").select("node", "text").mapInPandas(again, "node long, hashes array<long>")
    if marked.groupBy("row").count().where("count > 1").limit(1).count():
        sets = sets.groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = written(sets, "sets")
    drop(wanted)
    both = met(met(pairs, sets.withColumnsRenamed({"node": "u", "hashes": "one"}), "u"), sets.withColumnsRenamed({"node": "v", "hashes": "two"}), "v")
    shared = F.size(F.array_intersect("one", "two"))
    found = written(both.where(shared >= F.lit(similarity) * (F.size("one") + F.size("two") - shared)).select("u", "v"), "links")
    drop(pairs)
    joined = components(found)
    more = written(rest_links(keyed, joined, sets, similarity), "rest")
    drop(found, keyed, sets)
    roots = met(nodes, joined.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    if not more.isEmpty():
        further = components(more).withColumnsRenamed({"node": "n", "root": "r"})
        roots = met(roots, further, F.col("root") == F.col("n"), "left").select("node", "least", F.coalesce("r", "root").alias("root"))
    roots = written(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    out = met(marked.select("doc_id", "row", "node"), met(roots, smallest, "root").select("node", "component_id", "root"), "node").select("doc_id", "component_id", "row", "root")
    out = written(out, "classes")
    drop(marked, nodes, more, roots)
    return out
