"""Language-model scoring by subword lattice likelihood.

The pieces of a public vocabulary, weighted by its own scores, span every segmentation of a text; its probability is
the sum over all of them, by a forward recursion in log space. A piece has the weight exp(score / temperature): the
file's scores are negated ranks, so a temperature is needed to make weights of them: the likeliest for all training words,
by their likelihood under each of ``TEMPERATURES`` and a parabola through the best.
Pieces that are one character or longer share ``1 - BYTES`` of the weight, and the 256 bytes the rest; a character can
always be spelled in bytes. A text is a stream of pieces with an end, whose share is that of the ends among
the training tokens. No piece crosses white space, so the lattice of a document is the chain of those of its words.

A temperature that is given leaves it at that. Otherwise the weights are the start of ``ROUNDS`` rounds of expectation and
maximization over the lattices of all distinct training words, and ``PRIOR`` pieces drawn from them are added to the expected
counts. Every word counts once there, as the pieces have to spell the words that are new. The lattice of a
word then has one more arc: a training word can be passed as a whole, by its count less ``DISCOUNT``; what the discounts
leave is the share of the pieces.

Jobs: one pass encodes documents in blocks, each with a dictionary of its own words, so a word is shuffled once per
block and not once per token; lists and dictionaries are compressed. The temperature's likelihoods and the expected counts
are sums over the distinct words. Word counts are an aggregate over all training documents; lattices are summed once per distinct word and
joined back to the dictionaries' words. Documents meet their block's dictionary in a co-group, both bounded by
``BLOCK_WORDS``. Only sums pass through the driver.

Nulls: a null text is an empty one: its end alone. Without training documents the temperature is ``NEUTRAL``,
counts are 0 and base scores null, for there is no distribution. Null ids, repeated rows and other columns do no harm; texts
may be of any length. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import written

#: Distinct words and tokens after which a block of documents ends.
BLOCK_WORDS, BLOCK_TOKENS = 300_000, 4_000_000
#: Temperatures whose likelihoods are compared, the one without training documents, the weight of all bytes together.
TEMPERATURES, NEUTRAL, BYTES = (500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0), 4000.0, 0.01
#: Rounds over the distinct words, pieces of the vocabulary's own weights added in each, what a word's count is less as an arc.
ROUNDS, PRIOR, DISCOUNT = 2, 1000.0, 0.75
#: Parts of an expected count of one, so that sums of them are exact.
UNIT = 1 << 20
MARK = "▁"
#: Characters of a word whose pieces are looked up at a time.
WINDOW = 4096
_P = np.uint64(0x100000001B3)
_vocabularies: dict = {}


class Vocabulary:
    """Pieces by hash, with the file's scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and MARK not in sp.id_to_piece(i)[1:]]
        self.pieces = [sp.id_to_piece(i) for i in plain]
        self.scores = np.array([sp.get_score(i) for i in plain])
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        #: which slots of the hashes have a piece; most strings that are none fall into empty ones
        self.slots = np.zeros(1 << 20, bool)
        self.slots[self._slot(self.hashes)] = True
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces have one hash")

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def weights(self, temperature: float, end: float) -> np.ndarray:
        """Log weights of the pieces, then of all 256 bytes together; the end has the weight ``end``."""
        scaled = self.scores / temperature
        return np.append(scaled - _logsum(scaled) + math.log(1 - BYTES), math.log(BYTES)) + math.log(1 - end)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 where there is none."""
        out = np.full(h.shape, -1, np.int32)
        maybe = np.nonzero(self.slots[self._slot(h)])
        own = h[maybe]
        at = np.searchsorted(self.hashes, own).clip(max=len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == own, self.ids[at], -1)
        return out

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces that end at each place, by length; bytes of each character) for words of equal length.

        Shapes (L, K, n) and (L, n): entry [j, k] is the piece of k + 1 characters that ends with character j.
        """
        return self.of_codes(np.stack([codes(MARK + w) for w in words], axis=1))

    def of_codes(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``lattice`` of code points (L, n)."""
        size, n = code.shape
        reach = min(self.longest, size)
        out = np.full((size, reach, n), -1, np.int32)
        h = np.zeros((size, n), np.uint64)
        for k in range(reach):
            h = h[: size - k] * _P + (code[k:] + 1).astype(np.uint64)
            out[k:, k] = self.find(h)
        return out, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def edges(found: np.ndarray, size: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log weights (L, K, n) of the edges; a character can always be spelled in bytes."""
    own = np.append(logp[:-1], -np.inf)[found]
    own[:, 0] = np.logaddexp(own[:, 0], size * (logp[-1] - math.log(256)))
    return own


def forward(weights: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Log sums at every place, after those of the places ``before`` (the start alone, if none are given)."""
    size, reach, n = weights.shape
    before = np.zeros((1, n)) if before is None else before
    a = np.concatenate([before, np.zeros((size, n))])
    for j in range(len(before), len(a)):
        k = min(j, reach)
        a[j] = _logsum(a[j - k : j][::-1] + weights[j - len(before), :k])
    return a


def backward(weights: np.ndarray) -> np.ndarray:
    """Log sums from every place to the end."""
    size, reach, n = weights.shape
    b = np.zeros((size + 1, n))
    for j in range(size - 1, -1, -1):
        k = np.arange(min(reach, size - j))
        b[j] = _logsum(weights[j + k, k] + b[j + 1 + k])
    return b


def expected(vocab: Vocabulary, words: list[str], logp: np.ndarray) -> np.ndarray:
    """How often the segmentations of the words use each piece, and bytes, weighted by their probability. Words beyond ``WINDOW`` characters count in parts."""
    out, words = np.zeros(len(logp)), [w[at : at + WINDOW] for w in words for at in range(0, len(w), WINDOW)]
    for group in by_length(words):
        if not len(group):
            continue
        found, sizes = vocab.lattice([words[i] for i in group])
        weights = edges(found, sizes, logp)
        a, b = forward(weights), backward(weights)
        for k in range(found.shape[1]):
            piece = found[k:, k]
            used = np.exp(a[: len(piece)] + np.append(logp[:-1], -np.inf)[piece] + b[k + 1 :] - a[-1])
            out += np.bincount(piece[piece >= 0], used[piece >= 0], minlength=len(out))
        out[-1] += (np.exp(a[:-1] + sizes * (logp[-1] - math.log(256)) + b[1:] - a[-1]) * sizes).sum()
    return out


def long_word(vocab: Vocabulary, word: str, logps: list[np.ndarray]) -> list[float]:
    """Log probabilities of one word, ``WINDOW`` characters at a time: of what is behind only the longest piece's places are kept."""
    code, reach = codes(MARK + word)[:, None], vocab.longest
    held: list = [None] * len(logps)
    for at in range(0, len(code), WINDOW):
        low = max(0, at - reach + 1)
        found, sizes = (x[at - low :] for x in vocab.of_codes(code[low : at + WINDOW]))
        held = [forward(edges(found, sizes, logp), h)[-reach:] for logp, h in zip(logps, held)]
    return [float(h[-1, 0]) for h in held]


def by_length(words: list[str], cells: int = 300_000) -> Iterator[np.ndarray]:
    """Positions of words of equal length, in groups of bounded size."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1):
        step = max(1, cells // (17 * (int(sizes[group[0]]) + 1))) if len(group) else 1
        for at in range(0, len(group), step):
            yield group[at : at + step]


def pressed(numbers: np.ndarray) -> bytes:
    """Integers below 2^31 as compressed bytes, the low bytes of all first."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpressed(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def encoded(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (block, doc_id, training, n_words, pairs) and of their blocks' dictionaries (block, pairs, words).

    pairs: word numbers and counts of a document, or the block's training counts by word number. Ids are decimal text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {}
        counts: list[int] = []
        rows: list[tuple] = []
        tokens = 0

        def close() -> pd.DataFrame:
            words = zstandard.compress(b" ".join(known), 3)
            lead = (block, None, None, None, pressed(np.minimum(np.array(counts, np.int64), (1 << 31) - 1)), words)
            return pd.DataFrame([lead, *rows], columns=["block", "doc_id", "training", "n_words", "pairs", "words"]).astype({"training": "boolean", "n_words": "Int64"})

        for f in frames:
            for doc, text, train in zip(f["doc_id"], f["text"], f["training"]):
                own = Counter((text or "").encode("utf-8", "replace").lower().split()) if isinstance(text, str) else Counter()
                at = np.empty((2, len(own)), np.int64)
                for i, (w, n) in enumerate(own.items()):
                    k = known.setdefault(w, len(known))
                    if k == len(counts):
                        counts.append(0)
                    if train:
                        counts[k] += n
                    at[0, i], at[1, i] = k, n
                at = at[:, np.argsort(at[0])]
                size = own.total()
                rows.append((block, doc, bool(train), size, pressed(np.concatenate([np.diff(at[0], prepend=0), at[1]])), None))
                tokens += size + 1
                if len(known) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                    yield close()
                    block, tokens = block + 1, 0
                    known.clear(), counts.clear(), rows.clear()
        if rows:
            yield close()

    own = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), training.alias("training"))
    return own.mapInPandas(run, "block long, doc_id string, training boolean, n_words long, pairs binary, words binary")


def dictionary(words: bytes) -> list[str]:
    import zstandard

    return [w.decode("utf-8", "replace") for w in zstandard.decompress(words).split(b" ") if w]


def word_rows(blocks: DataFrame) -> DataFrame:
    """(block, k, word, n) of the blocks' dictionaries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, words, counts in zip(f["block"], f["words"], f["pairs"]):
                if not (own := dictionary(words)):
                    continue
                yield pd.DataFrame({"block": block, "k": np.arange(len(own), dtype=np.int32), "word": own, "n": unpressed(counts).astype(np.int64)})

    return blocks.where("words is not null").select("block", "words", "pairs").mapInPandas(run, "block long, k int, word string, n long")


def word_scores(vocab: Vocabulary, words: list[str], logps: list[np.ndarray]) -> np.ndarray:
    """(len(logps), len(words)): log probability of every word under each set of weights."""
    out = np.empty((len(logps), len(words)))
    for group in by_length(words):
        if len(group) and len(words[group[0]]) > WINDOW:
            for i in group:
                out[:, i] = long_word(vocab, words[i], logps)
            continue
        found, sizes = vocab.lattice([words[i] for i in group])
        for t, logp in enumerate(logps):
            out[t, group] = forward(edges(found, sizes, logp))[-1]
    return out


def best_temperature(counts: DataFrame, vocab_path: str, end: float) -> float:
    """The temperature with the greatest likelihood of all training words (word, n), between the compared ones by a parabola."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, total = vocabulary(vocab_path), np.zeros(len(TEMPERATURES))
        logps = [vocab.weights(t, end) for t in TEMPERATURES]
        for f in frames:
            total += word_scores(vocab, f["word"].tolist(), logps) @ f["n"].to_numpy()
        yield pd.DataFrame({"k": np.arange(len(total)), "likelihood": total})

    sums = counts.where("n > 0").select("word", "n").mapInPandas(run, "k int, likelihood double").groupBy("k").agg(F.array_sort(F.collect_list("likelihood")).alias("parts"))
    # in the order of their size: the same sum in every run
    y = np.array([math.fsum(r["parts"]) for r in sums.orderBy("k").collect()])
    k = int(np.clip(y.argmax(), 1, len(y) - 2))
    x = np.log(TEMPERATURES)
    a, b, c = np.polyfit(x[k - 1 : k + 2] - x[k], y[k - 1 : k + 2] - y[k], 2)
    return float(np.exp(x[k] + np.clip(-b / (2 * a), x[k - 1] - x[k], x[k + 1] - x[k]))) if a < 0 else TEMPERATURES[int(y.argmax())]


def learned(counts: DataFrame, vocab_path: str, temperature: float) -> np.ndarray:
    """Log weights of the pieces and of all bytes by the distinct training words of (word, n), from those at the temperature."""
    logp = vocabulary(vocab_path).weights(temperature, 0.0)
    prior = PRIOR * np.exp(logp)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, total = vocabulary(vocab_path), np.zeros(len(logp))
        for f in frames:
            total += expected(vocab, f["word"].tolist(), logp)
        k = np.nonzero(total)[0]
        yield pd.DataFrame({"k": k, "n": np.rint(total[k] * UNIT).astype(np.int64)})

    for _ in range(ROUNDS):
        found = counts.where("n > 0").select("word").mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        total = prior.copy()
        total[[r["k"] for r in found]] += np.array([r["n"] for r in found]) / UNIT
        with np.errstate(divide="ignore"):
            logp = np.log(total / total.sum())
    return logp


def scored(docs: DataFrame, training: Column, vocab_path: str, temperature: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of every whole text; scores are log10.

    training: which rows of ``docs`` counts, weights and the share of ends are learned from. temperature: the weights are those of the
    vocabulary's scores at it, and no word is an arc.
    """
    blocks = written(encoded(docs, training, id_col, text_col), "blocks")
    ends, tokens = blocks.where("training").agg(F.count("*"), F.sum("n_words")).first()
    total = (tokens or 0) + ends
    # with nothing learned, an end after 50 words; a corpus of empty texts alone leaves pieces some weight
    end = min(ends / total, 0.99) if total else 0.02
    rows = word_rows(blocks)
    counts = written(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")
    kinds = counts.where("n > 0").count() + (ends > 0)
    logp, whole = None, bool(tokens) and temperature is None
    if whole:
        logp = learned(counts, vocab_path, best_temperature(counts, vocab_path, end))
        spelled = math.log(DISCOUNT * (kinds - (ends > 0)) / total)
    base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))

    def lattices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(vocab_path)
        own = logp if whole else vocab.weights(temperature or NEUTRAL, end)
        for f in frames:
            p = word_scores(vocab, f["word"].tolist(), [own])[0]
            if whole:
                with np.errstate(divide="ignore"):
                    p = np.logaddexp(np.log((f["n"].to_numpy() - DISCOUNT).clip(0) / total), p + spelled)
            yield f.assign(logp=p)

    known = counts.mapInPandas(lattices, "word string, n long, logp double")
    numbers = rows.select("block", "k", "word").join(known, "word").select("block", "k", "n", "logp")

    def score(own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        n, p = np.zeros(len(words), np.int64), np.zeros(len(words))
        n[words["k"]], p[words["k"]] = words["n"], words["logp"]
        plain = base(n) if total else np.full(len(n), np.nan)
        out = []
        for pairs in own["pairs"]:
            k, times = unpressed(pairs).reshape(2, -1)
            k = np.cumsum(k)
            out.append((int(times[n[k] > 0].sum()) + (ends > 0), float(plain[k] @ times) + (float(base(ends)) if total else np.nan), (float(p[k] @ times) + math.log(end)) / math.log(10)))
        found = pd.DataFrame(out, columns=["n_known", "base_score", "score"])
        made = pd.DataFrame({"doc_id": own["doc_id"], "training": own["training"].astype(bool), "n_tokens": own["n_words"].astype("int64") + 1})
        return pd.concat([made.astype({"doc_id": object}).reset_index(drop=True), found], axis=1)

    texts = blocks.where("words is null").select("block", "doc_id", "training", "n_words", "pairs")
    made = texts.groupBy("block").cogroup(numbers.groupBy("block")).applyInPandas(score, "doc_id string, training boolean, n_tokens long, n_known long, base_score double, score double")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "training", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.nanvl("base_score", F.lit(None).cast("double")).alias("base_score"), "score")
