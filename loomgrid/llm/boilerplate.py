"""The main text of web pages: markup first, then what a host repeats on its pages.

Every page is cut into blocks (``html_blocks``). The words of the blocks that markup does not rule out are the page's token
stream. A host's streams are concatenated and their suffixes sorted: a suffix array, sorted to the depth of ``LENGTH`` tokens by
doubling, in which equal neighbours are one string. A string of that length found on at least ``SHARE`` of the host's
pages, and on ``LEAST_PAGES`` pages, is boilerplate; longer ones are covered by the strings in them. Covered words are
removed from all blocks of the page, and its unique runs stay. A page of which nothing would stay is a copy of others, not
what surrounds a text, and keeps its text.

A host's pages are dealt over shards of ``SHARD`` characters, so that a host with a third of all pages is many groups. A
string on a share of all pages is on that share of the pages of one shard at least, so a shard passes on only the strings that
reach the share in it. Where a host has one shard these counts are final. For other hosts the passed-on strings are counted again
in every page: pages meet their host's strings by a join, without moving pages together. Hosts of fewer than ``LEAST_PAGES`` pages
take no part in this. Strings are told apart by a 64-bit hash of their words' XXH64.

Of the blocks, those in articles are the main text, else those in the main part, else all.

Nulls: a null html is an empty page; a null url, or one without a host, has no host, and markup alone decides. Page ids may
be null or repeat; every row is a page, equal rows too, and repeated pages count as distinct. Empty tables give an empty result.
Pages of any length are read whole; a shard holds at least one page. Columns besides the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, written
from loomgrid.llm.html_blocks import blocks, chosen

#: Words of a repeated string (a power of two), the part of a host's pages and the number of pages that it is on.
LENGTH, SHARE, LEAST_PAGES = 8, 0.5, 4
#: Characters of html in a shard of a host.
SHARD = 8_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


class Hashes(dict):
    """XXH64 of words, each made once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray) -> np.ndarray:
    """A hash, as a long, of the ``LENGTH`` words from each place at which so many are left."""
    n = len(hashes) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LENGTH):
            out = out * MIX + hashes[k : k + n]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def repeated(streams: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pages): of each string of ``LENGTH`` tokens on at least ``least`` of the streams, its first place in the concatenation and its number of streams.

    The suffix array of the concatenated streams: ranks by one token are doubled until they are ranks by ``LENGTH``, and
    sorted. Suffixes that reach over the end of their stream are left out.
    """
    text = np.concatenate(streams)
    lengths = np.array([len(s) for s in streams])
    stream = np.repeat(np.arange(len(streams)), lengths)
    whole = np.arange(len(text)) + LENGTH <= np.repeat(np.cumsum(lengths), lengths)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < LENGTH:
        after = np.zeros_like(rank)
        after[:-depth] = rank[depth:] + 1
        rank = np.unique(rank * (len(text) + 1) + after, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    array = np.flatnonzero(whole)
    array = array[np.argsort(rank[array], kind="stable")]
    new = np.r_[True, np.diff(rank[array]) != 0]
    # equal strings stand in the order of the text, so each stream's are together
    first_of_stream = new | np.r_[True, np.diff(stream[array]) != 0]
    begins = np.flatnonzero(new)
    pages = np.add.reduceat(first_of_stream.astype(np.int64), begins)
    found = pages >= least
    return array[begins[found]], pages[found]


def needed(pages: int, share: float = SHARE, least: int = 1) -> int:
    return max(least, -int(-share * pages // 1))


def stream_of(html: str | None) -> list[str]:
    return [w for _, text in blocks(html or "") for w in text.split(" ")]


def dealt(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """Pages as (host, shard, html), and (host, pages, shards) of the hosts that can have boilerplate."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null")
    size = F.coalesce(F.length("html"), F.lit(0))
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum(size).alias("chars")).where(F.col("pages") >= LEAST_PAGES)
    hosts = written(hosts.select("host", "pages", F.ceil((F.col("chars") + 1) / F.lit(SHARD)).alias("shards")), "hosts")
    rows = rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    return rows.join(hosts, "host").select("host", F.pmod("row", F.col("shards")).alias("shard"), "html", "pages", "shards"), hosts


def boilerplate(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, strings): hashes of the strings that are boilerplate on a host, written; hosts without any are absent."""
    rows, hosts = dealt(pages, url_col, html_col)

    @F.pandas_udf("binary")
    def packed(html: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        return pd.Series([pack.compress(" ".join(stream_of(h)).encode("utf-8", "surrogatepass")) for h in html], dtype=object)

    def of_shard(group: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack, known = zstandard.ZstdDecompressor(), Hashes()
        streams = [known.of(unpack.decompress(p).decode("utf-8", "surrogatepass").split()) for p in group["stream"]]
        final = int(group["shards"].iloc[0]) == 1
        places, n = repeated(streams, needed(len(group), SHARE, LEAST_PAGES if final else 1))
        text = np.concatenate(streams)
        strings = [windows(text[p : p + LENGTH])[0] for p in places]
        return pd.DataFrame({"host": group["host"].iloc[0], "string": np.array(strings, np.int64), "n": n, "final": final})

    streams = rows.select("host", "shard", "shards", packed("html").alias("stream"))
    found = streams.groupBy("host", "shard").applyInPandas(of_shard, "host string, string long, n long, final boolean")
    found = written(found, "strings")
    done = found.where("final").select("host", "string")
    open_ = found.where("not final").groupBy("host").agg(F.collect_set("string").alias("strings"))
    again = rows.where("shards > 1").select("host", "html").join(open_, "host")

    def on_page(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for f in frames:
            hits = [np.intersect1d(windows(known.of(stream_of(h))), s) for h, s in zip(f["html"], f["strings"])]
            yield pd.DataFrame({"host": np.repeat(f["host"].to_numpy(object), [len(h) for h in hits]), "string": np.concatenate([np.zeros(0, np.int64), *hits])})

    counted = again.select("host", "html", "strings").mapInPandas(on_page, "host string, string long").groupBy("host", "string").agg(F.count("*").alias("n"))
    enough = counted.join(hosts, "host").where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.ceil(F.col("pages") * F.lit(SHARE)))).select("host", "string")
    out = written(done.unionByName(enough).groupBy("host").agg(F.collect_set("string").alias("strings")), "boilerplate")
    drop(found, hosts)
    return out


def main_text(html: str | None, strings: np.ndarray | None, known: Hashes) -> tuple[str, int]:
    """The main text of a page, and how many of its words are covered by boilerplate strings."""
    found = blocks(html or "")
    where = chosen(found)
    plain = "\n\n".join(text for w, text in found if w == where)
    if strings is None or not len(strings):
        return plain, 0
    tokens = [text.split(" ") for _, text in found]
    hits = np.isin(windows(known.of([w for t in tokens for w in t])), strings)
    if not hits.any():
        return plain, 0
    covered = np.zeros(len(hits) + LENGTH - 1, bool)
    for k in range(LENGTH):
        covered[k : k + len(hits)] |= hits
    out, at = [], 0
    for (w, _), t in zip(found, tokens):
        kept = [x for x, c in zip(t, covered[at : at + len(t)]) if not c]
        at += len(t)
        if w == where and kept:
            out.append(" ".join(kept))
    return "\n\n".join(out) or plain, int(covered.sum())


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_covered): the main text of every page; n_covered counts the words that the host repeats."""
    strings = boilerplate(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(strings, "host", "left").select("page_id", "url", "html", "strings")
    kind = dict(rows.dtypes)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for f in frames:
            made = [main_text(h, s, known) for h, s in zip(f["html"], f["strings"])]
            yield f[["page_id", "url"]].assign(text=[t for t, _ in made], n_chars=[len(t) for t, _ in made], n_covered=[c for _, c in made])

    text = rows.select(F.col("page_id").cast("string"), "url", "html", "strings").mapInPandas(read, "page_id string, url string, text string, n_chars long, n_covered long")
    return text.select(F.col("page_id").cast(kind["page_id"]), "url", "text", "n_chars", "n_covered")
