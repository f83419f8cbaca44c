"""Importance resampling towards a target: the corpus' documents whose n-grams are likelier in the target texts.

Features are the runs of 1 to ``n`` consecutive words, hashed by crc32 into ``buckets``. Features are exploded and counted
by bucket, over all corpus and all target texts; a bucket's gain is the scaled log of the ratio of its smoothed
probabilities, rounded down. The gains are one row for each bucket, whatever the corpus, so they are broadcast to the
exploded features of the corpus, which are summed by document: a document's features stand in one partition, so one partial
sum of each is shuffled. A document's weight is its mean gain, its score adds a Gumbel number made of its id, and the
highest scores are drawn, which is sampling without replacement by the weights.

Ranks come from one global range sort: a row's rank is the number of rows in the ranges before its own, and its place in its
range. Only the ranges' counts meet in one task. Rows with equal scores and ids are told apart by where they were read, so
no group of equal rows is one range. The sorted rows are written before they are counted, so that a lost task cannot move
a row to another range.

Everything is DataFrame expressions. Nulls: a null text has no features and a null id's Gumbel number is that of the empty
text; null ids come last among equal scores. A document without features weighs 0. Texts of any length are used whole,
repeated rows are documents of their own, columns besides id and text are ignored. An empty corpus gives an empty result; without
target texts every bucket's gain is that of t = T = 0.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import drop, written

#: What is no part of a word, after A-Z are lower-cased: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, SCALE, SEED = 10_000, 1000, 2024
#: Documents with fewer words are not drawn; percent of the others that are.
MIN_WORDS, PERCENT = 20, 10
#: Bits of a monotonically increasing id that count within a partition.
PLACE = 33


def words(text: Column) -> Column:
    """Array of the words of a text in lower case; empty for null."""
    cut = F.split(F.translate(text.cast("string"), UPPER, LOWER), GAP)
    return F.coalesce(F.array_remove(cut, ""), F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of 1 to ``n`` tokens, joined by one space."""
    slices = lambda k: F.filter(F.transform(tokens, lambda _, i: F.slice(tokens, i + 1, k)), lambda x: F.size(x) == k)
    return F.concat(tokens, *[F.transform(slices(k), lambda x: F.array_join(x, " ")) for k in range(2, n + 1)]) if n > 1 else tokens


def bucketed(tokens: DataFrame, n: int, buckets: int, *keep: str) -> DataFrame:
    """(keep..., bucket): a row for each feature of ``tokens``; a text without features has one with a null bucket."""
    features = tokens.select(*keep, F.explode_outer(ngrams(F.col("tokens"), n)).alias("feature"))
    return features.select(*keep, F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(corpus: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """(bucket, gain) of every bucket from two tables of ``tokens``, written: floor(scale * ln of the ratio of probabilities)."""
    count = lambda rows, name: bucketed(rows, n, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(corpus, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0)
    both = written(both, "counts")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    one = lambda c: F.col(c).cast("double") + 1.0
    ratio = one("t") * F.lit(float(total["s"] + buckets)) / (one("s") * F.lit(float(total["t"] + buckets)))
    return both.select("bucket", F.floor(F.lit(float(scale)) * F.log(ratio)).alias("gain"))


def gumbel(id_: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """floor(scale * a Gumbel number) from the first 8 hex digits of the sha256 of seed and id."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): the floored mean gain of each document's features; ``row`` tells rows apart."""
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("tokens"))
    table = gains(tokens, target.select(words(F.col(target_col)).alias("tokens")), n, buckets)
    features = bucketed(tokens.withColumn("n_words", F.size("tokens").cast("long")), n, buckets, "row", "doc_id", "n_words")
    met = features.join(F.broadcast(table), "bucket", "left")
    sums = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.expr("(total - pmod(total, n_features)) div n_features")
    return sums.select("row", "doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those that are not drawn.

    Drawn are the ``percent`` of the documents with at least ``min_words`` words (rounded down) with the highest scores, ties to the smaller id.
    """
    scored = weighed(docs, target, n, buckets, id_col, text_col, target_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= min_words).drop("n_words")
    scored = written(scored, "scores")
    order = (F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    line = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    line = written(line, "ranks")
    drop(scored)
    line = line.withColumn("range", F.shiftright("place", PLACE)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range: as many as shuffle partitions
    ranges = line.groupBy("range").agg(F.count("*").alias("n"), F.count_if("able").alias("of"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.expr(f"sum(of) over () * {int(percent)} div 100").alias("most"))
    rank = F.col("skip") + F.col("place") + 1
    out = line.join(F.broadcast(ranges), "range")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= F.col("most")), rank).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` with a drawn id, all columns, with ``rank``; ids are taken to be unique here."""
    ranks = resampled(docs, target, id_col=id_col, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn_id"), F.col("rank").alias("_drawn_rank"))
    rows = docs.select(F.struct(*docs.columns).alias("_drawn_row"), F.col(id_col).alias("_drawn_key"))
    met = rows.join(ranks, F.col("_drawn_key").eqNullSafe(F.col("_drawn_id")))
    return met.select(F.col("_drawn_row").alias("row"), F.col("_drawn_rank").alias("rank"))


def _crc_table() -> list[int]:
    """The 256 steps of crc32 by a byte."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    assert out[1] ^ out[2] == out[3] and zlib.crc32(b"a") == (out[0xFF ^ 97] ^ 0xFFFFFF) ^ 0xFFFFFFFF
    return out


ORACLE_SQL = f"""
WITH doc_words AS (SELECT doc_id, len(w) AS n_words, unnest(CASE WHEN len(w) > 0 THEN w ELSE [NULL] END) AS word
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w FROM documents)),
target_words AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '')) AS word FROM benchmark),
counts AS (SELECT word, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM (SELECT word, 0 AS side FROM doc_words UNION ALL SELECT word, 1 FROM target_words) WHERE word IS NOT NULL GROUP BY word),
hexed AS (SELECT *, hex(encode(word)) AS h FROM counts),
placed AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
    lambda c, b: xor(c >> 8, (CAST({_crc_table()} AS UBIGINT[]))[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % {BUCKETS} AS bucket FROM hexed),
sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM placed GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM sums),
gains AS (SELECT p.word, CAST(floor({SCALE}::DOUBLE * ln((b.t + 1) * (a.s + {BUCKETS}) / ((b.s + 1) * (a.t + {BUCKETS})))) AS BIGINT) AS gain FROM placed p JOIN sums b USING (bucket), totals a),
weighed AS (SELECT doc_id, n_words, count(word) AS n_features, CASE WHEN count(word) > 0 THEN CAST((sum(gain) - ((sum(gain) % count(word)) + count(word)) % count(word)) // count(word) AS BIGINT) ELSE 0 END AS weight
    FROM doc_words LEFT JOIN gains USING (word) GROUP BY doc_id, n_words),
scored AS (SELECT *, weight + CAST(floor(-{SCALE}::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= {MIN_WORDS} DESC, score DESC, doc_id) AS rank, CAST(count(*) FILTER (n_words >= {MIN_WORDS}) OVER () * {PERCENT} // 100 AS BIGINT) AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM ranked
"""
