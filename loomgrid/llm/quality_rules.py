"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over ``SLOTS`` hash slots of word n-grams are counted over whole tables: the trusted one from the
rows marked as trusted, the raw one from all rows. The trusted one has a prior centred on the raw one, so a slot with
few n-grams has a ratio near 1. A document's score is the mean, over its n-grams, of the log of the ratio of the slot's
probabilities. It is kept if it passes the base rules and its score is at least
``threshold``; the threshold is a constant, so a document's verdict depends on no sample and no quantile.

Everything is DataFrame expressions. To count, n-grams are exploded and summed by slot on either side of the shuffle.
To score, the ratios are one array of ``SLOTS`` floats, whatever the corpus, that every row reads: verdicts are made
where the row is, without a shuffle. The base counts come from the arrays of the row itself.

Nulls: a null text has no words: its counts are 0, its score null, and it is rejected by the base rules. A text
without n-grams (n_words = 0) likewise. Without trusted rows the score is null and the base rules decide. Repeated
rows are scored one by one, texts of any length as a whole; null ids are kept; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import words, written

SLOTS = 1 << 17
#: Mean log-likelihood ratio per n-gram from which a document is kept; how it was found is in the README.
THRESHOLD = -0.18
#: Expected count below which a slot says little: the mass of a prior centred on the raw multinomial.
SMOOTHING = 5.0
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., slot): the hash slots of the one- and two-word n-grams of ``tokens``; a row without tokens gives a null slot."""
    slot = lambda *w: F.pmod(F.xxhash64(*w), F.lit(SLOTS)).cast("int")
    last = F.size("tokens") - 1
    at = rows.select(*keep, "tokens", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
    one, two = F.get("tokens", F.col("i")), F.get("tokens", F.col("i") + 1)
    both = at.select(*keep, F.explode_outer(F.when(F.col("i") < F.size("tokens") - 1, F.array(slot(one), slot(one, two))).when(F.col("i").isNotNull(), F.array(slot(one)))).alias("slot"))
    return both


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with tokens, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (the last five are long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0)
    window = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 2), lambda i: F.xxhash64(F.get("tokens", i - 1), F.get("tokens", i), F.get("tokens", i + 1)))
    placed = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter("windows", lambda x, k: (F.get("windows", k - 1)["h"] == x["h"]) | F.coalesce(F.get("windows", k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.aggregate(
        "repeated",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + F.lit(3) - F.greatest(F.lit(0), acc["end"] - i)).cast("long").alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    out = docs.withColumn("tokens", words(F.col(text_col).cast("string")))
    out = out.withColumn("lines", lines).withColumn("n_words", F.size("tokens").cast("long"))
    out = out.withColumn("hashes", F.when(F.col("n_words") >= 3, window))
    # only texts with an equal pair of windows sort them
    out = out.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    out = out.withColumn("repeated", F.array_sort(F.transform(twice, lambda x: x["i"])))
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("tokens", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("lines", "hashes", "windows", "repeated")


def ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(slot, ratio): log of trusted over raw probability for the slots that occur; and whether anything was trusted."""
    wanted = trusted.select(F.col("doc_id").alias(id_col), F.lit(True).alias("trusted")).distinct().hint("shuffle_hash")
    marked = docs.select(id_col, text_col).join(wanted, id_col, "left").select("trusted", words(F.col(text_col).cast("string")).alias("tokens"))
    both = exploded(marked, "trusted").where("slot is not null").groupBy("slot").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted"))
    both = written(both, "slots")
    total = both.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()
    if not total["trusted"]:
        return both, False
    expected = F.col("raw") * F.lit(total["trusted"] / total["raw"])
    return both.select("slot", F.log((F.col("trusted") + F.lit(SMOOTHING)) / (expected + F.lit(SMOOTHING))).alias("ratio")), True


def table(ratios: DataFrame) -> Column:
    """The ratios as one array by slot, SLOTS long; 0 where a slot does not occur."""
    every = ratios.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(ratios, "slot", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("ratio", F.lit(0.0)).cast("float").alias("ratio")))), lambda x: x["ratio"]).alias("table")).scalar()


def with_verdict(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept): ``row`` has all columns of ``docs``.

    trusted: ids (doc_id) of the documents of the wanted kind.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    ratios, learned = ratio(docs, trusted, id_col, text_col)
    rows = counted(rows).withColumn("table", table(ratios) if learned else F.lit(None).cast("array<float>"))
    slot = lambda *w: F.pmod(F.xxhash64(*w), F.lit(SLOTS)).cast("int")
    one, two = (lambda i: F.get("tokens", i)), (lambda i: F.get("tokens", i + 1))
    last = F.size("tokens") - 1
    step = lambda acc, i: acc + F.get("table", slot(one(i))) + F.when(i < last, F.get("table", slot(one(i), two(i)))).otherwise(0.0)
    total = F.aggregate(F.sequence(F.lit(0), last), F.lit(0.0), step)
    rows = rows.withColumn("score", F.when(last >= 0, total / (2 * last + 1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & F.coalesce(F.col("score") >= threshold, F.lit(True))
    return rows.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", kept.alias("kept"))


def kept_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    Verdicts are written first: a filter on them would be pushed below the arrays that they are made of, which would then
    be made anew for every word.
    """
    found = with_verdict(docs, trusted, threshold, id_col, text_col).select("row", "kept")
    return written(found, "verdicts").where("kept").select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that some row of ``labels`` marks with quality 1."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
