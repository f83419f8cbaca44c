"""The corpus pipeline: quality rules, near-duplicates, repeated strings, mixing, packing.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

* quality_rules: documents that the rules reject go; the trusted kind are the documents that labels mark as good.
* simhash: of each group of near-duplicates (sets of five-word shingles, similarity of 0.8 or more) the row with the
  smallest doc_id stays, null ids last; of its rows with that id, one.
* suffix_array: bytes of strings of 100 bytes that occurred earlier are cut out; characters that a cut divides go with it.
  A document of which nothing but white space is left goes.
* mixing: sources are brought to their target weights; a document that is taken twice is two rows.
* packing: one row per piece with its sequence and place. Rows of a document that the mix took twice are packed each.

Nulls: a null text is rejected by the quality rules. Null ids pass through all stages as rows of their own, except that
near-duplicates of another row go. Columns besides those of ``documents`` are dropped by the first stage. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import bwt_dedup, mixing, packing, quality_rules, simhash
from loomgrid.llm.common import drop, table, written
from loomgrid.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WIDTH, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.kept_documents(docs.select(*COLUMNS), quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    ship(spark)
    found = simhash.similar_documents(docs, width=WIDTH, similarity=SIMILARITY)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    first = found.groupBy("root").agg(least.alias("row")).select("row")
    kept = simhash.met(docs.select(*COLUMNS, simhash.row_key(F.col("doc_id"), F.col("text")).alias("row")), first, "row", "left_semi")
    if found.groupBy("row").count().where("count > 1").limit(1).count():
        # equal ids with equal texts: one of them
        kept = kept.groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("doc")).select("doc.*")
    return kept.select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings that occurred earlier."""
    ship(spark)
    return bwt_dedup.cleaned(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    from loomgrid.llm.queries import tokenizer_path

    ship(spark)
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality_rules", quality), ("simhash", near_duplicates), ("suffix_array", repeated_strings), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the similar sets and the removal of strings; tests/llm holds every stage, and the run, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
