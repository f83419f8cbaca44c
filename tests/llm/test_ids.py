"""Ids of 64 bits beside nulls in one batch, through every operator that handles rows in Python."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import bwt_dedup, compress_quality, langid, lattice_lm, packing, simhash

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), None, 7]


def quality(docs):
    labels = docs.sparkSession.createDataFrame([(2**53 + 1, 1), (7, 0)], "doc_id long, quality int")
    return compress_quality.scored(docs, compress_quality.learn(compress_quality.sample(docs, labels)))


OPERATORS = {
    "op2": quality,
    "op3": lambda docs: packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
    "op5": bwt_dedup.spans,
    "op6": lambda docs: lattice_lm.scored(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model")),
    "op7": lambda docs: langid.predicted(docs, langid.learn(docs.where("doc_id is not null"))),
    "op9": simhash.near_duplicates,
    "similar": simhash.similar_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_are_kept(spark, name):
    docs = spark.createDataFrame([(i, f"some words of number {k} " * 9, "en") for k, i in enumerate(IDS)], "doc_id long, text string, lang string").coalesce(1)
    assert sorted((r.doc_id for r in OPERATORS[name](docs).collect()), key=repr) == sorted(IDS, key=repr)
