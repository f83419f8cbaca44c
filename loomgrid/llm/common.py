"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.session import drop, shared_dir, written  # noqa: F401

#: The words of a text are the runs of characters outside this class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


@F.pandas_udf(T.BinaryType())
def pressed(texts: pd.Series) -> pd.Series:
    """Texts as zstandard-compressed UTF-8, for the shuffles that move whole texts; null for null."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    return pd.Series([None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)
