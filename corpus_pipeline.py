"""The corpus pipeline: quality rules, line dedup, near-dedup, redaction, packing.

Every stage takes (spark, docs, sf_dir) and gives a frame that is written as
Parquet and read again as the next one's ``docs``. All but the last keep the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import lines, packing, pii, rules, shingles
from tabloom.llm.common import discard, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base rules or is too far from its language's character classes and common words."""
    judged = rules.judge(docs.select(*COLUMNS).withColumn("__text", F.col("text")), rules.references(docs), text="__text")
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut boilerplate lines, all but their first occurrence."""
    return _documents(lines.dedup(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by SimHash prints within 3 bits or a Jaccard similarity of 0.8 over five-word shingles: the one with the smallest id."""
    return shingles.keep_one(docs.select(*COLUMNS), shingles.Settings(prints=True))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return _documents(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece, with its ids, its sequence and its place there.

    A null text counts as empty and has the end token only; repeated rows are packed as they come, other columns stay behind.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), s=packing.Settings(known=60_000, slice_bytes=512 << 10, remember=False))


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", redaction), ("packing", pack)]

# Trees, least squares and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = staged(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
