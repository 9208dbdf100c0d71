"""The operators as registered queries over the given tables, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, chat, fingerprint, language, lines, merkle, packing, pii, repair, rules, simhash, token_output, weak
from tabloom.llm.common import documents
from tabloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return register


@query("op2_simhash")
def op2(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.groups(documents(spark, root))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


@query("op9_byte_bpe")
def op9(spark: SparkSession, root: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, root).select("doc_id", "text"), path, public_tokenizers.PATTERN, digests=True)


@query("op1_language")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return language.identify(documents(spark, root))


@query("op3_quality_rules")
def op3(spark: SparkSession, root: str) -> DataFrame:
    return rules.quality(documents(spark, root))


@query("op4_token_output")
def op4(spark: SparkSession, root: str) -> DataFrame:
    """Pieces as they stand in the written files: place, length and CRC-32 of the 16-bit ids."""
    out = scratch_path(spark, "tokens")
    token_output.write(documents(spark, root), out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_output.pieces(token_output.read(spark, out)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op6_packing")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(documents(spark, root), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query("op8_fingerprints")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return fingerprint.neighbours(documents(spark, root))


@query("op7_line_dedup", lines.SQL)
def op7(spark: SparkSession, root: str) -> DataFrame:
    return lines.dedup(documents(spark, root)).select("doc_id", "text", "n_lines", "n_removed")


@query("op10_pii")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return pii.report(documents(spark, root))


@query("op5_weak_quality")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return weak.classify(documents(spark, root))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark: SparkSession, root: str) -> DataFrame:
    return merkle.verify(documents(spark, root))


@query("op13_chat_format", chat.SQL)
def op13(spark: SparkSession, root: str) -> DataFrame:
    return chat.report(spark.read.parquet(f"{root}/conversations.parquet"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return repair.report(spark.read.parquet(f"{root}/conversations.parquet"))
