"""Writers. A full reload writes a new version and never overwrites what it reads."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def sink(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    df.write.mode(mode).format(fmt).save(path)


def _current(spark: SparkSession, path: str) -> Row | None:
    """Last row of the ledger; None before the first load. Any fault but a missing ledger is raised."""
    try:
        ledger = spark.read.schema("version long, folder string").parquet(f"{path}/ledger")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return ledger.orderBy(F.desc("version"), F.desc("folder")).first()


def current_version(spark: SparkSession, path: str) -> int:
    """Highest committed version; 0 before the first load."""
    row = _current(spark, path)
    return row.version if row else 0


def reload(df: DataFrame, path: str) -> int:
    """Replace a table's contents: new folder first, then one ledger row makes it current.

    A job that dies half-way leaves the old version in force, and ``df`` may
    read the very table it replaces. Each load has a folder of its own, so two
    loads at once never mix their rows; the ledger names the one in force.
    """
    spark = df.sparkSession
    version = current_version(spark, path) + 1
    folder = f"load-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/{folder}")
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"))
    row.write.mode("append").parquet(f"{path}/ledger")
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{_current(spark, path).folder}")


def archive_swap(spark: SparkSession, raw: str, archive: str, new: DataFrame) -> None:
    """Archive takes the current raw table, raw takes the new rows."""
    if current_version(spark, raw):
        reload(read_current(spark, raw), archive)
    reload(new, raw)


def sink_dated_csv(df: DataFrame, folder: str, name: str, as_of: date, sep: str = ",") -> str:
    """A dated copy ``name_yyyymmdd`` next to the earlier ones."""
    path = f"{folder}/{name}_{as_of:%Y%m%d}"
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def unload(df: DataFrame, folder: str, as_of: date, max_rows: int = 1_000_000) -> None:
    """``dt=`` partition with capped file sizes; a rerun replaces only its own date."""
    (
        df.withColumn("dt", F.lit(as_of))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows).partitionBy("dt").parquet(folder)
    )


def extract_by_year(df: DataFrame, folder: str, ts: str) -> None:
    """One extract per calendar year; the rebalance splits a dominant year."""
    out = df.withColumn("year", F.year(ts)).hint("rebalance", "year")
    out.write.mode("overwrite").partitionBy("year").parquet(folder)
