"""Readers: columnar, delimited, fixed-width, nested JSON, JDBC, file listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any Spark-readable URI: local paths, ``s3a://``, ``abfss://`` and so on."""
    return spark.read.format(fmt).options(**options).load(path)


def scan_delimited(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None,
    cols: Sequence[str] | None = None, encoding: str = "UTF-8",
) -> DataFrame:
    """Delimited text with a header, optionally only some columns."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*cols) if cols else df


def scan_fixed_width(
    spark: SparkSession, paths: str | Sequence[str], layout: DataFrame,
    cols: Sequence[str] | None = None, where: Column | None = None, tag: str | None = None,
) -> DataFrame:
    """Slice text records by a (field, start, end) dictionary, 1-based inclusive.

    The dictionary has one row per field of the file and is read on the driver.
    """
    fields = layout.select("field", "start", "end").orderBy("start").collect()
    wanted = [f for f in fields if cols is None or f["field"] in cols]
    lines = spark.read.text(paths)
    slices = [
        F.trim(F.substring("value", f["start"], f["end"] - f["start"] + 1)).alias(f["field"]) for f in wanted
    ]
    if tag:
        slices.append(F.col("_metadata.file_name").alias(tag))
    out = lines.select(*slices)
    return out.where(where) if where is not None else out


def header_promote(df: DataFrame, order_col: str) -> DataFrame:
    """The first data row names the columns and is dropped."""
    first = df.orderBy(order_col).limit(1).first()
    names = {c: str(first[c]) for c in df.columns if c != order_col}
    return df.where(F.col(order_col) != first[order_col]).drop(order_col).withColumnsRenamed(names)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """(Compressed) JSON documents with a declared nested schema."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def jdbc_options(
    url: str, query: str, partition_col: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1,
    fetch: int = 10_000,
) -> dict[str, str]:
    """Reader options: the query runs on the server, split by a numeric column."""
    opts = {"url": url, "fetchsize": str(fetch)}
    if not partition_col:
        return opts | {"query": query}
    return opts | {
        "dbtable": f"({query}) q", "partitionColumn": partition_col,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts),
    }


def scan_jdbc(spark: SparkSession, url: str, query: str, **split) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **split)).load()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime")


def list_dated_files(files: DataFrame, regex: str, since: date) -> DataFrame:
    """Files whose embedded ``yyyymmdd`` is on or after a cutoff."""
    stamp = F.regexp_extract("path", regex, 1)
    day = F.to_date(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd")))
    return files.withColumn("file_date", day).where(F.col("file_date") >= F.lit(since))


def newest_file(files: DataFrame, ext: str, n: int = 1) -> DataFrame:
    """The n-th newest file with an extension, skipping lock files; empty when missing."""
    name = F.element_at(F.split("path", "/"), -1)
    keep = F.col("path").endswith(ext) & ~name.startswith("~$")
    return files.where(keep).orderBy(F.desc("modificationTime"), "path").limit(n).offset(n - 1)


def tag_source(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Base file name per row; apply right after a file scan."""
    return df.select("*", F.col("_metadata.file_name").alias(name))


def union_files(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Same-layout files as one table; columns missing in some files become NULL."""
    return spark.read.format(fmt).option("mergeSchema", True).load(list(paths))
