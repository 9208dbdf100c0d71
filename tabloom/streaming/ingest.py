"""Incremental file ingestion: each new file is loaded once, and its rows with new keys are appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.relational import dedupe

BUCKETS = 64  # folders a target is cut into by key; a batch reads only those it has keys for


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def committed(spark: SparkSession, target: str) -> int:
    """The last batch that is whole, -1 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return -1
    return spark.read.schema("batch long").parquet(f"{target}/commits").agg(F.max("batch")).first()[0]


def read_target(spark: SparkSession, target: str, schema: T.StructType, last: int | None = None) -> DataFrame:
    """The rows of all whole batches (or those up to ``last``); what a broken run left behind is not seen."""
    last = committed(spark, target) if last is None else last
    if last < 0:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("__batch", T.LongType()), T.StructField("__bucket", T.IntegerType())])
    rows = spark.read.schema(full).option("basePath", f"{target}/rows").parquet(f"{target}/rows")
    return rows.where(F.col("__batch") <= last)


def append_batch(rows: DataFrame, batch: int, target: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Append the rows of one batch whose key no earlier batch holds; of rows with one key the last by ``order``.

    The batch's folder is written over and its commit row comes last, so a batch that failed half-way leaves nothing when
    it is sent again, and one that is whole is not taken twice. Target and checkpoint belong together. Held keys are read from the buckets and the key range of the batch only: files lie by bucket and are
    sorted by key, so those outside the range are skipped unread.
    """
    spark, schema = rows.sparkSession, rows.schema
    fresh = dedupe(rows, keys, order, "last").withColumn("__bucket", _bucket(keys, buckets))
    before = committed(spark, target)
    if batch <= before:
        return
    if before >= 0:
        met = fresh.agg(F.collect_set("__bucket").alias("b"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).first()  # at most one entry per bucket
        held = read_target(spark, target, schema, before)
        held = held.where(F.col("__bucket").isin(met["b"] or [-1]) & (F.col(keys[0]).between(F.lit(met["lo"]), F.lit(met["hi"])) | F.col(keys[0]).isNull()))
        known = held.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        fresh = fresh.join(known, same, "left_anti")
    placed = fresh.repartition("__bucket").sortWithinPartitions("__bucket", *keys)
    placed.write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/rows/__batch={batch}")
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/part={batch}")


def ingest(
    spark: SparkSession, incoming: str, target: str, checkpoint: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str],
    fmt: str = "parquet", buckets: int = BUCKETS,
) -> DataFrame:
    """Run the stream until every file present is in the target; gives the target's rows.

    The checkpoint remembers the files already taken and gives each batch its number; a batch that is run again after a
    crash has the same number and files.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(incoming)
    run = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda rows, batch: append_batch(rows, batch, target, keys, order, buckets)).start()
    )
    run.awaitTermination()
    return read_target(spark, target, schema).select(*schema.names)
