"""Session helpers: shared scratch space, lineage cuts, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_base(spark: SparkSession) -> str:
    """Shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="tabloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_base(spark)}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, fixes partition contents."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Even out rows before work that is heavy per row, whatever the file splits were."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Tables:
    """Attribute access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)
