"""Small helpers the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import scratch_path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive the executor that wrote them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of staged frames that nothing will read again."""
    for df in frames:
        if path := getattr(df, "staged_at", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def text_bytes(name: str = "text", alias: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(alias)


_INNER = re.compile(r" (?=\s|\Z)")


def blank_parts(text: str) -> list[str]:
    """Cut a text at every blank that a non-blank character follows.

    Byte-level patterns whose matches hold a blank only in front never match
    across such a cut, so the parts can be encoded one by one: the first as it
    is, every other one with the blank in front that was taken away.
    """
    parts = text.split(" ")
    if _INNER.search(text) is None:
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns whose names an operator's own results take."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def values(column) -> Iterator:
    """Values of an Arrow column one by one, so a batch of long texts is not held twice."""
    return (v.as_py() for v in column)


def slices(texts: Iterable, most: int) -> Iterator[list]:
    """Consecutive texts of together about ``most`` bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def ddl(df: DataFrame, columns: list[str], extra: str) -> str:
    """Schema text of some columns of a frame, followed by further fields."""
    kinds = df.select(*[F.col(f"`{c}`") for c in columns]).schema
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], extra])
