"""Sorts, limits, pages and rank-based selections over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.operators.ordered import Order, attach, join_back, nearby, ntile_column, position, running
from tabloom.session import stable


def sort(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[F.desc(c) if d == "desc" else F.asc(c) for c, d in spec])


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_pct(df: DataFrame, order: Order, p: float) -> DataFrame:
    """First ``floor(n * p)`` rows by a total order."""
    n = int(df.count() * p)
    return position(df, [], order, "__rn").where(F.col("__rn") <= n).drop("__rn")


def page(df: DataFrame, order: Sequence[Column], lo: int, hi: int) -> DataFrame:
    """Rows lo..hi (1-based, inclusive): a top-hi followed by an offset."""
    return df.orderBy(*order).limit(hi).offset(lo - 1)


def head_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First n rows per key. Spark limits each group map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def tiles(df: DataFrame, order: Order, n: int, name: str = "tile") -> DataFrame:
    """NTILE(n) over the whole table without a single-task window."""
    total = F.lit(df.count())
    pos = position(df, [], order, "__rn")
    return pos.withColumn(name, ntile_column(F.col("__rn"), total, n)).drop("__rn")


def ngroup(df: DataFrame, keys: Sequence[str], name: str = "group_id") -> DataFrame:
    """Dense 0-based id per key combination in key order."""
    ids = position(df.select(*keys).distinct(), [], list(keys), "__id")
    return join_back(df, ids.select(*keys, (F.col("__id") - 1).alias(name)), keys)


def running_total(df: DataFrame, col: str, name: str = "running_total") -> DataFrame:
    """Cumulative sum where equal values share the total (RANGE frame)."""
    sums = df.groupBy(col).agg(F.sum(col).alias("__s"))
    cum = running(sums, [], [col], {name: ("sum", F.col("__s"))}).select(col, name)
    return join_back(df, cum, [col])


def ffill(df: DataFrame, keys: Sequence[str], order: Order, cols: Sequence[str]) -> DataFrame:
    """Carry the last non-NULL value forward per key."""
    out = running(df, keys, order, {f"__f_{c}": ("last", F.col(c)) for c in cols})
    return out.select(*[F.col(f"__f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def ffill_by_position(df: DataFrame, keys: Sequence[str], order: Order, cols: Sequence[str]) -> DataFrame:
    """Forward fill through the position of the last non-NULL row (second formulation).

    The running maximum of (position, value) pairs carries the value itself.
    """
    pos = position(df, keys, order, "__pos")
    marks = {
        f"__m_{c}": ("max", F.when(F.col(c).isNotNull(), F.struct("__pos", F.col(c).alias("v"))))
        for c in cols
    }
    out = running(stable(pos), keys, ["__pos"], marks)
    return out.select(*[F.col(f"__m_{c}.v").alias(c) if c in cols else F.col(c) for c in df.columns])


def lags(df: DataFrame, keys: Sequence[str], order: Order, col: str, ns: Sequence[int]) -> DataFrame:
    return nearby(df, keys, order, max(ns), lambda w: {f"{col}_lag_{n}": F.lag(col, n).over(w) for n in ns})


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Order, col: str, n: int, name: str) -> DataFrame:
    """Trailing n-row mean, NULL until n non-NULL values are there."""

    def expr(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return {name: F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))}

    return nearby(df, keys, order, n - 1, expr)


def islands(df: DataFrame, col: str) -> DataFrame:
    """Maximal runs of consecutive integers."""
    pos = position(df.select(F.col(col).cast("long").alias("v")).distinct(), [], ["v"], "rn")
    return pos.groupBy((F.col("v") - F.col("rn")).alias("__g")).agg(
        F.min("v").alias("first_n"), F.max("v").alias("last_n"), F.count(F.lit(1)).alias("n")
    ).drop("__g")


def merge_spans(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge overlapping or touching spans per key."""
    spans = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    seen = running(spans, keys, [start], {"__seen": ("max", F.col(end))}, exclusive=True)
    fresh = seen.withColumn("__new", F.when(F.col(start) <= F.col("__seen"), 0).otherwise(1))
    grouped = running(stable(fresh), keys, [start], {"__grp": ("sum", F.col("__new"))})
    return grouped.groupBy(*keys, "__grp").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__grp")


def group_transform(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Group statistics repeated on each row."""
    return join_back(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def flag_any(df: DataFrame, keys: Sequence[str], rule: Column, name: str) -> DataFrame:
    """1 on every row of a key when any of its rows satisfies the rule."""
    return group_transform(df, keys, {name: F.max(F.when(rule, 1).otherwise(0))})


def exists_since(
    df: DataFrame, keys: Sequence[str], day: str, rule: Column, days: int, name: str
) -> DataFrame:
    """Whether the key has a matching row dated at or after (own date − days).

    There is no upper bound, so the key's latest matching date decides.
    """
    out = group_transform(df, keys, {"__latest": F.max(F.when(rule, F.col(day)))})
    hit = F.col("__latest") >= F.date_sub(F.col(day), days)
    return out.withColumn(name, F.when(hit, 1).otherwise(0)).drop("__latest")


def cumulative_share(df: DataFrame, bucket: str, hits: str) -> DataFrame:
    """Hits per bucket with cumulative count and share; buckets are few."""
    counts = df.groupBy(bucket).agg(F.sum(hits).alias("hits"))
    cum = running(counts, [], [bucket], {"cumulative_hits": ("sum", F.col("hits"))})
    total = counts.agg(F.sum("hits").alias("__t"))
    return attach(cum, total).withColumn("cumulative_share", F.col("cumulative_hits") / F.col("__t")).drop("__t")
