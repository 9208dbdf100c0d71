"""Join forms. The physical strategy is left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import attach, join_back


def merge_data(
    left: DataFrame, right: DataFrame, how: str = "inner",
    on: Sequence[str] | None = None,
    left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi join on shared keys or on pairs of differently named keys."""
    if on:
        return left.join(right, list(on), how)
    cond = [left[a] == right[b] for a, b in zip(left_on, right_on)]
    return left.join(right, cond, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def join_suffix(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Overlapping non-key columns get a suffix per side."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    ren = [{c: c + s for c in both} for s in suffixes]
    return left.withColumnsRenamed(ren[0]).join(right.withColumnsRenamed(ren[1]), list(on), how)


def join_replace_columns(base: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Bring columns over, replacing same-named ones."""
    old = [c for c in cols if c in base.columns and c not in keys]
    return base.drop(*old).join(new.select(*keys, *cols), list(keys), "left")


def semi(df: DataFrame, keys_df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys_df, list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


def anti_above(df: DataFrame, other: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows with no match on the keys whose ``col`` is at least as high.

    The other side shrinks to one maximum per key first, so no inequality join.
    """
    top = other.groupBy(*keys).agg(F.max(col).alias("__top"))
    out = join_back(df, top, keys)
    return out.where(F.col("__top").isNull() | (F.col("__top") < F.col(col))).drop("__top")


def exclude_all(df: DataFrame, other: DataFrame, on: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    """Drop rows whose key meets any of several rules in one other table.

    All rules read the same table, so one anti join on their disjunction does.
    """
    return anti(df, other.where(reduce(lambda a, b: a | b, rules)).select(*on), on)


def match_any(
    df: DataFrame, id_cols: Sequence[str], code_cols: Sequence[str], dim: DataFrame, code: str,
    keep_code: bool = False,
) -> DataFrame:
    """Match a dimension on any of several code columns: explode, equi-join, distinct."""
    codes = F.explode(F.array_distinct(F.array_compact(F.array(*code_cols))))
    long = df.select(*id_cols, codes.alias(code))
    out = long.join(dim, code)
    return (out if keep_code else out.drop(code)).distinct()


def active_on(df: DataFrame, start: str, stop: str, as_of: Column) -> DataFrame:
    return df.where(as_of.between(F.col(start), F.col(stop)))


def latest_attr(df: DataFrame, key: Sequence[str], order: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Attributes of each key's last row in a total order."""
    last = F.max_by(F.struct(*attrs), F.struct(*order)).alias("__last")
    return df.groupBy(*key).agg(last).select(*key, "__last.*")


def interval_join(
    events: DataFrame, spans: DataFrame, key: str, ts: str, start: str, stop: str, bin_days: int = 30,
) -> DataFrame:
    """Events inside a per-key validity span.

    Spans are cut into day bins, so a key with very many events and spans is
    joined on (key, bin) instead of all its pairs.
    """
    day = F.unix_date(F.to_date(ts))
    first, last = F.unix_date(F.to_date(start)), F.unix_date(F.to_date(stop))
    bins = F.sequence(F.floor(first / bin_days), F.floor(last / bin_days))
    cut = spans.where(F.col(start) <= F.col(stop)).withColumn("__bin", F.explode(bins))
    out = events.withColumn("__bin", F.floor(day / bin_days)).join(cut, [key, "__bin"])
    return out.where(F.col(ts).between(F.col(start), F.col(stop))).drop("__bin")


def keep_group_max(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """All rows equal to their group's maximum."""
    top = df.groupBy(*keys).agg(F.max(col).alias("__top"))
    return join_back(df, top, keys).where(F.col(col) == F.col("__top")).drop("__top")


def successors(df: DataFrame, col: str) -> DataFrame:
    """Pairs (n, n+1) that both occur."""
    values = df.select(F.col(col).alias("n")).distinct()
    return values.join(values.select((F.col("n") - 1).alias("n"), F.col("n").alias("next_n")), "n")


def crosswalk(df: DataFrame, cols: Sequence[str], dim: DataFrame, code: str, value: str) -> DataFrame:
    """Translate several code columns through the same dimension."""
    for c in cols:
        side = dim.select(F.col(code).alias(c), F.col(value).alias(f"{c}_{value}"))
        df = df.join(side, c, "left")
    return df


def indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Label each key both / left_only / right_only."""
    a = left.select(*on).distinct().withColumn("__l", F.lit(1))
    b = right.select(*on).distinct().withColumn("__r", F.lit(1))
    side = (
        F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    )
    return a.join(b, list(on), "full").select(*on, side.alias("side"))


def not_in_history(new: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    return anti(new, history, keys)


def recent_batches(df: DataFrame, batch_key: str, n: int) -> DataFrame:
    """The n highest distinct batch ids."""
    return df.select(batch_key).distinct().orderBy(F.desc(batch_key)).limit(n)


def not_in(df: DataFrame, col: str, held: DataFrame, held_col: str) -> DataFrame:
    """SQL's ``col NOT IN (held)``: nothing if the set holds a NULL, a NULL in ``col`` only if the set is empty.

    One aggregate tells whether the set is empty or holds a NULL; the rest is an anti join on distinct values, which
    shuffles both sides instead of sending the set to every task.
    """
    values = held.select(F.col(held_col).alias("__v"))
    facts = values.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__v").isNull()).alias("__nulls"))
    asked = attach(df, facts).where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(col).isNotNull())).drop("__n", "__nulls")
    return asked.join(values.distinct(), F.col(col) == F.col("__v"), "left_anti")
