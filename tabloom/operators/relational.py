"""Projections, filters, casts and column-set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.ordered import quantiles


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select, reorder and rename: ``{new: old}``."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def conform(df: DataFrame, target: T.StructType, constants: Mapping[str, object] = {}) -> DataFrame:
    """Exactly the target layout: constants, casts, typed NULLs, nothing else."""
    cols = []
    for f in target.fields:
        if f.name in constants:
            c = F.lit(constants[f.name])
        elif f.name in df.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def flag(df: DataFrame, name: str, rule: Column) -> DataFrame:
    return df.withColumn(name, F.when(rule, 1).otherwise(0))


def subset(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Keep rows matching every ``{column: value or list of values}``."""
    for name, want in spec.items():
        many = isinstance(want, (list, tuple, set))
        df = df.where(F.col(name).isin(list(want)) if many else F.col(name) == want)
    return df


def exclude(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(~F.col(col).isin(list(values)))


def between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def code_between(col: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    """Lexicographic membership in any inclusive code range."""
    return reduce(lambda a, b: a | b, [col.between(lo, hi) for lo, hi in ranges])


def like_any(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(col).like(p) for p in patterns]))


def month_in(df: DataFrame, ts: str, lo: int, hi: int) -> DataFrame:
    return df.where(F.month(ts).between(lo, hi))


def not_empty(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def any_in(cols: Sequence[str], codes: Sequence) -> Column:
    """True when any of the columns holds a listed code (NULLs never match)."""
    hits = [F.coalesce(F.col(c).isin(list(codes)), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, hits)


def none_in(cols: Sequence[str], codes: Sequence) -> Column:
    return ~any_in(cols, codes)


def safe_cast(df: DataFrame, spec: Mapping[str, str], fill: Mapping[str, object] = {}) -> DataFrame:
    """Cast where possible; unparsable values become NULL, then ``fill``."""
    out = df.withColumns({c: F.col(c).try_cast(t) for c, t in spec.items()})
    return out.na.fill(dict(fill)) if fill else out


def strict_cast(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Cast that raises on a bad value (ANSI)."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in spec.items()})


def to_numeric_all(df: DataFrame) -> DataFrame:
    """Turn every string column whose values all parse into double."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    bad = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in strings]
    ).first()
    return safe_cast(df, {c: "double" for c in strings if bad[c] == 0})


def token_to_null(df: DataFrame, cols: Sequence[str], token: str = "-") -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in cols})


def fill(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Fill NULLs per column with a constant, ``"median"`` or ``"mean"``."""
    constants = {c: v for c, v in spec.items() if v not in ("median", "mean")}
    med = [c for c, v in spec.items() if v == "median"]
    avg = [c for c, v in spec.items() if v == "mean"]
    if med:
        rows = quantiles(df, med, {"m": 0.5}).collect()  # one row per listed column
        constants.update({r["column"]: r["m"] for r in rows})
    if avg:
        constants.update(df.agg(*[F.avg(c).alias(c) for c in avg]).first().asDict())
    return df.na.fill({c: v for c, v in constants.items() if v is not None})


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), c)


def clean_nonfinite(df: DataFrame, cols: Sequence[str], fill_with: float | None = None) -> DataFrame:
    """±inf and NaN to NULL, optionally on to a constant."""
    out = df.withColumns({c: finite(F.col(c)) for c in cols})
    return out if fill_with is None else out.na.fill(fill_with, subset=list(cols))


def fallback(*cols: str) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])


def recode(col: str, mapping: Mapping) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col))


def make_key(cols: Sequence[str], sep: str = "-", strip: str = "") -> Column:
    """Concatenated business key; NULL parts become empty strings."""
    key = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    for ch in strip:
        key = F.replace(key, F.lit(ch), F.lit(""))
    return key


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), keep: str | None = "first"
) -> DataFrame:
    """One row per key, chosen by a total order; ``keep=None`` drops all repeats.

    An aggregate rather than a window, so repeats collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest) if rest else F.lit(0)
    if keep is None:
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__row"))
        one = one.where("__n = 1")
    else:
        pick = F.min_by if keep == "first" else F.max_by
        one = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("__row"))
    picked = [F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    return one.select(*picked)


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    cols = list(cols or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return {c: row[c] or 0.0 for c in cols}


def drop_sparse(df: DataFrame, threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    shares = null_shares(df)
    return df.drop(*[c for c, s in shares.items() if s >= threshold and c not in keep])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def drop_constant(df: DataFrame) -> DataFrame:
    """Drop columns with at most one distinct non-NULL value."""
    row = df.agg(
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in df.columns]
    ).first()
    return df.drop(*[c for c in df.columns if row[c]])


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols) if cols else None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def row_total(df: DataFrame, keep: Sequence[str], name: str = "total") -> DataFrame:
    nums = [c for c in numeric_columns(df) if c not in keep]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in nums])
    return df.select(*keep, total.alias(name))


def even_double_else_triple(c: Column) -> Column:
    return F.when(c % 2 == 0, c * 2).otherwise(c * 3)


def union_rows(*dfs: DataFrame, allow_missing: bool = False, distinct: bool = False) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)
    return out.distinct() if distinct else out
