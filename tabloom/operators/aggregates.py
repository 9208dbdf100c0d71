"""Grouped aggregates. All combine map-side, so one hot key costs no more."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import attach, join_back, position, quantiles, running, unpivot_numeric


def group_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(f"sum_{c}") for c in cols])


def collapse_max(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Max of every non-key column, generated from the schema."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest]).select(*df.columns)


def sum_or_max(col: str, use_max: Column) -> Column:
    return F.when(use_max, F.max(col)).otherwise(F.sum(col))


def cond_sum(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(r).alias(n) for n, r in rules.items()])


def distinct_conditional(df: DataFrame, keys: Sequence[str], col: str, rules: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_distinct(col).alias("n_distinct"),
        *[F.count_distinct(F.when(r, F.col(col))).alias(n) for n, r in rules.items()],
    )


def flag_pivot(
    df: DataFrame, key: Sequence[str], category: str, count: str, rules: Mapping[str, tuple[str, int]],
    extra: Mapping[str, Column] = {},
) -> DataFrame:
    """(key, category, count) rows to one 0/1 column per ``{name: (category, threshold)}``."""
    cols = []
    for name, (cat, n) in rules.items():
        hit = (F.col(category) == cat) & (F.col(count) >= n)
        if name in extra:
            hit = hit & extra[name]
        cols.append(F.max(F.when(hit, 1).otherwise(0)).alias(name))
    return df.groupBy(*key).agg(*cols)


def netted_flags(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "flag_") -> DataFrame:
    """1 when a signed sum is exactly zero; an all-NULL sum gives 0."""
    return df.groupBy(*keys).agg(
        *[F.when(F.sum(c) == 0, 1).otherwise(0).alias(f"{prefix}{c}") for c in cols]
    )


def month_boundaries(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def has_month_span(df: DataFrame, keys: Sequence[str], day: str, n: int = 2) -> DataFrame:
    span = month_boundaries(F.min(day), F.max(day)) >= n
    return df.groupBy(*keys).agg(F.when(span, 1).otherwise(0).alias("has_span"))


def dups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def singles(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(col)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def mode_all(df: DataFrame, col: str) -> DataFrame:
    """Every most frequent value with its count."""
    counts = value_counts(df.where(F.col(col).isNotNull()), [col])
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(top), "n", "left_semi")  # one row


def median_by_position(df: DataFrame, col: str) -> DataFrame:
    """Mean of the one or two middle rows by row number and total count."""
    df = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    n = df.count()
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    cum = running(counts, [], ["v"], {"upto": ("sum", F.col("n"))})
    middle = F.filter(F.array(F.lit((n + 1) // 2), F.lit((n + 2) // 2)),
                      lambda p: (p > F.col("upto") - F.col("n")) & (p <= F.col("upto")))
    return cum.select("v", F.explode(middle)).agg(F.avg("v").alias("median"))


def second_highest(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(F.desc(col)).offset(1).limit(1)


def max_pair_product(df: DataFrame, col: str) -> DataFrame:
    """Largest product of two rows: the two highest or the two lowest; null below two rows."""
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    product = F.when(F.count("v") == 2, F.product("v")).alias("p")
    hi = v.orderBy(F.desc("v")).limit(2).agg(product)
    lo = v.orderBy("v").limit(2).agg(product)
    return hi.unionByName(lo).agg(F.max("p").alias("max_product"))


def string_join(df: DataFrame, keys: Sequence[str], col: str, sep: str = "; ") -> DataFrame:
    """Distinct values per key in order, joined; repeats collapse before the shuffle."""
    d = df.select(*keys, col).where(F.col(col).isNotNull()).distinct()
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(col))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """Count and share per class."""
    counts = value_counts(df, [y])
    return share_of(counts, "n", "share")


def share_of(counts: DataFrame, col: str, name: str) -> DataFrame:
    total = counts.agg(F.sum(col).alias("__total"))
    return attach(counts, total).withColumn(name, F.col(col) / F.col("__total")).drop("__total")


def share(df: DataFrame, key: str, col: str) -> DataFrame:
    return share_of(df.groupBy(key).agg(F.sum(col).alias("total")), "total", "share")


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values) if values else None).count().na.fill(0)


def group_mean(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(y).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per column (and group)."""
    long = unpivot_numeric(df, by, cols).where(F.col("value").isNotNull())
    moments = long.groupBy(*by, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(df, cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    return join_back(moments, q, [*by, "column"])


def rollup_period(df: DataFrame, ts: str, unit: str, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Aggregate by week (Monday start) or month, optionally per key."""
    period = F.to_date(F.date_trunc(unit, F.col(ts))).alias("period")
    return df.groupBy(*keys, period).agg(*aggs)


def multi_stats(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{column: [avg, max, …]}`` in one aggregate, named ``avg_column``."""
    fn = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    return df.groupBy(*keys).agg(*[fn[s](c).alias(f"{s}_{c}") for c, ss in spec.items() for s in ss])


def team_record(games: DataFrame, season: str, team: str, won: Column, side: str) -> DataFrame:
    """Games and wins per season and team for one side."""
    return games.groupBy(F.col(season).alias("season"), F.col(team).alias("team")).agg(
        F.count(F.lit(1)).alias(f"{side}_games"), F.count_if(won).alias(f"{side}_wins")
    )


def mixed_first(df: DataFrame, keys: Sequence[str], means: Sequence[str], firsts: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.min_by(c, F.struct(*order)).alias(c) for c in firsts],
    )


def skewness_sample(c: Column) -> Column:
    """Bias-corrected skewness, as pandas reports it."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def skewed(df: DataFrame, cols: Sequence[str], threshold: float = 1.0) -> DataFrame:
    long = unpivot_numeric(df, [], cols)
    out = long.groupBy("column").agg(skewness_sample(F.col("value")).alias("skew"))
    return out.where(F.abs("skew") > threshold)


def tail_ratio(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows above mean + one standard deviation."""
    stats = df.groupBy(*by).agg((F.avg(col) + F.stddev_samp(col)).alias("cut"))
    joined = join_back(df, stats, by) if by else attach(df, stats)
    above = F.avg((F.col(col) > F.col("cut")).cast("int")).alias("tail_ratio")
    return joined.groupBy(*by).agg(above)


def missing_numbers(df: DataFrame, col: str) -> DataFrame:
    """Integers between min and max that do not occur."""
    v = df.select(F.col(col).cast("long").alias("n")).distinct()
    lo, hi = v.agg(F.min("n"), F.max("n")).first()
    if lo is None:
        return v
    return df.sparkSession.range(lo, hi + 1).toDF("n").join(v, "n", "left_anti")


def ranked(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """RANK() ascending from distinct-value counts."""
    counts = value_counts(df, [col])
    before = running(counts, [], [col], {name: ("sum", F.col("n"))}, exclusive=True)
    ranks = before.select(col, (F.coalesce(name, F.lit(0)) + 1).alias(name))
    return join_back(df, ranks, [col])


def positions(df: DataFrame, order: Sequence, name: str = "rn") -> DataFrame:
    return position(df, [], order, name)
