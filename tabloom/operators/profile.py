"""Profiling, data quality and correlation structure."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalars import log1p_positive, parse_date, width_bin
from tabloom.operators.aggregates import crosstab, skewed, value_counts
from tabloom.operators.geo import iqr_bounds
from tabloom.operators.ordered import attach, running, unpivot_numeric
from tabloom.operators.relational import clean_nonfinite, drop_constant, drop_sparse, numeric_columns
from tabloom.session import stable


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: type, non-NULL and NULL counts, NULL share, distinct count, min and max as text.

    Values are reduced to (column, value) counts first, so wide tables need no
    multi-distinct expansion on the reduce side; a long value travels as its digest.
    """
    text = {c: F.col(c).cast("string") for c in df.columns}
    short = lambda v: F.when(F.length(v) > 64, F.sha2(v, 256)).otherwise(v)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), short(text[c]).alias("v")) for c, t in df.dtypes
    ])
    counts = df.select(F.inline(cells)).groupBy("column", "type", "v").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy("column", "type").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("v").alias("n_distinct"),
    )
    edges = df.agg(*[f(c).cast("string").alias(f"{n}_{c}") for c in df.columns for n, f in (("min", F.min), ("max", F.max))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max")) for c in df.columns
    ])
    out = shape.join(edges.select(F.inline(rows)), "column")
    total = F.col("non_null") + F.col("nulls")
    return out.withColumn("null_pct", F.col("nulls") / F.nullif(total, F.lit(0)) * 100)


def audit_types(df: DataFrame) -> DataFrame:
    """Number of columns per type."""
    rows = [(c, t) for c, t in df.dtypes]
    return value_counts(df.sparkSession.createDataFrame(rows, "name string, type string"), ["type"])


def optimize_dtypes(df: DataFrame, date_hint: str = "date") -> DataFrame:
    """Parse date-named text columns and narrow integers and floats to what the values need."""
    texts = [c for c, t in df.dtypes if t == "string" and date_hint in c.lower()]
    df = df.withColumns({c: F.coalesce(F.col(c).try_cast("date"), parse_date(F.col(c))) for c in texts}) if texts else df
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not ints and not doubles:
        return df
    # A double narrows to float only when every value survives the round trip.
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in ints], *[F.max(c).alias(f"hi_{c}") for c in ints],
        *[F.count_if(F.col(c).cast("float").cast("double") != F.col(c)).alias(f"lossy_{c}") for c in doubles],
    ).first()
    casts = {}
    for c in ints:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if lo is not None and -(2**bits) <= lo and hi < 2**bits:
                casts[c] = F.col(c).cast(name)
                break
    casts.update({c: F.col(c).cast("float") for c in doubles if row[f"lossy_{c}"] == 0})
    return df.withColumns(casts) if casts else df


def category_columns(df: DataFrame, ratio: float = 0.5) -> list[str]:
    """Text columns whose distinct share is below a ratio."""
    texts = [c for c, t in df.dtypes if t == "string"]
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_distinct(c).alias(c) for c in texts]).first()
    return [c for c in texts if row["__n"] and row[c] / row["__n"] < ratio]


def clean_data(
    df: DataFrame, missing_threshold: float = 0.3, log_scale: Sequence[str] = (), constant: bool = True,
    fill_with: float | None = 0.0,
) -> DataFrame:
    """Drop sparse and constant columns, log-scale positive ones, clear non-finite values."""
    out = drop_sparse(df, missing_threshold)
    out = drop_constant(out) if constant else out
    doubles = [c for c, t in out.dtypes if t in ("double", "float")]
    out = clean_nonfinite(out, doubles, fill_with)
    return log1p_positive(out, [c for c in log_scale if c in out.columns]) if log_scale else out


# Correlation

def _pair_rows(df: DataFrame, pairs: dict[tuple[str, str], Column]) -> DataFrame:
    one = df.agg(*[c.alias(f"p{i}") for i, c in enumerate(pairs.values())])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.inline(rows))


def value_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n, upto, dense) of all columns in one frame: rows with the value, rows up to it, its place among the values."""
    long = unpivot_numeric(df, [], cols).where(F.col("value").isNotNull())
    counts = stable(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return stable(running(counts, ["column"], ["value"], {"upto": ("sum", F.col("n")), "dense": ("sum", F.lit(1).cast("long"))}))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank; the ranks of all columns come from one frame of distinct values."""
    ranks = value_ranks(df, cols).select("column", "value", (F.col("upto") - (F.col("n") - 1) / 2).alias("__rank"))
    for c in cols:
        own = ranks.where(F.col("column") == c).select(F.col("value").alias("__v"), "__rank")
        df = df.join(own, F.col(c).cast("double") == F.col("__v"), "left").withColumn(c, F.col("__rank")).drop("__rank", "__v")
    return df


def kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r): exact tau-b of all pairs of columns in O(n log n) each, in the same few jobs.

    Pairs share one frame keyed by pair and the dense ranks of their columns. The rank of b is read bit by bit. Two rows
    first differ at one bit; there, within the shared higher bits, rows with bit 0 and bit 1 in the order of a give the
    concordant and discordant pairs from one running sum. Rows without either value do not count for a pair.
    """
    cols = sorted({c for p in pairs for c in p})
    ranks = value_ranks(df, cols)
    most = ranks.agg(F.max("dense")).first()[0] or 1
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), number[a].alias("x"), number[b].alias("y")) for a, b in pairs])
    f = df.select(F.inline(both)).where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    f = stable(f.join(ranks.select(F.col("column").alias("b"), F.col("value").alias("y"), (F.col("dense") - 1).alias("yr")), ["b", "y"]))
    levels = F.array(*[F.lit(b) for b in range(max(1, math.ceil(math.log2(max(most, 2)))))])
    rows = f.select("a", "b", "x", "yr", "n", F.explode(levels).alias("level"))
    one = F.call_function("shiftright", F.col("yr"), F.col("level")).bitwiseAND(F.lit(1)) == 1
    prefix = F.call_function("shiftright", F.col("yr"), F.col("level") + 1)
    steps = rows.groupBy("a", "b", "level", prefix.alias("prefix"), "x").agg(
        F.sum(F.when(one, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(~one, F.col("n")).otherwise(0)).alias("zeros"))
    seen = running(stable(steps), ["a", "b", "level", "prefix"], ["x"], {"b1": ("sum", F.col("ones")), "b0": ("sum", F.col("zeros"))}, exclusive=True)
    product = lambda m, n: F.sum(F.coalesce(F.col(m), F.lit(0)).cast("decimal(19,0)") * F.col(n).cast("decimal(19,0)"))
    found = seen.groupBy("a", "b").agg(product("b0", "ones").alias("con"), product("b1", "zeros").alias("dis"))

    def ties(c: str) -> DataFrame:
        m = F.col("m").cast("decimal(19,0)")
        return f.groupBy("a", "b", c).agg(F.sum("n").alias("m")).groupBy("a", "b").agg(F.sum(m * (m - 1)).alias(f"t{c}"), F.sum("m").alias(f"n{c}"))

    out = found.join(ties("x"), ["a", "b"]).join(ties("yr"), ["a", "b"])
    n = F.col("nx").cast("decimal(19,0)")
    free = lambda t: F.sqrt((n * (n - 1) - F.col(t)).cast("double"))
    r = 2 * (F.col("con") - F.col("dis")).cast("double") / F.nullif(free("tx") * free("tyr"), F.lit(0.0))
    listed = df.sparkSession.createDataFrame(list(pairs), "a string, b string")  # one row per pair of columns
    return listed.join(out.select("a", "b", r.alias("r")), ["a", "b"], "left")


def kendall_tau(df: DataFrame, x: str, y: str) -> float | None:
    return kendall_pairs(df, [(x, y)]).first()["r"]


def corr_pairs(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(a, b, r) for the upper triangle of the numeric columns; rows need all values for rank methods."""
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    if method == "kendall":
        return kendall_pairs(df, pairs)
    if method == "spearman":
        df = average_ranks(df.select(*cols).na.drop(), cols)
    as_double = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return _pair_rows(as_double, {(a, b): F.corr(a, b) for a, b in pairs})


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def pairs_over(pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """Pairs at or above a threshold, by default mean + two standard deviations of all."""
    if threshold is None:
        cut = pairs.agg(F.avg("r") + 2 * F.stddev_samp("r")).first()[0]
        threshold = cut if cut is not None else float("inf")
    return pairs.where(F.col("r") >= threshold)


def prune_by_variance(df: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of each strongly correlated pair drop the column with the higher variance."""
    strong = pairs.where(F.abs("r") > threshold).orderBy("a", "b").collect()  # column pairs, not data
    cols = sorted({c for p in strong for c in (p["a"], p["b"])})
    if not cols:
        return df
    var = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    return df.drop(*{p["a"] if var[p["a"]] > var[p["b"]] else p["b"] for p in strong})


def prune_upper(df: DataFrame, pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Drop a column correlated above the threshold with an earlier one."""
    strong = pairs.where(F.abs("r") > threshold).collect()  # column pairs, not data
    return df.drop(*{p["b"] for p in strong})


def corr_target(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of each column with the label, strongest first."""
    df, y = df.withColumnRenamed(y, "__y"), "__y"
    long = unpivot_numeric(df, [y], [c for c in cols if c != y])
    out = long.groupBy("column").agg(F.corr("value", F.col(y).cast("double")).alias("r"))
    return out.orderBy(F.desc(F.abs("r")), "column")


def keep_correlated(pairs: DataFrame, threshold: float = 0.12) -> DataFrame:
    """Columns whose mean absolute correlation with the others reaches a threshold."""
    both = pairs.select(F.col("a").alias("column"), "r").unionByName(pairs.select(F.col("b").alias("column"), "r"))
    return both.groupBy("column").agg(F.avg(F.abs("r")).alias("mean_r")).where(F.col("mean_r") >= threshold)


# Distribution

def detect_outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Per column: bounds and how many values lie outside."""
    bounds = iqr_bounds(df, cols, k)
    long = unpivot_numeric(df, [], cols)
    joined = long.join(F.broadcast(bounds), "column")  # one row per column
    return joined.groupBy("column").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("n_outliers"),
    )


def drop_outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    for b in iqr_bounds(df, cols, k).collect():  # one row per column
        df = df.where(F.col(b["column"]).between(b["lo"], b["hi"]))
    return df


def skew_report(df: DataFrame, cols: Sequence[str], threshold: float = 1.0) -> DataFrame:
    return skewed(df, cols, threshold)


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / bins
    i = F.floor((v - lo) / F.nullif(width, F.lit(0.0))).cast("int")
    return F.coalesce(F.least(i, F.lit(bins - 1)), F.lit(0))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 10, min_unique: int = 10) -> DataFrame:
    """Counts per equal-width bin for columns with enough distinct values."""
    counts = unpivot_numeric(df, [], cols).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("u"))
    rows = counts.join(F.broadcast(shape.where(F.col("u") >= min_unique)), "column")  # one row per column
    b = _bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    return rows.groupBy("column", b).agg(F.sum("n").alias("n"))


def density(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts on an equal-width grid."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    edge = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = attach(rows, edge)
    return rows.groupBy(
        _bin(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("x_bin"), _bin(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("y_bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def top_separating(df: DataFrame, y: str, features: Sequence[str], n: int) -> DataFrame:
    """Features by the gap of their class means."""
    df, y = df.withColumnRenamed(y, "__y"), "__y"
    long = unpivot_numeric(df, [y], features)
    means = long.groupBy("column").agg(
        F.avg(F.when(F.col(y) == 0, F.col("value"))).alias("mean_0"), F.avg(F.when(F.col(y) == 1, F.col("value"))).alias("mean_1"))
    gap = means.withColumn("gap", F.abs(F.col("mean_1") - F.col("mean_0")))
    return gap.orderBy(F.desc("gap"), "column").limit(n)


def age_match(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two age sources: match, mismatch or missing, with counts."""
    state = F.when(F.col(a).isNull() | F.col(b).isNull(), "missing").when(F.col(a) == F.col(b), "match").otherwise("mismatch")
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def age_crosstab(df: DataFrame, a: str, b: str, width: int = 10, hi: int = 100) -> DataFrame:
    """Decade of one source against decade of the other."""
    labels = [f"{i}-{i + width - 1}" for i in range(0, hi, width)]
    rows = df.select(width_bin(F.col(a), width, hi).alias("a_bin"), width_bin(F.col(b), width, hi).alias("b_bin"))
    return crosstab(rows.na.drop(), "a_bin", "b_bin", labels)
