"""Column functions: text, dates, numbers, arrays and maps. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


# Text

def concat_blank(cols: Sequence[str], sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def split_last(c: Column) -> tuple[Column, Column]:
    """(all but the last character, last character)."""
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - 1, F.lit(0))), F.right(c, F.lit(1))


def drop_suffix(c: Column, suffix: str = ".0") -> Column:
    """Remove one literal trailing suffix."""
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def strip_set(c: Column, chars: str, side: str = "both") -> Column:
    """Strip any of a set of characters, as Python's strip does."""
    fn = {"left": F.ltrim, "right": F.rtrim, "both": F.trim}[side]
    return fn(c, F.lit(chars))


def replace_chars(c: Column, chars: str, new: str = "") -> Column:
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(new))
    return c


def split_expand(c: Column, sep: str, n: int) -> list[Column]:
    """n columns; missing parts are NULL."""
    parts = F.split(c, sep)
    return [F.get(parts, F.lit(i)) for i in range(n)]


def split_rows(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """Delimited list to trimmed, non-empty rows."""
    out = df.withColumn(col, F.explode(F.split(F.col(col), sep))).withColumn(col, F.trim(col))
    return out.where(F.col(col) != "")


def palindrome(c: Column) -> Column:
    s = F.lower(F.replace(c, F.lit(" "), F.lit("")))
    return s == F.reverse(s)


def char_counts(df: DataFrame, key: str, col: str) -> DataFrame:
    """Occurrences of each character per row key."""
    chars = F.explode(F.split(F.col(col), "")).alias("ch")
    return df.select(key, chars).where("ch <> ''").groupBy(key, "ch").agg(F.count(F.lit(1)).alias("n"))


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a set occur."""
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("int")


def token_match(cols: Sequence[str], tokens: Mapping[str, Sequence[str]]) -> Column:
    """Sorted labels whose tokens occur in the lower-cased text of any column.

    The dictionary is a parameter of fixed size, so it becomes one expression.
    """
    text = F.lower(F.concat_ws("\n", *cols))
    hits = [
        F.when(reduce(lambda a, b: a | b, [text.contains(x) for x in xs]), F.lit(label))
        for label, xs in sorted(tokens.items())
    ]
    return F.array_compact(F.array(*hits))


def clean_lines(c: Column) -> Column:
    """Strip every line and drop the empty ones."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# Dates

def age(dob: Column, as_of: Column) -> Column:
    """Completed years."""
    early = (F.month(as_of) * 100 + F.day(as_of)) < (F.month(dob) * 100 + F.day(dob))
    return F.year(as_of) - F.year(dob) - early.cast("int")


def age_between(dob: Column, lo: int, hi: int, as_of: Column) -> Column:
    return (F.add_months(dob, 12 * lo) <= as_of) & (F.add_months(dob, 12 * hi) >= as_of)


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts), "month": F.month(ts), "week": F.weekofyear(ts),
        "day": F.day(ts), "day_of_week": F.weekday(ts),
    }


def month_window(as_of: Column, lookback: int) -> dict[str, Column]:
    """Bounds of the month of ``as_of`` and of the months before it."""
    start = F.to_date(F.trunc(as_of, "month"))
    return {
        "month_start": start, "month_end": F.last_day(start),
        "lookback_start": F.add_months(start, -lookback), "lookback_end": F.date_sub(start, 1),
    }


def days_between(a: Column, b: Column, fill: int | None = None) -> Column:
    d = F.datediff(b, a)
    return d if fill is None else F.coalesce(d, F.lit(fill))


def boundary_diff(unit: str, a: Column, b: Column) -> Column:
    """Calendar boundaries crossed, not elapsed units."""
    years = F.year(b) - F.year(a)
    return years if unit == "year" else years * 12 + F.month(b) - F.month(a)


def parse_date(c: Column, fmt: str = "yyyyMMdd") -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))


def next_weekdays(d: Column, n: int) -> Column:
    """Array of the next n Monday-to-Friday dates after a date."""
    days = F.sequence(F.date_add(d, 1), F.date_add(d, n + 2 * (n // 5 + 1)))
    return F.slice(F.filter(days, lambda x: F.weekday(x) < 5), 1, n)


def next_run(last: Column, frequency: Column) -> Column:
    """Next scheduled date by frequency; unknown frequencies give NULL."""
    f = F.lower(frequency)
    to_weekday = F.when(F.weekday(last) == 4, 3).when(F.weekday(last) == 5, 2).otherwise(1)
    return (
        F.when(f == "daily", F.date_add(last, 1))
        .when(f == "weekday", F.date_add(last, to_weekday))
        .when(f == "weekly", F.date_add(last, 7))
        .when(f == "monthly", F.add_months(last, 1))
        .when(f == "quarterly", F.add_months(last, 3))
        .when(f == "annual", F.add_months(last, 12))
    )


# Numbers

def log1p_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p of the columns whose every value is above zero."""
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.log1p(c) for c in cols if low[c] is not None and low[c] > 0})


def ratio(a: Column, b: Column, eps: float) -> Column:
    return a / (b + F.lit(eps))


def _values(cols: Sequence[Column]) -> list[Column]:
    """Doubles with NaN as NULL."""
    return [F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in cols]


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean over the present values of a row; NULL when there are none."""
    v = _values(cols)
    n = _sum([c.isNotNull().cast("double") for c in v])
    return _sum(v) / F.nullif(n, F.lit(0.0))


def row_std(cols: Sequence[Column]) -> Column:
    """Sample standard deviation over the present values of a row."""
    v = _values(cols)
    n = _sum([c.isNotNull().cast("double") for c in v])
    mean = row_mean(cols)
    ss = _sum([(c - mean) * (c - mean) for c in v])
    return F.sqrt(ss / F.nullif(F.greatest(n - 1, F.lit(0.0)), F.lit(0.0)))


def entropy(cols: Sequence[Column], eps: float = 1e-9, inner: float = 1e-6) -> Column:
    """Shannon entropy (bits) of a row's values as shares."""
    vs = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols]
    total = reduce(lambda a, b: a + b, vs) + F.lit(eps)
    terms = [(v / total) * F.log2(v / total + F.lit(inner)) for v in vs]
    return -reduce(lambda a, b: a + b, terms)


def recency(cols: Sequence[Column]) -> dict[str, Column]:
    """Highest month index with a positive value and months since the most recent one.

    Columns are ordered from the most recent month back; none positive gives n + 1.
    """
    flags = F.array(*[F.coalesce(c > 0, F.lit(False)) for c in cols])
    n = len(cols)
    first = F.array_position(flags, True).cast("int")
    back = F.array_position(F.reverse(flags), True).cast("int")
    return {
        "last_positive_index": F.when(back == 0, n + 1).otherwise(n + 1 - back),
        "months_since": F.when(first == 0, n + 1).otherwise(first),
    }


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def clock_fraction(c: Column, total: float = 900.0) -> Column:
    """``MM:SS`` to a share of the period."""
    parts = F.split(c, ":")
    minutes, seconds = [F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1)]
    return (minutes * 60 + seconds) / total


def clip(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def width_bin(c: Column, width: int, hi: int) -> Column:
    """Right-closed bins (0, w], (w, 2w], … labelled ``0-9``, ``10-19``, …"""
    i = F.ceil(c / width).cast("int") - 1
    label = F.concat((i * width).cast("string"), F.lit("-"), (i * width + width - 1).cast("string"))
    return F.when((c > 0) & (c <= hi), label)


# Arrays and maps

def even_odd(arr: Column) -> Column:
    return F.create_map(
        F.lit("even"), F.filter(arr, lambda x: x % 2 == 0), F.lit("odd"), F.filter(arr, lambda x: x % 2 != 0)
    )


def flatten_where(arr: Column, pred: Callable[[Column], Column] | None = None) -> Column:
    flat = F.flatten(arr)
    return F.filter(flat, pred) if pred else flat


def sort_structs(arr: Column, spec: Sequence[tuple[str, bool]]) -> Column:
    """Sort an array of structs by fields; True means descending."""

    def compare(a, b):
        out = F.lit(0)
        for name, desc in reversed(spec):
            lo, hi = (1, -1) if desc else (-1, 1)
            out = F.when(a[name] < b[name], lo).when(a[name] > b[name], hi).otherwise(out)
        return out

    return F.array_sort(arr, compare)


def unnest(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """One row per array element, struct fields as columns; empty arrays keep their row."""
    out = df.withColumn("__e", F.explode_outer(col)).drop(col)
    fields = out.schema["__e"].dataType.names
    rest = [c for c in out.columns if c != "__e"]
    return out.select(*rest, *[F.col(f"__e.{f}").alias(f"{prefix}{f}") for f in fields])


def map_build(keys: Column, fn: Callable[[Column], Column]) -> Column:
    return F.map_from_arrays(keys, F.transform(keys, fn))


def map_invert(m: Column) -> Column:
    return F.map_from_entries(
        F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    )


def map_sum(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)


def map_scale(m: Column, factor: float, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    if keep:
        m = F.map_filter(m, keep)
    return F.transform_values(m, lambda k, v: v * factor)


def map_text(m: Column) -> Column:
    """Entries in key order as text."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ","
    )
