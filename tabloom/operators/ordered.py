"""Ordered computations that stay distributed whatever the size of a group.

Every function here cuts the rows into pieces: ranges of (keys, order) whose
limits are values, drawn from the rows by hash in one narrow job. A piece is a plain function of
a row, so it is the same whenever a part of the plan runs again, and windows
over (piece, keys) never hold more than a piece. What a key's earlier pieces
add up to is carried into the later ones by a join with one row per piece.
The plan is the same for every size; the rows themselves move once. An input
that is dear to compute should be cut with ``stable`` first: it is read by the
draw, by the totals and by the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PIECES = 2  # pieces per task; they are dealt to the tasks in turn
DRAWS = 16  # rows drawn per piece to find its limits
CHARS = 16  # of a text, so many characters stand in a limit

Order = Sequence[str | tuple[str, str]]  # column names, or (name, "desc")


def _named(order: Order) -> list[tuple[str, bool]]:
    """(name, whether it falls) of every order column."""
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in order]


def sort_columns(order: Order, back: bool = False) -> list[Column]:
    """Sort expressions: rising with nulls first or falling with nulls last; ``back`` gives the reverse."""
    return [F.col(f"`{n}`").desc_nulls_last() if fall != back else F.col(f"`{n}`").asc_nulls_first() for n, fall in _named(order)]


def _turned(c: Column) -> Column:
    """A text whose rising order is the falling order of the given one: digits of its bytes turned round, and an end above them all."""
    return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _rising(df: DataFrame, name: str, fall: bool) -> Column:
    """A value whose rising order is the wanted order of the column."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if not fall:
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # NaN is the greatest
        rank = F.when(c.isNull(), 2).when(F.isnan(c), 0).otherwise(1)
        return F.struct(rank, F.when(F.isnan(c), F.lit(0.0)).otherwise(-c))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        turned = _turned(c)
    elif isinstance(kind, T.BooleanType):
        turned = ~c
    elif isinstance(kind, T.DecimalType):
        turned = -c
    elif isinstance(kind, T.DateType):
        turned = -F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        turned = F.bitwise_not(F.unix_micros(c))
    elif isinstance(kind, T.IntegralType):
        turned = F.bitwise_not(c)
    else:
        raise TypeError(f"cannot order by falling {kind.simpleString()}")
    return F.struct(c.isNull(), turned)


def rising(df: DataFrame, order: Order) -> Column:
    """The place of a row in the order as one comparable value."""
    return F.struct(F.lit(0).alias("__"), *[_rising(df, n, fall).alias(f"o{i}") for i, (n, fall) in enumerate(_named(order))])


def _coarse(df: DataFrame, order: Order) -> list[Column]:
    """The order as numbers and short strings that rise with it, if not strictly; up to the first column without such a form."""
    out, whole = [], None  # whole: no text so far was cut
    for n, fall in _named(order):
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(kind, T.DateType):
            c = F.unix_date(c)
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, (T.BooleanType, T.IntegralType)):
            c = c.cast("long")
        elif isinstance(kind, T.BinaryType):
            c = F.hex(c)
        elif not isinstance(kind, (T.StringType, T.FloatType, T.DoubleType, T.DecimalType)):
            return out
        made = []
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = c.cast("double")
            rank = F.when(c.isNull(), 0).when(F.isnan(value), 2).otherwise(1)
            value = F.when(~F.isnan(value), value)
            made += [-rank, -value] if fall else [rank, value]
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            # long texts count by their beginning; of them nothing behind it may decide
            cut = F.coalesce(F.char_length(c) > CHARS, F.lit(False))
            short = F.left(c, F.lit(CHARS))
            made += [c.isNull().cast("int"), _turned(short), (~cut).cast("int")] if fall else [short, cut.cast("int")]
        elif fall:
            made += [c.isNull().cast("int"), -c if isinstance(kind, T.DecimalType) else F.bitwise_not(c)]
        else:
            made += [c]
        out += [m if whole is None else F.when(whole, m) for m in made]
        if isinstance(kind, (T.StringType, T.BinaryType)):
            whole = ~cut if whole is None else whole & ~cut
    return out


def _limits(rows: DataFrame, pieces: int) -> Column:
    """Sorted array of up to ``pieces`` + 1 places.

    Of every slot of the places' hashes the smallest hash is drawn, so the draw
    is even, has a bound and needs no count beforehand.
    """
    kind, h = rows.schema["__at"].dataType, F.xxhash64("__at")
    drawn = rows.groupBy(F.pmod(h, F.lit(pieces * DRAWS)).alias("slot")).agg(F.min_by("__at", h).alias("at"))
    drawn = drawn.agg(F.sort_array(F.collect_list("at")).alias("a"))  # one place per slot
    every = F.greatest(F.lit(1), F.ceil(F.size("a") / F.lit(float(pieces))).cast("int"))
    # one row for the driver, a few bytes per piece
    found = drawn.select("a", every.alias("every")).select(F.to_json(F.filter("a", lambda x, i: i % F.col("every") == 0))).first()[0]
    return F.from_json(F.lit(found), T.ArrayType(kind))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``__task``, every task with the same number of pieces; windows over (__task, __piece, keys) need no other exchange."""
    tasks = _tasks(rows)
    return rows.withColumn("__task", F.col("__piece") % tasks).repartitionById(tasks, "__task")


def in_pieces(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """``df`` with ``__piece``, and ``__split``: whether the row's key may lie in several pieces."""
    pieces = PIECES * _tasks(df)
    key = F.xxhash64(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0).cast("long")
    place = [c.alias(f"o{i}") for i, c in enumerate(_coarse(df, order))]
    rows = df.withColumn("__at", F.struct(key.alias("key"), *place))
    # Asking for the task at hand keeps the optimizer from repeating the limits in every step, or the search in filters.
    task = F.spark_partition_id()
    rows = rows.withColumn("__limits", F.when(task >= 0, _limits(rows, pieces)))
    limits, piece, at = F.col("__limits"), F.col("__piece"), F.col("__at")
    rows = rows.withColumn("__piece", F.lit(0))
    for b in reversed(range((pieces + 1).bit_length())):  # binary search: how many limits are at or below the row
        rows = rows.withColumn("__piece", F.when(F.get(limits, piece + ((1 << b) - 1)) <= at, piece + (1 << b)).otherwise(piece))
    same = lambda i: F.coalesce(F.get(limits, i)["key"] == at["key"], F.lit(False))
    rows = rows.withColumn("__piece", piece + task * 0)
    return rows.withColumn("__split", same(piece - 1) | same(piece)).drop("__at", "__limits")


_LOCAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(local + carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def _matches(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the key columns with their renamed copies, and of the pieces."""
    same = F.col("__piece") == F.col(f"{prefix}piece")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"{prefix}k{i}"))
    return same


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col("__piece").alias(f"{prefix}piece"), *[F.col(f"`{k}`").alias(f"{prefix}k{i}") for i, k in enumerate(keys)]]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    aggs: dict[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Running sum/max/min/last-non-null per key in a total order.

    ``exclusive`` leaves the current row out of its own frame.
    """
    keys = list(keys)
    rows = df.select("*", *[c.alias(f"__in_{n}") for n, (_, c) in aggs.items()])
    rows = in_pieces(rows, keys, order)
    frame = Window.partitionBy("__task", "__piece", *keys).orderBy(*sort_columns(order)).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    local = _dealt(rows).select("*", *[_LOCAL[k](F.col(f"__in_{n}")).over(frame).alias(f"__loc_{n}") for n, (k, _) in aggs.items()])

    def total(name: str, kind: str) -> Column:
        value = F.col(f"__in_{name}")
        whole = F.max_by(value, F.when(value.isNotNull(), rising(rows, order))) if kind == "last" else _LOCAL[kind](value)
        return whole.alias(f"__in_{name}")

    totals = rows.where("__split").groupBy("__piece", *keys).agg(*[total(n, k) for n, (k, _) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*_renamed(keys, "__c_"), *[_LOCAL[k](F.col(f"__in_{n}")).over(before).alias(f"__car_{n}") for n, (k, _) in aggs.items()])
    # carry holds rows of split keys only, at most two per piece (and those whose hashes are equal)
    out = local.join(F.broadcast(carry), _matches(keys, "__c_"), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[_combine(k, F.col(f"__loc_{n}"), F.col(f"__car_{n}")).alias(n) for n, (k, _) in aggs.items()],
    )


def position(df: DataFrame, keys: Sequence[str], order: Order, name: str = "rn") -> DataFrame:
    """1-based row number per key in a total order."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})


def nearby(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    halo: int,
    exprs: Callable[[object], dict[str, Column]],
) -> DataFrame:
    """Window expressions that look back at most ``halo`` rows (lag, rolling).

    A piece gets copies of the ``halo`` rows that its key has before it; they
    are dropped afterwards.
    """
    keys, halo = list(keys), max(1, halo)
    rows = in_pieces(df, keys, order)
    tail = Window.partitionBy("__piece", *keys).orderBy(*sort_columns(order, back=True))
    last = rows.where("__split").withColumn("__back", F.row_number().over(tail)).where(F.col("__back") <= halo)
    # at most halo rows per piece and split key: numbered through, so that short pieces are looked through
    last = last.withColumn("__no", F.row_number().over(Window.partitionBy(*keys).orderBy("__piece", F.desc("__back"))))
    first = F.min("__no")
    bins = F.array_distinct(F.array(F.floor((F.col("first") - halo) / halo), F.floor((F.col("first") - 1) / halo)))
    heads = last.groupBy("__piece", *keys).agg(first.alias("first")).select(*_renamed(keys, "__h_"), "first", F.explode(bins).alias("bin"))
    same = (F.floor(F.col("__no") / halo) == F.col("bin")) & F.col("__no").between(F.col("first") - halo, F.col("first") - 1)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__h_k{i}"))
    names = [F.col(f"`{c}`") for c in df.columns]
    copies = last.join(F.broadcast(heads), same).select(*names, F.col("__h_piece").alias("__piece"), F.lit(True).alias("__copy"))
    both = rows.select(*names, "__piece", F.lit(False).alias("__copy")).unionAll(copies)
    w = Window.partitionBy("__task", "__piece", *keys).orderBy(*sort_columns(order))
    return _dealt(both).select("*", *[c.alias(n) for n, c in exprs(w).items()]).where(~F.col("__copy")).drop("__piece", "__copy", "__task")


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach per-group columns to every row; NULL keys form a group too.

    Used in place of whole-partition windows: the statistics are combined
    map-side, and the join is open to AQE broadcast and skew splitting.
    """
    keys = list(keys)
    renamed = stats.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[c for c in stats.columns if c not in keys],
    )
    cond = None
    for i, k in enumerate(keys):
        eq = df[k].eqNullSafe(renamed[f"__k{i}"])
        cond = eq if cond is None else cond & eq
    return df.join(renamed, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate on every row, as a scalar subquery."""
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.select("*", *[one.getField(c).alias(c) for c in stats.columns])


def quantiles(df: DataFrame, cols: Sequence[str], qs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (keys, column).

    A histogram over pieces, counted for all columns in one scan, tells which
    pieces hold a wanted position; only their values are read again.
    """
    group = [*keys, "column"]
    long = unpivot_numeric(df, keys, cols).where(F.col("value").isNotNull())
    rows = in_pieces(long, group, ["value"]).drop("__split")
    bins = rows.groupBy(*group, "__piece").agg(F.count(F.lit(1)).alias("n"))
    # bins has at most one row per group and piece
    each = Window.partitionBy(*group)
    upto = F.sum("n").over(each.orderBy("__piece"))
    bins = bins.select(*group, "__piece", "n", (upto - F.col("n")).alias("before"), F.sum("n").over(each).alias("total"))
    at = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in qs.items()}
    places = [p.cast("long") for h in at.values() for p in (F.floor(h), F.ceil(h))]
    wanted = bins.where(F.exists(F.array(*places), lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))))
    wanted = wanted.select(*_renamed(group, "__w_"), "before", "total")
    held = rows.join(wanted if keys else F.broadcast(wanted), _matches(group, "__w_"))  # two rows per column and quantile
    counts = held.groupBy(*group, "__piece", "value", "before", "total").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*group, "__piece").orderBy("value")
    cum = counts.withColumn("upto", F.col("before") + F.sum("n").over(inside)).withColumn("from", F.col("upto") - F.col("n"))
    holds = lambda p: F.min(F.when((p >= F.col("from")) & (p < F.col("upto")), F.col("value")))
    ends = {}
    for name, h in at.items():
        ends[f"__lo_{name}"], ends[f"__hi_{name}"] = holds(F.floor(h)), holds(F.ceil(h))
    agg = cum.groupBy(*group).agg(F.max("total").alias("total"), *[c.alias(n) for n, c in ends.items()])
    between = {name: F.col(f"__lo_{name}") + (h - F.floor(h)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) for name, h in at.items()}
    return agg.select(*group, *[c.alias(name) for name, c in between.items()])


def unpivot_numeric(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide numeric columns to (keys, column, value); NaN counts as null."""
    number = {c: F.col(c).cast("double") for c in cols}
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.when(~F.isnan(v), v).alias("value")) for c, v in number.items()]
    )
    return df.select(*keys, F.inline(pairs))


def ntile_column(pos: Column, total: Column, n: int) -> Column:
    """SQL NTILE from a row number and a row count (larger tiles first)."""
    size, extra = F.floor(total / n), total % n
    big = extra * (size + 1)
    return F.when(pos <= big, F.ceil(pos / (size + 1))).otherwise(
        extra + F.ceil((pos - big) / F.greatest(size, F.lit(1)))
    ).cast("int")
