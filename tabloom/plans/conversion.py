"""Monthly conversion analytics on entity × month-end snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import entropy, ratio, recency, row_mean, row_std
from tabloom.operators.ordered import quantiles
from tabloom.operators.relational import clean_nonfinite, dedupe, finite

MONTHS = range(1, 7)


def month_edges(target: date, lookback: int = 6) -> dict[str, date]:
    """First and last day of the target month and of the lookback window."""
    def shift(d, n):
        y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
        return date(y, m + 1, 1)

    start = target.replace(day=1)
    day = lambda d: date.fromordinal(d.toordinal() - 1)
    return {
        "start": start, "end": day(shift(start, 1)),
        "lookback_start": shift(start, -lookback), "lookback_end": day(start),
    }


def any_positive(cols: Sequence[str]) -> Column:
    return F.when(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in cols]), 1).otherwise(0)


def usage_flags(snap: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 per group: any of its columns above zero (NULL is not)."""
    return snap.withColumns({name: any_positive(cols) for name, cols in groups.items()})


def conversion_member_flags(
    snap: DataFrame, target: date, lookback: int, used: str, attrs: Sequence[str],
    key: str = "member_id", month: str = "month_end",
) -> DataFrame:
    """Per member: used in the target month, used in the lookback, converted, latest attributes."""
    e = month_edges(target, lookback)
    in_target = F.col(month).between(e["start"], e["end"]) & (F.col(used) == 1)
    in_lookback = F.col(month).between(e["lookback_start"], e["lookback_end"]) & (F.col(used) == 1)
    at_end = F.col(month) == F.lit(e["end"])
    flags = snap.groupBy(key).agg(
        F.max(F.when(in_target, 1).otherwise(0)).alias("used_in_target_month"),
        F.max(F.when(in_lookback, 1).otherwise(0)).alias("used_in_lookback"),
        F.min(F.when(at_end, F.struct(*attrs))).alias("__last"),
    )
    converted = (F.col("used_in_target_month") == 1) & (F.col("used_in_lookback") == 0)
    return flags.withColumn("converted", F.when(converted, 1).otherwise(0)).select(
        key, "used_in_target_month", "used_in_lookback", "converted", "__last.*")


def conversion_metrics(flags: DataFrame, status: str = "status", tenure: str = "tenure", key: str = "member_id") -> DataFrame:
    """Counts and rates among active members, as one row."""
    new = F.col(tenure) < 6
    n = lambda rule: F.count_distinct(F.when(rule, F.col(key)))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)
    counts = flags.where(F.col(status) == "Active").agg(
        F.count_distinct(key).alias("active_members"),
        F.coalesce(F.sum("used_in_target_month"), F.lit(0)).alias("used_in_target"),
        n(F.col("used_in_lookback") == 1).alias("used_in_lookback"),
        n(F.col("used_in_lookback") == 0).alias("eligible"),
        n(F.col("converted") == 1).alias("converted"),
        n((F.col("used_in_lookback") == 0) & (F.col("used_in_target_month") == 0)).alias("never_used"),
        n(new).alias("new_members"), n(new & (F.col("converted") == 1)).alias("new_converted"),
    )
    return counts.withColumns({
        "total_members": F.col("active_members"),
        "conversion_rate": rate("converted", "eligible"),
        "new_conversion_rate": rate("new_converted", "new_members"),
    })


def modeling_frame(
    snap: DataFrame, flags: DataFrame, target: date, key: str = "member_id", month: str = "month_end",
    status: str = "status",
) -> DataFrame:
    """One target-month row per active member with its labels."""
    end = month_edges(target)["end"]
    rows = dedupe(snap.where(F.col(month) == F.lit(end)), [key], [c for c in snap.columns if c != key])
    active = flags.where(F.col(status) == "Active").select(key, "converted", "used_in_target_month", "used_in_lookback")
    return rows.join(active, key)


def time_window_split(
    df: DataFrame, ts: str, target: date, lookback: int = 6
) -> tuple[DataFrame, DataFrame]:
    """(train = lookback months, test = target month)."""
    e = month_edges(target, lookback)
    return (
        df.where(F.col(ts).between(e["lookback_start"], e["lookback_end"])),
        df.where(F.col(ts).between(e["start"], e["end"])),
    )


def split_stats(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    stats = lambda d, name: d.agg(
        F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("positives"),
        F.coalesce(F.avg(y), F.lit(0.0)).alias("rate"))
    return stats(train, "train").unionByName(stats(test, "test"))


def member_features(df: DataFrame) -> DataFrame:
    """Engineered columns from monthly usage: momentum, ratios, recency, entropy, bins, interactions.

    Families gf, pl and vod hold ``<family>_usage_1m`` … ``_6m``; checkin_perc
    likewise; averages end in ``_avg`` and ``_avg_l3m``.
    """
    c = F.col
    months = {f: [c(f"{f}_usage_{i}m") for i in MONTHS] for f in ("gf", "pl", "vod")}
    checkin = [c(f"checkin_perc_{i}m") for i in MONTHS]
    bounds = {r["column"]: r for r in quantiles(df, ["gf_usage_avg", "gf_usage_avg_l3m"], {"low": 0.25, "high": 0.75}).collect()}
    one = lambda rule: F.when(rule, 1).otherwise(0)
    new: dict[str, Column] = {}
    for f, cols in months.items():
        new[f"{f}_usage_momentum"] = row_mean(cols[:3]) - row_mean(cols[3:])
        new[f"used_{f}_recent"] = one(cols[0] > 0)
        new[f"{f}_decay"] = cols[0] - cols[5]
    for f in ("gf", "pl"):
        recent = ratio(c(f"{f}_usage_avg_l3m"), c(f"{f}_usage_avg"), 0.01)
        new[f"{f}_recent_ratio"] = recent
        new[f"{f}_momentum_ratio"] = recent
        new[f"{f}_trend"] = one(months[f][0] > months[f][5])
        new[f"months_since_{f}"] = recency(months[f])["last_positive_index"]
    new["months_since_checkin"] = recency(checkin)["last_positive_index"]
    new["checked_in_recent"] = one(checkin[0] > 0)
    new["checkin_std"] = row_std(checkin)
    new["checkin_perc_per_club_age"] = ratio(c("pref_club_av_checkin_perc_l6m"), c("pref_club_age"), 1.0)
    low, high = bounds["gf_usage_avg"]["low"], bounds["gf_usage_avg_l3m"]["high"]
    new["low_gf_high_recent"] = one((c("gf_usage_avg") <= low) & (c("gf_usage_avg_l3m") >= high))
    new["visit_type_entropy"] = entropy([c("gf_usage_avg_l3m"), c("pl_usage_avg_l3m"), c("vod_usage_avg_l3m")])
    new["tenure_bin_new"] = one(c("tenure_in_months") <= 3)
    new["tenure_bin_mid"] = one((c("tenure_in_months") > 3) & (c("tenure_in_months") <= 12))
    new["tenure_bin_veteran"] = one(c("tenure_in_months") > 12)
    new["checkin_perc_age_ratio"] = ratio(c("pref_club_av_checkin_perc_l6m"), c("age"), 1.0)
    new["spend_momentum"] = ratio(c("av_spend_l3m"), c("av_spend_l6m"), 0.01)
    new["tenure_checkin_combo"] = c("tenure_in_months") * c("pref_club_av_checkin_perc_l6m")
    products = {
        "checkin_std_x_gf_recent": ("checkin_std", "used_gf_recent"),
        "gf_momentum_x_recency": ("gf_usage_momentum", "gf_momentum_ratio"),
        "pl_decay_x_recent": ("pl_decay", "used_pl_recent"),
        "checkin_std_x_tenure": ("checkin_std", "tenure_in_months"),
        "gf_recent_x_momentum": ("gf_usage_avg_l3m", "gf_usage_momentum"),
        "months_since_gf_x_avg": ("months_since_gf", "gf_usage_avg_l3m"),
    }
    out = df.withColumns(new)
    out = out.withColumns({n: c(a) * c(b) for n, (a, b) in products.items()})
    made = [*new, *products]
    doubles = [n for n, t in out.dtypes if t == "double"]
    out = clean_nonfinite(out, doubles)
    return out.na.fill(0, subset=[n for n, t in out.dtypes if n in made or t == "double"])


def monthly_score_merge(scored: DataFrame, actuals: DataFrame, key: str, label: str) -> DataFrame:
    """Scores beside actual labels; members without a label count as 0."""
    return scored.join(actuals.select(key, label), key, "left").na.fill(0, subset=[label])


def numeric_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only the training features, numeric, in order; absent ones are 0."""
    cols = []
    for f in features:
        value = finite(F.col(f).try_cast("double")) if f in df.columns else F.lit(0.0)
        cols.append(F.coalesce(value, F.lit(0.0)).alias(f))
    return df.select(*cols)
