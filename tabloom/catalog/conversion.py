"""Conversion jobs: order months per customer are the snapshots."""

from datetime import date

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.plans import conversion as V

TARGET = date(1998, 6, 1)
SNAP_SQL = """snap as (select o_custkey as member_id, last_day(o_orderdate) as month_end, count(*) as usage_count,
  max(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as used_flag,
  case when o_custkey % 5 = 0 then 'Inactive' else 'Active' end as status,
  cast((year(last_day(o_orderdate)) - 1998) * 12 + month(last_day(o_orderdate)) + o_custkey % 9 - 5 as int) as tenure
  from orders group by all)"""
FLAGS_SQL = SNAP_SQL + """,
flags as (select member_id, max(case when month_end between date '1998-06-01' and date '1998-06-30' and used_flag = 1 then 1 else 0 end) as used_in_target_month,
  max(case when month_end between date '1997-12-01' and date '1998-05-31' and used_flag = 1 then 1 else 0 end) as used_in_lookback,
  max(case when month_end = date '1998-06-30' then status end) as status, max(case when month_end = date '1998-06-30' then tenure end) as tenure
  from snap group by member_id),
conv as (select *, case when used_in_target_month = 1 and used_in_lookback = 0 then 1 else 0 end as converted from flags)"""


def snap(t):
    day = F.last_day(F.to_date("o_orderdate"))
    rows = t.orders.select(F.col("o_custkey").alias("member_id"), day.alias("month_end"),
                           F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent"))
    out = rows.groupBy("member_id", "month_end").agg(F.count("*").alias("usage_count"), F.max("urgent").alias("used_flag"))
    return out.selectExpr("*", "case when member_id % 5 = 0 then 'Inactive' else 'Active' end as status",
                          "cast((year(month_end) - 1998) * 12 + month(month_end) + member_id % 9 - 5 as int) as tenure")


def flags(t):
    return V.conversion_member_flags(snap(t), TARGET, 6, "used_flag", ["status", "tenure"])


USAGE = [f"case when (c_custkey + {i}) % {i + 4} = 0 then cast({i} as double) when c_custkey % 7 = 0 then null else 0 end as usage_{i}m" for i in range(1, 7)]
ANY = " or ".join(f"usage_{i}m > 0" for i in range(1, 7))


@query("usage_flags", f"""with s as (select c_custkey, {', '.join(USAGE)}, case when c_acctbal > 5000 then 1 else 0 end as mtd from customer)
select c_custkey, case when {ANY} then 1 else 0 end as usage_6m_flag, case when mtd > 0 then 1 else 0 end as usage_flag from s""")
def _usage(t):
    rows = t.customer.selectExpr("c_custkey", *USAGE, "case when c_acctbal > 5000 then 1 else 0 end as mtd")
    out = V.usage_flags(rows, {"usage_6m_flag": [f"usage_{i}m" for i in range(1, 7)], "usage_flag": ["mtd"]})
    return out.select("c_custkey", "usage_6m_flag", "usage_flag")


@query("conversion_member_flags", f"with {FLAGS_SQL} select * from conv")
def _flags(t):
    return flags(t)


METRICS_SQL = FLAGS_SQL + """,
a as (select * from conv where status = 'Active'),
m as (select count(distinct member_id) as active_members, cast(sum(used_in_target_month) as bigint) as used_in_target,
  count(distinct member_id) filter (used_in_lookback = 1) as used_in_lookback, count(distinct member_id) filter (used_in_lookback = 0) as eligible,
  count(distinct member_id) filter (converted = 1) as converted,
  count(distinct member_id) filter (used_in_lookback = 0 and used_in_target_month = 0) as never_used,
  count(distinct member_id) filter (tenure < 6) as new_members, count(distinct member_id) filter (tenure < 6 and converted = 1) as new_converted from a)"""


@query("conversion_metrics", f"""with {METRICS_SQL} select *, active_members as total_members,
  case when eligible > 0 then converted / eligible else 0 end as conversion_rate,
  case when new_members > 0 then new_converted / new_members else 0 end as new_conversion_rate from m""")
def _metrics(t):
    return V.conversion_metrics(flags(t))


@query("modeling_frame", f"""with {FLAGS_SQL} select s.*, converted, used_in_target_month, used_in_lookback
from snap s join conv c on c.member_id = s.member_id where s.month_end = date '1998-06-30' and c.status = 'Active'""")
def _frame(t):
    return V.modeling_frame(snap(t), flags(t), TARGET)


@query("time_window_split", f"""with {SNAP_SQL} select 'train' as part, count(*) as n, cast(sum(used_flag) as bigint) as positives, avg(used_flag) as rate
from snap where month_end between date '1997-12-01' and date '1998-05-31'
union all select 'test', count(*), cast(sum(used_flag) as bigint), avg(used_flag) from snap where month_end between date '1998-06-01' and date '1998-06-30'""")
def _split(t):
    return V.split_stats(*V.time_window_split(snap(t), "month_end", TARGET), "used_flag")


MONTHLY = {"gf_usage": 3, "pl_usage": 5, "vod_usage": 7, "checkin_perc": 11}
MEMBER = ["c_custkey as member_id", *[
    f"cast(case when (c_custkey + {i}) % {m} = 0 then 0 else (c_custkey * {i + m}) % 13 end as double) as {p}_{i}m"
    for p, m in MONTHLY.items() for i in range(1, 7)],
    "cast(c_custkey % 17 as double) as gf_usage_avg", "cast(c_custkey % 19 as double) as gf_usage_avg_l3m",
    "cast(c_custkey % 23 as double) as pl_usage_avg", "cast(c_custkey % 29 as double) as pl_usage_avg_l3m",
    "cast(c_custkey % 31 as double) as vod_usage_avg_l3m", "cast(c_custkey % 37 as double) as pref_club_av_checkin_perc_l6m",
    "cast(c_custkey % 41 as double) as pref_club_age", "cast(c_custkey % 43 + 18 as double) as age",
    "cast(c_custkey % 47 as double) as av_spend_l3m", "cast(c_custkey % 53 as double) as av_spend_l6m",
    "cast(c_custkey % 20 as int) as tenure_in_months"]
OUT = ["gf_usage_momentum", "vod_usage_momentum", "checkin_std", "gf_recent_ratio", "low_gf_high_recent", "used_pl_recent",
       "months_since_gf", "months_since_checkin", "pl_decay", "gf_trend", "visit_type_entropy", "tenure_bin_mid",
       "checkin_perc_per_club_age", "spend_momentum", "checkin_std_x_tenure", "gf_momentum_x_recency", "months_since_gf_x_avg"]
ROUND = ["gf_usage_momentum", "vod_usage_momentum", "checkin_std", "gf_recent_ratio", "visit_type_entropy", "checkin_perc_per_club_age",
         "spend_momentum", "checkin_std_x_tenure", "gf_momentum_x_recency"]


def last_positive(p):
    return "case " + " ".join(f"when {p}_{i}m > 0 then {i}" for i in range(6, 0, -1)) + " else 7 end"


@query("member_features", f"""with s as (select {', '.join(MEMBER)} from customer),
q as (select quantile_cont(gf_usage_avg, 0.25) as lo, quantile_cont(gf_usage_avg_l3m, 0.75) as hi from s),
f as (select *, (gf_usage_1m + gf_usage_2m + gf_usage_3m) / 3 - (gf_usage_4m + gf_usage_5m + gf_usage_6m) / 3 as gf_usage_momentum,
  (vod_usage_1m + vod_usage_2m + vod_usage_3m) / 3 - (vod_usage_4m + vod_usage_5m + vod_usage_6m) / 3 as vod_usage_momentum,
  list_stddev_samp([checkin_perc_1m, checkin_perc_2m, checkin_perc_3m, checkin_perc_4m, checkin_perc_5m, checkin_perc_6m]) as checkin_std,
  gf_usage_avg_l3m / (gf_usage_avg + 0.01::double) as gf_recent_ratio,
  case when gf_usage_avg <= lo and gf_usage_avg_l3m >= hi then 1 else 0 end as low_gf_high_recent,
  case when pl_usage_1m > 0 then 1 else 0 end as used_pl_recent, {last_positive('gf_usage')} as months_since_gf,
  {last_positive('checkin_perc')} as months_since_checkin, pl_usage_1m - pl_usage_6m as pl_decay,
  case when gf_usage_1m > gf_usage_6m then 1 else 0 end as gf_trend,
  gf_usage_avg_l3m + pl_usage_avg_l3m + vod_usage_avg_l3m + 1e-9 as tot,
  case when tenure_in_months > 3 and tenure_in_months <= 12 then 1 else 0 end as tenure_bin_mid,
  pref_club_av_checkin_perc_l6m / (pref_club_age + 1) as checkin_perc_per_club_age, av_spend_l3m / (av_spend_l6m + 0.01::double) as spend_momentum
  from s cross join q),
g as (select *, -({' + '.join(f'({x} / tot) * log2({x} / tot + 1e-6)' for x in ('gf_usage_avg_l3m', 'pl_usage_avg_l3m', 'vod_usage_avg_l3m'))}) as visit_type_entropy,
  checkin_std * tenure_in_months as checkin_std_x_tenure, gf_usage_momentum * gf_recent_ratio as gf_momentum_x_recency,
  months_since_gf * gf_usage_avg_l3m as months_since_gf_x_avg from f)
select member_id, {', '.join(f'round({c}, 5) as {c}' if c in ROUND else c for c in OUT)} from g""")
def _features(t):
    out = V.member_features(t.customer.selectExpr(*MEMBER))
    return out.select("member_id", *[F.round(c, 5).alias(c) if c in ROUND else F.col(c) for c in OUT])


@query("monthly_score_merge", """select d.doc_id, n_chars / 1000.0::double as score, coalesce(quality, 0) as quality from documents d
left join labels l on l.doc_id = d.doc_id""")
def _merge(t):
    scored = t.documents.selectExpr("doc_id", "n_chars / 1000.0D as score")
    return V.monthly_score_merge(scored, t.labels, "doc_id", "quality")
