"""Grouped aggregates on the driver's tables."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import aggregates as A
from tabloom.operators.ordered import quantiles

CENTS = "cast(l_extendedprice as decimal(18,2))"


def cents(t):
    return t.lineitem.withColumn("price", F.expr(CENTS))


@query("group_sum", f"""select l_suppkey, l_returnflag, cast(sum({CENTS}) as double) as sum_price,
  sum(l_quantity) as sum_l_quantity from lineitem group by all""")
def _sum(t):
    out = A.group_sum(cents(t), ["l_suppkey", "l_returnflag"], ["price", "l_quantity"])
    return out.withColumn("sum_price", F.col("sum_price").cast("double"))


@query("agg_conditional_sum", """select user_id, count(*) filter (event_type = 'click') as clicks,
  count(*) filter (event_type = 'purchase' and value > 10) as big_purchases from events group by user_id""")
def _cond(t):
    return A.cond_sum(t.events, ["user_id"], {
        "clicks": F.col("event_type") == "click",
        "big_purchases": (F.col("event_type") == "purchase") & (F.col("value") > 10),
    })


@query("agg_distinct_conditional", """select l_returnflag, count(distinct l_suppkey) as n_distinct,
  count(distinct case when l_quantity > 45 then l_suppkey end) as n_large,
  count(distinct case when l_discount = 0 then l_suppkey end) as n_full_price from lineitem group by l_returnflag""")
def _distinct(t):
    return A.distinct_conditional(t.lineitem, ["l_returnflag"], "l_suppkey", {
        "n_large": F.col("l_quantity") > 45, "n_full_price": F.col("l_discount") == 0})


@query("agg_max_pivot_flags", """with c as (select user_id, event_type, count(*) as visits from events group by all)
select user_id, max(case when event_type = 'purchase' and visits >= 30 then 1 else 0 end) as buyer,
  max(case when event_type = 'purchase' and visits >= 36 then 1 else 0 end) as heavy_buyer,
  max(case when event_type = 'error' and visits >= 33 then 1 else 0 end) as troubled from c group by user_id""")
def _pivot(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("visits"))
    return A.flag_pivot(counts, ["user_id"], "event_type", "visits", {
        "buyer": ("purchase", 30), "heavy_buyer": ("purchase", 36), "troubled": ("error", 33)})


@query("agg_span_months", """select o_custkey, case when (year(max(o_orderdate)) - year(min(o_orderdate))) * 12
  + month(max(o_orderdate)) - month(min(o_orderdate)) >= 60 then 1 else 0 end as has_span from orders group by o_custkey""")
def _span(t):
    return A.has_month_span(t.orders, ["o_custkey"], "o_orderdate", 60)


@query("having_duplicates", """select l_orderkey, l_linenumber, count(*) as n from lineitem
group by l_orderkey, l_linenumber having count(*) > 1""")
def _dups(t):
    return A.dups(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("having_singletons", "select l_extendedprice from lineitem group by l_extendedprice having count(*) = 1")
def _singles(t):
    return A.singles(t.lineitem, "l_extendedprice")


@query("agg_mode", """select l_quantity, count(*) as n from lineitem group by l_quantity
having count(*) = (select max(c) from (select count(*) as c from lineitem group by l_quantity))""")
def _mode(t):
    return A.mode_all(t.lineitem, "l_quantity").select("l_quantity", "n")


@query("agg_median_builtin", "select l_returnflag, quantile_cont(l_extendedprice, 0.5) as median from lineitem group by l_returnflag")
def _median(t):
    return quantiles(t.lineitem, ["l_extendedprice"], {"median": 0.5}, ["l_returnflag"]).drop("column")


@query("agg_median_rownum", """select avg(o_totalprice) as median from (select o_totalprice,
  row_number() over (order by o_totalprice) as rn, count(*) over () as n from orders)
where rn in ((n + 1) // 2, (n + 2) // 2)""")
def _median_rn(t):
    return A.median_by_position(t.orders, "o_totalprice")


@query("agg_filtered_sum", "select cast(sum(l_partkey) as bigint) as total from lineitem where l_partkey % 2 = 0")
def _filtered(t):
    return t.lineitem.where("l_partkey % 2 = 0").agg(F.sum("l_partkey").alias("total"))


@query("agg_second_highest", "select max(l_extendedprice) as v from lineitem where l_extendedprice < (select max(l_extendedprice) from lineitem)")
def _second(t):
    return A.second_highest(t.lineitem, "l_extendedprice").withColumnRenamed("l_extendedprice", "v")


@query("agg_top_pair_product", """with v as (select c_acctbal as v from customer),
hi as (select v, row_number() over (order by v desc) as rn from v), lo as (select v, row_number() over (order by v) as rn from v)
select greatest((select v from hi where rn = 1) * (select v from hi where rn = 2),
  (select v from lo where rn = 1) * (select v from lo where rn = 2)) as max_product""")
def _pair(t):
    return A.max_pair_product(t.customer, "c_acctbal")


@query("agg_string_join", """select user_id, string_agg(distinct event_type, '; ' order by event_type) as event_type
from events group by user_id""")
def _join(t):
    return A.string_join(t.events, ["user_id"], "event_type")


@query("agg_value_counts", "select year(o_orderdate) as year, o_orderstatus, count(*) as n from orders group by all")
def _counts(t):
    return A.value_counts(t.orders.select(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus"), ["year", "o_orderstatus"])


@query("agg_class_balance", "select quality, count(*) as n, count(*) / sum(count(*)) over () as share from labels group by quality")
def _balance(t):
    return A.class_balance(t.labels, "quality")


@query("agg_crosstab", """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O,
  count(*) filter (o_orderstatus = 'P') as P from orders group by o_orderpriority""")
def _crosstab(t):
    return A.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("agg_group_mean", """select l_returnflag, round(avg(l_quantity), 6) as mean_l_quantity,
  round(avg(l_extendedprice), 6) as mean_l_extendedprice from lineitem group by l_returnflag""")
def _mean(t):
    out = A.group_mean(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


DESCRIBE_SQL = """select l_linestatus, '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean,
  round(stddev_samp({c}), 4) as std, min({c}) as min, max({c}) as max, round(quantile_cont({c}, 0.25), 4) as p25,
  round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75 from lineitem group by l_linestatus"""


@query("agg_describe", " union all ".join(DESCRIBE_SQL.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _describe(t):
    out = A.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("agg_period_rollup", f"""select 'week' as unit, user_id, cast(date_trunc('week', ts) as date) as period,
  cast(sum(cast(value as decimal(18,2))) as double) as total, count(*) as n from events group by all
union all select 'month', user_id, cast(date_trunc('month', ts) as date), cast(sum(cast(value as decimal(18,2))) as double),
  count(*) from events group by all""")
def _rollup(t):
    aggs = [F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n")]
    week, month = [A.rollup_period(t.events, "ts", u, aggs, ["user_id"]).withColumn("unit", F.lit(u)) for u in ("week", "month")]
    return week.unionByName(month)


@query("agg_share_of_total", """select l_suppkey, total, total / sum(total) over () as share from (
  select l_suppkey, sum(l_quantity) as total from lineitem group by l_suppkey)""")
def _share(t):
    return A.share(t.lineitem, "l_suppkey", "l_quantity")


@query("agg_multi_stats", """select o_orderkey, o_custkey, round(avg_l_quantity, 6) as avg_l_quantity, max_l_quantity, min_l_quantity,
  max_l_discount, sum_l_quantity from orders left join (
  select l_orderkey, avg(l_quantity) as avg_l_quantity, max(l_quantity) as max_l_quantity, min(l_quantity) as min_l_quantity,
    max(l_discount) as max_l_discount, sum(l_quantity) as sum_l_quantity from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def _multi(t):
    stats = A.multi_stats(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"],
                          {"l_quantity": ["avg", "max", "min", "sum"], "l_discount": ["max"]})
    out = t.orders.select("o_orderkey", "o_custkey").join(stats, "o_orderkey", "left")
    return out.withColumn("avg_l_quantity", F.round("avg_l_quantity", 6))


GAMES = """select cast(year(o_orderdate) as bigint) as season, o_custkey % 32 as home, o_orderkey % 32 as away,
  o_totalprice as home_score, 250000 + o_orderkey as away_score from orders"""


@query("agg_home_away", f"""with g as ({GAMES}),
h as (select season, home as team, count(*) as home_games, count(*) filter (home_score > away_score) as home_wins from g group by all),
a as (select season, away as team, count(*) as away_games, count(*) filter (away_score > home_score) as away_wins from g group by all)
select coalesce(h.season, a.season) as season, coalesce(h.team, a.team) as team, coalesce(home_games, 0) as home_games,
  coalesce(home_wins, 0) as home_wins, coalesce(away_games, 0) as away_games, coalesce(away_wins, 0) as away_wins,
  coalesce(home_wins, 0) + coalesce(away_wins, 0) as total_wins from h full join a on h.season = a.season and h.team = a.team""")
def _home(t):
    g = t.orders.selectExpr("cast(year(o_orderdate) as bigint) as season", "o_custkey % 32 as home", "o_orderkey % 32 as away",
                            "o_totalprice as home_score", "250000 + o_orderkey as away_score")
    home = A.team_record(g, "season", "home", F.col("home_score") > F.col("away_score"), "home")
    away = A.team_record(g, "season", "away", F.col("away_score") > F.col("home_score"), "away")
    out = home.join(away, ["season", "team"], "full").na.fill(0)
    return out.withColumn("total_wins", F.col("home_wins") + F.col("away_wins"))


@query("agg_mixed_first", """select l_suppkey, round(avg(l_quantity), 6) as l_quantity, round(avg(l_extendedprice), 6) as l_extendedprice,
  arg_min(l_returnflag, row(l_shipdate, l_orderkey, l_linenumber, l_returnflag)) as l_returnflag from lineitem group by l_suppkey""")
def _mixed(t):
    out = A.mixed_first(t.lineitem, ["l_suppkey"], ["l_quantity", "l_extendedprice"], ["l_returnflag"],
                        ["l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@query("agg_quantile", """select 'l_extendedprice' as "column", quantile_cont(l_extendedprice, 0.25) as q25,
  quantile_cont(l_extendedprice, 0.75) as q75, quantile_cont(l_extendedprice, 0.99) as q99 from lineitem
union all select 'l_quantity', quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.75), quantile_cont(l_quantity, 0.99) from lineitem""")
def _quantile(t):
    out = quantiles(t.lineitem, ["l_extendedprice", "l_quantity"], {"q25": 0.25, "q75": 0.75, "q99": 0.99})
    return out


@query("agg_skewness", """with v as (select c_acctbal as a, c_acctbal * c_acctbal * c_acctbal as b, exp(c_acctbal / 2000) as c from customer),
s as (select 'a' as "column", round(skewness(a), 6) as skew from v union all select 'b', round(skewness(b), 6) from v
  union all select 'c', round(skewness(c), 6) from v)
select * from s where abs(skew) > 1""")
def _skew(t):
    rows = t.customer.selectExpr("c_acctbal as a", "c_acctbal * c_acctbal * c_acctbal as b", "exp(c_acctbal / 2000) as c")
    return A.skewed(rows, ["a", "b", "c"]).withColumn("skew", F.round("skew", 6))


@query("agg_share_above_threshold", """with o as (select 'all' as grp, o_totalprice from orders union all
  select o_orderstatus, o_totalprice from orders),
s as (select grp, avg(o_totalprice) + stddev_samp(o_totalprice) as cut from o group by grp)
select o.grp, avg(case when o_totalprice > cut then 1 else 0 end) as tail_ratio from o join s on o.grp = s.grp group by o.grp""")
def _tail(t):
    rows = t.orders.withColumnRenamed("o_orderstatus", "grp")
    return A.tail_ratio(rows, "o_totalprice", ["grp"]).unionByName(
        A.tail_ratio(rows, "o_totalprice").withColumn("grp", F.lit("all")))


@query("missing_numbers", """select n from (select unnest(range((select min(l_partkey * 3) from lineitem),
  (select max(l_partkey * 3) + 1 from lineitem))) as n) where n not in (select l_partkey * 3 from lineitem)""")
def _missing(t):
    return A.missing_numbers(t.lineitem.selectExpr("l_partkey * 3 as k"), "k")

