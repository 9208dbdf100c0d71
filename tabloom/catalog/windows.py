"""Window operators on the driver's tables."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.catalog.relational import SPARSE_SQL, sparse
from tabloom.operators import aggregates as A
from tabloom.operators import ranks as K
from tabloom.operators import relational as R
from tabloom.operators.ordered import attach


@query("win_row_page", """select o_orderkey, o_totalprice from (select *, row_number() over (order by o_totalprice, o_orderkey) as rn
  from orders) where rn between 101 and 150""")
def _page(t):
    return K.page(t.orders.select("o_orderkey", "o_totalprice"), [F.asc("o_totalprice"), F.asc("o_orderkey")], 101, 150)


@query("win_dedupe_delete", """select l_orderkey, l_linenumber, l_shipdate, l_partkey from (select *, row_number() over (
  partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey) as rn from lineitem) where rn = 1""")
def _dedupe(t):
    out = R.dedupe(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


@query("win_latest_per_key", """select user_id, event_id, ts from (select *, row_number() over (
  partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 3""")
def _latest(t):
    return K.head_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)


@query("win_rank", "select l_orderkey, l_linenumber, l_quantity, rank() over (order by l_quantity) as rank from lineitem")
def _rank(t):
    return A.ranked(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("win_running_total", "select l_orderkey, l_quantity, sum(l_quantity) over (order by l_quantity) as running_total from lineitem")
def _running(t):
    return K.running_total(t.lineitem.select("l_orderkey", "l_quantity"), "l_quantity")


@query("win_total_count", "select o_orderkey, count(*) over () as n_total from orders")
def _count(t):
    total = t.orders.agg(F.count("*").alias("n_total"))
    return attach(t.orders.select("o_orderkey"), total)


@query("win_claim_level_flag", """select l_orderkey, l_linenumber, l_quantity,
  max(case when l_quantity >= 49 and l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey) as is_large from lineitem""")
def _flag(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    rule = (F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R")
    return K.flag_any(rows, ["l_orderkey"], rule, "is_large").drop("l_returnflag")


FFILL_SQL = f"""with {SPARSE_SQL} select event_id, user_id,
  last_value(reading ignore nulls) over w as reading, last_value(rare ignore nulls) over w as rare from sparse
window w as (partition by user_id order by ts, event_id rows unbounded preceding)"""


def gaps(t):
    return sparse(t).select("event_id", "user_id", "ts", "reading", "rare")


@query("win_ffill_running_count", FFILL_SQL)
def _ffill(t):
    return K.ffill(gaps(t), ["user_id"], ["ts", "event_id"], ["reading", "rare"]).drop("ts")


@query("win_ffill_max_id", FFILL_SQL)
def _ffill_pos(t):
    return K.ffill_by_position(gaps(t), ["user_id"], ["ts", "event_id"], ["reading", "rare"]).drop("ts")


@query("win_lag", """select event_id, user_id, value, lag(value, 1) over w as value_lag_1, lag(value, 2) over w as value_lag_2
from events window w as (partition by user_id order by ts, event_id)""")
def _lag(t):
    out = K.lags(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", [1, 2])
    return out.drop("ts")


@query("win_rolling_mean", """select event_id, user_id,
  round(case when count(value) over w3 = 3 then avg(value) over w3 end, 6) as mean_3,
  round(case when count(value) over w7 = 7 then avg(value) over w7 end, 6) as mean_7 from events
window w3 as (partition by user_id order by ts, event_id rows 2 preceding),
  w7 as (partition by user_id order by ts, event_id rows 6 preceding)""")
def _rolling(t):
    out = t.events.select("event_id", "user_id", "ts", "value")
    for n in (3, 7):
        out = K.rolling_mean(out, ["user_id"], ["ts", "event_id"], "value", n, f"mean_{n}")
    return out.select("event_id", "user_id", F.round("mean_3", 6).alias("mean_3"), F.round("mean_7", 6).alias("mean_7"))


@query("win_group_transform", """select event_id, round(avg(value) over w, 6) as mean_value, round(stddev_samp(value) over w, 6) as std_value,
  count(*) over w as n from events window w as (partition by user_id, event_type)""")
def _transform(t):
    out = K.group_transform(t.events.select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], {
        "mean_value": F.round(F.avg("value"), 6), "std_value": F.round(F.stddev_samp("value"), 6), "n": F.count("*")})
    return out.select("event_id", "mean_value", "std_value", "n")


@query("win_ngroup", """select event_id, user_id, event_type, dense_rank() over (order by user_id, event_type) - 1 as group_id from events""")
def _ngroup(t):
    return K.ngroup(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"])


@query("win_decile", "select o_orderkey, cast(ntile(10) over (order by o_totalprice desc, o_orderkey) as int) as tile from orders")
def _decile(t):
    return K.tiles(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), "o_orderkey"], 10).select(
        "o_orderkey", "tile")


@query("win_cumulative_share", """with d as (select cast(ntile(10) over (order by o_totalprice desc, o_orderkey) as int) as tile,
  case when o_orderstatus = 'F' then 1 else 0 end as hit from orders),
g as (select tile, cast(sum(hit) as bigint) as hits from d group by tile)
select tile, hits, cast(sum(hits) over (order by tile) as bigint) as cumulative_hits,
  sum(hits) over (order by tile) / sum(hits) over () as cumulative_share from g""")
def _cumulative(t):
    rows = t.orders.selectExpr("o_orderkey", "o_totalprice", "case when o_orderstatus = 'F' then 1 else 0 end as hit")
    tiled = K.tiles(rows, [("o_totalprice", "desc"), "o_orderkey"], 10)
    return K.cumulative_share(tiled, "tile", "hit")


@query("win_consecutive_islands", """with v as (select distinct l_extendedprice::bigint as v from lineitem),
g as (select v, v - row_number() over (order by v) as g from v)
select min(v) as first_n, max(v) as last_n, count(*) as n from g group by g""")
def _islands(t):
    # DuckDB rounds half to even in this cast, so the rounding is made explicit.
    return K.islands(t.lineitem.select(F.expr("cast(bround(l_extendedprice) as bigint) as v")), "v")


SPANS = """spans as (select o_custkey, cast(o_orderdate as date) as start_date,
  cast(o_orderdate as date) + cast(o_orderkey % 120 as int) as stop_date from orders)"""


@query("win_merge_intervals", f"""with {SPANS},
m as (select *, max(stop_date) over (partition by o_custkey order by start_date, stop_date
  rows between unbounded preceding and 1 preceding) as seen from spans),
g as (select *, sum(case when start_date <= seen then 0 else 1 end) over (partition by o_custkey order by start_date, stop_date
  rows unbounded preceding) as grp from m)
select o_custkey, min(start_date) as start_date, max(stop_date) as stop_date from g group by o_custkey, grp""")
def _merge(t):
    spans = t.orders.selectExpr("o_custkey", "cast(o_orderdate as date) as start_date",
                                "date_add(cast(o_orderdate as date), cast(o_orderkey % 120 as int)) as stop_date")
    return K.merge_spans(spans, ["o_custkey"], "start_date", "stop_date")


@query("win_prior_claim_exists", """with e as (select event_id, user_id, cast(ts as date) as day, event_type from events)
select event_id, case when exists (select 1 from e p where p.user_id = e.user_id and p.event_type = 'purchase'
  and p.day >= e.day - 3) then 1 else 0 end as has_claim from e""")
def _prior(t):
    rows = t.events.selectExpr("event_id", "user_id", "cast(ts as date) as day", "event_type")
    return K.exists_since(rows, ["user_id"], "day", F.col("event_type") == "purchase", 3, "has_claim").select("event_id", "has_claim")
