"""Join forms on the driver's tables."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import joins as J

AS_OF = "date '1998-06-30'"


@query("join_inner", """select o_orderkey, c_name, l_linenumber, l_quantity from lineitem
join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""")
def _inner(t):
    lines = J.merge_data(t.lineitem, t.orders, left_on=["l_orderkey"], right_on=["o_orderkey"])
    out = J.merge_data(lines, t.customer, left_on=["o_custkey"], right_on=["c_custkey"])
    return out.select("o_orderkey", "c_name", "l_linenumber", "l_quantity")


@query("join_left", """select c_custkey, o_orderkey from customer
left join (select * from orders where o_totalprice > 300000) on c_custkey = o_custkey""")
def _left(t):
    big = t.orders.where("o_totalprice > 300000")
    return J.merge_data(t.customer, big, "left", left_on=["c_custkey"], right_on=["o_custkey"]).select("c_custkey", "o_orderkey")


@query("join_right", "select e.event_id, c_custkey, c_name from events e right join customer on user_id = c_custkey")
def _right(t):
    return J.merge_data(t.events, t.customer, "right", left_on=["user_id"], right_on=["c_custkey"]).select(
        "event_id", "c_custkey", "c_name")


@query("join_full", """select coalesce(a.id, b.id) as id, coalesce(n_orders, 0) as n_orders, coalesce(n_events, 0) as n_events
from (select o_custkey as id, count(*) as n_orders from orders group by all) a
full join (select user_id * 7 as id, count(*) as n_events from events group by all) b on a.id = b.id""")
def _full(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    b = t.events.groupBy((F.col("user_id") * 7).alias("id")).agg(F.count("*").alias("n_events"))
    return J.merge_data(a, b, "full", on=["id"]).na.fill(0)


@query("join_natural", "select * from nation natural join (select r_regionkey as n_regionkey, r_name from region)")
def _natural(t):
    return J.natural_join(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"))


@query("join_suffix", """select a.doc_id, a.lang as lang_old, b.lang as lang_new, a.n_chars as n_chars_old, b.n_chars as n_chars_new
from documents a left join (select doc_id + 1 as doc_id, lang, n_chars from documents) b on a.doc_id = b.doc_id""")
def _suffix(t):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return J.join_suffix(docs, docs.withColumn("doc_id", F.col("doc_id") + 1), ["doc_id"], "left", ("_old", "_new"))


@query("join_replace_columns", """select d.doc_id, d.lang, l.quality, l.toxic, l.quality + 10 as n_chars
from documents d left join labels l on d.doc_id = l.doc_id""")
def _replace(t):
    new = t.labels.select("doc_id", "quality", "toxic", (F.col("quality") + 10).alias("n_chars"))
    return J.join_replace_columns(t.documents.select("doc_id", "lang", "n_chars"), new, ["doc_id"], ["quality", "toxic", "n_chars"])


@query("semi_in_subquery", """select o_orderkey, o_totalprice from orders where o_custkey in (
  select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def _semi(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as o_custkey")
    return J.semi(t.orders, keys, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("anti_not_exists", """select l_orderkey, l_linenumber, l_suppkey from lineitem l where not exists (
  select 1 from lineitem m where m.l_returnflag = 'R' and m.l_orderkey = l.l_orderkey and m.l_linenumber = l.l_linenumber)""")
def _anti(t):
    other = t.lineitem.where("l_returnflag = 'R'")
    return J.anti(t.lineitem, other, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("anti_theta", """select l_orderkey, l_linenumber, l_partkey from lineitem l where not exists (
  select 1 from lineitem m where m.l_returnflag = 'N' and m.l_orderkey = l.l_orderkey
    and m.l_linenumber = l.l_linenumber and m.l_partkey >= l.l_partkey)""")
def _theta(t):
    held = t.lineitem.where("l_returnflag = 'N'")
    return J.anti_above(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), held, ["l_orderkey", "l_linenumber"], "l_partkey")


@query("anti_multi_rule", """select c_custkey from customer c
where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')
  and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 480000)
  and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'O')""")
def _multi(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    rules = [
        F.col("o_orderstatus") == "P", F.col("o_totalprice") > 480000,
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"),
    ]
    return J.exclude_all(t.customer.select("c_custkey"), orders, ["c_custkey"], rules)


@query("anti_notin_null_aware", """select 'with null' as variant, count(*) as n from part where p_partkey not in (
  select case when l_partkey % 2 = 0 then l_partkey end from lineitem)
union all select 'without null', count(*) from part where p_partkey not in (
  select l_partkey from lineitem where l_partkey % 2 = 0)""")
def _not_in(t):
    even = F.col("l_partkey") % 2 == 0
    sets = {"with null": t.lineitem.select(F.when(even, F.col("l_partkey")).alias("k")), "without null": t.lineitem.where(even).select(F.col("l_partkey").alias("k"))}
    counts = [J.not_in(t.part, "p_partkey", keys, "k").agg(F.lit(name).alias("variant"), F.count(F.lit(1)).alias("n")) for name, keys in sets.items()]
    return counts[0].unionAll(counts[1])


DX = ["l_orderkey", "l_linenumber", "l_partkey % 60 as d1",
      "case when l_suppkey % 2 = 0 then l_suppkey % 60 end as d2", "(l_partkey + l_suppkey) % 60 as d3"]


@query("join_any_of_columns", f"""with l as (select {', '.join(DX)} from lineitem)
select distinct l_orderkey, l_linenumber, n_name from l join nation on d1 = n_nationkey or d2 = n_nationkey or d3 = n_nationkey""")
def _any(t):
    dim = t.nation.select("n_nationkey", "n_name").withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    out = J.match_any(t.lineitem.selectExpr(*DX), ["l_orderkey", "l_linenumber"], ["d1", "d2", "d3"], dim, "n_nationkey")
    return out.select("l_orderkey", "l_linenumber", "n_name")


SPANS = ["o_orderkey", "o_custkey", "o_orderpriority", "cast(o_orderdate as date) as start_date"]
SPANS_SQL = """spans as (select o_orderkey, o_custkey, o_orderpriority, cast(o_orderdate as date) as start_date,
  cast(o_orderdate as date) + cast(30 + o_orderkey % 200 as int) as stop_date from orders)"""


def spans(t):
    return t.orders.selectExpr(*SPANS).withColumn("stop_date", F.expr("date_add(start_date, cast(30 + o_orderkey % 200 as int))"))


@query("join_active_interval", f"with {SPANS_SQL} select o_custkey, o_orderkey from spans where {AS_OF} between start_date and stop_date")
def _active(t):
    return J.active_on(spans(t), "start_date", "stop_date", F.expr(AS_OF)).select("o_custkey", "o_orderkey")


@query("join_latest_value", f"""with {SPANS_SQL} select o_custkey, o_orderpriority, stop_date from (
  select *, row_number() over (partition by o_custkey order by stop_date desc, o_orderkey desc) as rn from spans) where rn = 1""")
def _latest(t):
    return J.latest_attr(spans(t), ["o_custkey"], ["stop_date", "o_orderkey"], ["o_orderpriority", "stop_date"])


@query("join_event_interval", f"""with {SPANS_SQL},
ev as (select l_orderkey, l_linenumber, l_orderkey // 10 as o_custkey, cast(l_shipdate as date) as ship_date from lineitem)
select ev.l_orderkey, ev.l_linenumber, ev.ship_date, s.o_orderkey from ev join spans s
on ev.o_custkey = s.o_custkey and ev.ship_date between s.start_date and s.stop_date""")
def _interval(t):
    ev = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_orderkey div 10 as o_custkey", "cast(l_shipdate as date) as ship_date")
    out = J.interval_join(ev, spans(t), "o_custkey", "ship_date", "start_date", "stop_date")
    return out.select("l_orderkey", "l_linenumber", "ship_date", "o_orderkey")


@query("join_max_per_group", """select l_orderkey, l_linenumber, l_shipdate from lineitem l
where l_shipdate = (select max(l_shipdate) from lineitem m where m.l_orderkey = l.l_orderkey)""")
def _max(t):
    return J.keep_group_max(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], "l_shipdate")


@query("self_join_successor", """select distinct a.l_partkey as n, b.l_partkey as next_n
from lineitem a join lineitem b on a.l_partkey + 1 = b.l_partkey""")
def _successor(t):
    return J.successors(t.lineitem, "l_partkey")


@query("join_scalar_subquery", "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
def _scalar(t):
    t.orders.createOrReplaceTempView("tabloom_orders")
    return t.spark.sql("select o_orderkey, o_totalprice from tabloom_orders "
                       "where o_totalprice > (select avg(o_totalprice) * 1.5 from tabloom_orders)")


CODES = ["s_suppkey", "cast(s_suppkey % 30 as int) as spec1", "cast(s_suppkey % 25 as int) as spec2", "s_nationkey as spec3"]


@query("join_crosswalk_chain", f"""with s as (select {', '.join(CODES)} from supplier)
select s.*, a.n_name as spec1_n_name, b.n_name as spec2_n_name, c.n_name as spec3_n_name from s
left join nation a on spec1 = a.n_nationkey left join nation b on spec2 = b.n_nationkey left join nation c on spec3 = c.n_nationkey""")
def _crosswalk(t):
    return J.crosswalk(t.supplier.selectExpr(*CODES), ["spec1", "spec2", "spec3"], t.nation, "n_nationkey", "n_name")


@query("join_match_indicator", """select coalesce(a.id, b.id) as id,
  case when a.id is null then 'right_only' when b.id is null then 'left_only' else 'both' end as side
from (select distinct o_custkey as id from orders) a full join (select distinct user_id * 3 as id from events) b on a.id = b.id""")
def _indicator(t):
    return J.indicator(t.orders.selectExpr("o_custkey as id"), t.events.selectExpr("user_id * 3 as id"), ["id"])


@query("drop_already_sent", """select event_id, user_id, event_type from events e where ts >= timestamp '2024-01-02'
and not exists (select 1 from events h where h.ts < timestamp '2024-01-02' and h.user_id = e.user_id and h.event_type = e.event_type)""")
def _sent(t):
    new = t.events.where("ts >= timestamp_ntz '2024-01-02 00:00:00'").select("event_id", "user_id", "event_type")
    return J.not_in_history(new, t.events.where("ts < timestamp_ntz '2024-01-02 00:00:00'"), ["user_id", "event_type"])
