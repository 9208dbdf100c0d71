"""Projections, filters, casts, sorts and set operations on the driver's tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.catalog import query
from tabloom.operators import aggregates as A
from tabloom.operators import joins as J
from tabloom.operators import ranks as K
from tabloom.operators import relational as R

# NULLs, placeholders and text numbers derived from events; the tables hold no NULLs.
SPARSE = [
    "event_id", "user_id", "event_type", "ts",
    "case when event_id % 3 <> 0 then value end as reading",
    "case when event_id % 7 = 0 then value end as rare",
    "cast('web' as string) as channel",
    "case when event_id % 4 = 0 then '-' when event_id % 4 = 1 then '' else cast(event_id as string) end as code",
    "case when event_id % 5 = 0 then 'n/a' else cast(event_id % 100 as string) end as raw_number",
    "cast(event_id * 2 as string) as clean_number",
]
SPARSE_SQL = "sparse as (select " + ", ".join(SPARSE).replace("as string)", "as varchar)") + " from events)"


def sparse(t):
    return t.events.selectExpr(*SPARSE)


@query("project_rename", "select o_orderkey as order_id, o_custkey as member_id, o_orderdate as placed_at from orders")
def _project(t):
    return R.project(t.orders, {"order_id": "o_orderkey", "member_id": "o_custkey", "placed_at": "o_orderdate"})


@query("conform_to_schema", """select cast(c_custkey as varchar) as person_id, 'wellness' as program,
  c_mktsegment as plan_name, cast(null as date) as close_date, cast(268300000 as bigint) as program_code from customer""")
def _conform(t):
    layout = T.StructType([
        T.StructField("person_id", T.StringType()), T.StructField("program", T.StringType()),
        T.StructField("plan_name", T.StringType()), T.StructField("close_date", T.DateType()),
        T.StructField("program_code", T.LongType()),
    ])
    src = t.customer.withColumnsRenamed({"c_custkey": "person_id", "c_mktsegment": "plan_name"})
    return R.conform(src, layout, {"program": "wellness", "program_code": 268300000})


@query("case_when_flag", """select o_orderkey,
  case when o_totalprice > 200000 and o_orderstatus <> 'F' then 1 else 0 end as warn_large from orders""")
def _flag(t):
    rule = (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") != "F")
    return R.flag(t.orders, "warn_large", rule).select("o_orderkey", "warn_large")


@query("subset_data", "select * from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def _subset(t):
    return R.subset(t.orders, {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query("filter_not_in_list", "select event_id, event_type from events where event_type not in ('click', 'error')")
def _not_in(t):
    return R.exclude(t.events, "event_type", ["click", "error"]).select("event_id", "event_type")


@query("filter_between", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 20")
def _between(t):
    return R.between(t.lineitem, "l_quantity", 10, 20).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_code_range", """with c as (select p_partkey, lpad(cast(p_partkey % 1000 as varchar), 4, '0') as code from part)
select * from c where code between '0100' and '0179' or code between '0200' and '0219'""")
def _range(t):
    codes = t.part.selectExpr("p_partkey", "lpad(cast(p_partkey % 1000 as string), 4, '0') as code")
    return codes.where(R.code_between(F.col("code"), [("0100", "0179"), ("0200", "0219")]))


@query("filter_pattern", "select p_partkey, p_name from part where p_name like 'small%' or p_name like '%ring%'")
def _pattern(t):
    return R.like_any(t.part, "p_name", ["small%", "%ring%"]).select("p_partkey", "p_name")


@query("filter_month_range", "select o_orderkey, o_orderdate from orders where month(o_orderdate) between 11 and 12")
def _month(t):
    return R.month_in(t.orders, "o_orderdate", 11, 12).select("o_orderkey", "o_orderdate")


@query("filter_null", f"""with {SPARSE_SQL} select event_id, code, reading from sparse
where code is not null and code <> '' and reading is not null""")
def _null(t):
    return R.drop_null_rows(R.not_empty(sparse(t), "code"), ["reading"]).select("event_id", "code", "reading")


WIDE = [
    "l_orderkey", "l_linenumber", "case when l_partkey % 4 <> 0 then l_partkey % 50 end as c1",
    "case when l_suppkey % 3 <> 0 then l_suppkey % 50 end as c2", "l_linenumber + 40 as c3",
]


@query("any_column_in_codes", f"""with w as (select {', '.join(WIDE)} from lineitem)
select l_orderkey, l_linenumber, c1, c2 from w where c1 in (7, 11, 43) or c2 in (7, 11, 43) or c3 in (7, 11, 43)""")
def _any(t):
    out = t.lineitem.selectExpr(*WIDE).where(R.any_in(["c1", "c2", "c3"], [7, 11, 43]))
    return out.select("l_orderkey", "l_linenumber", "c1", "c2")


@query("none_column_in_codes", f"""with w as (select {', '.join(WIDE)} from lineitem)
select l_orderkey, l_linenumber, c1, c2 from w where not (coalesce(c1 in (7, 11, 43), false)
  or coalesce(c2 in (7, 11, 43), false) or coalesce(c3 in (7, 11, 43), false))""")
def _none(t):
    out = t.lineitem.selectExpr(*WIDE).where(R.none_in(["c1", "c2", "c3"], [7, 11, 43]))
    return out.select("l_orderkey", "l_linenumber", "c1", "c2")


@query("safe_cast", f"""with {SPARSE_SQL} select event_id, coalesce(try_cast(raw_number as bigint), -1) as raw_number,
  try_cast(code as double) as code from sparse""")
def _safe(t):
    rows = sparse(t).select("event_id", "raw_number", "code")
    return R.safe_cast(rows, {"raw_number": "bigint", "code": "double"}, {"raw_number": -1})


@query("strict_cast", """select cast(l_orderkey as varchar) as claim_nr, cast(l_quantity as int) as units,
  cast(l_shipdate as date) as ship_date from lineitem""")
def _strict(t):
    rows = t.lineitem.selectExpr("l_orderkey as claim_nr", "l_quantity as units", "l_shipdate as ship_date")
    return R.strict_cast(rows, {"claim_nr": "string", "units": "int", "ship_date": "date"})


@query("numeric_all_columns", f"""with {SPARSE_SQL} select event_id, raw_number,
  cast(clean_number as double) as clean_number, channel from sparse""")
def _numeric(t):
    return R.to_numeric_all(sparse(t).select("event_id", "raw_number", "clean_number", "channel"))


@query("token_to_null", f"with {SPARSE_SQL} select event_id, nullif(code, '-') as code from sparse")
def _token(t):
    return R.token_to_null(sparse(t), ["code"]).select("event_id", "code")


@query("fill_nulls", f"""with {SPARSE_SQL} select event_id, coalesce(reading, (select quantile_cont(reading, 0.5) from sparse)) as reading,
  coalesce(rare, 0) as rare from sparse""")
def _fill(t):
    return R.fill(sparse(t), {"reading": "median", "rare": 0.0}).select("event_id", "reading", "rare")


@query("clean_nonfinite", """select event_id, case when event_id % 11 in (0, 1, 2) then 0.0 else value end as v from events""")
def _finite(t):
    rows = t.events.selectExpr(
        "event_id",
        "case event_id % 11 when 0 then double('infinity') when 1 then double('-infinity') "
        "when 2 then double('nan') else value end as v",
    )
    return R.clean_nonfinite(rows, ["v"], 0.0)


@query("coalesce_fallback", f"with {SPARSE_SQL} select event_id, coalesce(rare, reading, -1.0) as v from sparse")
def _coalesce(t):
    rows = sparse(t).withColumn("d", F.lit(-1.0))
    return rows.select("event_id", R.fallback("rare", "reading", "d").alias("v"))


@query("map_recode", """select event_id, case event_type when 'view' then 'V' when 'click' then 'C' else event_type end as kind
from events""")
def _recode(t):
    return t.events.select("event_id", R.recode("event_type", {"view": "V", "click": "C"}).alias("kind"))


@query("composite_key", """select c_custkey, replace(replace(c_name || '-' || c_mktsegment || '-'
  || coalesce(case when c_nationkey % 2 = 0 then cast(c_nationkey as varchar) end, ''), '#', ''), '.', '') as key from customer""")
def _key(t):
    rows = t.customer.withColumn("part", F.expr("case when c_nationkey % 2 = 0 then c_nationkey end"))
    return rows.select("c_custkey", R.make_key(["c_name", "c_mktsegment", "part"], "-", "#.").alias("key"))


@query("distinct_rows", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def _distinct(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("drop_dups_subset", """select * from (select 'first' as keep, user_id, event_type, event_id, value from (
  select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn = 1
union all select 'last', user_id, event_type, event_id, value from (
  select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1
union all select 'none', user_id, event_type, event_id, value from (
  select *, count(*) over (partition by user_id, event_type) as n from events) where n = 1)""")
def _dups(t):
    rows, keys = t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"]
    parts = [
        R.dedupe(rows, keys, ["event_id"], keep).withColumn("keep", F.lit(keep or "none"))
        for keep in ("first", "last", None)
    ]
    return R.union_rows(*parts)


@query("drop_sparse_columns", f"with {SPARSE_SQL} select event_id, reading, channel, code from sparse")
def _sparse(t):
    return R.drop_sparse(sparse(t).select("event_id", "reading", "rare", "channel", "code"), 0.4)


@query("drop_columns", "select c_custkey, c_name, c_acctbal from customer")
def _drop(t):
    return R.drop_columns(t.customer, ["c_nationkey", "c_mktsegment", "not_there"])


@query("drop_constant_columns", f"with {SPARSE_SQL} select event_id, reading, code from sparse")
def _constant(t):
    return R.drop_constant(sparse(t).select("event_id", "reading", "channel", "code"))


@query("drop_null_rows", f"with {SPARSE_SQL} select event_id, reading, rare from sparse where reading is not null and rare is not null")
def _nulls(t):
    return R.drop_null_rows(sparse(t).select("event_id", "reading", "rare"))


@query("row_total", """select l_orderkey, l_linenumber, l_quantity + l_extendedprice + l_discount + l_tax as total from lineitem""")
def _total(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return R.row_total(rows, ["l_orderkey", "l_linenumber"])


@query("if_even_double_else_triple", "select event_id, case when event_id % 2 = 0 then event_id * 2 else event_id * 3 end as v from events")
def _even(t):
    return t.events.select("event_id", R.even_double_else_triple(F.col("event_id")).alias("v"))


# Sorts, limits, top-k

@query("sort_multi", """select o_orderkey, o_orderpriority, o_totalprice from orders
order by o_orderpriority, o_totalprice desc, o_orderkey""")
def _sort(t):
    return K.sort(t.orders, [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")]).select(
        "o_orderkey", "o_orderpriority", "o_totalprice"
    )


@query("topk_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _topk(t):
    return K.topk(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("topk_distinct_jobs", """with b as (select l_orderkey, year(l_shipdate) * 12 + month(l_shipdate) as batch from lineitem),
top as (select distinct batch from b order by batch desc limit 3)
select distinct l_orderkey from b where batch in (select batch from top)""")
def _batches(t):
    rows = t.lineitem.selectExpr("l_orderkey", "year(l_shipdate) * 12 + month(l_shipdate) as batch")
    return J.semi(rows, J.recent_batches(rows, "batch", 3), ["batch"]).select("l_orderkey").distinct()


@query("top_percent", """select o_orderkey, o_totalprice from (select *, row_number() over (order by o_totalprice desc, o_orderkey) as rn,
  count(*) over () as n from orders) where rn <= floor(n * 0.05)""")
def _pct(t):
    return K.top_pct(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), "o_orderkey"], 0.05)


@query("offset_one", "select distinct o_totalprice from orders order by o_totalprice desc limit 1 offset 1")
def _offset(t):
    return A.second_highest(t.orders, "o_totalprice")


@query("sample_head", "select * from customer order by c_custkey limit 10")
def _head(t):
    return K.topk(t.customer, [F.asc("c_custkey")], 10)


# Set operations

@query("union_all", """select c_custkey as id, c_nationkey as nation from customer
union all select s_suppkey, s_nationkey from supplier""")
def _union(t):
    return R.union_rows(t.customer.selectExpr("c_custkey as id", "c_nationkey as nation"),
                        t.supplier.selectExpr("s_suppkey as id", "s_nationkey as nation"))


@query("union_distinct", "select l_suppkey as id from lineitem union select s_suppkey from supplier union select p_partkey from part")
def _union_distinct(t):
    return R.union_rows(t.lineitem.selectExpr("l_suppkey as id"), t.supplier.selectExpr("s_suppkey as id"),
                        t.part.selectExpr("p_partkey as id"), distinct=True)


@query("union_outer_columns", """select c_custkey as id, c_mktsegment as segment, cast(null as varchar) as brand from customer
union all select p_partkey, null, p_brand from part""")
def _union_outer(t):
    return R.union_rows(t.customer.selectExpr("c_custkey as id", "c_mktsegment as segment"),
                        t.part.selectExpr("p_partkey as id", "p_brand as brand"), allow_missing=True)


@query("intersect_rows", "select user_id as id from events intersect select c_custkey from customer")
def _intersect(t):
    return t.events.selectExpr("user_id as id").intersect(t.customer.selectExpr("c_custkey as id"))


@query("except_rows", """select c_custkey, c_name from customer where not exists (
  select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)""")
def _except(t):
    big = t.orders.where("o_totalprice > 250000").selectExpr("o_custkey as c_custkey")
    return J.anti(t.customer.select("c_custkey", "c_name"), big, ["c_custkey"])
