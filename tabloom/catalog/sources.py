"""Readers and writers: each query writes a driver table out and reads it back."""

from datetime import date

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.functions import scalars as S
from tabloom.operators import aggregates as A
from tabloom.operators import relational as R
from tabloom.sources import readers as I
from tabloom.sources import sinks as O
from tabloom.streaming.ingest import ingest

ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders"
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query("scan_parquet", "select * from part")
def _parquet(t):
    return I.scan(t.spark, t.path("part"))


@query("scan_delimited", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _delimited(t):
    path = t.scratch("delimited")
    t.orders.select(*COLS).write.option("header", True).option("sep", ";").csv(path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return I.scan_delimited(t.spark, path, ";", schema, ["o_orderkey", "o_orderstatus", "o_totalprice"])


def layout(t):
    """Record dictionary, derived from the widths the writer below uses."""
    return t.nation.where("n_nationkey < 4").selectExpr(
        "element_at(array('claim', 'line', 'flag', 'amount'), n_nationkey + 1) as field",
        "element_at(array(1, 13, 16, 17), n_nationkey + 1) as start",
        "element_at(array(12, 15, 16, 30), n_nationkey + 1) as end",
    )


def write_fixed(t, lines):
    path = t.scratch("fixed")
    lines.select(F.concat(
        F.rpad(F.col("l_orderkey").cast("string"), 12, " "), F.lpad(F.col("l_linenumber").cast("string"), 3, " "),
        F.col("l_returnflag"), F.lpad(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), 14, " "),
    ).alias("value")).write.option("compression", "gzip").text(path)
    return path


@query("scan_fixed_width", """select cast(l_orderkey as varchar) as claim, l_returnflag as flag,
  cast(l_extendedprice as double) as amount from lineitem where l_returnflag = 'R'""")
def _fixed(t):
    path = write_fixed(t, t.lineitem)
    out = I.scan_fixed_width(t.spark, path, layout(t), ["claim", "flag", "amount"], F.col("flag") == "R")
    return R.safe_cast(out, {"amount": "double"})


@query("header_promote", "select cast(c_custkey as varchar) as member_id, c_name as name, c_mktsegment as plan from customer")
def _header(t):
    body = t.customer.selectExpr("c_custkey + 1 as line", "cast(c_custkey as string) as c0", "c_name as c1", "c_mktsegment as c2")
    head = t.region.where("r_regionkey = 0").selectExpr(
        "cast(0 as bigint) as line", "'member_id' as c0", "'name' as c1", "'plan' as c2")
    return I.header_promote(head.unionByName(body), "line")


@query("scan_nested_json", """select o_orderkey, cast(1 + o_orderkey % 4 as int) as n_items,
  (1 + o_orderkey % 4) * o_totalprice as top_amount from orders""")
def _json(t):
    path = t.scratch("json")
    items = F.expr("transform(sequence(1, 1 + cast(o_orderkey % 4 as int)), i -> struct(i as item, i * o_totalprice as amount))")
    t.orders.select("o_orderkey", items.alias("items")).write.option("compression", "gzip").json(path)
    df = I.scan_json(t.spark, path, "o_orderkey long, items array<struct<item: int, amount: double>>", False)
    return df.select("o_orderkey", F.size("items").alias("n_items"), F.array_max("items.amount").alias("top_amount"))


@query("scan_object_store", ORDERS)
def _store(t):
    path = t.scratch("store")
    t.orders.select(*COLS).write.option("header", True).csv(path)
    uri = path if "://" in path else f"file://{path}"
    return I.scan(t.spark, uri, "csv", header="true").select(
        *[F.col(c).cast(d).alias(c) for c, d in t.orders.select(*COLS).dtypes])


@query("list_dated_files", """select distinct cast(last_day(o_orderdate) as date) as file_date from orders
where last_day(o_orderdate) >= date '2000-01-01'""")
def _dated(t):
    path = t.scratch("dated")
    stamp = F.date_format(F.last_day(F.to_date("o_orderdate")), "yyyyMMdd")
    t.orders.select("o_orderkey", stamp.alias("stamp")).hint("rebalance", "stamp").write.partitionBy("stamp").parquet(path)
    files = I.list_dated_files(I.list_files(t.spark, path), r"stamp=(\d{8})/", date(2000, 1, 1))
    return files.select("file_date").distinct()


@query("newest_file", """with f as (select case when o_orderkey % 7 = 0 then '~$' else '' end || 'report_' || o_orderkey
  || case when o_orderkey % 2 = 0 then '.csv' else '.txt' end as name, o_orderdate as ts from orders),
g as (select name, ts, row_number() over (order by ts desc, '/in/' || name) as rn from f where name like '%.csv' and name not like '~$%')
select '/in/' || name as path, ts as "modificationTime" from g where rn = 2""")
def _newest(t):
    files = t.orders.selectExpr(
        "concat('/in/', case when o_orderkey % 7 = 0 then '~$' else '' end, 'report_', o_orderkey, "
        "case when o_orderkey % 2 = 0 then '.csv' else '.txt' end) as path", "o_orderdate as modificationTime")
    return I.newest_file(files, ".csv", 2)


@query("source_file_tag", "select n_nationkey, 'nation.parquet' as source_file from nation")
def _tag(t):
    return I.tag_source(t.nation).select("n_nationkey", "source_file")


@query("union_files", """select o_orderkey, o_custkey, case when year(o_orderdate) < 1998 then o_totalprice end as o_totalprice from orders""")
def _union(t):
    old, new = t.scratch("old"), t.scratch("new")
    t.orders.where("year(o_orderdate) < 1998").select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(old)
    t.orders.where("year(o_orderdate) >= 1998").select("o_orderkey", "o_custkey").write.parquet(new)
    return I.union_files(t.spark, [old, new])


@query("sink_append", ORDERS)
def _append(t):
    path = t.scratch("append")
    for rest in (0, 1):
        O.sink(t.orders.select(*COLS).where(F.col("o_orderkey") % 2 == rest), path)
    return I.scan(t.spark, path)


@query("sink_replace", f"{ORDERS} where o_orderstatus = 'F'")
def _replace(t):
    path = t.scratch("replace")
    for status in ("O", "F"):
        O.sink(t.orders.select(*COLS).where(F.col("o_orderstatus") == status), path, "overwrite")
    return I.scan(t.spark, path)


@query("sink_truncate_reload", "select o_orderkey, o_totalprice * 2 as o_totalprice from orders where o_orderstatus = 'F'")
def _reload(t):
    path = t.scratch("reload")
    O.reload(t.orders.select(*COLS), path)
    again = O.read_current(t.spark, path).where("o_orderstatus = 'F'")
    O.reload(again.selectExpr("o_orderkey", "o_totalprice * 2 as o_totalprice"), path)
    return O.read_current(t.spark, path)


@query("sink_archive_swap", """select 'raw' as place, o_orderkey from orders where o_orderstatus = 'O'
union all select 'archive', o_orderkey from orders where o_orderstatus = 'F'""")
def _swap(t):
    raw, archive = t.scratch("raw"), t.scratch("archive")
    for status in ("F", "O"):
        O.archive_swap(t.spark, raw, archive, t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey"))
    return O.read_current(t.spark, raw).select(F.lit("raw").alias("place"), "o_orderkey").unionByName(
        O.read_current(t.spark, archive).select(F.lit("archive").alias("place"), "o_orderkey"))


@query("sink_dated_csv", "select c_custkey, c_mktsegment from customer")
def _csv(t):
    path = O.sink_dated_csv(t.customer.select("c_custkey", "c_mktsegment"), t.scratch("csv"), "members", date(2024, 1, 31))
    return I.scan_delimited(t.spark, path, schema="c_custkey long, c_mktsegment string")


@query("unload_partitioned", "select event_id, value, date '2024-01-30' as dt from events")
def _unload(t):
    path = t.scratch("unload")
    for _ in range(2):  # the second run replaces the first
        O.unload(t.events.select("event_id", "value"), path, date(2024, 1, 30), 2000)
    return I.scan(t.spark, path)


@query("extract_by_period", "select o_orderkey, cast(year(o_orderdate) as int) as year from orders")
def _extract(t):
    path = t.scratch("years")
    O.extract_by_year(t.orders.select("o_orderkey", "o_orderdate"), path, "o_orderdate")
    return I.scan(t.spark, path).select("o_orderkey", "year")


@query("surprise_extract", """select l_orderkey || '-' || l_linenumber as key, cast(l_orderkey as varchar) as claim,
  string_agg(distinct case when l_suppkey % 2 = 0 then 'even' else 'odd' end, '; ' order by case when l_suppkey % 2 = 0 then 'even' else 'odd' end) as files
from lineitem where l_returnflag = 'R' group by l_orderkey, l_linenumber""")
def _surprise(t):
    """Two daily files of fixed-width records, flagged rows only, file names joined per record."""
    parts = []
    for rest, name in ((0, "even"), (1, "odd")):
        path = write_fixed(t, t.lineitem.where(F.col("l_suppkey") % 2 == rest))
        rows = I.scan_fixed_width(t.spark, path, layout(t), None, F.col("flag") == "R", tag="file")
        parts.append(rows.withColumn("file", F.when(F.col("file").endswith(".txt.gz"), F.lit(name))))
    both = R.union_rows(*parts)
    out = A.string_join(both, ["claim", "line"], "file")
    return out.select(R.make_key(["claim", "line"]).alias("key"), "claim", F.col("file").alias("files"))


@query("rebate_clean", """select cast(p_partkey as varchar) as drug, nullif(case when p_partkey % 5 = 0 then '-' else p_type end, '-') as tier,
  case when p_partkey % 7 <> 0 then floor(p_retailprice * 1000) end as rebate from part""")
def _rebate(t):
    body = t.part.selectExpr(
        "p_partkey + 1 as line", "cast(p_partkey as string) as c0", "case when p_partkey % 5 = 0 then '-' else p_type end as c1",
        "case when p_partkey % 7 = 0 then '-' else format_number(floor(p_retailprice * 1000), 0) end as c2")
    head = t.region.where("r_regionkey = 0").selectExpr("0L as line", "'NDC' as c0", "'TIER' as c1", "'AMT' as c2")
    rows = R.token_to_null(I.header_promote(head.unionByName(body), "line"), ["TIER", "AMT"])
    rows = R.project(rows, {"drug": "NDC", "tier": "TIER", "rebate": "AMT"})
    return R.safe_cast(rows.withColumn("rebate", S.replace_chars(F.col("rebate"), ",")), {"rebate": "double"})


@query("incremental_file_ingest", """select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders""")
def _ingest(t):
    incoming, target, check = [t.scratch(x) for x in ("incoming", "target", "progress")]
    out = None
    for cut in ("o_orderkey % 3 < 2", "o_orderkey % 3 >= 1"):  # the second drop repeats some keys
        O.sink(t.orders.select(*COLS).where(cut), incoming)
        out = ingest(t.spark, incoming, target, check, t.orders.select(*COLS).schema,
                     ["o_orderkey"], ["o_totalprice"])
    return out
