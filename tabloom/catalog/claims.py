"""Claims jobs on lineitem: order = claim, partkey % 3 = adjustment, ship month = batch."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import aggregates as A
from tabloom.plans import claims as C
from tabloom.session import stable

KEYS = ["claim_nr", "line_nr", "adj_nr"]
ORDER = ["ship_date", "part_nr", "supp_nr", "charged", "units"]
MEASURES = ["charged", "paid", "units"]
FILL = ["denial_code", "billing_name", "post_date"]

SRC_SQL = """
claims as (
  select l_orderkey as claim_nr, l_linenumber as line_nr, cast(l_partkey % 3 as int) as adj_nr,
    cast(year(l_shipdate) * 100 + month(l_shipdate) as int) as job_id, cast(l_shipdate as date) as ship_date,
    l_partkey as part_nr, l_suppkey as supp_nr,
    cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(18,2)) as charged,
    cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(3,2)) as paid,
    cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as decimal(18,2)) as units,
    case when l_suppkey % 3 = 0 then 'D' || (l_partkey % 7) end as denial_code,
    case when l_partkey % 2 = 0 then 'Biller ' || (l_suppkey % 11) end as billing_name,
    case when l_suppkey % 5 = 0 then cast(l_shipdate as date) end as post_date
  from lineitem)"""
JOBS_SQL = """
jobs as (
  select distinct cast(year(l_shipdate) * 100 + month(l_shipdate) as int) as job_id,
    case when month(l_shipdate) % 3 = 0 then 'WGS' else 'CS90' end as file_type,
    repeat('f', 76 + month(l_shipdate)) as file_name
  from lineitem)"""
SCOPE_SQL = f"{SRC_SQL},{JOBS_SQL}" + """,
recent as (select distinct job_id from claims order by job_id desc limit 3),
scoped as (
  select distinct c.*, j.file_type, j.file_name from claims c left join jobs j on c.job_id = j.job_id
  where claim_nr in (select claim_nr from claims where job_id in (select job_id from recent)))"""
COLLAPSE_SQL = SCOPE_SQL + """,
collapsed as (
  select claim_nr, line_nr, adj_nr, file_type, file_name, max(job_id) as job_id, max(ship_date) as ship_date,
    max(part_nr) as part_nr, max(supp_nr) as supp_nr, max(denial_code) as denial_code,
    max(billing_name) as billing_name, max(post_date) as post_date,
    case when file_type = 'WGS' or length(file_name) > 82 then max(charged) else sum(charged) end as total_charged,
    case when file_type = 'WGS' or length(file_name) > 82 then max(paid) else sum(paid) end as total_paid,
    case when file_type = 'WGS' or length(file_name) > 82 then max(units) else sum(units) end as total_units
  from scoped group by claim_nr, line_nr, adj_nr, file_type, file_name)"""
FILLED_SQL = SCOPE_SQL + """,
filled as (
  select * exclude (denial_code, billing_name, post_date),
    last_value(denial_code ignore nulls) over w as denial_code,
    last_value(billing_name ignore nulls) over w as billing_name,
    last_value(post_date ignore nulls) over w as post_date
  from scoped
  window w as (partition by claim_nr, line_nr, adj_nr
    order by ship_date, part_nr, supp_nr, charged, units rows unbounded preceding))"""
CLAIM_EXPRS = [
    "l_orderkey as claim_nr", "l_linenumber as line_nr", "cast(l_partkey % 3 as int) as adj_nr",
    "cast(year(l_shipdate) * 100 + month(l_shipdate) as int) as job_id", "cast(l_shipdate as date) as ship_date",
    "l_partkey as part_nr", "l_suppkey as supp_nr",
    "cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(18,2)) as charged",
    "cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(3,2)) as paid",
    "cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as decimal(18,2)) as units",
    "case when l_suppkey % 3 = 0 then concat('D', l_partkey % 7) end as denial_code",
    "case when l_partkey % 2 = 0 then concat('Biller ', l_suppkey % 11) end as billing_name",
    "case when l_suppkey % 5 = 0 then cast(l_shipdate as date) end as post_date",
]


def claims(t):
    return t.lineitem.selectExpr(*CLAIM_EXPRS)


def jobs(t):
    return t.lineitem.selectExpr(
        "cast(year(l_shipdate) * 100 + month(l_shipdate) as int) as job_id",
        "case when month(l_shipdate) % 3 = 0 then 'WGS' else 'CS90' end as file_type",
        "repeat('f', 76 + month(l_shipdate)) as file_name",
    ).distinct()


def scoped(t):
    return C.claims_scope(claims(t), jobs(t), 3, "claim_nr", "job_id")


def use_max():
    return (F.col("file_type") == "WGS") | (F.length("file_name") > 82)


def collapsed(t):
    return C.claims_collapse(scoped(t), KEYS, MEASURES, use_max(), ["file_type", "file_name"])


def doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


TOTALS = [f"total_{m}" for m in MEASURES]


@query("claims_scope", f"""with {SCOPE_SQL}
select claim_nr, line_nr, adj_nr, job_id, ship_date, part_nr, file_type, denial_code,
  cast(charged as double) as charged from scoped""")
def _scope(t):
    out = scoped(t).select(*KEYS, "job_id", "ship_date", "part_nr", "file_type", "denial_code", "charged")
    return doubles(out, "charged")


@query("claims_collapse", f"""with {COLLAPSE_SQL}
select * replace (cast(total_charged as double) as total_charged, cast(total_paid as double) as total_paid,
  cast(total_units as double) as total_units) from collapsed""")
def _collapse(t):
    return doubles(collapsed(t), *TOTALS)


@query("claims_collapse_simple", f"""with {FILLED_SQL.replace('from scoped', 'from claims')},
sums as (select claim_nr, line_nr, sum(charged) as total_charged, sum(units) as total_units
  from claims group by all),
ff as (select claim_nr, line_nr,
    last_value(denial_code ignore nulls) over w as denial_code,
    last_value(billing_name ignore nulls) over w as billing_name,
    row_number() over (partition by claim_nr, line_nr
      order by ship_date desc, part_nr desc, supp_nr desc, charged desc, units desc) as rn
  from claims window w as (partition by claim_nr, line_nr
    order by ship_date, part_nr, supp_nr, charged, units rows unbounded preceding))
select s.claim_nr, s.line_nr, cast(total_charged as double) as total_charged,
  cast(total_units as double) as total_units, denial_code, billing_name
from sums s join ff on s.claim_nr = ff.claim_nr and s.line_nr = ff.line_nr and rn = 1""")
def _collapse_simple(t):
    out = C.claims_collapse_simple(
        claims(t), ["claim_nr", "line_nr"], ORDER, ["charged", "units"], ["denial_code", "billing_name"]
    )
    return doubles(out, "total_charged", "total_units")


CANCEL_SQL = COLLAPSE_SQL + """,
flagged as (
  select c.*, f.cancel_total_charged, f.cancel_total_paid, f.cancel_total_units
  from collapsed c join (
    select claim_nr, adj_nr,
      case when sum(total_charged) = 0 then 1 else 0 end as cancel_total_charged,
      case when sum(total_paid) = 0 then 1 else 0 end as cancel_total_paid,
      case when sum(total_units) = 0 then 1 else 0 end as cancel_total_units
    from collapsed group by claim_nr, adj_nr) f
  on c.claim_nr = f.claim_nr and c.adj_nr = f.adj_nr)"""


def flagged(t):
    return C.claims_cancel_flags(collapsed(t), ["claim_nr", "adj_nr"], TOTALS)


@query("claims_cancel_flags", f"""with {CANCEL_SQL}
select claim_nr, line_nr, adj_nr, file_type, file_name, cancel_total_charged, cancel_total_paid,
  cancel_total_units, cast(total_units as double) as total_units from flagged""")
def _cancel(t):
    out = flagged(t).select(*KEYS, "file_type", "file_name", *[f"cancel_{m}" for m in TOTALS], "total_units")
    return doubles(out, "total_units")


@query("claims_ffill", f"""with {FILLED_SQL}
select claim_nr, line_nr, adj_nr, ship_date, part_nr, supp_nr, denial_code, billing_name, post_date from filled""")
def _ffill(t):
    rows = stable(scoped(t).select(*KEYS, *ORDER, *FILL))  # read by the draw, the totals and the result
    return C.claims_ffill(rows, KEYS, ORDER, FILL).select(*KEYS, *ORDER[:3], *FILL)


SET_SQL = CANCEL_SQL + FILLED_SQL[len(SCOPE_SQL):] + """,
claim_set as (
  select c.*, f.denial_code, f.billing_name, f.post_date from (
    select claim_nr, line_nr, adj_nr, max(job_id) as job_id, max(ship_date) as ship_date,
      max(total_charged) as total_charged, max(total_paid) as total_paid, max(total_units) as total_units,
      max(cancel_total_charged) as cancel_total_charged
    from flagged group by all) c
  left join (
    select claim_nr, line_nr, adj_nr, max(denial_code) as denial_code, max(billing_name) as billing_name,
      max(post_date) as post_date from filled group by all) f
  on c.claim_nr = f.claim_nr and c.line_nr = f.line_nr and c.adj_nr = f.adj_nr),
target as (select claim_nr, line_nr, adj_nr from claim_set where claim_nr % 4 = 0),
inserted as (
  select s.* from claim_set s
  join (select claim_nr, max(adj_nr) as top from claim_set group by claim_nr) m
    on s.claim_nr = m.claim_nr and s.adj_nr = m.top
  where not exists (select 1 from target x where x.claim_nr = s.claim_nr and x.line_nr = s.line_nr
    and x.adj_nr = s.adj_nr))"""
SET_COLS = [*KEYS, "job_id", "ship_date", *TOTALS, "cancel_total_charged", *FILL]
SET_OUT = """claim_nr, line_nr, adj_nr, job_id, ship_date, cast(total_charged as double) as total_charged,
  cast(total_paid as double) as total_paid, cast(total_units as double) as total_units,
  cancel_total_charged, denial_code, billing_name, post_date"""


def claim_set(t):
    out = C.claims_consolidate(
        scoped(t), KEYS, ORDER, MEASURES, FILL, use_max(), ["file_type", "file_name"], ["claim_nr", "adj_nr"]
    )
    return out.select(*SET_COLS)


@query("claims_set", f"with {SET_SQL} select {SET_OUT} from claim_set")
def _set(t):
    return doubles(claim_set(t), *TOTALS)


@query("claims_flat_insert", f"with {SET_SQL} select {SET_OUT} from inserted")
def flat_insert(t):
    rows = claim_set(t)
    target = rows.where("claim_nr % 4 = 0").select(*KEYS)
    return doubles(C.claims_flat_insert(rows, target, "claim_nr", "adj_nr", KEYS), *TOTALS)


@query("claims_prune_adjustments", f"""with {SRC_SQL}
select claim_nr, line_nr, adj_nr, part_nr, supp_nr from claims c
where adj_nr = (select max(adj_nr) from claims d where d.claim_nr = c.claim_nr)""")
def _prune(t):
    return C.claims_prune(claims(t), "claim_nr", "adj_nr").select(*KEYS, "part_nr", "supp_nr")


@query("claims_bridge_missing", f"""with {SRC_SQL},
target as (select * from claims where claim_nr % 3 = 0 and adj_nr < 2),
newer as (select * from claims c where not exists (
  select 1 from target x where x.claim_nr = c.claim_nr and x.line_nr = c.line_nr and x.adj_nr >= c.adj_nr)),
top as (select n.* from newer n join (select claim_nr, line_nr, max(adj_nr) as m from newer group by all) g
  on n.claim_nr = g.claim_nr and n.line_nr = g.line_nr and n.adj_nr = g.m)
select claim_nr, line_nr, adj_nr, max(ship_date) as ship_date, max(part_nr) as part_nr,
  max(denial_code) as denial_code from top group by claim_nr, line_nr, adj_nr""")
def _bridge(t):
    clean = claims(t)
    target = clean.where("claim_nr % 3 = 0 and adj_nr < 2")
    out = C.claims_bridge_missing(clean, target, "claim_nr", "line_nr", "adj_nr")
    return out.select(*KEYS, "ship_date", "part_nr", "denial_code")


@query("claims_backfill_column", f"""with {SRC_SQL},
src as (select claim_nr, line_nr, adj_nr, max('C' || (part_nr % 9)) as code from claims group by all)
select c.claim_nr, c.line_nr, c.adj_nr, c.part_nr, c.supp_nr,
  case when c.denial_code is null and c.job_id >= 199801 then s.code else c.denial_code end as denial_code
from claims c left join src s on c.claim_nr = s.claim_nr and c.line_nr = s.line_nr and c.adj_nr = s.adj_nr""")
def _backfill(t):
    target = claims(t)
    clean = target.select(*KEYS, F.expr("concat('C', part_nr % 9)").alias("denial_code"))
    out = C.claims_backfill_column(target, clean, KEYS, "denial_code", F.col("job_id") >= 199801)
    return out.select(*KEYS, "part_nr", "supp_nr", "denial_code")


IDS_SQL = """tgt as (select o_orderkey as claim_nr, case when o_orderkey % 5 < 3 then o_orderkey + 1000 end as hf_id
  from orders)"""


def id_target(t):
    return t.orders.selectExpr(
        "o_orderkey as claim_nr", "case when o_orderkey % 5 < 3 then o_orderkey + 1000 end as hf_id"
    )


@query("claims_inherit_ids", f"""with {IDS_SQL},
src as (select l_orderkey as claim_nr, min(l_orderkey * 10 + l_linenumber) as new_id from lineitem
  where l_orderkey % 2 = 0 group by l_orderkey)
select t.claim_nr, coalesce(t.hf_id, s.new_id) as hf_id from tgt t left join src s on t.claim_nr = s.claim_nr""")
def _inherit(t):
    source = t.lineitem.where("l_orderkey % 2 = 0").selectExpr(
        "l_orderkey as claim_nr", "l_orderkey * 10 + l_linenumber as hf_id"
    )
    return C.claims_inherit_ids(id_target(t), source, "claim_nr", "hf_id")


@query("claims_mint_ids", f"""with {IDS_SQL},
missing as (select distinct claim_nr from tgt where hf_id is null),
minted as (select claim_nr, row_number() over (order by claim_nr) + (select max(hf_id) from tgt) as new_id from missing)
select t.claim_nr, cast(coalesce(t.hf_id, m.new_id) as bigint) as hf_id
from tgt t left join minted m on t.claim_nr = m.claim_nr""")
def _mint(t):
    return C.claims_mint_ids(id_target(t), "claim_nr", "hf_id")


FLAG_COLS = {
    "hcpcs": "hcpcs", "place": "place", "revenue": "revenue", "service": "service",
    "drg": "drg", "drg_type": "drg_type", "specialty": "specialty",
}
CARE_EXPRS = [
    "l_orderkey as claim_id",
    "case l_partkey % 40 when 1 then 'S9083' when 2 then 'S9088' when 3 then '59400' when 4 then '99283' else '99201' end as hcpcs",
    "case l_suppkey % 4 when 0 then '11' when 1 then '20' when 2 then '22' else '23' end as place",
    "case l_linenumber % 7 when 0 then '0450' when 1 then '0455' when 2 then '0105' when 3 then '0490' when 4 then '0210' when 5 then '0300' end as revenue",
    "case l_partkey % 3 when 0 then 'HOSP' when 1 then 'FANCL' else 'PROF' end as service",
    "case when l_partkey % 11 = 0 then '470' end as drg",
    "case when l_partkey % 22 = 0 then 'AP' when l_partkey % 11 = 0 then 'MS' end as drg_type",
    "cast(case l_suppkey % 6 when 0 then 66 when 1 then 28 when 2 then 8 else 5 end as int) as specialty",
    "case when l_partkey % 13 = 0 then '10D00Z0' end as proc_1",
    "case when l_suppkey % 17 = 0 then '10E0XZZ' end as proc_2",
]


@query("claims_care_flags", f"""with lines as (select {', '.join(CARE_EXPRS)} from lineitem)
select claim_id,
  max(case when hcpcs in ('S9083','S9088') then 1 when place = '20' and specialty <> 66 then 1
    when place = '11' and specialty in (28, 38, 186) then 1 else 0 end) as is_urgent_care,
  max(case when revenue in ('0490','0499') then 1 when specialty = 8 then 1 else 0 end) as is_surgical_center,
  max(case when hcpcs = '59400' then 1 when proc_1 in ('10D00Z0','10E0XZZ') then 1
    when proc_2 in ('10D00Z0','10E0XZZ') then 1 else 0 end) as is_maternity,
  max(case when revenue = '0450' or (service in ('FANCL','HOSP') and revenue between '0451' and '0459')
    then 1 else 0 end) as is_er,
  max(case when service in ('FANCL','HOSP') and (revenue between '0100' and '0179'
    or revenue between '0200' and '0219' or revenue between '0800' and '0809'
    or (drg is not null and drg_type is not null and drg_type <> 'AP')) then 1 else 0 end) as is_inpatient,
  max(case when service in ('FANCL','HOSP') and place = '22' and (revenue not between '0450' and '0459'
    and hcpcs not between '99281' and '99285') then 1 else 0 end) as is_outpatient
from lines group by claim_id""")
def _care(t):
    lines = t.lineitem.selectExpr(*CARE_EXPRS)
    rules = C.care_rules(FLAG_COLS, ["proc_1", "proc_2"], ["59400"], ["10D00Z0", "10E0XZZ"])
    return C.claims_care_flags(lines, "claim_id", rules)


@query("claims_load_counts", """select (select count(*) from lineitem) as n_target,
  (select count(*) from lineitem where l_shipdate >= timestamp '1998-01-01') as n_staged,
  (select count(*) from lineitem where l_shipdate < timestamp '1998-01-01') as difference""")
def _counts(t):
    return C.claims_load_counts(t.lineitem, t.lineitem.where("l_shipdate >= timestamp_ntz '1998-01-01'"))


@query("surprise_bill", f"""with {SRC_SQL}
select claim_nr, denial_code, max(line_nr) as line_nr, max(adj_nr) as adj_nr,
  cast(sum(units) as double) as units, cast(sum(charged) as double) as charged
from claims group by claim_nr, denial_code having sum(units) > 0 or sum(charged) > 0""")
def _surprise(t):
    out = C.surprise_bill(claims(t), ["claim_nr", "denial_code"], "line_nr", "adj_nr", "units", "charged")
    return doubles(out, "units", "charged")


@query("group_max_coalesce", f"""with {SRC_SQL}
select claim_nr, line_nr, max(adj_nr) as adj_nr, max(denial_code) as denial_code,
  max(billing_name) as billing_name, max(post_date) as post_date from claims group by claim_nr, line_nr""")
def _max(t):
    rows = claims(t).select("claim_nr", "line_nr", "adj_nr", *FILL)
    return A.collapse_max(rows, ["claim_nr", "line_nr"])


@query("agg_rule_by_group", f"""with {SRC_SQL},{JOBS_SQL}
select claim_nr, file_type, cast(case when file_type = 'WGS' then max(paid) else sum(paid) end as double) as total_paid
from claims c join jobs j on c.job_id = j.job_id group by claim_nr, file_type""")
def _rule(t):
    rows = claims(t).join(jobs(t), "job_id")
    use = F.col("file_type") == "WGS"
    out = rows.groupBy("claim_nr", "file_type").agg(A.sum_or_max("paid", use).alias("total_paid"))
    return doubles(out, "total_paid")


@query("agg_netted_to_zero", f"""with {SRC_SQL}
select claim_nr, supp_nr, case when sum(charged) = 0 then 1 else 0 end as flag_charged,
  case when sum(units) = 0 then 1 else 0 end as flag_units,
  case when sum(case when denial_code is not null then units end) = 0 then 1 else 0 end as flag_denied
from claims group by claim_nr, supp_nr""")
def _netted(t):
    rows = claims(t).withColumn("denied", F.expr("case when denial_code is not null then units end"))
    return A.netted_flags(rows, ["claim_nr", "supp_nr"], ["charged", "units", "denied"])
