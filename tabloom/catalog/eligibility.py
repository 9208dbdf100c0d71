"""Eligibility jobs: customer = person, orders = coverage spans, lineitem = claims, supplier = centre."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.catalog import query
from tabloom.operators import relational as R
from tabloom.plans import eligibility as E

DAY = "date '2000-06-30'"
ELIG = ["o_custkey as person_id", "cast(o_orderdate as date) as start_date",
        "date_add(cast(o_orderdate as date), cast(300 + o_orderkey % 900 as int)) as stop_date",
        "case when o_orderkey % 9 <> 0 then o_orderpriority end as plan_name"]
CLAIMS = ["o_custkey as person_id", "cast(l_shipdate as date) as service_date", "l_suppkey % 20 as billing_tax_id",
          "case l_linenumber % 3 when 0 then '11' when 1 then '22' else '23' end as place", "l_partkey % 10 as specialty_id"]
ENROLL = ["c_custkey as person_id", "c_custkey % 100 as facility_id",
          "date_add(date '1999-01-01', cast(c_custkey % 700 as int)) as active_date", "268300000 as program",
          "cast(case c_custkey % 4 when 0 then 268300303 when 1 then 268300313 else 268300305 end as int) as status",
          "cast(case when c_custkey % 11 = 0 then 1 else 0 end as int) as state",
          "cast(case when c_custkey % 8 = 0 then 268300001 else 0 end as int) as outcome",
          "cast(case when c_custkey % 3 = 0 then 268300002 else 0 end as int) as warning_reason",
          "case when c_custkey % 5 <> 0 then date_add(date '2000-01-01', cast(c_custkey % 200 as int)) end as warning_date"]
ORG = ["s_suppkey as org_id", "s_suppkey % 20 as tax_id", "s_name as name",
       "case when s_suppkey % 3 = 0 then concat('Parent ', s_suppkey % 20) end as parent_name", "s_suppkey % 2 = 0 as five_star"]
REGISTRY = ["c_custkey as person_id", "date_add(date '2000-01-01', cast(c_custkey % 300 as int)) as last_visit",
            "case when c_custkey % 3 <> 0 then date_add(date '2000-04-01', cast(c_custkey % 200 as int)) end as next_appt"]


def sql(exprs):
    """The same derivation in the check's dialect (date + int instead of date_add)."""
    text = ", ".join(exprs)
    return re.sub(r"date_add\((.+?), (cast\(.+? as int\))\)", r"\1 + \2", text)


BASE_SQL = f"""
elig as (select {sql(ELIG)} from orders),
claims as (select {sql(CLAIMS)} from lineitem join orders on l_orderkey = o_orderkey),
enroll as (select {sql(ENROLL)} from customer),
org as (select {sql(ORG)} from supplier),
registry as (select {sql(REGISTRY)} from customer),
five as (select distinct org_id as facility_id, tax_id, coalesce(parent_name, name) as center_name from org where five_star)"""


def universe_sql(months, join):
    return BASE_SQL + f""",
universe as (
  select distinct e.person_id, e.facility_id, e.active_date, s.start_date, s.stop_date, p.plan_name, c.service_date,
    c.billing_tax_id, r.last_visit, r.next_appt, f.tax_id, f.center_name
  from enroll e
  join (select distinct person_id, start_date, stop_date from elig where stop_date > {DAY}) s on s.person_id = e.person_id
  left join (select person_id, plan_name from (select *, row_number() over (partition by person_id
      order by stop_date desc, plan_name desc) as rn from elig
      where plan_name is not null and {DAY} between start_date and stop_date) where rn = 1) p on p.person_id = e.person_id
  {join} join (select distinct person_id, service_date, billing_tax_id from claims
      where service_date >= {DAY} - interval {months} month and place in ('11', '22') and specialty_id in (
        select n_nationkey from nation where n_regionkey = 1)) c on c.person_id = e.person_id
  left join registry r on r.person_id = e.person_id
  left join five f on f.facility_id = e.facility_id
  where e.program = 268300000 and e.status = 268300305 and e.state = 0
    and date_diff('day', e.active_date, {DAY}) > 180),
used as (select *, case when billing_tax_id in (select tax_id from org where five_star) then 1 else 0 end as center_usage from universe)"""


def frames(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "elig": t.orders.selectExpr(*ELIG), "claims": lines.selectExpr(*CLAIMS), "enroll": t.customer.selectExpr(*ENROLL),
        "org": t.supplier.selectExpr(*ORG), "registry": t.customer.selectExpr(*REGISTRY),
        "specialties": t.nation.selectExpr("cast(n_nationkey as bigint) as specialty_id", "n_regionkey as attribution_level"),
    }


def universe(t, months=9, keep=False):
    return E.wellness_universe(**frames(t), as_of=F.expr(DAY), months=months, keep_no_claims=keep)


KEEP = ["person_id", "stop_date", "plan_name", "service_date", "billing_tax_id", "tax_id", "center_name", "next_appt"]
KEEP_SQL = ", ".join(KEEP)
SWITCH_SQL = "case when tax_id is not null and billing_tax_id <> tax_id and center_usage = 1 then 1 else 0 end as warn_switch"
NOAPT_SQL = "case when service_date is null and next_appt is null then 1 else 0 end as warn_no_appointment"
FLAGS = ["warn_switch", "warn_no_appointment", "warn_no_usage"]


@query("wellness_universe", f"with {universe_sql(9, '')} select {KEEP_SQL}, last_visit, active_date from universe")
def _universe(t):
    return universe(t).select(*KEEP, "last_visit", "active_date")


@query("wellness_flags_v1", f"""with {universe_sql(9, 'left')}
select distinct {KEEP_SQL}, {SWITCH_SQL}, {NOAPT_SQL},
  case when next_appt is null and not exists (select 1 from used w where w.person_id = u.person_id
    and w.service_date >= u.service_date - 270 and w.billing_tax_id = w.tax_id) then 1 else 0 end as warn_no_usage from used u""")
def _v1(t):
    f = frames(t)
    return E.wellness_flags_v1(universe(t, keep=True), f["org"]).select(*KEEP, *FLAGS).distinct()


@query("wellness_flags_v2", f"""with {universe_sql(18, 'left')},
flagged as (select distinct {KEEP_SQL}, {SWITCH_SQL}, {NOAPT_SQL},
  case when (next_appt is null or date_diff('day', next_appt, {DAY}) >= 1) and date_diff('day', service_date, {DAY}) >= 270
    and not exists (select 1 from used w where w.person_id = u.person_id and w.billing_tax_id = w.tax_id)
  then 1 else 0 end as warn_no_usage from used u)
select * from flagged where warn_switch = 1 or warn_no_appointment = 1 or warn_no_usage = 1""")
def _v2(t):
    out = E.wellness_flags_v2(universe(t, 18, True), frames(t)["org"], F.expr(DAY))
    return out.select(*KEEP, *FLAGS).distinct()


ACTIONS_SQL = universe_sql(18, "left") + f""",
days as (select *, coalesce(date_diff('day', service_date, {DAY}), 0) as since,
  coalesce(billing_tax_id = tax_id, false) as same from used where tax_id is not null),
marks as (select *, (next_appt is null or next_appt <= {DAY}) and since >= 270 and not same as no_usage,
  since <= 270 and same as usage, coalesce(billing_tax_id <> tax_id, false) and center_usage = 1 as switch from days),
acted as (select *, case when switch and no_usage then 'Switch Five Star' when no_usage then 'No Usage'
  when usage then 'Usage' when switch then 'Switch Five Star' end as action from marks),
actions as (
  select {KEEP_SQL}, action from (select *, row_number() over (partition by person_id
    order by service_date desc, billing_tax_id, stop_date) as rn from acted
    where action = 'Switch Five Star' and service_date >= {DAY} - 90) where rn = 1
  union all select {KEEP_SQL}, action from acted where action = 'No Usage' and person_id not in (
    select person_id from acted where action = 'Usage'))"""


def actions(t):
    return E.wellness_actions(universe(t, 18, True), frames(t)["org"], F.expr(DAY), switch_days=90)


@query("wellness_actions", f"with {ACTIONS_SQL} select * from actions")
def _actions(t):
    return actions(t).select(*KEEP, "action")


@query("wellness_episode_rows", f"""with {ACTIONS_SQL},
layout as (select distinct cast(person_id as varchar) as person_id, 'wellness' as program, action, plan_name, cast(null as date) as close_date
  from actions),
fresh as (select * from layout l where not exists (select 1 from customer where cast(c_custkey as varchar) = l.person_id
  and c_custkey % 2 = 0 and l.action = case when c_custkey % 4 = 0 then 'No Usage' else 'Switch Five Star' end))
select 'episode' as place, person_id, program, action, plan_name, close_date from fresh
union all select 'history', person_id, null, action, null, null from fresh""")
def _episodes(t):
    s, d = T.StringType(), T.DateType()
    layout = T.StructType([T.StructField(n, x) for n, x in (
        ("person_id", s), ("program", s), ("action", s), ("plan_name", s), ("close_date", d))])
    history = t.customer.where("c_custkey % 2 = 0").selectExpr(
        "cast(c_custkey as string) as person_id",
        "case when c_custkey % 4 = 0 then 'No Usage' else 'Switch Five Star' end as action")
    fresh, sent = E.wellness_episode_rows(actions(t), history, layout, {"program": "wellness"}, ["person_id", "action"])
    return R.union_rows(fresh.withColumn("place", F.lit("episode")), sent.withColumn("place", F.lit("history")), allow_missing=True)


@query("wellness_reinstate", f"""with {BASE_SQL},
res as (select * from enroll where program = 268300000 and status = 268300303 and state = 0 and warning_reason = 268300002
  and (warning_date is null or warning_date >= {DAY} - 90) and person_id % 5 < 4)
select distinct r.person_id, c.service_date, c.billing_tax_id, f.center_name, r.warning_date from res r
join five f on f.facility_id = r.facility_id
join claims c on c.person_id = r.person_id and c.billing_tax_id = f.tax_id and c.service_date >= {DAY} - 270
where exists (select 1 from elig e where e.person_id = r.person_id and {DAY} between start_date and stop_date)""")
def _reinstate(t):
    f = frames(t)
    flagged = t.customer.selectExpr("c_custkey as person_id", "case when c_custkey % 5 < 4 then 'No Usage' else 'Usage' end as action")
    out = E.wellness_reinstate(f["enroll"], f["claims"], f["elig"], f["org"], flagged, F.expr(DAY))
    return out.select("person_id", "service_date", "billing_tax_id", "center_name", "warning_date").distinct()


# The lines of one service date are few here, so thresholds are met through several codes.
DX_CLAIMS = ["concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as line_id", "o_custkey as person_id",
             "date_add(date '1950-01-01', cast((o_custkey % 200) * 110 as int)) as dob", "cast(l_shipdate as date) as service_date",
             "l_partkey % 100 as dx1", "l_suppkey % 100 as dx2", "case when l_linenumber > 3 then (l_partkey + l_suppkey) % 100 end as dx3"]
DX_DIM = """select n_nationkey::bigint as dx, 'diabetes' as condition from nation where n_nationkey < 12
  union all select n_nationkey + 12, 'htn' from nation where n_nationkey < 14 union all select n_nationkey + 26, 'asthma' from nation
  where n_nationkey < 5 union all select n_nationkey + 31, 'cad' from nation union all select n_nationkey + 60, 'stroke' from nation where n_nationkey < 2"""
DX_SQL = BASE_SQL + f""",
dxc as (select {sql(DX_CLAIMS)} from lineitem join orders on l_orderkey = o_orderkey),
dim as ({DX_DIM}),
hits as (select distinct line_id, person_id, service_date, dx, condition from dxc join dim on dx1 = dx or dx2 = dx or dx3 = dx
  where service_date > date '2001-06-30' - 400 and year(date '2001-06-30') - year(dob) >= 18),
visits as (select person_id, condition, service_date, count(*) as visits from hits group by all),
conditions as (select person_id, {', '.join(f"max(case when condition = '{c}' and visits >= {n} then 1 else 0 end) as {k}"
  for k, (c, n) in E.CONDITION_RULES.items())} from visits group by person_id)"""
RX = ["o_custkey as person_id", "concat('rx', l_orderkey) as claim_nr", "l_partkey % 300 as gpi",
      "case l_suppkey % 10 when 0 then '12121200' when 1 then '24081600' when 2 then '24320400' else '0' end as ahfs",
      "cast(l_shipdate as date) as fill_date", "date_add(cast(l_shipdate as date), cast(l_linenumber as int)) as process_date"]
RX_SQL = f"""rxc as (select {sql(RX)} from lineitem join orders on l_orderkey = o_orderkey),
rx as (select person_id, count(distinct claim_nr) as n_claims,
  case when (year(max(fill_date)) - year(min(fill_date))) * 12 + month(max(fill_date)) - month(min(fill_date)) >= 2 then 1 else 0 end as has_three_months,
  count(*) filter (gpi in (select n_nationkey from nation)) as diabetes_fills,
  count(*) filter (ahfs = '12121200') as asthma_fills, count(*) filter (ahfs in ('24081600', '24320400')) as htn_fills
  from rxc where process_date >= date '2001-06-30' - 60 group by person_id)"""
LATE = "date '2001-06-30'"


def conditions(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*DX_CLAIMS)
    n = t.nation
    dim = R.union_rows(*[
        n.where(cut).selectExpr(f"cast(n_nationkey + {shift} as bigint) as dx", f"'{name}' as condition")
        for cut, shift, name in (("n_nationkey < 12", 0, "diabetes"), ("n_nationkey < 14", 12, "htn"),
                                 ("n_nationkey < 5", 26, "asthma"), ("true", 31, "cad"), ("n_nationkey < 2", 60, "stroke"))])
    return E.chronic_conditions(lines, dim, ["dx1", "dx2", "dx3"], F.expr(LATE))


def rx(t):
    fills = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*RX)
    return E.rx_utilization(fills, t.nation.selectExpr("cast(n_nationkey as bigint) as gpi"), F.expr(LATE), 60)


@query("chronic_conditions", f"with {DX_SQL} select * from conditions")
def _conditions(t):
    return conditions(t)


@query("rx_utilization", f"with {RX_SQL} select * from rx")
def _rx(t):
    return rx(t)


@query("enroll_candidates", f"""with {DX_SQL}, {RX_SQL},
people as (select distinct person_id from elig where date '2001-06-30' between start_date and stop_date
  and person_id in (select person_id from enroll) and person_id not in (
    select person_id from enroll where program = 268300000 and (state = 0 and person_id % 3 > 0 or status = 268300313 or outcome = 268300001))),
j as (select p.person_id, c.* exclude (person_id), r.* exclude (person_id) from people p
  left join conditions c on c.person_id = p.person_id left join rx r on r.person_id = p.person_id)
select person_id from j where (diabetes = 1 and diabetes_fills >= 1) or diabetes2 = 1 or has_three_months = 1
  or (asthma = 1 and asthma_fills >= 1) or (htn = 1 and htn_fills >= 2) or stroke = 1 or htn_renal = 1 or cad = 1
  or chf = 1 or copd = 1 or pad = 1""")
def _candidates(t):
    f = frames(t)
    enroll = f["enroll"].withColumn("state", F.expr("cast(case when person_id % 3 > 0 then state else 1 end as int)"))
    return E.enroll_candidates(f["elig"], enroll, conditions(t), rx(t), F.expr(LATE))


SPINE = ["concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as line_id", "o_custkey as person_id",
         "cast(l_shipdate as date) as service_date", "l_quantity - 5 as paid",
         "case l_partkey % 25 when 1 then '22533' when 2 then '22856' when 3 then '63047' when 4 then '22612' else '99213' end as hcpcs",
         "case l_suppkey % 30 when 1 then '459' when 2 then ' 473' when 3 then '520' else '001' end as drg_code",
         "cast(case when l_linenumber = 7 then 1 else 0 end as int) as is_maternity",
         "case when l_partkey % 50 = 3 then 'Y' end as deceased", "cast(l_suppkey % 45 as string) as discharge",
         "concat('z', o_custkey % 40) as zip", "case when l_partkey % 20 = 0 then 'B20' end as dg1",
         "case when l_suppkey % 20 = 0 then 'N186' when l_suppkey % 20 = 1 then 'M54' end as dg2"]
SPINE_SQL = f"""spine as (select {sql(SPINE).replace('as string)', 'as varchar)')} from lineitem join orders on l_orderkey = o_orderkey),
grouped as (select *, case when hcpcs in ('22533', '22612') then 'lumbar' when hcpcs = '22856' then 'cervical'
  when hcpcs = '63047' then 'decompression' when trim(drg_code) = '459' then 'lumbar' when trim(drg_code) = '473' then 'cervical'
  when trim(drg_code) = '520' then 'decompression' end as care_group from spine)"""


def spine(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*SPINE)


@query("spine_care_group", f"with {SPINE_SQL} select line_id, hcpcs, drg_code, care_group from grouped where care_group is not null")
def _group(t):
    return E.spine_care_group(spine(t)).select("line_id", "hcpcs", "drg_code", "care_group")


@query("spine_outreach", f"""with {SPINE_SQL},
people as (select c_custkey as person_id, date '1920-01-01' + cast(c_custkey * 25 % 30000 as int) as dob from customer)
select distinct g.line_id, g.person_id, g.service_date, g.care_group, p.dob from grouped g join people p on p.person_id = g.person_id
where care_group is not null and paid > 0 and is_maternity = 0 and deceased is null and discharge not in ('20', '41', '42', '7')
  and coalesce(dg1, '') <> 'B20' and coalesce(dg2, '') <> 'N186' and service_date > {DAY} - interval 1 year
  and dob + interval 18 year <= {DAY} and dob + interval 75 year >= {DAY}
  and zip in (select 'z' || n_nationkey from nation where n_nationkey % 2 = 0)""")
def _outreach(t):
    people = t.customer.selectExpr("c_custkey as person_id", "date_add(date '1920-01-01', cast(c_custkey * 25 % 30000 as int)) as dob")
    zips = t.nation.selectExpr("concat('z', n_nationkey) as zip", "case when n_nationkey % 2 = 0 then 1 else 0 end as in_catchment", "1 as is_valid")
    out = E.spine_outreach(spine(t), people, zips, ["dg1", "dg2"], F.expr(DAY))
    return out.select("line_id", "person_id", "service_date", "care_group", "dob").distinct()
