"""Provider jobs: supplier = provider, nation = specialty dimension, events = referrals."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.plans import providers as P

RAW = ["concat('P', s_suppkey, chr(cast(65 + s_suppkey % 4 as int))) as prov_id", "concat(s_suppkey + 1000000000, '.0') as npi",
       "concat(s_suppkey % 37, '.0') as tax_id", "s_suppkey % 30 as spec1", "s_suppkey % 25 as spec2",
       "cast(s_nationkey as bigint) as spec3", "s_suppkey % 50 as spec4", "s_name as name", "concat('1, Main St. ', s_suppkey) as address"]


@query("provider_clean", """with r as (select 'P' || s_suppkey as provider, chr(cast(65 + s_suppkey % 4 as int)) as location,
  s_suppkey + 1000000000 as npi, s_suppkey % 37 as tax_id, s_suppkey % 30 as spec1, s_suppkey % 25 as spec2,
  cast(s_nationkey as bigint) as spec3, s_suppkey % 50 as spec4, s_name as name, '1, Main St. ' || s_suppkey as address from supplier),
m as (select n_nationkey as code, n_regionkey as id from nation where n_nationkey % 5 <> 0)
select r.*, provider || location || npi || tax_id || replace(replace(address, ',', ''), '.', '') as flag_id, a.id as spec1_specialty_id,
  b.id as spec2_specialty_id, c.id as spec3_specialty_id, d.id as spec4_specialty_id from r left join m a on spec1 = a.code
left join m b on spec2 = b.code left join m c on spec3 = c.code left join m d on spec4 = d.code""")
def _clean(t):
    raw = t.supplier.selectExpr(*RAW)
    codes = t.nation.selectExpr("cast(n_nationkey as bigint) as specialty_code", "n_regionkey as specialty_id",
                                "case when n_nationkey % 5 = 0 then 'OTH' else 'SPS' end as file_type")
    return P.provider_clean(raw.unionByName(raw), codes)


@query("provider_scd", """with cur as (select c_custkey as id, c_name as name, date '2023-01-01' as date_added,
    case when c_custkey % 10 = 3 then date '2023-06-01' end as date_removed from customer where c_custkey % 3 <> 0),
inc as (select c_custkey as id, c_name as name from customer where c_custkey % 4 <> 1)
select coalesce(cur.id, inc.id) as id, coalesce(cur.name, inc.name) as name,
  case when cur.id is null then date '2024-01-31' else date_added end as date_added,
  case when inc.id is null then coalesce(date_removed, date '2024-01-31') end as date_removed
from cur full join inc on cur.id = inc.id""")
def _scd(t):
    cur = t.customer.where("c_custkey % 3 <> 0").selectExpr(
        "c_custkey as id", "c_name as name", "date '2023-01-01' as date_added",
        "case when c_custkey % 10 = 3 then date '2023-06-01' end as date_removed")
    inc = t.customer.where("c_custkey % 4 <> 1").selectExpr("c_custkey as id", "c_name as name")
    return P.provider_scd(cur, inc, "id", F.expr("date '2024-01-31'"))


SYSTEMS = {"presby": "purchase", "northwell": "click", "nyu": "view"}
LISTS = [("mshs", 3), ("nyp", 4), ("northwell", 5), ("nyu", 6), ("presby", 7), ("wmc", 8)]


@query("provider_affiliation", f"""with p as (select s_suppkey as npi, s_name as lbn1, 'Nation ' || s_nationkey as lbn2 from supplier),
refs as (select user_id as npi, count(*) as n_refs, count(distinct event_id % 40) as n_people,
  {', '.join(f"count(*) filter (event_type = '{v}') as {k}_refs, count(distinct case when event_type = '{v}' then event_id % 40 end) as {k}_people"
    for k, v in SYSTEMS.items())} from events where event_type in ('purchase', 'click', 'view') group by user_id),
j as (select p.*, concat_ws(';', case when lower(lbn1 || chr(10) || lbn2) like '%0001%' or lower(lbn1 || chr(10) || lbn2) like '%nation 3%' then 'east' end,
    case when lower(lbn1 || chr(10) || lbn2) like '%7%' then 'west' end) as affiliations,
  {', '.join(f"case when npi % {m} = 0 then 1 else 0 end as {n}" for n, m in LISTS)} from p)
select j.*, coalesce(n_refs, 0) as n_refs, coalesce(n_people, 0) as n_people,
  {', '.join(f"coalesce({k}_refs, 0) as {k}_refs, coalesce({k}_people, 0) as {k}_people" for k in SYSTEMS)},
  -5 * mshs + 5 * nyp + 3 * (northwell + nyu + presby + wmc) + coalesce(n_refs, 0) as score
from j left join refs r on r.npi = j.npi""")
def _affiliation(t):
    rows = t.supplier.selectExpr("s_suppkey as npi", "s_name as lbn1", "concat('Nation ', s_nationkey) as lbn2")
    pairs = ", ".join(f"case when s_suppkey % {m} = 0 then '{n}' end" for n, m in LISTS)
    lists = t.supplier.selectExpr("s_suppkey as npi", f"explode(array_compact(array({pairs}))) as list")
    refs = t.events.selectExpr("user_id as npi", "event_type as system", "event_id % 40 as ssn")
    return P.provider_affiliation(rows, ["lbn1", "lbn2"], {"east": ["0001", "nation 3"], "west": ["7"]}, lists, refs, SYSTEMS)


@query("hospital_crosswalk", """select distinct n_nationkey as ccn, n_name as hospital, s_suppkey % 30 as tin, r_name as system
from nation join supplier on s_nationkey = n_nationkey left join region on r_regionkey = s_suppkey % 30""")
def _hospital(t):
    linkage = t.nation.selectExpr("n_nationkey as ccn", "n_name as hospital")
    tins = t.supplier.selectExpr("s_nationkey as ccn", "s_suppkey % 30 as tin")
    systems = t.region.selectExpr("cast(r_regionkey as bigint) as tin", "r_name as system")
    return P.hospital_crosswalk(linkage, tins, systems)


@query("rate_file_flatten", """with o as (select o_orderkey as plan_id, o_totalprice as charge from orders),
d as (select *, plan_id % 3 as n from o),
e as (select d.plan_id, d.charge, case when n = 0 then null else i end as i from d left join (select unnest([1, 2]) as i) on i <= n)
select plan_id, 'S' || i as name, 'npi' as tin_type, cast(plan_id * 10 + i as varchar) as tin_value,
  charge / i as allowed_amount, charge as provider_billed_charge, plan_id + j as provider_npi
from e join (select unnest([0, 1]) as j) on true where i is not null
union all select plan_id, null, null, null, null, null, null from e where i is null""")
def _rates(t):
    payment = """array(struct(o_totalprice / i as allowed_amount, transform(array(0, 1), j -> struct(
      o_totalprice as billed_charge, o_orderkey + j as npi)) as providers))"""
    amounts = f"array(struct(struct('npi' as type, cast(o_orderkey * 10 + i as string) as value) as tin, {payment} as payments))"
    services = f"transform(sequence(1, cast(o_orderkey % 3 as int)), i -> struct(concat('S', i) as name, {amounts} as allowed_amounts))"
    docs = t.orders.selectExpr("o_orderkey as plan_id", f"case when o_orderkey % 3 > 0 then {services} end as out_of_network")
    return P.rate_file_flatten(docs)
