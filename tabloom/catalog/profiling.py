"""Profiling and correlation on the driver's tables."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.catalog.relational import SPARSE_SQL, sparse
from tabloom.operators import profile as P

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Columns with real dependence, derived from lineitem.
DEP = ["l_quantity", "l_extendedprice", "l_quantity * 2 + l_tax * 100 as near_copy", "-l_quantity + l_discount * 200 as opposite",
       "l_discount * 100 + l_tax * 50 as mix"]
DEP_COLS = ["l_quantity", "l_extendedprice", "near_copy", "opposite", "mix"]
DEP_SQL = "d as (select " + ", ".join(DEP) + " from lineitem)"
PAIRS = [(a, b) for i, a in enumerate(DEP_COLS) for b in DEP_COLS[i + 1:]]
PAIR_SQL = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from d" for a, b in PAIRS)


def dep(t):
    return t.lineitem.selectExpr(*DEP)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


PROFILE = [("event_id", "bigint"), ("reading", "double"), ("rare", "double"), ("channel", "string"), ("code", "string")]


@query("profile_columns", f"with {SPARSE_SQL} " + " union all ".join(
    f"""select '{c}' as "column", '{d}' as type, count({c}) as non_null, count(*) - count({c}) as nulls, count(distinct {c}) as n_distinct,
  cast(min({c}) as varchar) as min, cast(max({c}) as varchar) as max, round((count(*) - count({c})) / count(*) * 100, 6) as null_pct from sparse"""
    for c, d in PROFILE))
def _profile(t):
    return rounded(P.profile_columns(sparse(t).select(*[c for c, _ in PROFILE])), "null_pct")


@query("audit_types", """select 'bigint' as type, cast(3 as bigint) as n union all select 'int', 1 union all select 'double', 4
union all select 'string', 2 union all select 'timestamp_ntz', 1""")
def _types(t):
    return P.audit_types(t.lineitem)


@query("optimize_dtypes", """select cast(l_orderkey as int) as l_orderkey, cast(l_linenumber as tinyint) as l_linenumber,
  cast(l_suppkey as smallint) as l_suppkey, cast(l_quantity as float) as l_quantity, l_extendedprice, cast(l_shipdate as date) as ship_date from lineitem""")
def _optimize(t):
    rows = t.lineitem.selectExpr("l_orderkey + 100000 as l_orderkey", "l_linenumber", "l_suppkey + 1000 as l_suppkey", "l_quantity",
                                 "l_extendedprice", "date_format(l_shipdate, 'yyyyMMdd') as ship_date")
    out = P.optimize_dtypes(rows)
    shift = {"l_orderkey": 100000, "l_suppkey": 1000}
    return out.withColumns({c: (F.col(c) - n).cast(out.schema[c].dataType) for c, n in shift.items()})


@query("clean_table", f"""with {SPARSE_SQL} select event_id, coalesce(case when (select min(reading) from sparse) > 0 then ln(1 + reading) else reading end, 0.0) as reading,
  code from sparse""")
def _clean(t):
    rows = sparse(t).select("event_id", "reading", "rare", "channel", "code")
    out = P.clean_data(rows, 0.4, ["reading"], fill_with=None)
    return out.na.fill(0.0, subset=["reading"])


@query("corr_pearson", f"with {DEP_SQL}, p as ({PAIR_SQL}) select a, b, round(r, 6) as r from p")
def _pearson(t):
    return rounded(P.corr_pairs(dep(t), DEP_COLS), "r")


RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in DEP_COLS)


@query("corr_spearman", f"with s as (select {', '.join(DEP)} from lineitem), d as (select {RANKS} from s), p as ({PAIR_SQL}) select a, b, round(r, 6) as r from p")
def _spearman(t):
    return rounded(P.corr_pairs(dep(t), DEP_COLS, "spearman"), "r")


@query("corr_kendall", """with v as (select cast(c_custkey as bigint) as i, round(c_acctbal / 100) as x, c_nationkey as y, round(c_acctbal / 500) + c_nationkey as z from customer),
pr as (select sign(a.x - b.x) as sx, sign(a.y - b.y) as sy, sign(a.z - b.z) as sz from v a join v b on a.i < b.i)
select 'x' as a, 'y' as b, round(sum(sx * sy) / sqrt(sum(sx * sx) * sum(sy * sy)), 6) as r from pr
union all select 'x', 'z', round(sum(sx * sz) / sqrt(sum(sx * sx) * sum(sz * sz)), 6) from pr
union all select 'y', 'z', round(sum(sy * sz) / sqrt(sum(sy * sy) * sum(sz * sz)), 6) from pr""")
def _kendall(t):
    rows = t.customer.selectExpr("round(c_acctbal / 100) as x", "c_nationkey as y", "round(c_acctbal / 500) + c_nationkey as z")
    return rounded(P.corr_pairs(rows, ["x", "y", "z"], "kendall"), "r")


@query("corr_top_pairs", f"with {DEP_SQL}, p as ({PAIR_SQL}) select a, b, round(r, 6) as r from p order by abs(r) desc limit 3")
def _top(t):
    return rounded(P.top_pairs(P.corr_pairs(dep(t), DEP_COLS), 3), "r")


@query("corr_pairs_over", f"""with {DEP_SQL}, p as ({PAIR_SQL}) select 'fixed' as rule, a, b, round(r, 6) as r from p where r >= 0.1
union all select 'spread', a, b, round(r, 6) from p where r >= (select avg(r) + 2 * stddev_samp(r) from p)""")
def _over(t):
    pairs = P.corr_pairs(dep(t), DEP_COLS)
    fixed, spread = [P.pairs_over(pairs, c).withColumn("rule", F.lit(n)) for n, c in (("fixed", 0.1), ("spread", None))]
    return rounded(fixed.unionByName(spread), "r")


@query("corr_prune_variance", f"with {DEP_SQL} select l_quantity, l_extendedprice, mix from d")
def _prune_var(t):
    rows = dep(t)
    return P.prune_by_variance(rows, P.corr_pairs(rows, DEP_COLS), 0.85)


@query("corr_prune_upper", f"with {DEP_SQL} select l_quantity, l_extendedprice, mix from d")
def _prune_upper(t):
    rows = dep(t)
    return P.prune_upper(rows, P.corr_pairs(rows, DEP_COLS), 0.85)


@query("corr_with_target", f"""with {DEP_SQL} """ + " union all ".join(
    f"""select '{c}' as "column", round(corr({c}, l_quantity), 6) as r from d""" for c in DEP_COLS[1:]))
def _target(t):
    return rounded(P.corr_target(dep(t), "l_quantity", DEP_COLS[1:]), "r")


@query("corr_column_filter", f"""with {DEP_SQL}, p as ({PAIR_SQL}), e as (select a as "column", abs(r) as r from p union all select b, abs(r) from p)
select "column", round(avg(r), 6) as mean_r from e group by "column" having avg(r) >= 0.12""")
def _filter(t):
    return rounded(P.keep_correlated(P.corr_pairs(dep(t), DEP_COLS)), "mean_r")


OUT_SQL = " union all ".join(
    f"""select '{c}' as "column", round(lo, 6) as lo, round(hi, 6) as hi, (select count(*) from lineitem where {c} < lo or {c} > hi) as n_outliers from (
  select quantile_cont({c}, 0.25) - 0.3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo,
    quantile_cont({c}, 0.75) + 0.3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from lineitem)""" for c in ("l_quantity", "l_extendedprice"))


@query("outliers_iqr", OUT_SQL)
def _outliers(t):
    return rounded(P.detect_outliers_iqr(t.lineitem, ["l_quantity", "l_extendedprice"], 0.3), "lo", "hi")


@query("skew_report", """with v as (select n_chars as a, n_chars * n_chars as b, doc_id as c from documents)
select 'a' as "column", round(skewness(a), 6) as skew from v union all select 'b', round(skewness(b), 6) from v""")
def _skew(t):
    rows = t.documents.selectExpr("n_chars as a", "n_chars * n_chars as b", "doc_id as c")
    return rounded(P.skew_report(rows, ["a", "b", "c"]), "skew")


def hist_sql(c):
    return f"""select '{c}' as "column", least(cast(floor(({c} - lo) / ((hi - lo) / 8)) as int), 7) as bin, count(*) as n from lineitem
  cross join (select min({c}) as lo, max({c}) as hi from lineitem) group by all"""


@query("histogram", hist_sql("l_quantity") + " union all " + hist_sql("l_extendedprice"))
def _histogram(t):
    return P.histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"], 8)


@query("density_2d", """select least(cast(floor((l_quantity - x0) / ((x1 - x0) / 10)) as int), 9) as x_bin,
  least(cast(floor((l_extendedprice - y0) / ((y1 - y0) / 10)) as int), 9) as y_bin, count(*) as n from lineitem cross join (
  select min(l_quantity) as x0, max(l_quantity) as x1, min(l_extendedprice) as y0, max(l_extendedprice) as y1 from lineitem) group by all""")
def _density(t):
    return P.density(t.lineitem, "l_quantity", "l_extendedprice", 10)


@query("class_mean_gap", """with j as (select n_chars, d.doc_id, toxic, quality from documents d join labels l on l.doc_id = d.doc_id),
g as (select 'n_chars' as "column", avg(n_chars) filter (quality = 0) as mean_0, avg(n_chars) filter (quality = 1) as mean_1 from j
  union all select 'doc_id', avg(doc_id) filter (quality = 0), avg(doc_id) filter (quality = 1) from j
  union all select 'toxic', avg(toxic) filter (quality = 0), avg(toxic) filter (quality = 1) from j)
select "column", round(mean_0, 6) as mean_0, round(mean_1, 6) as mean_1, round(abs(mean_1 - mean_0), 6) as gap from g order by gap desc limit 2""")
def _gap(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return rounded(P.top_separating(rows, "quality", ["n_chars", "doc_id", "toxic"], 2), "mean_0", "mean_1", "gap")


AGES = ["case when c_custkey % 6 <> 0 then cast(c_custkey % 90 + 1 as int) end as a",
        "cast(case when c_custkey % 4 = 0 then c_custkey % 80 + 5 else c_custkey % 90 + 1 end as int) as b"]
DECADE = lambda c: f"(cast(ceil({c} / 10) as int) - 1)"


@query("audit_age_match", f"""with v as (select {', '.join(AGES)} from customer)
select 'state' as part, case when a is null or b is null then 'missing' when a = b then 'match' else 'mismatch' end as a_bin, cast(null as varchar) as b_bin, count(*) as n
from v group by all union all
select 'decade', ({DECADE('a')} * 10) || '-' || ({DECADE('a')} * 10 + 9), ({DECADE('b')} * 10) || '-' || ({DECADE('b')} * 10 + 9), count(*)
from v where a is not null and b is not null group by all""")
def _ages(t):
    rows = t.customer.selectExpr(*AGES)
    state = P.age_match(rows, "a", "b").selectExpr("'state' as part", "state as a_bin", "cast(null as string) as b_bin", "n")
    table = P.age_crosstab(rows, "a", "b")
    cells = table.unpivot("a_bin", table.columns[1:], "b_bin", "n").where("n > 0")
    return state.unionByName(cells.selectExpr("'decade' as part", "a_bin", "b_bin", "n"))
