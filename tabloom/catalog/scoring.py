"""Evaluation on orders scored by a fixed function of their key (with ties)."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import evaluate as E
from tabloom.operators.ordered import attach

SCORED = ["o_orderkey as id", "case when o_orderstatus = 'F' then 1 else 0 end as y", "(o_orderkey * 7919 % 1000) / 1000.0D as score",
          "case when o_orderkey * 7919 % 1000 >= 600 then 1 else 0 end as pred"]
SCORED_SQL = "s as (select " + ", ".join(SCORED).replace("1000.0D", "1000.0::double") + " from orders)"


def scored(t):
    return t.orders.selectExpr(*SCORED)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("eval_confusion", f"with {SCORED_SQL} select y, pred, count(*) as n from s group by y, pred")
def _confusion(t):
    return E.confusion(scored(t), "y", "pred")


REPORT = """select '{c}' as class, count(*) filter (y = {c} and pred = {c}) / count(*) filter (pred = {c}) as precision,
  count(*) filter (y = {c} and pred = {c}) / count(*) filter (y = {c}) as recall, count(*) filter (y = {c}) as support from s"""


@query("eval_class_report", f"""with {SCORED_SQL}, r as ({REPORT.format(c=0)} union all {REPORT.format(c=1)}),
f as (select *, 2 * precision * recall / (precision + recall) as f1 from r),
a as (select *  from f union all select 'macro', avg(precision), avg(recall), sum(support)::bigint, avg(f1) from f)
select class, round(precision, 6) as precision, round(recall, 6) as recall, support, round(f1, 6) as f1,
  (select round(avg(case when y = pred then 1 else 0 end), 6) from s) as accuracy from a""")
def _report(t):
    return rounded(E.class_report(scored(t), "y", "pred"), "precision", "recall", "f1", "accuracy")


POINTS = """g as (select score, cast(sum(y) as bigint) as pos, cast(sum(1 - y) as bigint) as neg from s group by score),
p as (select score as threshold, sum(pos) over w / sum(pos) over () as tpr, sum(neg) over w / sum(neg) over () as fpr,
  sum(pos) over w / (sum(pos) over w + sum(neg) over w) as precision from g window w as (order by score desc))"""


@query("eval_roc_auc", f"""with {SCORED_SQL}, {POINTS},
t as (select *, lag(tpr, 1, 0) over (order by threshold desc) as tpr0, lag(fpr, 1, 0) over (order by threshold desc) as fpr0 from p)
select threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr, round((select sum((fpr - fpr0) * (tpr + tpr0) / 2) from t), 6) as auc from p""")
def _roc(t):
    auc = E.roc_auc(scored(t), "y", "score")
    return rounded(attach(E.roc_points(scored(t), "y", "score"), auc), "fpr", "tpr", "auc")


@query("eval_pr_curve", f"""with {SCORED_SQL}, {POINTS},
t as (select *, lag(tpr, 1, 0) over (order by threshold desc) as r0, lag(precision, 1, 1) over (order by threshold desc) as p0 from p)
select threshold, round(tpr, 6) as recall, round(precision, 6) as precision, round((select sum((tpr - r0) * (precision + p0) / 2) from t), 6) as pr_auc from p""")
def _pr(t):
    auc = E.pr_auc(scored(t), "y", "score")
    return rounded(attach(E.pr_points(scored(t), "y", "score"), auc), "recall", "precision", "pr_auc")


TS = " union all ".join(f"select {x}::double as t" for x in E.THRESHOLDS)


@query("eval_threshold_sweep", f"""with {SCORED_SQL}, ts as ({TS}),
g as (select t as threshold, coalesce(count(*) filter (score >= t and y = 1) / nullif(count(*) filter (score >= t), 0), 0) as precision,
  count(*) filter (score >= t and y = 1) / count(*) filter (y = 1) as recall from s cross join ts group by t)
select threshold, round(precision, 6) as precision, round(recall, 6) as recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1 from g""")
def _sweep(t):
    return rounded(E.threshold_sweep(scored(t), "y", "score"), "precision", "recall", "f1")


RANKED = f"{SCORED_SQL}, r as (select *, row_number() over (order by score desc, id) as rn, count(*) over () as n, sum(y) over () as total from s)"


@query("eval_lift_topk", f"""with {RANKED} """ + " union all ".join(
    f"""select {p}::double as top_share, count(*) as users, cast(sum(y) as bigint) as positives, round(sum(y) / max(total), 6) as recall,
  round((sum(y) / count(*)) / (max(total) / max(n)), 6) as lift from r where rn <= floor(n * {p})""" for p in (0.01, 0.05, 0.1)))
def _lift(t):
    return rounded(E.lift_topk(scored(t), "y", "score", "id"), "recall", "lift")


@query("eval_decile_table", f"""with {RANKED}, d as (select *, cast(ntile(10) over (order by score desc, id) as int) as decile from r),
g as (select decile, count(*) as size, cast(sum(y) as bigint) as converters, max(n) as n, max(total) as total from d group by decile)
select decile, size, converters, size - converters as non_converters, round(converters / size, 6) as conversion_rate,
  round((converters / size) / (total / n), 6) as lift, cast(sum(converters) over (order by decile) as bigint) as cumulative_converters,
  round(sum(converters) over (order by decile) / total, 6) as cumulative_share, round(size / n, 6) as size_share from g""")
def _decile(t):
    return rounded(E.decile_table(scored(t), "y", "score", "id"), "conversion_rate", "lift", "cumulative_share", "size_share")


@query("eval_score_summary", f"""with {RANKED} select cast(sum(y) as bigint) as converters, round(avg(score) filter (y = 1), 6) as mean_score,
  min(score) filter (y = 1) as min_score, max(score) filter (y = 1) as max_score, cast(sum(y) filter (rn <= floor(n * 0.1)) as bigint) as top10,
  cast(sum(y) filter (rn <= floor(n * 0.25)) as bigint) as top25, count(*) filter (score > 0.75) as n_high, round(avg(y) filter (score > 0.75), 6) as high_rate from r""")
def _summary(t):
    return rounded(E.score_summary(scored(t), "y", "score", "id"), "mean_score", "high_rate")


REG = "select l_extendedprice as y, l_quantity * 1500 + l_tax * 100 as pred from lineitem"


@query("eval_regression", f"""with r as ({REG}) select round(avg(abs(y - pred)), 4) as mae, round(avg(pow(y - pred, 2)) / 1e6, 4) as mse_millions,
  round(sqrt(avg(pow(y - pred, 2))), 4) as rmse, round(1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(*)), 6) as r2,
  round(var_samp(y) / 1e6, 4) as variance_millions from r""")
def _regression(t):
    rows = t.lineitem.selectExpr("l_extendedprice as y", "l_quantity * 1500 + l_tax * 100 as pred")
    m = E.regression_metrics(rows, "y", "pred")
    return m.select(F.round("mae", 4).alias("mae"), F.round(F.col("mse") / 1e6, 4).alias("mse_millions"), F.round("rmse", 4).alias("rmse"),
                    F.round("r2", 6).alias("r2"), F.round(F.col("target_variance") / 1e6, 4).alias("variance_millions"))


@query("eval_residuals", f"""with r as (select y - pred as e from ({REG})), m as (select min(e) as lo, max(e) as hi from r)
select least(cast(floor((e - lo) / ((hi - lo) / 20)) as int), 19) as bin, count(*) as n from r cross join m group by all""")
def _residuals(t):
    rows = t.lineitem.selectExpr("l_extendedprice as y", "l_quantity * 1500 + l_tax * 100 as pred")
    return E.residual_histogram(rows, "y", "pred")


@query("threshold_predict", f"with {SCORED_SQL} select id, case when score >= 0.35 then 1 else 0 end as prediction from s")
def _predict(t):
    return E.predict_at(scored(t), "score", 0.35).select("id", "prediction")
