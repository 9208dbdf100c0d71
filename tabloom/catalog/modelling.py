"""Feature preparation and models on per-customer order features."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import models as M
from tabloom.operators import relational as R
from tabloom.plans.conversion import numeric_features

COLS = ["n_orders", "total", "largest", "urgent", "c_acctbal"]
SEGMENT = "case when c_custkey % 10 = 0 then null else c_mktsegment end"


def people(t):
    """Customers with order features; label: more urgent orders than a third, shifted by balance."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").cast("double").alias("n_orders"), (F.sum("o_totalprice") / 1e5).alias("total"),
        (F.max("o_totalprice") / 1e5).alias("largest"),
        F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("double").alias("urgent"))
    base = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1e3).alias("c_acctbal"), "c_nationkey")
    rows = base.join(orders, "id", "left").na.fill(0.0)
    noise = (F.col("id") * 7919 % 100) / 100.0
    return rows.withColumn("y", F.when(F.col("urgent") / (F.col("n_orders") + 1) + F.col("c_acctbal") / 40 + noise / 5 > 0.65, 1).otherwise(0))


@query("label_encode", f"""with c as (select c_custkey, coalesce({SEGMENT}, 'nan') as seg from customer)
select c_custkey, dense_rank() over (order by seg) - 1 as seg from c""")
def _encode(t):
    return M.label_encode(t.customer.selectExpr("c_custkey", f"{SEGMENT} as seg"), ["seg"])


@query("attach_label", """select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50) then 1 else 0 end as label from orders""")
def _attach(t):
    pos = t.lineitem.where("l_quantity = 50").selectExpr("l_orderkey as o_orderkey")
    return M.attach_label(t.orders.select("o_orderkey"), pos, ["o_orderkey"])


@query("factorize", f"""with c as (select c_custkey, {SEGMENT} as seg from customer),
f as (select seg, row_number() over (order by min(c_custkey)) - 1 as code from c where seg is not null group by seg)
select c.c_custkey, coalesce(code, -1) as seg from c left join f on f.seg = c.seg""")
def _factorize(t):
    return M.factorize(t.customer.selectExpr("c_custkey", f"{SEGMENT} as seg"), ["seg"], "c_custkey")


@query("one_hot", "select o_orderkey, " + ", ".join(
    f"case when o_orderstatus = '{s}' then 1 else 0 end as \"o_orderstatus_{s}\"" for s in "FOP") + " from orders")
def _one_hot(t):
    return M.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("low_cardinality_cols", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def _low(t):
    rows = t.orders.withColumn("note", F.concat(F.lit("n"), F.col("o_orderkey").cast("string")))
    return M.low_card(rows).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("impute_constant", "select event_id, case when event_id % 3 <> 0 then value else 0 end as v from events")
def _impute(t):
    return R.fill(t.events.selectExpr("event_id", "case when event_id % 3 <> 0 then value end as v"), {"v": 0.0})


@query("standard_scale", """select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as l_quantity,
  round((l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over (), 6) as l_tax from lineitem""")
def _scale(t):
    out = M.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query("split_random", """select o_orderkey, case when cast('0x' || left(md5(o_orderkey || '-56'), 8) as bigint) % 10000 < 8000 then 'train' else 'test' end as part from orders""")
def _split(t):
    train, test = M.split_random(t.orders.select("o_orderkey"), "o_orderkey", 0.8, 56)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("smote_oversample")
def _smote(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    rows = rows.selectExpr("doc_id as id", "cast(n_chars as double) as n_chars", "cast(doc_id % 97 as double) as place", "toxic as y")
    return M.smote(rows, ["n_chars", "place"], "y")


@query("class_weight", """select doc_id, case when toxic = 1 then (select sum(1 - toxic) / sum(toxic) from labels) else 1 end as weight from labels""")
def _weight(t):
    return M.class_weight(t.labels, "toxic").select("doc_id", "weight")


CHI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHI_PART = """select '{c}' as "column", sum(pow(obs - exp, 2) / exp) as chi2 from (select o.obs, o.n * t.total / t.n as exp from (
  select l_returnflag, sum({c} - lo) as obs, count(*) as n from lineitem cross join (select min({c}) as lo from lineitem) group by l_returnflag) o
  cross join (select sum({c} - lo) as total, count(*) as n from lineitem cross join (select min({c}) as lo from lineitem)) t)"""


@query("select_chi2", "with x as (" + " union all ".join(CHI_PART.format(c=c) for c in CHI) + """)
select "column", round(chi2, 3) as chi2 from x order by x.chi2 desc limit 3""")
def _chi2(t):
    out = M.select_chi2(t.lineitem.select("l_returnflag", *CHI), CHI, "l_returnflag", 3)
    return out.withColumn("chi2", F.round("chi2", 3))


MI_PART = """select '{c}' as "column", sum(n / m * ln(n * m / (nb * ny))) as mi from (select n, sum(n) over (partition by bin) as nb, sum(n) over (partition by y) as ny,
  sum(n) over () as m from (select least(floor((v - lo) / ((hi - lo) / 10)), 9) as bin, y, count(*)::double as n from (
    select {c} as v, l_returnflag as y from lineitem) cross join (select min({c}) as lo, max({c}) as hi from lineitem) group by all))"""


@query("select_mutual_info", "with x as (" + " union all ".join(MI_PART.format(c=c) for c in CHI[:2]) + """) select "column", round(mi, 8) as mi from x""")
def _mi(t):
    return M.mutual_info(t.lineitem.select("l_returnflag", *CHI[:2]), CHI[:2], "l_returnflag").withColumn("mi", F.round("mi", 8))


@query("select_rfe")
def _rfe(t):
    rows = people(t)
    kept = M.select_rfe(rows, COLS, "y", M.classifier("random_forest", "y", numTrees=20), 3)
    return t.spark.createDataFrame([(c, int(c in kept)) for c in COLS], "feature string, kept int")


@query("importance_permutation")
def _permutation(t):
    rows = people(t)
    model = M.fit(rows, COLS, "y", M.classifier("logistic", "y"))
    return M.importance_permutation(model, rows, "id", COLS, "y", M.auc_evaluator("y").evaluate)


@query("importance_tree")
def _importance(t):
    rows = people(t)
    return M.importance_table(rows, M.fit(rows, COLS, "y", M.classifier("random_forest", "y", numTrees=50)), COLS)


def trained(t, kind, **params):
    """Train on 80%, score the rest, report the area under the ROC curve beside each row."""
    train, test = M.split_random(people(t), "id", 0.8)
    model = M.fit(train, COLS, "y", M.classifier(kind, "y", len(COLS), **params))
    return M.score_batch(model, test, "id", "y")


@query("clf_logistic")
def _logistic(t):
    return M.coefficient_table(people(t), COLS, "y")


@query("clf_logistic_balanced")
def _balanced(t):
    train, test = M.split_random(people(t), "id", 0.8)
    weighted = M.class_weight(train, "y")
    est = M.classifier("logistic", "y", weight="weight", elasticNetParam=0.5, regParam=0.01)
    return M.score_batch(M.fit(weighted, COLS, "y", est), test, "id", "y")


@query("clf_random_forest")
def _forest(t):
    return trained(t, "random_forest", numTrees=100)


@query("clf_gbt")
def _gbt(t):
    return trained(t, "gbt", maxIter=20)


PEOPLE_SQL = """o as (select o_custkey as id, count(*)::double as n_orders, sum(o_totalprice) / 1e5 as total, max(o_totalprice) / 1e5 as largest,
  count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH'))::double as urgent from orders group by o_custkey),
f as (select c_custkey as id, coalesce(n_orders, 0) as n_orders, coalesce(total, 0) as total, coalesce(largest, 0) as largest,
  coalesce(urgent, 0) as urgent, c_acctbal / 1e3 as c_acctbal from customer left join o on o.id = c_custkey),
people as (select *, case when urgent / (n_orders + 1) + c_acctbal / 40 + (id * 7919 % 100) / 100.0::double / 5 > 0.65 then 1 else 0 end as y,
  cast('0x' || left(md5(id || '-56'), 8) as bigint) % 10000 < 8000 as train from f)"""
BAYES_SQL = f"""with {PEOPLE_SQL},
e as (select 1e-9 * greatest({', '.join(f'var_pop({c})' for c in COLS)}) as eps from people where train),
m as (select y, count(*) as n, {', '.join(f'avg({c}) as m_{c}, var_pop({c}) as v_{c}' for c in COLS)} from people where train group by y),
ll as (select p.id, p.y as actual, m.y, ln(m.n) - 0.5 * ({' + '.join(f'(ln(2 * pi() * (v_{c} + eps)) + pow(p.{c} - m_{c}, 2) / (v_{c} + eps))' for c in COLS)}) as l
  from people p cross join m cross join e where not p.train),
pr as (select id, actual, 1 / (1 + exp(max(l) filter (y = 0) - max(l) filter (y = 1))) as score from ll group by id, actual)
select id, actual as y, round(score, 4) as score from pr"""


@query("clf_naive_bayes", BAYES_SQL)
def _bayes(t):
    return trained(t, "naive_bayes").select("id", "y", F.round("score", 4).alias("score"))


@query("clf_svm_linear")
def _svm(t):
    return trained(t, "svm_linear", maxIter=50)


@query("clf_decision_tree")
def _tree(t):
    return trained(t, "decision_tree")


@query("clf_mlp")
def _mlp(t):
    return trained(t, "mlp", maxIter=50)


KNN_SQL = """p as (select c_custkey as id, floor(c_acctbal) as a, c_nationkey * 100::double as b, case when c_acctbal > 4000 + c_custkey % 3000 then 1 else 0 end as y from customer),
tr as (select * from p where id % 5 <> 0), te as (select * from p where id % 5 = 0),
d as (select te.id, tr.y, {dist} as d, row_number() over (partition by te.id order by {dist}, tr.id) as rn from te cross join tr)"""


def knn_rows(t):
    return t.customer.selectExpr("c_custkey as id", "cast(floor(c_acctbal) as double) as a", "c_nationkey * 100.0D as b",
                                 "case when c_acctbal > 4000 + c_custkey % 3000 then 1 else 0 end as y")


@query("clf_knn", f"""with {KNN_SQL.format(dist='sqrt(pow(te.a - tr.a, 2) + pow(te.b - tr.b, 2))')}
select id, cast(case when sum(y) >= 3 then 1 else 0 end as int) as prediction from d where rn <= 5 group by id""")
def _knn(t):
    rows = knn_rows(t)
    return M.knn_predict(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), ["a", "b"], "y", 5)


@query("clf_knn_weighted", f"""with {KNN_SQL.format(dist='(abs(te.a - tr.a) + abs(te.b - tr.b))')},
v as (select id, y, round(sum(1 / (d + 1e-12)), 9) as w from d where rn <= 3 group by id, y)
select id, y as prediction from (select *, row_number() over (partition by id order by w desc, y) as r from v) where r = 1""")
def _knn_weighted(t):
    rows = knn_rows(t)
    return M.knn_predict(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), ["a", "b"], "y", 3, "distance", 1)


def regressed(t, kind, **params):
    cols = ["n_orders", "urgent", "c_acctbal", "largest"]
    train, test = M.split_random(people(t), "id", 0.8)
    scored = M.fit(train, cols, "total", M.regressor(kind, "total", **params)).transform(test)
    return scored.select("id", "total", "prediction")


def two_feature_sql(penalty):
    """Normal equations of total on (n_orders, urgent); the penalty goes on the diagonal."""
    return f"""with o as (select o_custkey as id, count(*)::double as n_orders, sum(o_totalprice) / 1e5 as total,
  count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH'))::double as urgent from orders group by o_custkey),
p as (select c_custkey as id, coalesce(n_orders, 0) as a, coalesce(urgent, 0) as b, coalesce(total, 0) as y,
  cast('0x' || left(md5(c_custkey || '-56'), 8) as bigint) % 10000 < 8000 as train from customer left join o on o.id = c_custkey),
s as (select avg(a) as ma, avg(b) as mb, avg(y) as my, count(*) * var_pop(a) + {penalty} as aa, count(*) * var_pop(b) + {penalty} as bb,
  count(*) * covar_pop(a, b) as ab, count(*) * covar_pop(a, y) as ay, count(*) * covar_pop(b, y) as by_ from p where train),
w as (select *, (bb * ay - ab * by_) / (aa * bb - ab * ab) as wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as wb from s)
select id, round(my + wa * (a - ma) + wb * (b - mb), 4) as prediction from p cross join w where not train"""


@query("reg_linear", two_feature_sql("0"))
def _linear(t):
    train, test = M.split_random(people(t), "id", 0.8)
    model = M.fit(train, ["n_orders", "urgent"], "total", M.regressor("linear", "total", solver="normal"))
    return model.transform(test).select("id", F.round("prediction", 4).alias("prediction"))


@query("reg_ridge", two_feature_sql("50"))
def _ridge(t):
    train, test = M.split_random(people(t), "id", 0.8)
    model = M.ridge(train, ["n_orders", "urgent"], "total", 50.0)
    return model.transform(test).select("id", F.round("prediction", 4).alias("prediction"))


@query("reg_random_forest")
def _reg_forest(t):
    return regressed(t, "random_forest", numTrees=50)


@query("reg_gbt")
def _reg_gbt(t):
    return regressed(t, "gbt", maxIter=20)


@query("search_grid")
def _grid(t):
    rows = people(t)
    est = M.classifier("logistic", "y", maxIter=20)
    _, res = M.search(rows, COLS, "y", est, {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}, M.auc_evaluator("y"))
    return M.search_table(rows, res)


@query("search_random")
def _random(t):
    rows = people(t)
    est = M.classifier("decision_tree", "y")
    _, res = M.search(rows, COLS, "y", est, {"maxDepth": [2, 3, 5], "minInstancesPerNode": [1, 10]}, M.auc_evaluator("y"), n_iter=3)
    return M.search_table(rows, res)


@query("cross_validate")
def _cv(t):
    rows = people(t)
    return M.cross_validate(rows, COLS, "y", M.classifier("logistic", "y", maxIter=20), M.auc_evaluator("y"), 5)


# The least-squares rising fit at a point is the greatest, over starts before it, of the least mean, over ends behind it.
@query("calibrate_isotonic", """with p as (select c_custkey as id, cast(c_acctbal as double) as score, case when c_acctbal > 4000 + c_custkey % 3000 then 1 else 0 end as y from customer),
g as (select score, sum(y) as sy, count(*) as n, row_number() over (order by score) as i from p group by score),
c as (select *, sum(sy) over (order by i) as cs, sum(n) over (order by i) as cn from g),
ab as (select a.i as a, b.i as b, (b.cs - a.cs + a.sy) / (b.cn - a.cn + a.n) as mean from c a join c b on b.i >= a.i),
lows as (select a, b as i, min(mean) over (partition by a order by b desc) as low from ab),
fit as (select i, max(low) as fitted from lows group by i)
select id, y, score, round(fitted, 9) as calibrated from p join g using (score) join fit using (i)""")
def _calibrate(t):
    scored = t.customer.selectExpr("c_custkey as id", "cast(c_acctbal as double) as score", "case when c_acctbal > 4000 + c_custkey % 3000 then 1 else 0 end as y")
    return M.calibrate_isotonic(scored, "y", "score").transform(scored).select("id", "y", "score", F.round("calibrated", 9).alias("calibrated"))


@query("score_batch")
def _score(t):
    rows = people(t)
    model = M.fit(rows, COLS, "y", M.classifier("logistic", "y"))
    return M.score_batch(M.save_and_load(model, rows), rows, "id", "y")


@query("feature_align", """select l_quantity, 0.0::double as missing, coalesce(try_cast(case when l_linenumber = 2 then 'bad' else cast(l_partkey as varchar) end as double), 0) as code from lineitem""")
def _align(t):
    rows = t.lineitem.selectExpr("l_quantity", "case when l_linenumber = 2 then 'bad' else cast(l_partkey as string) end as code", "l_tax as unused")
    return numeric_features(rows, ["l_quantity", "missing", "code"])


@query("kmeans_elbow")
def _elbow(t):
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding")).alias("features"))
    return M.kmeans_elbow(rows, "features", 2, 50)


PRICE_SQL = f"""with {PEOPLE_SQL},
r as (select id, least(1.0, 0.4 + c_acctbal / 20 + n_orders / 100)::double as u, largest + 0.5::double as price, n_orders from people),
s as (select avg(price) as ma, avg(n_orders) as mb, avg(u) as my, var_pop(price) as aa, var_pop(n_orders) as bb, covar_pop(price, n_orders) as ab,
  covar_pop(price, u) as ay, covar_pop(n_orders, u) as by_ from r),
w as (select *, (bb * ay - ab * by_) / (aa * bb - ab * ab) as wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as wb from s),
g as (select id, price, price * (1 - 5.0::double + 10.0::double / 29 * i) as p, my + wa * (price * (1 - 5.0::double + 10.0::double / 29 * i) - ma) + wb * (n_orders - mb) as pred,
  my + wa * (price - ma) + wb * (n_orders - mb) as now from r cross join w cross join (select unnest(range(0, 30)) as i))
select id, price as current_price, round(coalesce(arg_min(p, pred - 0.6) filter (pred >= 0.6 and p > 0), price), 4) as best_price,
  round(coalesce(min(pred) filter (pred >= 0.6 and p > 0), max(now)), 4) as predicted from g group by id, price"""


@query("price_grid_search", PRICE_SQL)
def _prices(t):
    rows = people(t).selectExpr("id", "least(1.0, 0.4 + c_acctbal / 20 + n_orders / 100) as utilization", "largest + 0.5 as price", "n_orders")
    model = M.fit(rows, ["price", "n_orders"], "utilization", M.regressor("linear", "utilization"))
    out = M.price_grid_search(rows, model, "id", "price", 0.6, 5.0, 30)
    return out.withColumns({c: F.round(c, 4) for c in ("best_price", "predicted")})
