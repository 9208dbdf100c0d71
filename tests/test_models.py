"""Neighbours, rank correlation, sampling and training against numpy."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import evaluate as E
from tabloom.operators import models as M
from tabloom.operators import profile as P
from tabloom.operators import series as S


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.range(240).selectExpr(
        "id", "cast(id * 37 % 101 as double) as a", "cast(id * 53 % 97 as double) as b", "cast(case when id * 37 % 101 > 60 then 1 else 0 end as int) as y").cache()


@pytest.mark.parametrize("pivots", [1, 7, 400])
def test_nearest_rows_any_number_of_pivots(cloud, pivots):
    got = M.nearest_rows(cloud, cloud, ["a", "b"], 4, skip_self=True, pivots=pivots).collect()
    pdf = cloud.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {i: sorted(range(240), key=lambda j: (d[i, j], j))[:4] for i in range(240)}
    have = {}
    for r in sorted(got, key=lambda r: (r.distance, r.other)):
        have.setdefault(r.id, []).append(r.other)
    assert have == want


@pytest.mark.parametrize("p", [1, 2, 3])
def test_nearest_rows_with_a_hot_spot(spark, p):
    """A third of the rows at one spot, far outliers, nulls; three features."""
    df = spark.range(300).selectExpr(
        "id", "case when id % 3 = 0 then 5.0D when id = 4 then null else id * 37 % 101 / 7.0D end as a",
        "case when id % 3 = 0 then 5.0D when id = 7 then 1e6D when id = 10 then double('NaN') else id * 53 % 97 / 3.0D end as b", "cast(case when id % 3 = 0 then 5 else id % 5 end as double) as c")
    rows = [r for r in df.collect() if r.a is not None and r.b == r.b]
    x = np.array([[r.a, r.b, r.c] for r in rows])
    got = {}
    for r in M.nearest_rows(df, df.where("id % 2 = 0"), ["a", "b", "c"], 5, p).collect():
        got.setdefault(r.id, []).append((r.distance, r.other))
    assert set(got) == {r.id for r in rows}
    for i, r in enumerate(rows):
        d = (np.abs(x - x[i]) ** p).sum(1) ** (1 / p)
        want = sorted((d[j], rows[j].id) for j in range(len(rows)) if rows[j].id % 2 == 0)[:5]
        assert np.allclose([w[0] for w in want], [g[0] for g in sorted(got[r.id])])
        assert {w[1] for w in want if w[0] < want[-1][0] - 1e-9} <= {g[1] for g in got[r.id]}


def test_a_query_visits_few_parts(spark):
    """Two features, 1,600 rows, 40 pivots: on average a query meets a small share of the parts."""
    rng = np.random.default_rng(1)
    x = rng.random((1600, 2))
    at = x[:40]
    d = np.sqrt(((x[:, None] - at) ** 2).sum(-1))
    own = d.argmin(1)
    reach = np.array([d[own == j, j].max() for j in range(40)])
    near = np.array([np.sort(np.append(d[own == j, j], [np.inf] * 5))[:5] for j in range(40)])
    assert M.Pivots(at, reach, near, 2).visits(rng.random((500, 2))).sum(1).mean() < 8


@pytest.mark.parametrize("mod", [(101, 97), (5, 3)])
def test_kendall_matches_pairs(spark, mod):
    df = spark.range(150).selectExpr(f"id * 37 % {mod[0]} as x", f"id * 53 % {mod[1]} as y")
    pdf = df.toPandas()
    s = [(np.sign(pdf.x[i] - pdf.x[j]), np.sign(pdf.y[i] - pdf.y[j])) for i, j in combinations(range(150), 2)]
    sx, sy = np.array(s).T
    want = (sx * sy).sum() / np.sqrt((sx ** 2).sum() * (sy ** 2).sum())
    assert P.kendall_tau(df, "x", "y") == pytest.approx(want, abs=1e-12)


def test_kendall_extremes(spark):
    df = spark.range(50).selectExpr("id as x", "id * 2 as y", "-id as z")
    assert P.kendall_tau(df, "x", "y") == pytest.approx(1.0)
    assert P.kendall_tau(df, "x", "z") == pytest.approx(-1.0)


def test_smote_balances_between_parents(cloud):
    out = M.smote(cloud, ["a", "b"], "y")
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    made = out.where("synthetic = 1").agg(F.min("a"), F.max("a")).first()
    small = cloud.where("y = 1").agg(F.min("a"), F.max("a")).first()
    assert small[0] <= made[0] and made[1] <= small[1]
    again = M.smote(cloud, ["a", "b"], "y")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_smote_raises_every_smaller_class(spark):
    """Three classes and a lonely row: all end up as large as the largest, between rows of their own class."""
    df = spark.range(100).selectExpr("id", "cast(id as double) as a", "cast(id * 7 % 31 as double) as b",
                                     "cast(case when id < 60 then 0 when id < 85 then 1 when id < 99 then 2 else 3 end as int) as y")
    out = M.smote(df, ["a", "b"], "y")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 60, 1: 60, 2: 60, 3: 60}
    assert out.where("synthetic = 1 and y = 1 and (a < 60 or a > 84)").count() == 0
    assert {(r.a, r.b) for r in out.where("y = 3").collect()} == {(99.0, 99 * 7 % 31 * 1.0)}


def test_regression_matches_least_squares(cloud):
    df = cloud.withColumn("t", 3 * F.col("a") - 2 * F.col("b") + F.col("y") * 5 + 1)
    model = M.fit(df, ["a", "b", "y"], "t", M.regressor("linear", "t"))
    assert np.allclose(model.stages[-1].coefficients.toArray(), [3, -2, 5], atol=1e-6)
    m = E.regression_metrics(model.transform(df), "t", "prediction").first()
    assert m.rmse < 1e-6 and m.r2 == pytest.approx(1.0)


@pytest.mark.parametrize("alpha", [0.0, 1.0, 500.0])
def test_ridge_matches_the_closed_form(cloud, alpha):
    df = cloud.withColumn("t", 3 * F.col("a") - 2 * F.col("b") + F.col("y") * 40 + F.col("id") % 7)
    got = M.ridge(df, ["a", "b"], "t", alpha).stages[-1].coefficients.toArray()
    pdf = df.toPandas()
    x = pdf[["a", "b"]] - pdf[["a", "b"]].mean()
    want = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ (pdf["t"] - pdf["t"].mean()))
    assert np.allclose(got, want, rtol=1e-6)


@pytest.mark.parametrize("kind", ["logistic", "random_forest", "gbt", "naive_bayes", "svm_linear", "decision_tree", "mlp"])
def test_classifiers_learn_the_rule(cloud, kind):
    extra = {"random_forest": {"numTrees": 10}, "gbt": {"maxIter": 5}}.get(kind, {})
    model = M.fit(cloud, ["a", "b"], "y", M.classifier(kind, "y", 2, **extra))
    scored = M.score_batch(model, cloud, "id", "y")
    assert E.roc_auc(scored, "y", "score").first()[0] > 0.9


def test_scaled_features_are_centred(cloud):
    r = M.standard_scale(cloud, ["a"]).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(r[0]) < 1e-9 and r[1] == pytest.approx(1.0)


def test_isotonic_is_monotone(cloud):
    scored = cloud.withColumn("score", F.col("a") / 101)
    out = M.calibrate_isotonic(scored, "y", "score").transform(scored).orderBy("score").select("calibrated").collect()
    values = [r[0] for r in out]
    assert values == sorted(values)


def test_isotonic_equals_pooling_by_hand(spark):
    """Unrounded scores with ties, against pooling neighbours one by one."""
    rng = np.random.default_rng(3)
    x = np.round(rng.random(400), 2) + rng.integers(0, 2, 400) * 1e-7
    y = (rng.random(400) < x).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, y int")
    got = {r.score: r.calibrated for r in M.calibrate_isotonic(df, "y", "score").transform(df).collect()}
    pools = []
    for v in sorted(set(x)):
        pools.append([y[x == v].sum(), (x == v).sum(), [v]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, vs = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + vs]
    for s, n, vs in pools:
        for v in vs:
            assert got[float(v)] == pytest.approx(s / n)


def test_elbow_is_the_k_before_the_largest_gain(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(120).selectExpr("cast(id % 4 * 100 + id % 7 as double) as a", "cast(id % 4 % 2 * 100 + id % 5 as double) as b")
    rows = M.kmeans_elbow(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df), "f", 2, 6).orderBy("k").collect()
    gains = [b.silhouette - a.silhouette for a, b in zip(rows, rows[1:])]
    assert [r.k for r in rows if r.chosen] == [2 + int(np.argmax(gains))]


def test_silhouettes_equal_the_evaluator(spark):
    """Overlapping clusters, one of a single row; every k at once."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(200).selectExpr("cast(id * 37 % 101 as double) as a", "cast(case when id = 9 then 5000 else id * 53 % 97 end as double) as b")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df)
    models = {k: KMeans(k=k, seed=1, featuresCol="f").fit(df) for k in (2, 3, 7)}
    got = M.silhouettes(df, "f", {k: np.array(m.clusterCenters()) for k, m in models.items()})
    for k, m in models.items():
        assert got[k] == pytest.approx(ClusteringEvaluator(featuresCol="f").evaluate(m.transform(df)), abs=1e-9)


def test_shuffled_column_keeps_its_values(cloud):
    out = M.shuffled(cloud, "id", "a", 1)
    assert sorted(r.a for r in out.collect()) == sorted(r.a for r in cloud.collect())
    assert out.join(cloud.select("id", F.col("a").alias("a0")), "id").where("a <> a0").count() > 100


def test_price_search_takes_the_nearest_from_above(spark):
    df = spark.range(1, 21).selectExpr("id", "cast(id as double) as price", "1.2D - id * 0.05D as u")
    model = M.fit(df, ["price"], "u", M.regressor("linear", "u"))
    for r in M.price_grid_search(df, model, "id", "price", 0.75, 0.5, 30).collect():
        if r.predicted >= 0.75 - 1e-9 and r.best_price != r.current_price:
            grid = [r.current_price * (0.5 + i / 29) for i in range(30)]
            ok = [1.2 - p * 0.05 for p in grid if 1.2 - p * 0.05 >= 0.75]
            assert r.predicted == pytest.approx(min(ok), abs=1e-6)
        else:
            assert r.best_price == r.current_price


def test_forecast_repeats_a_season(spark):
    week = {0: 10.0, 1: 20.0, 2: 30.0, 3: 20.0, 4: 15.0}
    df = spark.range(140).selectExpr("date_add(date '2024-01-01', cast(id as int)) as d").where("weekday(d) < 5")
    df = df.withColumn("y", F.element_at(F.create_map(*[F.lit(x) for kv in week.items() for x in kv]), F.weekday("d")))
    out = S.forecast_series(df.withColumn("k", F.lit(1)), ["k"], "d", "y", 10).orderBy("day").collect()
    assert len(out) == 10
    for r in out:
        assert r.day.weekday() < 5 and r.forecast == pytest.approx(week[r.day.weekday()], abs=1e-6)
        assert r.low <= r.forecast <= r.high


def test_lift_and_threshold_edges(spark):
    df = spark.createDataFrame([(i, int(i < 3), 1 - i / 10) for i in range(10)], "id int, y int, score double")
    top = {round(r.top_share, 2): r for r in E.lift_topk(df, "y", "score", "id", [0.1, 0.3]).collect()}
    assert top[0.3].positives == 3 and top[0.3].recall == 1.0 and top[0.3].lift == pytest.approx(10 / 3)
    sweep = {r.threshold: r for r in E.threshold_sweep(df, "y", "score", [0.1, 0.95]).collect()}
    assert sweep[0.95].precision == 1.0 and sweep[0.95].recall == pytest.approx(1 / 3)
    assert E.roc_auc(df, "y", "score").first()[0] == 1.0


def test_search_reads_stored_rows(spark, monkeypatch):
    """Every fit of a search reads its rows again: a join behind them runs once."""
    seen, real = [], M.CrossValidator.fit
    monkeypatch.setattr(M.CrossValidator, "fit", lambda self, df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(self, df))
    left = spark.range(80).selectExpr("id", "cast(id % 7 as double) as a")
    rows = left.join(spark.range(80).selectExpr("id", "cast(id % 7 > 3 as int) as y"), "id")
    assert M.cross_validate(rows, ["a"], "y", M.classifier("logistic", "y", maxIter=2), M.auc_evaluator("y"), 2).count() == 1
    assert len(seen) == 1 and "Join" not in seen[0]


def test_series_are_forecast_by_the_batch(spark):
    """Series of any length, with null keys and values, equal each series fitted alone; no call of Python per series."""
    days = pd.bdate_range("2024-01-01", periods=40)
    rows = [(None if k == 3 else k, "ab"[k % 2], d.date(), float((i * 7 + k * 3) % 11) + 0.25 * k) for k in range(12) for i, d in enumerate(days[: 1 + 3 * k])]
    df = spark.createDataFrame(rows, "k long, kind string, d date, y double")
    out = S.forecast_series(df, ["k", "kind"], "d", "y", 4)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.kind, r.day): (r.forecast, r.low, r.high) for r in out.collect()}
    assert len(got) == 48
    for k in range(12):
        mine = [(d, y) for a, _, d, y in rows if a == (None if k == 3 else k)]
        path = [y for _, y in mine]
        coef, sd = S.fit_seasonal_ar(np.array(path), 5)
        for step, day in enumerate(pd.bdate_range(pd.Timestamp(mine[-1][0]) + pd.Timedelta(days=1), periods=4), 1):
            back = [path[-n] if len(path) >= n else path[-1] for n in (1, 5, 6)]
            path.append(coef[0] + np.dot(coef[1:], back))
            width = 1.96 * sd * step**0.5
            assert got[(None if k == 3 else k, "ab"[k % 2], day.date())] == pytest.approx((path[-1], path[-1] - width, path[-1] + width))
