"""Model evaluation as aggregates and running sums over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import attach, position, running
from tabloom.operators.profile import histogram
from tabloom.operators.ranks import tiles

THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(18)]


def _safe(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(scored: DataFrame, y: str, pred: str) -> DataFrame:
    return scored.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(scored: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, the macro mean, and accuracy on every row."""
    cells = confusion(scored, y, pred)
    side = lambda c, n: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(n))
    hit = cells.where(F.col(y) == F.col(pred)).select(F.col(y).alias("class"), F.col("n").alias("hits"))
    rows = side(y, "support").join(side(pred, "predicted"), "class", "full").join(hit, "class", "left").na.fill(0)
    total = rows.agg((F.sum("hits") / F.sum("support")).alias("accuracy"))
    rows = rows.withColumns({"precision": _safe(F.col("hits"), F.col("predicted")), "recall": _safe(F.col("hits"), F.col("support"))})
    rows = rows.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rows = rows.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    macro = rows.agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return attach(rows.unionByName(macro), total)


def _cumulative(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score and at or above it."""
    at = scored.groupBy(score).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    return running(at, [], [(score, "desc")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})


def _totals(points: DataFrame) -> DataFrame:
    total = points.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return attach(points, total)


def roc_points(scored: DataFrame, y: str, score: str) -> DataFrame:
    rows = _totals(_cumulative(scored, y, score))
    return rows.select(F.col(score).alias("threshold"), _safe(F.col("fp"), F.col("N")).alias("fpr"), _safe(F.col("tp"), F.col("P")).alias("tpr"))


def roc_auc(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Trapezoid area under the ROC curve."""
    rows = _totals(_cumulative(scored, y, score))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return rows.agg((area / F.nullif(F.max("P") * F.max("N"), F.lit(0))).alias("auc"))


def pr_points(scored: DataFrame, y: str, score: str) -> DataFrame:
    rows = _totals(_cumulative(scored, y, score))
    return rows.select(
        F.col(score).alias("threshold"), _safe(F.col("tp"), F.col("P")).alias("recall"),
        _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def pr_auc(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Trapezoid area under the precision–recall curve, starting at precision 1."""
    rows = _totals(_cumulative(scored, y, score))
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.coalesce(before_tp / F.nullif(before_tp + before_fp, F.lit(0)), F.lit(1.0))
    return rows.agg(F.sum(F.col("pos") / F.col("P") * (now + before) / 2).alias("pr_auc"))


def threshold_sweep(scored: DataFrame, y: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall and F1 when predicting positive at or above each threshold."""
    ts = F.array(*[F.lit(float(x)) for x in thresholds])
    level = F.size(F.filter(ts, lambda x: x <= F.col(score)))
    counts = scored.groupBy(level.alias("level")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    met = counts.select("pos", "n", F.explode(F.slice(ts, F.lit(1), F.greatest("level", F.lit(0)))).alias("threshold"))
    hits = met.groupBy("threshold").agg(F.sum("pos").alias("tp"), F.sum("n").alias("predicted"))
    total = counts.agg(F.sum("pos").alias("P"))
    grid = scored.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    rows = attach(grid.join(hits, "threshold", "left").na.fill(0), total)
    rows = rows.withColumns({"precision": _safe(F.col("tp"), F.col("predicted")), "recall": _safe(F.col("tp"), F.col("P"))})
    f1 = _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("threshold", "precision", "recall", f1.alias("f1"))


def lift_topk(scored: DataFrame, y: str, score: str, key: str, percents: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Users, positives, recall and lift among the best-scored shares."""
    n = scored.count()
    ranked = position(scored.select(key, y, score), [], [(score, "desc"), key], "rn")
    cuts = [(p, int(n * p)) for p in percents]
    one = ranked.agg(F.sum(y).alias("P"), *[F.sum(F.when(F.col("rn") <= k, F.col(y))).alias(f"h{i}") for i, (_, k) in enumerate(cuts)])
    rows = F.array(*[
        F.struct(F.lit(float(p)).alias("top_share"), F.lit(k).cast("long").alias("users"), F.coalesce(F.col(f"h{i}"), F.lit(0)).cast("long").alias("positives"))
        for i, (p, k) in enumerate(cuts)])
    out = one.select("P", F.inline(rows))
    base = F.col("P") / F.lit(n)
    return out.select("top_share", "users", "positives", _safe(F.col("positives"), F.col("P")).alias("recall"),
                      _safe(_safe(F.col("positives"), F.col("users")), base).alias("lift"))


def decile_table(scored: DataFrame, y: str, score: str, key: str, n: int = 10) -> DataFrame:
    """Per decile (1 = best scores): size, converters, rate, lift, cumulative share."""
    tiled = tiles(scored.select(key, y, score), [(score, "desc"), key], n, "decile")
    rows = tiled.groupBy("decile").agg(F.count(F.lit(1)).alias("size"), F.sum(y).cast("long").alias("converters"))
    cum = running(rows, [], ["decile"], {"cumulative_converters": ("sum", F.col("converters"))})
    total = rows.agg(F.sum("size").alias("__n"), F.sum("converters").alias("__c"))
    out = attach(cum, total)
    rate = F.col("converters") / F.col("size")
    return out.select(
        "decile", "size", "converters", (F.col("size") - F.col("converters")).alias("non_converters"), rate.alias("conversion_rate"),
        _safe(rate, F.col("__c") / F.col("__n")).alias("lift"), "cumulative_converters",
        _safe(F.col("cumulative_converters"), F.col("__c")).alias("cumulative_share"), (F.col("size") / F.col("__n")).alias("size_share"))


def score_summary(scored: DataFrame, y: str, score: str, key: str, high: float = 0.75) -> DataFrame:
    """Converter score statistics, capture of the top 10% and 25%, conversion above a score."""
    n = scored.count()
    ranked = position(scored.select(key, y, score), [], [(score, "desc"), key], "rn")
    hit = F.when(F.col(y) == 1, F.col(score))
    top = lambda p: F.coalesce(F.sum(F.when(F.col("rn") <= int(n * p), F.col(y))), F.lit(0)).cast("long")
    above = F.col(score) > high
    return ranked.agg(
        F.sum(y).cast("long").alias("converters"), F.avg(hit).alias("mean_score"), F.min(hit).alias("min_score"), F.max(hit).alias("max_score"),
        top(0.10).alias("top10"), top(0.25).alias("top25"), F.count_if(above).alias("n_high"),
        F.coalesce(F.avg(F.when(above, F.col(y))), F.lit(0.0)).alias("high_rate"))


def regression_metrics(scored: DataFrame, y: str, pred: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return scored.agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.var_samp(y).alias("target_variance"))


def residuals(scored: DataFrame, y: str, pred: str) -> DataFrame:
    return scored.withColumn("residual", F.col(y) - F.col(pred))


def residual_histogram(scored: DataFrame, y: str, pred: str, bins: int = 20) -> DataFrame:
    return histogram(residuals(scored, y, pred), ["residual"], bins, 1).drop("column")


def predict_at(scored: DataFrame, score: str, threshold: float, name: str = "prediction") -> DataFrame:
    return scored.withColumn(name, F.when(F.col(score) >= threshold, 1).otherwise(0))
