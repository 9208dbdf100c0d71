"""Encoding, sampling, selection, training, search and scoring with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as G
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.ordered import join_back, position, unpivot_numeric
from tabloom.operators.ranks import head_per_key
from tabloom.operators.relational import numeric_columns, union_rows
from tabloom.session import scratch_path, stable

PIVOTS = 2_048  # most pivots of a neighbour search
SHARE = 20_000  # queries that one task holds against one part of the rows


# Encoding and preparation

def label_encode(df: DataFrame, cols: Sequence[str], null_label: str = "nan") -> DataFrame:
    """0-based code by sorted text value; NULL is a value of its own."""
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(null_label)))
        codes = position(df.select(c).distinct(), [], [c], "__rn").select(c, (F.col("__rn") - 1).alias("__code"))
        df = df.join(codes, c).withColumn(c, F.col("__code")).drop("__code")
    return df


def factorize(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """0-based code by first appearance; NULL gives −1."""
    for c in cols:
        first = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("__first"))
        codes = position(first, [], ["__first"], "__rn").select(c, (F.col("__rn") - 1).alias("__code"))
        df = join_back(df, codes, [c]).withColumn(c, F.coalesce("__code", F.lit(-1).cast("long"))).drop("__code")
    return df


def one_hot_vector(df: DataFrame, col: str, name: str) -> DataFrame:
    """``col`` as a sparse indicator vector over its sorted values, null last. For any number of values."""
    codes = position(df.select(col).where(F.col(col).isNotNull()).distinct(), [], [col], "__rn").select(col, (F.col("__rn") - 1).cast("double").alias("__code"))
    coded = join_back(df, stable(codes), [col])
    made = OneHotEncoder(inputCol="__code", outputCol=name, dropLast=False, handleInvalid="keep")
    return made.fit(coded).transform(coded.withColumn("__code", F.coalesce("__code", F.lit(float("nan"))))).drop("__code", col)


def one_hot(df: DataFrame, cols: Sequence[str], limit: int = 1_000) -> DataFrame:
    """Indicator columns ``<column>_<value>``; a column of more than ``limit`` values becomes one sparse vector ``<column>_vector``."""
    made, wide = {}, []
    for c in cols:
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(limit + 1).collect()]
        if len(values) > limit:
            wide.append(c)
            continue
        made.update({f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for v in values})
    df = df.withColumns(made).drop(*[c for c in cols if c not in wide])
    for c in wide:
        df = one_hot_vector(df, c, f"{c}_vector")
    return df


def low_card(df: DataFrame, n: int = 10) -> DataFrame:
    """Text columns with fewer than n values, and every numeric column."""
    texts = [c for c, t in df.dtypes if t == "string"]
    row = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first()
    nums = numeric_columns(df)
    return df.select(*[c for c in df.columns if c in nums or (c in texts and row[c] < n)])


def standard_scale(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """z-scores with population (ddof 0) or sample deviation; constant columns become 0."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[sd(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / F.lit(row[f"s_{c}"] or 1.0) for c in cols})


def hash_share(key: str, seed: int) -> Column:
    """Repeatable number in [0, 1) from a key; the same on every run and cluster."""
    text = F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10_000 / 10_000.0


def split_random(df: DataFrame, key: str, p: float = 0.8, seed: int = 56) -> tuple[DataFrame, DataFrame]:
    train = hash_share(key, seed) < p
    return df.where(train), df.where(~train)


def class_weight(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Positive rows weigh negatives / positives."""
    row = df.agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n")).first()
    w = (row["n"] - row["p"]) / row["p"] if row["p"] else 1.0
    return df.withColumn(name, F.when(F.col(y) == 1, float(w)).otherwise(1.0))


def attach_label(df: DataFrame, positives: DataFrame, on: Sequence[str], name: str = "label") -> DataFrame:
    marks = positives.select(*on).distinct().withColumn(name, F.lit(1))
    return df.join(marks, list(on), "left").na.fill(0, subset=[name])


# Neighbours

def _distances(x: np.ndarray, to: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances of all rows of x to all rows of ``to``."""
    return sum(np.abs(x[:, [j]] - to[:, j]) ** p for j in range(x.shape[1])) ** (1.0 / p)


def _matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols])


@dataclass(frozen=True)
class Pivots:
    """Points that part the base rows: a row belongs to its nearest pivot."""

    at: np.ndarray  # pivots × features
    reach: np.ndarray  # distance of each part's furthest row
    near: np.ndarray  # pivots × k: distances of each part's nearest rows
    p: int

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Which parts can hold one of the k nearest rows of each query, by the triangle inequality."""
        d, k = _distances(x, self.at, self.p), self.near.shape[1]
        every = (d[:, :, None] + self.near).reshape(len(x), -1)
        bound = np.partition(every, k - 1, 1)[:, k - 1 : k] * (1 + 1e-9) + 1e-12  # k rows lie within it
        own = d.argmin(1)
        mine = d[np.arange(len(x)), own][:, None]
        between = _distances(self.at, self.at, self.p)[own]
        if self.p == 2:
            side = (d**2 - mine**2) / (2 * np.maximum(between, 1e-300))  # to the plane half way between two pivots
        else:
            side = (d - mine) / 2
        side[np.arange(len(x)), own] = 0
        return (np.maximum(d - self.reach, side) <= bound) & np.isfinite(self.reach)


def nearest_rows(
    queries: DataFrame, base: DataFrame, cols: Sequence[str], k: int, p: int = 2, skip_self: bool = False,
    extra: Sequence[str] = (), pivots: int = PIVOTS,
) -> DataFrame:
    """Exact k nearest base rows per query row (both with a unique ``id``); ties to the smaller id.

    Base rows are parted by their nearest pivot, and a query visits only the parts that the triangle inequality does not
    rule out. Of base rows at one spot the k smallest ids suffice, so no spot makes a part large. Up to ``pivots`` pivots
    (a bounded draw, about the square root of the rows) are known to every task. Rows with a null or NaN feature have no
    neighbours and are none.
    """
    k_all = k + int(skip_self)
    known = lambda df: df.where(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in cols))
    fresh = lambda df, names: df.select(F.col("id").alias("id"), *[F.col(c).cast("double").alias(c) for c in cols], *[F.col(c).alias(c) for c in names if c not in cols])
    rows = stable(head_per_key(fresh(known(base), extra), list(cols), [F.asc("id")], k_all))
    q = fresh(known(queries), [])
    n, nq = rows.count(), q.count()
    names = ["id", "other", "distance", *extra]
    types = dict(base.dtypes) | {c: "double" for c in cols}
    schema = ", ".join([f"id {dict(queries.dtypes)['id']}", f"other {types['id']}", "distance double", *[f"{e} {types[e]}" for e in extra]])
    if not n or not nq:
        return queries.sparkSession.createDataFrame([], schema)
    most = max(1, min(pivots, round(n**0.5)))
    drawn = rows.select(*cols).distinct().orderBy(F.xxhash64(*cols), *cols).limit(most).collect()
    at = np.array([[float(v) for v in r] for r in drawn])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                piece = b.slice(start, 1024)
                d = _distances(_matrix(piece, cols), at, p)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own])], [*piece.schema.names, "__part", "__far"])

    parted = rows.mapInArrow(part, T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__far", T.DoubleType())]))
    parted = stable(parted)
    closest = head_per_key(parted.select("id", "__part", "__far"), ["__part"], [F.asc("__far"), F.asc("id")], k_all)
    reach, near = np.full(len(at), -np.inf), np.full((len(at), k_all), np.inf)
    for r in parted.groupBy("__part").agg(F.max("__far").alias("far")).collect():  # one row per pivot
        reach[r["__part"]] = r["far"] * (1 + 1e-9)
    for r in closest.groupBy("__part").agg(F.sort_array(F.collect_list("__far")).alias("far")).collect():
        near[r["__part"], : len(r["far"])] = r["far"]
    known_pivots = Pivots(at, reach, near, p)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                piece = b.slice(start, 256)
                row, to = np.nonzero(known_pivots.visits(_matrix(piece, cols)))
                yield pa.RecordBatch.from_arrays([*piece.take(pa.array(row)).columns, pa.array(to.astype(np.int32))], [*piece.schema.names, "__part"])

    sent = q.mapInArrow(send, T.StructType([*q.schema.fields, T.StructField("__part", T.IntegerType())]))
    shares = max(1, -(-nq // (len(at) * SHARE)))  # parts of the queries of one part of the rows
    sent = sent.withColumn("__share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"))
    copies = parted.drop("__far").withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("id")
        m, ids = right[list(cols)].to_numpy(float), right["id"].to_numpy()
        for start in range(0, len(left) if len(m) else 0, 256):
            piece = left.iloc[start: start + 256]
            d = _distances(piece[list(cols)].to_numpy(float), m, p)
            if skip_self:
                d[piece["id"].to_numpy()[:, None] == ids[None, :]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            at_row = np.repeat(np.arange(len(piece)), top.shape[1])
            picked, dist = top.ravel(), d[np.arange(len(piece))[:, None], top].ravel()
            keep = np.isfinite(dist)
            rec = {"id": piece["id"].to_numpy()[at_row][keep], "other": ids[picked][keep], "distance": dist[keep]}
            rec.update({e: right[e].to_numpy()[picked][keep] for e in extra})
            out.append(pd.DataFrame(rec))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    pairs = sent.groupBy("__part", "__share").cogroup(copies.groupBy("__part", "__share")).applyInPandas(best, schema)
    return head_per_key(pairs, ["id"], [F.asc("distance"), F.asc("other")], k)


def knn_predict(
    train: DataFrame, test: DataFrame, cols: Sequence[str], y: str, k: int = 5, weights: str = "uniform", p: int = 2
) -> DataFrame:
    """(id, prediction): majority vote of the k nearest, optionally weighted by 1/distance; ties to the lower class."""
    near = nearest_rows(test, train, cols, k, p, extra=[y])
    w = F.lit(1.0) if weights == "uniform" else 1.0 / (F.col("distance") + 1e-12)
    votes = near.groupBy("id", y).agg(F.sum(w).alias("votes"))
    best = F.max_by(y, F.struct(F.round("votes", 9), -F.col(y)))
    return votes.groupBy("id").agg(best.alias("prediction"))


def _raised(small: DataFrame, cols: Sequence[str], y: str, have: int, need: int, k: int, seed: int) -> DataFrame:
    """``need`` synthetic rows of one class; a row without any neighbour is its own."""
    near = nearest_rows(small, small, cols, k, skip_self=True).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "other")))["other"].alias("others"))
    whole = small.where(" and ".join(f"`{c}` is not null" for c in cols)).select("id")
    around = whole.join(near, "id", "left").withColumn("others", F.coalesce("others", F.array("id")))
    base = position(stable(around), [], ["id"], "rn")
    copies = F.lit(need // have) + F.when(F.col("rn") <= need % have, 1).otherwise(0)
    rows = base.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))))
    pick = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.size("others")).cast("int")
    gap = F.pmod(F.xxhash64("copy", "id", F.lit(seed + 1)), F.lit(10_000)) / 10_000.0
    rows = rows.select("id", "copy", F.get("others", pick).alias("other"), gap.alias("gap"))
    a = small.select("id", y, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = small.select(F.col("id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return rows.join(a, "id").join(b, "other").select(
        F.concat_ws("-", F.col("id").cast("string"), F.col("copy").cast("string")).alias("id"),
        *[(F.col(f"a_{c}") + F.col("gap") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).cast("double").alias(c) for c in cols],
        y, F.lit(1).alias("synthetic"))


def smote(df: DataFrame, cols: Sequence[str], y: str, k: int = 5, seed: int = 56) -> DataFrame:
    """All rows plus synthetic rows until every class has as many as the largest.

    Each synthetic row lies between a row and one of the k nearest rows of its class; the choice is a hash, so reruns
    agree. Rows with a null feature are kept but have no synthetic ones. One pass per smaller class.
    """
    whole = F.count_if(F.expr(" and ".join(f"`{c}` is not null" for c in cols)))
    classes = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"), whole.alias("whole")).orderBy(y).collect()
    most = max((r["n"] for r in classes), default=0)
    made = [_raised(df.where(F.col(y) == r[y]), cols, y, r["whole"], most - r["n"], k, seed) for r in classes if r["n"] < most and r["whole"]]
    real = df.select(F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in cols], y, F.lit(0).alias("synthetic"))
    return union_rows(real, *made) if made else real


# Selection

def chi2_scores(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Chi-square of each shifted non-negative feature's class totals against the class shares."""
    df, y = df.withColumnRenamed(y, "__y"), "__y"
    long = unpivot_numeric(df, [y], cols)
    low = long.groupBy("column").agg(F.min("value").alias("lo"))
    cells = long.groupBy("column", y).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    cells = cells.join(low, "column").withColumn("obs", F.col("s") - F.col("lo") * F.col("n"))
    total = cells.groupBy("column").agg(F.sum("obs").alias("t"), F.sum("n").alias("m"))
    rows = cells.join(total, "column").withColumn("exp", F.col("t") * F.col("n") / F.col("m"))
    part = (F.col("obs") - F.col("exp")) ** 2 / F.nullif(F.col("exp"), F.lit(0.0))
    return rows.groupBy("column").agg(F.sum(part).alias("chi2"))


def select_chi2(df: DataFrame, cols: Sequence[str], y: str, k: int) -> DataFrame:
    return chi2_scores(df, cols, y).orderBy(F.desc("chi2"), "column").limit(k)


def mutual_info(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each equal-width-binned feature with the label."""
    df, y = df.withColumnRenamed(y, "__y"), "__y"
    long = unpivot_numeric(df, [y], cols).where("value is not null")
    edge = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = long.join(F.broadcast(edge), "column")  # one row per column
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    b = F.coalesce(F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0))
    cells = rows.groupBy("column", b.alias("bin"), y).agg(F.count(F.lit(1)).alias("n"))
    side = lambda keys, name: cells.groupBy("column", *keys).agg(F.sum("n").alias(name))
    full = cells.join(side(["bin"], "nb"), ["column", "bin"]).join(side([y], "ny"), ["column", y]).join(side([], "m"), "column")
    term = F.col("n") / F.col("m") * F.log(F.col("n") * F.col("m") / (F.col("nb") * F.col("ny")))
    return full.groupBy("column").agg(F.sum(term).alias("mi"))


def select_rfe(df: DataFrame, cols: Sequence[str], y: str, estimator, k: int) -> list[str]:
    """Refit and drop the weakest feature until k remain; all fits read one stored frame."""
    left, df = list(cols), stable(df.select(*cols, y))
    while len(left) > k:
        ranked = importances(fit(df, left, y, estimator), left)
        left.remove(min(ranked, key=lambda c: (ranked[c], c)))
    return left


def importances(model: PipelineModel, cols: Sequence[str]) -> dict[str, float]:
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return {c: float(values[i]) for i, c in enumerate(cols)}


def importance_table(df: DataFrame, model: PipelineModel, cols: Sequence[str]) -> DataFrame:
    rows = sorted(importances(model, cols).items(), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(r + 1, c, v) for r, (c, v) in enumerate(rows)], "rank int, feature string, importance double")


def shuffled(df: DataFrame, key: str, col: str, seed: int) -> DataFrame:
    """One column permuted over the rows: values and rows meet on two hash orders."""
    hashed = lambda s: F.xxhash64(F.col(key), F.lit(s)).alias("__h")
    rows = position(df.drop(col).select("*", hashed(seed)), [], ["__h", key], "__rn")
    values = position(df.select(key, col, hashed(seed + 1)), [], ["__h", key], "__rn").select("__rn", col)
    return rows.join(values, "__rn").drop("__rn").select(*df.columns)


def importance_permutation(model: PipelineModel, df: DataFrame, key: str, cols: Sequence[str], y: str, metric: Callable[[DataFrame], float], seed: int = 56) -> DataFrame:
    """Loss of the metric when one column is shuffled.

    The copies, one per feature, are made and scored together from one stored frame; ``metric`` then reads the scores of
    one copy at a time. A shuffle joins rows and values by their ranks in two hash orders, all features at once.
    """
    spark, names = df.sparkSession, list(dict.fromkeys([key, *cols, y]))
    df = stable(df.select(*names))
    cells = F.array(*[F.struct(F.lit(c).alias("__feature"), F.col(c).cast("double").alias("__value")) for c in cols])
    hashed = lambda s: F.xxhash64(F.col(key), F.col("__feature"), F.lit(s)).alias("__h")
    long = df.select(key, F.inline(cells))
    rows = position(long.select("__feature", key, hashed(seed)), ["__feature"], ["__h", key], "__rn").select(F.col("__feature").alias("__f"), F.col(key).alias("__k"), "__rn")
    values = position(long.select("*", hashed(seed + 1)), ["__feature"], ["__h", key], "__rn").select("__feature", "__rn", "__value")
    moved = values.join(rows, (F.col("__feature") == F.col("__f")) & (values["__rn"] == rows["__rn"])).select("__feature", "__k", "__value")
    copies = moved.join(df, F.col("__k") == F.col(key)).select(
        "__feature", *[F.when(F.col("__feature") == c, F.col("__value")).otherwise(F.col(c).cast("double")).alias(c) if c in cols else F.col(c) for c in names])
    whole = df.select(F.lit("").alias("__feature"), *[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in names])
    scored = model.transform(copies.unionByName(whole))
    kept = [c for c in scored.columns if c in {"__feature", y, "prediction", "probability", "rawPrediction"}]
    path = scratch_path(spark, "permuted")
    scored.select(*kept).write.partitionBy("__feature").parquet(path)
    schema = scored.select(*kept).schema
    of = lambda c: metric(spark.read.schema(schema).parquet(path).where(F.col("__feature").isNull() if c is None else F.col("__feature") == c))
    base = of(None)  # an empty partition value is read as null
    return spark.createDataFrame([(c, base - of(c)) for c in cols], "feature string, loss double")


# Training and search

def classifier(kind: str, y: str, n_features: int = 0, weight: str | None = None, **params):
    """Estimator by name with the usual settings as defaults."""
    common = {"labelCol": y, "featuresCol": "features"}
    if weight and kind not in ("mlp",):
        common["weightCol"] = weight
    made = {
        "logistic": lambda: C.LogisticRegression(**{**common, **params}),
        "random_forest": lambda: C.RandomForestClassifier(**{**common, "numTrees": 100, "seed": 56, **params}),
        "gbt": lambda: C.GBTClassifier(**{**common, "seed": 56, **params}),
        "naive_bayes": lambda: C.NaiveBayes(**{**common, "modelType": "gaussian", **params}),
        "svm_linear": lambda: C.LinearSVC(**{**common, **params}),
        "decision_tree": lambda: C.DecisionTreeClassifier(**{**common, "seed": 56, **params}),
        "mlp": lambda: C.MultilayerPerceptronClassifier(**{**common, "layers": [n_features, 8, 2], "seed": 56, **params}),
    }
    return made[kind]()


def regressor(kind: str, y: str, **params):
    common = {"labelCol": y, "featuresCol": "features"}
    made = {
        "linear": lambda: G.LinearRegression(**{**common, **params}),
        "random_forest": lambda: G.RandomForestRegressor(**{**common, "numTrees": 100, "seed": 56, **params}),
        "gbt": lambda: G.GBTRegressor(**{**common, "seed": 56, **params}),
    }
    return made[kind]()


def ridge(df: DataFrame, cols: Sequence[str], y: str, alpha: float = 1.0) -> PipelineModel:
    """Least squares plus alpha times the squared coefficients, as ridge is usually stated.

    Spark divides the loss by 2n and scales the penalty by the label's
    deviation, so alpha is converted.
    """
    row = df.agg(F.stddev_pop(y).alias("s"), F.count(y).alias("n")).first()
    return fit(df, cols, y, regressor("linear", y, regParam=alpha * row["s"] / row["n"], elasticNetParam=0.0, standardization=False, solver="normal"))


def fit(df: DataFrame, cols: Sequence[str], y: str, estimator) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(df.select(*df.columns))


def with_probability(scored: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 (the raw margin where a model has none)."""
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.withColumn(name, vector_to_array(F.col(source))[1])


def coefficient_table(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Logistic coefficients with standard errors and p-values."""
    model = fit(df, cols, y, G.GeneralizedLinearRegression(family="binomial", labelCol=y, featuresCol="features")).stages[-1]
    s = model.summary
    names = [*cols, "intercept"]
    coef = [*model.coefficients.toArray(), model.intercept]
    rows = [(n, float(c), float(e), float(p)) for n, c, e, p in zip(names, coef, s.coefficientStandardErrors, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, std_error double, p_value double")


def search(
    df: DataFrame, cols: Sequence[str], y: str, estimator, grid: Mapping[str, Sequence], evaluator, folds: int = 3,
    n_iter: int | None = None, seed: int = 56, parallelism: int = 4,
) -> tuple[PipelineModel, list[tuple[dict, float, float]]]:
    """Cross-validated grid, or ``n_iter`` sampled combinations; (best model, [(params, mean, sd)])."""
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    if n_iter is not None and n_iter < len(combos):
        combos = random.Random(seed).sample(combos, n_iter)
    maps = [{estimator.getParam(k): v for k, v in c.items()} for c in combos]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features"), estimator])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps or ParamGridBuilder().build(), evaluator=evaluator,
                        numFolds=folds, seed=seed, parallelism=parallelism)
    model = cv.fit(stable(df))  # every fit and every score reads the rows again
    return model.bestModel, list(zip(combos, model.avgMetrics, model.stdMetrics))


def search_table(df: DataFrame, results: Sequence[tuple[dict, float, float]]) -> DataFrame:
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(m), float(s)) for p, m, s in results]
    return df.sparkSession.createDataFrame(rows, "params string, mean double, sd double")


def cross_validate(df: DataFrame, cols: Sequence[str], y: str, estimator, evaluator, folds: int = 5) -> DataFrame:
    _, results = search(df, cols, y, estimator, {}, evaluator, folds)
    return search_table(df, results)


def auc_evaluator(y: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=y, rawPredictionCol="rawPrediction")


def rmse_evaluator(y: str) -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=y, metricName="rmse")


def calibrate_isotonic(scored: DataFrame, y: str, score: str) -> G.IsotonicRegressionModel:
    """Monotone map from score to probability, fitted on (score, count-weighted rate)."""
    points = scored.groupBy(score).agg(F.avg(y).alias("rate"), F.count(F.lit(1)).cast("double").alias("n"))
    return G.IsotonicRegression(featuresCol=score, labelCol="rate", weightCol="n", predictionCol="calibrated").fit(points)


def save_and_load(model: PipelineModel, df: DataFrame) -> PipelineModel:
    path = scratch_path(df.sparkSession, "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def score_batch(model: PipelineModel, df: DataFrame, key: str, actual: str | None = None) -> DataFrame:
    """Keep the id, the prediction and the score beside the actual."""
    scored = model.transform(df)
    if {"probability", "rawPrediction"} & set(scored.columns):
        scored = with_probability(scored)
    keep = [c for c in (key, actual, "prediction", "score") if c and c in scored.columns]
    return scored.select(*keep)


def silhouettes(df: DataFrame, features: str, centers: Mapping[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette (squared distances) of every clustering, all of them in the same two scans.

    The first scan sums vectors and squares per cluster, the second holds every row against the sums. What is known to
    every task is the centres and the sums: as many vectors as there are clusters.
    """
    ks = sorted(centers)
    width = len(centers[ks[0]][0])
    split = np.cumsum([0, *[len(centers[k]) for k in ks]])
    every = np.concatenate([centers[k] for k in ks])
    rows = df.select(vector_to_array(features).alias("x"))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        x = np.array(batch.column("x").values.to_numpy()).reshape(-1, width)
        square = (x**2).sum(1)
        far = (every**2).sum(1) - 2 * x @ every.T
        return x, square, [lo + far[:, lo:hi].argmin(1) for lo, hi in zip(split, split[1:])]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = np.zeros(len(every)), np.zeros((len(every), width)), np.zeros(len(every))
        for b in batches:
            x, square, own = read(b)
            for at in own:
                np.add.at(n, at, 1), np.add.at(total, at, x), np.add.at(squares, at, square)
        yield pa.RecordBatch.from_pydict({"c": np.arange(len(every)), "n": n, "q": squares, "s": pa.array(total.tolist(), pa.list_(pa.float64()))})

    sums = rows.mapInArrow(add, "c long, n double, q double, s array<double>")
    each = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)])
    found = {r["c"]: r for r in sums.groupBy("c").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), each.alias("s")).collect()}  # one row per cluster
    n = np.array([found[c]["n"] if c in found else 0.0 for c in range(len(every))])
    mean_square = np.array([found[c]["q"] if c in found else 0.0 for c in range(len(every))]) / np.maximum(n, 1)
    mean = np.array([found[c]["s"] if c in found else [0.0] * width for c in range(len(every))]) / np.maximum(n, 1)[:, None]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(ks)), 0
        for b in batches:
            x, square, own = read(b)
            seen += len(x)
            far = np.maximum(square[:, None] + mean_square - 2 * x @ mean.T, 0)
            far[:, n == 0] = np.inf
            line = np.arange(len(x))
            for i, (lo, hi, at) in enumerate(zip(split, split[1:], own)):
                size = n[at]
                inside = far[line, at] * size / np.maximum(size - 1, 1)
                rest = far[:, lo:hi].copy()
                rest[line, at - lo] = np.inf
                outside = rest.min(1)
                most = np.maximum(inside, outside)
                value = np.where((size > 1) & np.isfinite(outside) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0)
                total[i] += value.sum()
        yield pa.RecordBatch.from_pydict({"k": np.array(ks), "total": total, "seen": np.full(len(ks), float(seen))})

    parts = rows.mapInArrow(score, "k long, total double, seen double").groupBy("k").agg((F.sum("total") / F.sum("seen")).alias("mean"))
    return {r["k"]: r["mean"] for r in parts.collect()}


def kmeans_elbow(df: DataFrame, features: str, k_min: int = 2, k_max: int = 50, seed: int = 56) -> DataFrame:
    """Silhouette per k, its gain over the previous k, and the chosen k: the one before the largest gain.

    All models are fitted on one stored copy of the features and scored together.
    """
    df = stable(df.select(features))
    fitted = {k: np.array(KMeans(k=k, seed=seed, featuresCol=features).fit(df).clusterCenters()) for k in range(k_min, k_max + 1)}
    found = silhouettes(df, features, fitted)
    scores = [found[k] for k in range(k_min, k_max + 1)]
    gains = [0.0] + [b - a for a, b in zip(scores, scores[1:])]
    best = k_min + max(range(1, len(gains)), key=lambda i: (gains[i], -i), default=1) - 1
    rows = [(k_min + i, float(s), float(g), int(k_min + i == best)) for i, (s, g) in enumerate(zip(scores, gains))]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, gain double, chosen int")


def price_grid_search(
    df: DataFrame, model: PipelineModel, key: str, price: str, target: float = 0.75, factor: float = 5.0, steps: int = 30
) -> DataFrame:
    """Best of ``steps`` prices around each row's own: prediction nearest to the goal from above, else unchanged.

    Every row carries its own price as candidate 0; non-positive prices are left out.
    """
    step = F.lit(2 * factor / (steps - 1))
    candidate = F.when(F.col("__i") == 0, F.col("__current")).otherwise(F.col("__current") * (1 - factor + step * (F.col("__i") - 1)))
    rows = df.withColumn("__current", F.col(price).cast("double"))
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn(price, candidate).where(F.col(price) > 0)
    tried = model.transform(rows).select(key, "__i", "__current", price, "prediction")
    good = (F.col("__i") > 0) & (F.col("prediction") >= target)
    rank = F.when(good, F.struct((F.col("prediction") - target).alias("gap"), F.col("__i").alias("i")))
    out = tried.groupBy(key).agg(
        F.max("__current").alias("current_price"),
        F.min_by(F.struct(F.col(price).alias("p"), F.col("prediction").alias("u")), rank).alias("__best"),
        F.max(F.when(F.col("__i") == 0, F.col("prediction"))).alias("__now"))
    return out.select(key, "current_price", F.coalesce("__best.p", "current_price").alias("best_price"),
                      F.coalesce("__best.u", "__now").alias("predicted"))
