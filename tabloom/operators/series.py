"""Per-key time series: features, price recommendation, seasonal forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordered import nearby


def series_features(
    df: DataFrame, key: str, ts: str, target: str, price: str, revenue: str, goal: float = 0.75, window: int = 7
) -> DataFrame:
    """Lags, rolling means, deviation from the goal, price ratio and calendar columns, per key."""

    def looks_back(w) -> dict[str, Column]:
        frame = w.rowsBetween(-(window - 1), 0)
        means = {f"{c}_rolling_mean": F.when(F.count(c).over(frame) == window, F.avg(c).over(frame)) for c in (target, revenue)}
        return {f"{target}_lag_{n}": F.lag(target, n).over(w) for n in (1, 2)} | means

    out = nearby(df, [key], [ts], max(2, window - 1), looks_back)
    made = [f"{target}_lag_1", f"{target}_lag_2", f"{target}_rolling_mean", f"{revenue}_rolling_mean"]
    out = out.na.fill(0.0, subset=made)
    return out.withColumns({
        f"{target}_deviation": F.col(target) - goal,
        "price_ratio": F.col(price) / F.nullif(F.col(target), F.lit(0.0)),
        "year": F.year(ts), "month": F.month(ts), "week_number": F.weekofyear(ts), "day": F.day(ts),
        "day_of_week": F.weekday(ts),
    })


def adjustment_frequency(volatility: Column) -> Column:
    return F.when(volatility > 0.1, "Daily").when(volatility > 0.05, "Weekly").otherwise("Monthly")


def price_recommend(priced: DataFrame, key: str, target: float = 0.75) -> DataFrame:
    """Per key: average prices and utilisation, adjustment frequency, revenue change, goal met."""
    out = priced.groupBy(key).agg(
        F.avg("price").alias("current_price"), F.avg("best_price").alias("recommended_price"),
        F.avg("predicted").alias("predicted_utilization"), F.avg("utilization").alias("current_utilization"),
        F.stddev_samp("utilization").alias("volatility"),
    )
    actual = F.col("current_price") * F.col("current_utilization")
    predicted = F.col("recommended_price") * F.col("predicted_utilization")
    return out.withColumns({
        "frequency": adjustment_frequency(F.col("volatility")),
        "revenue_change_pct": (predicted - actual) / F.nullif(actual, F.lit(0.0)) * 100,
        "meets_target": F.when(F.col("predicted_utilization") >= target, 1).otherwise(0),
    })


def target_share(recommended: DataFrame) -> DataFrame:
    return recommended.agg(F.count(F.lit(1)).alias("n_keys"), (F.avg("meets_target") * 100).alias("pct_meeting_target"))


def fit_seasonal_ar(y: np.ndarray, season: int) -> tuple[np.ndarray, float]:
    """Least-squares AR on lag 1, the seasonal lag and their product lag; (coefficients, residual sd)."""
    lagged = [1, season, season + 1]
    if len(y) <= season + 1 + len(lagged):
        return np.array([y.mean() if len(y) else 0.0, 0.0, 0.0, 0.0]), float(y.std(ddof=1)) if len(y) > 1 else 0.0
    start = season + 1
    x = np.column_stack([np.ones(len(y) - start)] + [y[start - k: len(y) - k] for k in lagged])
    coef, *_ = np.linalg.lstsq(x, y[start:], rcond=None)
    return coef, float((y[start:] - x @ coef).std())


def forecast_series(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, steps: int, season: int = 5
) -> DataFrame:
    """Forecast the next business days of every series with a 95% interval.

    Daily means come first, so a series handed to Python is one row with a value
    per business day, however many raw rows its key holds. A batch of series is
    forecast by one call, and its results are built as whole columns.
    """
    daily = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(y).cast("double").alias("y"))
    daily = daily.where(F.weekday("day") < 5)
    types = dict(daily.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "day date", "forecast double", "low double", "high double"])
    # An explicit partition count: the fits are heavier than their few bytes suggest.
    parts = daily.sparkSession.sparkContext.defaultParallelism * 4
    by_day = F.sort_array(F.collect_list(F.struct("day", "y")))
    series = daily.repartition(parts, *keys).groupBy(*keys).agg(by_day.alias("__s"))
    series = series.select(*keys, F.get("__s", F.size("__s") - 1)["day"].alias("__last"), F.col("__s")["y"].alias("__y"))

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = np.arange(1, steps + 1)
        for b in batches:
            mid, width = np.empty((b.num_rows, steps)), np.empty((b.num_rows, steps))
            for i, value in enumerate(b.column("__y")):
                values = value.values.to_numpy(zero_copy_only=False).astype(float)
                coef, sd = fit_seasonal_ar(values, season)
                path = list(values)
                for _ in range(steps):
                    back = [path[-k] if len(path) >= k else path[-1] for k in (1, season, season + 1)]
                    path.append(float(coef[0] + np.dot(coef[1:], back)))
                mid[i], width[i] = path[-steps:], 1.96 * sd * np.sqrt(ahead)
            last = b.column("__last").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            days = np.busday_offset(last[:, None], ahead[None, :], roll="backward")
            row = pa.array(np.repeat(np.arange(b.num_rows), steps))
            made = [pa.array(x.ravel()) for x in (days, mid, mid - width, mid + width)]
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(row) for i in range(len(keys))], *made], names=[*keys, "day", "forecast", "low", "high"])

    return series.mapInArrow(forecast, schema)
