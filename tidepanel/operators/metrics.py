"""Forecast errors.  Forecast rows carry ``y`` (actual), ``yhat`` and ``scale``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.stats import array_mean

METRICS = ("mae", "rmse", "mape", "smape", "mase")
KEYS = ("series_id", "fold", "model", "seed")
FLOOR = 1e-8


def _error(y: Column, yhat: Column) -> Column:
    return F.abs(y - yhat)


def metric_columns(y: str = "y", yhat: str = "yhat", scale: str = "scale") -> dict[str, Column]:
    """The five library metrics as aggregates; ``scale`` is constant within a group."""
    a, f = F.col(y), F.col(yhat)
    err = _error(a, f)
    return {
        "mae": F.avg(err),
        "rmse": F.sqrt(F.avg(err * err)),
        "mape": F.avg(err / F.greatest(F.abs(a), F.lit(FLOOR))) * 100,
        "smape": F.avg(err / F.greatest((F.abs(a) + F.abs(f)) / 2, F.lit(FLOOR))) * 100,
        "mase": F.avg(err) / F.greatest(F.first(scale), F.lit(FLOOR)),
    }


def metrics(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All metrics per key; one aggregation, no join (rows already hold the actuals)."""
    return rows.groupBy(*keys).agg(*[c.alias(name) for name, c in metric_columns().items()])


def array_metrics(test: Column, yhat: Column, scale: Column) -> dict[str, Column]:
    """The five metrics of packed arrays, without leaving the row."""
    mean = lambda fn: array_mean(F.zip_with(test, yhat, fn))
    mae = mean(_error)
    return {
        "mae": mae,
        "rmse": F.sqrt(mean(lambda y, f: (y - f) * (y - f))),
        "mape": mean(lambda y, f: _error(y, f) / F.greatest(F.abs(y), F.lit(FLOOR))) * 100,
        "smape": mean(lambda y, f: _error(y, f) / F.greatest((F.abs(y) + F.abs(f)) / 2, F.lit(FLOOR))) * 100,
        "mase": mae / F.greatest(scale, F.lit(FLOOR)),
    }


def score(rows: DataFrame, metric: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One named metric per key."""
    found = metric_columns().get(metric.lower())
    if found is None:
        raise ValueError(f"unknown metric {metric!r}; choose one of {METRICS}")
    return rows.groupBy(*keys).agg(found.alias("score"))


def train_scale(train: DataFrame, season: int = 12) -> DataFrame:
    """Seasonal-naive error of the training rows: 1 when not longer than one season."""
    before = F.lag("y", season).over(Window.partitionBy("series_id").orderBy("ts"))
    step = train.select("series_id", F.abs(F.col("y") - before).alias("_d"))
    return step.groupBy("series_id").agg(
        F.greatest(F.coalesce(F.avg("_d"), F.lit(1.0)), F.lit(FLOOR)).alias("scale")
    )


def metrics_by_horizon(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dashboard metrics over the first ``h`` steps, for every ``h`` at once.

    Denominators are floored at 1, and a scale of 0 gives a MASE of 0.
    """
    upto = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    y, f = F.col("y"), F.col("yhat")
    err = _error(y, f)
    mae = F.avg(err).over(upto)
    return rows.select(
        *keys,
        "h",
        mae.alias("mae"),
        F.sqrt(F.avg(err * err).over(upto)).alias("rmse"),
        (F.avg(err / F.greatest(y, F.lit(1.0))).over(upto) * 100).alias("mape"),
        (F.avg(2 * err / F.greatest(F.abs(y) + F.abs(f), F.lit(1.0))).over(upto) * 100).alias("smape"),
        F.when(F.col("scale") > 0, mae / F.col("scale")).otherwise(0.0).alias("mase"),
    )


def step_errors(rows: DataFrame) -> DataFrame:
    """Absolute and percentage error of every step."""
    err = _error(F.col("y"), F.col("yhat"))
    pct = err / F.greatest(F.abs("y"), F.lit(FLOOR)) * 100
    return rows.select(*[k for k in KEYS if k in rows.columns], "h", "ts", err.alias("abs_error"), pct.alias("pct_error"))


def horizon_errors(rows: DataFrame) -> DataFrame:
    """Mean percentage error per model and step."""
    return step_errors(rows).groupBy("model", "h").agg(F.avg("pct_error").alias("mean_pct_error"))


def horizon_growth(rows: DataFrame) -> DataFrame:
    """Mean percentage error relative to the first step of the same model."""
    first = F.first("mean_pct_error").over(Window.partitionBy("model").orderBy("h"))
    return horizon_errors(rows).withColumn(
        "relative_growth", F.col("mean_pct_error") / F.greatest(first, F.lit(1e-4))
    )
