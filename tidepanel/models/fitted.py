"""In-sample fitted values and residuals of all models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import SEASON
from tidepanel.models import baseline, trees
from tidepanel.models.linear import ar, ridge, sarima, spec_struct
from tidepanel.models.registry import ARIMA_ORDER, PLAIN_MODELS, SARIMA_ORDER, SARIMA_SEASONAL, TRANSFORMS, fitted_alone
from tidepanel.models.smoothing import holt_winters
from tidepanel.session import materialised

# Adds a column of fitted values, one per training row.
Fitter = Callable[[DataFrame, str], DataFrame]


def _kept(make: Callable[..., DataFrame]) -> Fitter:
    """The fitted values that a forecaster keeps with its fit."""
    return lambda frame, out: make(frame, "_o").withColumn(out, F.col("_o_fit.fitted")).drop("_o", "_o_fit")


def log_fitted(frame: DataFrame, out: str, inner: Fitter) -> DataFrame:
    """Fitted values of a model of the logarithms, back on the scale of the values."""
    params, forward, back = TRANSFORMS["log"]
    kept = frame.withColumn("_raw", F.col("train")).withColumn("_params", params(F.col("train")))
    made = inner(kept.withColumn("train", F.transform("train", lambda x: forward(x, F.col("_params")))), out)
    made = made.withColumn(out, F.transform(out, lambda z: back(z, F.col("_params"))))
    return made.withColumn("train", F.col("_raw")).drop("_raw", "_params")


def _per_fold(make: Fitter) -> Fitter:
    """A pooled model is fitted on each fold alone; the folds are few."""

    def made(frame: DataFrame, out: str) -> DataFrame:
        if "fold" not in frame.columns:
            return make(frame, out)
        folds = sorted(r.fold for r in frame.select("fold").distinct().collect())
        parts = [make(frame.filter(F.col("fold") == k), out) for k in folds]
        return reduce(DataFrame.unionByName, parts) if parts else frame.withColumn(out, F.lit(None).cast("array<double>"))

    return made


def fitters(season: int = SEASON) -> dict[str, Fitter]:
    train = F.col("train")
    expression = lambda c: lambda frame, out: frame.withColumn(out, c)
    seasonal = spec_struct(SARIMA_ORDER, (*SARIMA_SEASONAL[:3], season))
    of_sarima = lambda **how: _kept(lambda f, o: sarima(f, o, seasonal, 1, keep_fit=True, **how))
    return {
        "Naive": expression(baseline.naive_fitted(train)),
        "Mean": expression(baseline.mean_fitted(train)),
        "Seasonal Naive": expression(baseline.seasonal_naive_fitted(train, season)),
        "Holt-Winters": expression(holt_winters(train, 1, season=season)["fitted"]),
        "Holt-Winters (Damped)": expression(holt_winters(train, 1, damped=True, season=season)["fitted"]),
        "AR(1)": _kept(lambda f, o: ar(f, o, 1, keep_fit=True)),
        "Ridge": _kept(lambda f, o: ridge(f, o, 1, keep_fit=True)),
        "ARIMA(1,1,1)": _kept(lambda f, o: sarima(f, o, spec_struct(ARIMA_ORDER, (0, 0, 0, season)), 1, keep_fit=True, multiplicative=True)),
        "SARIMA": of_sarima(multiplicative=True),
        "Log + SARIMA": lambda f, out: log_fitted(f, out, of_sarima()),
        "Direct Linear": _per_fold(trees.direct_fitted),
        **{name: _per_fold(model.with_fitted) for name, model in trees.TREE_MODELS.items()},
    }


def fitted_values(frame: DataFrame, models: tuple[str, ...] = ("Naive", "Mean", "Seasonal Naive"), season: int = SEASON) -> DataFrame:
    """Long table ``series_id, model, ts, y, fitted, resid``; null where a model has no fitted value yet."""
    known = fitters(season)
    if unknown := [m for m in models if m not in known]:
        raise ValueError(f"no fitted values for {unknown}; known: {sorted(known)}")
    # Pooled fits read the packed rows several times.
    made, entries = frame if set(models) <= set(PLAIN_MODELS) else materialised(frame), []
    for i, name in enumerate(models):
        made = fitted_alone(name, known[name](made, f"_m{i}"))
        entries.append(F.struct(F.lit(name).alias("model"), F.col(f"_m{i}").alias("fitted")))
    keys = [c for c in ("series_id", "fold") if c in frame.columns]
    rows = made.select(*keys, "train", "train_dates", F.explode(F.array(*entries)).alias("m"))
    zipped = F.arrays_zip(F.col("train_dates").alias("ts"), F.col("train").alias("y"), F.col("m.fitted").alias("fitted"))
    long = rows.filter(F.col("m.fitted").isNotNull()).select(*keys, "m.model", F.explode(zipped).alias("z"))
    return long.select(*keys, "model", "z.ts", "z.y", "z.fitted", (F.col("z.y") - F.col("z.fitted")).alias("resid"))
