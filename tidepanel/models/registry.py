"""Named forecasters.

A forecaster is a function ``(frame, out) -> frame`` that adds an array column
``out`` with the forecast of ``train``; null means the series was refused.  A
column ``<out>_error`` beside it may hold the reason.  New
ones are added with ``register``; a plain Python function on one series comes in
through ``python_forecaster``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import HORIZON, SEASON
from tidepanel.functions.stats import array_mean
from tidepanel.models import baseline
from tidepanel.models.linear import ar, ridge, sarima, spec_struct
from tidepanel.models.smoothing import holt_winters
from tidepanel.operators.transforms import with_power
from tidepanel.session import materialised

# Ship this module's functions with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Forecaster = Callable[[DataFrame, str], DataFrame]

# Default orders.
ARIMA_ORDER = (1, 1, 1)
SARIMA_ORDER, SARIMA_SEASONAL = (1, 1, 1), (1, 1, 0, 12)
RIDGE_PENALTY = 1.0
#: Models that are Spark expressions without a Python step.
PLAIN_MODELS = ("Naive", "Seasonal Naive", "Mean")


def from_expression(make: Callable[[Column], Column]) -> Forecaster:
    return lambda frame, out: frame.withColumn(out, make(F.col("train")))


def holt_winters_with_fallback(frame: DataFrame, out: str, horizon: int = HORIZON, season: int = SEASON) -> DataFrame:
    """Additive smoothing, and the damped form where that gives nothing."""
    main = holt_winters(F.col("train"), horizon, season=season)["yhat"]
    # The damped fit only sees series the first one refused.
    made = frame.withColumn(out, main)
    left = F.when(F.col(out).isNull(), F.col("train"))
    return made.withColumn(out, F.coalesce(F.col(out), holt_winters(left, horizon, damped=True, season=season)["yhat"]))


def default_forecasters(
    horizon: int = HORIZON, season: int = SEASON, spec: Column | None = None, penalty: Column | float = RIDGE_PENALTY
) -> dict[str, Forecaster]:
    """The models that are fitted per series without a pooled training job.

    ``spec`` is a column with the orders of each row (chosen per series); the
    default orders apply where it is null.  ``penalty`` is that of the ridge regression.
    """
    default = spec_struct(SARIMA_ORDER, SARIMA_SEASONAL)
    orders = default if spec is None else F.coalesce(spec, default)
    return {
        "Naive": from_expression(lambda y: baseline.naive(y, horizon)),
        "Seasonal Naive": from_expression(lambda y: baseline.seasonal_naive(y, horizon, season)),
        "Holt-Winters": lambda f, out: holt_winters_with_fallback(f, out, horizon, season),
        "ARIMA(1,1,1)": lambda f, out: sarima(f, out, spec_struct(ARIMA_ORDER, (0, 0, 0, season)), horizon, multiplicative=True, errors=True),
        "SARIMA": lambda f, out: sarima(f, out, orders, horizon, multiplicative=True, errors=True),
        "Ridge": lambda f, out: ridge(f, out, horizon, alpha=penalty),
    }


def default_refits(horizon: int = HORIZON, spec: Column | None = None) -> dict[str, Forecaster]:
    """Constrained refits tried before the seasonal naive fallback."""
    default = spec_struct(SARIMA_ORDER, SARIMA_SEASONAL)
    orders = default if spec is None else F.coalesce(spec, default)
    return {"SARIMA": lambda f, out: sarima(f, out, orders, horizon, multiplicative=True, constrained=True)}


def extra_forecasters(horizon: int = HORIZON, season: int = SEASON) -> dict[str, Forecaster]:
    return {
        "Mean": from_expression(lambda y: baseline.mean(y, horizon)),
        "AR(1)": lambda f, out: ar(f, out, horizon, lags=1),
        "Holt-Winters (Damped)": from_expression(lambda y: holt_winters(y, horizon, damped=True, season=season)["yhat"]),
        "Log + SARIMA": lambda f, out: transformed(f, out, horizon),
    }


def _log(y: Column) -> Column:
    low = F.array_min(y)
    return F.struct(F.when(low <= 0, 1 - low).otherwise(0.0).alias("a"), F.lit(1.0).alias("b"))


def _standard(y: Column) -> Column:
    mean = array_mean(y)
    spread = F.sqrt(array_mean(F.transform(y, lambda x: (x - mean) * (x - mean))))
    return F.struct(mean.alias("a"), F.when(spread > 0, spread).otherwise(1.0).alias("b"))


def _min_max(y: Column) -> Column:
    low, width = F.array_min(y), F.array_max(y) - F.array_min(y)
    return F.struct(low.alias("a"), F.when(width > 0, width).otherwise(1.0).alias("b"))


def _robust(y: Column) -> Column:
    ordered, n = F.array_sort(y), F.size(y)

    def at(q: float) -> Column:
        place = (n - 1) * q
        low = F.element_at(ordered, F.floor(place).cast("int") + 1)
        return low + (F.element_at(ordered, F.ceil(place).cast("int") + 1) - low) * (place - F.floor(place))

    width = at(0.75) - at(0.25)
    return F.struct(at(0.5).alias("a"), F.when(width > 0, width).otherwise(1.0).alias("b"))


# Name -> (parameters of the training values, or the step that adds them as ``_params``; forward, back); ``a`` and ``b``
# are the parameters.
TRANSFORMS: dict[str, tuple[Callable[[Column], Column], Callable, Callable]] = {
    "log": (_log, lambda x, p: F.ln(x + p["a"]), lambda z, p: F.exp(z) - p["a"]),
    "sqrt": (_log, lambda x, p: F.sqrt(x + p["a"]), lambda z, p: z * z - p["a"]),
    "standard": (_standard, lambda x, p: (x - p["a"]) / p["b"], lambda z, p: z * p["b"] + p["a"]),
    "minmax": (_min_max, lambda x, p: (x - p["a"]) / p["b"], lambda z, p: z * p["b"] + p["a"]),
    "robust": (_robust, lambda x, p: (x - p["a"]) / p["b"], lambda z, p: z * p["b"] + p["a"]),
}


def box_cox_of_series(frame: DataFrame) -> DataFrame:
    """Add ``_params`` with offset ``a`` and maximum-likelihood power ``b`` of each row's training values."""
    made = with_power(frame, "train", "_a", "_b")
    return made.withColumn("_params", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))).drop("_a", "_b")


TRANSFORMS["boxcox"] = (
    box_cox_of_series,
    lambda x, p: F.when(p["b"] == 0, F.ln(x + p["a"])).otherwise((F.pow(x + p["a"], p["b"]) - 1) / p["b"]),
    lambda z, p: F.when(p["b"] == 0, F.exp(z)).otherwise(F.pow(F.greatest(z * p["b"] + 1, F.lit(0.0)), 1 / p["b"])) - p["a"],
)


def box_cox(power: float) -> tuple:
    """Box-Cox with a given power and automatic offset, as an entry of ``TRANSFORMS``."""
    if power == 0:
        return TRANSFORMS["log"]
    forward = lambda x, p: (F.pow(x + p["a"], F.lit(power)) - 1) / power
    return _log, forward, lambda z, p: F.pow(F.greatest(z * power + 1, F.lit(0.0)), F.lit(1 / power)) - p["a"]


def differenced(frame: DataFrame, out: str, forecaster: Forecaster, lag: int = 1) -> DataFrame:
    """Difference -> forecast -> repeated sums from the last ``lag`` values, for any forecaster."""
    train = F.col("train")
    m = F.greatest(F.size(train) - lag, F.lit(0))
    steps = F.zip_with(F.slice(train, lag + 1, m), F.slice(train, F.lit(1), m), lambda a, b: a - b)
    kept = frame.withColumn("_raw", train).withColumn("train", steps)
    dated = "train_dates" in frame.columns
    if dated:
        kept = kept.withColumn("_dates", F.col("train_dates")).withColumn("train_dates", F.slice("train_dates", lag + 1, m))
    made = forecaster(kept, out)
    grown = F.aggregate(out, F.slice("_raw", -lag, lag), lambda h, d: F.array_append(h, d + F.element_at(h, -lag)))
    made = made.withColumn(out, F.when(F.size("_raw") > lag, F.slice(grown, lag + 1, F.size(out))))
    made = made.withColumn("train", F.col("_raw")).drop("_raw")
    return made.withColumn("train_dates", F.col("_dates")).drop("_dates") if dated else made


def transformed(
    frame: DataFrame, out: str, horizon: int = HORIZON, forecaster: Forecaster | None = None, by: str | tuple = "log"
) -> DataFrame:
    """Transform -> forecast -> transform back, for any forecaster.

    ``by`` names an entry of ``TRANSFORMS`` or is one; its parameters come from each row's training values.
    """
    params, forward, back = TRANSFORMS[by] if isinstance(by, str) else by
    inner = forecaster or (lambda f, o: sarima(f, o, spec_struct(SARIMA_ORDER, SARIMA_SEASONAL), horizon))
    kept = frame.withColumn("_raw", F.col("train"))
    kept = params(kept) if params is box_cox_of_series else kept.withColumn("_params", params(F.col("train")))
    made = inner(kept.withColumn("train", F.transform("train", lambda x: forward(x, F.col("_params")))), out)
    made = made.withColumn(out, F.transform(out, lambda z: back(z, F.col("_params"))))
    return made.withColumn("train", F.col("_raw")).drop("_raw", "_params")


_REGISTERED: dict[str, Forecaster] = {}


def register(name: str, forecaster: Forecaster) -> None:
    """Make a forecaster available to the backtest under ``name``."""
    _REGISTERED[name] = forecaster


def python_forecaster(fit_predict: Callable[[np.ndarray, int], Sequence[float]], horizon: int = HORIZON) -> Forecaster:
    """Wrap ``fit_predict(values, steps)`` of one series; an error becomes a null forecast and its text the reason."""
    result = T.StructType().add("yhat", T.ArrayType(T.DoubleType())).add("error", T.StringType())

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(values):
            try:
                return np.asarray(fit_predict(np.asarray(values, dtype=float), horizon), dtype=float), None
            except Exception as why:  # noqa: BLE001 - a refused series is a null forecast with its reason
                return None, f"{type(why).__name__}: {why}"

        for batch in batches:
            made = [one(values) for values in batch]
            yield pd.DataFrame({name: pd.Series([m[i] for m in made], dtype=object) for i, name in enumerate(result.names)})

    udf = run.asNondeterministic()

    def make(frame: DataFrame, out: str) -> DataFrame:
        made = frame.withColumn("_made", udf("train"))
        return made.withColumn(out, F.col("_made.yhat")).withColumn(f"{out}_error", F.col("_made.error")).drop("_made")

    return make


def all_forecasters(
    horizon: int = HORIZON, season: int = SEASON, spec: Column | None = None, penalty: Column | float = RIDGE_PENALTY
) -> dict[str, Forecaster]:
    return {**default_forecasters(horizon, season, spec, penalty), **extra_forecasters(horizon, season), **_REGISTERED}


def add_forecasts(frame: DataFrame, forecasters: dict[str, Forecaster], prefix: str = "forecast") -> tuple[DataFrame, dict[str, str]]:
    """Add one column per model side by side and return the frame with model -> column."""
    columns = {}
    for i, (name, make) in enumerate(forecasters.items()):
        columns[name] = f"{prefix}_{i}"
        frame = fitted_alone(name, make(frame, columns[name]))
    return frame, columns


def fitted_alone(name: str, frame: DataFrame) -> DataFrame:
    """Store what model ``name`` has added: Python steps in one stage hold a worker each in every running task."""
    return frame if name in PLAIN_MODELS else materialised(frame)
