"""Leaderboards and report tables.

``bench`` is a table of rounded metric rows, one per (series, model):
``series_id, model, paradigm, mae, rmse, mape, smape, mase``.
``rows`` is the long forecast table ``series_id, model, h, ts, y, yhat``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import MODEL_PARADIGMS, paradigm_of
from tidepanel.operators.backtest import MASE_CAP
from tidepanel.operators.metrics import METRICS, metric_columns
from tidepanel.operators.quantiles import exact_percentiles

# Models of the short comparison, paradigms in report order.
CORE_MODELS = ("Naive", "Holt-Winters", "SARIMA", "XGBoost")
PARADIGM_ORDER = tuple(dict.fromkeys(p for _, p in MODEL_PARADIGMS))
DIGITS = {"mae": 2, "rmse": 2, "mape": 2, "smape": 2, "mase": 3}


def model_position(model: Column) -> Column:
    """Place of a model in the fixed report order; unknown ones come last."""
    place = F.array_position(F.array(*[F.lit(m) for m, _ in MODEL_PARADIGMS]), model)
    return F.when(place > 0, place).otherwise(len(MODEL_PARADIGMS) + 1)


def benchmark(rows: DataFrame) -> DataFrame:
    """Rounded metric row per (series, model)."""
    measures = [F.round(c, DIGITS[name]).alias(name) for name, c in metric_columns().items()]
    made = rows.groupBy("series_id", "model").agg(*measures)
    return made.select("series_id", "model", paradigm_of(F.col("model")).alias("paradigm"), *METRICS)


def core_subset(bench: DataFrame, models: Sequence[str] = CORE_MODELS) -> DataFrame:
    return bench.filter(F.col("model").isin(*models))


def winners(bench: DataFrame, metric: str = "mae") -> DataFrame:
    """Best model per series; ties go to the model listed first."""
    order = F.struct(F.col(metric), model_position(F.col("model")), F.col("model"))
    return bench.filter(F.col(metric).isNotNull()).groupBy("series_id").agg(
        F.min_by("model", order).alias("model"), F.min(metric).alias(metric)
    )


def leaderboard(bench: DataFrame) -> DataFrame:
    """Per-model means of the rounded rows, median MAE, series won, ranked by mean MASE."""
    means = bench.groupBy("model").agg(
        F.first("paradigm").alias("paradigm"), *[F.avg(m).alias(f"mean_{m}") for m in METRICS]
    )
    median = exact_percentiles(bench, ["model"], "mae", (0.5,)).select("model", F.col("q")[0].alias("median_mae"))
    won = winners(bench).groupBy("model").agg(F.count(F.lit(1)).alias("series_won"))
    joined = means.join(median, "model").join(won, "model", "left").fillna({"series_won": 0})
    return joined.withColumn("rank", F.row_number().over(Window.orderBy("mean_mase", "model")))


def win_shares(bench: DataFrame) -> DataFrame:
    """Series won per model and the share of all series."""
    won = winners(bench).groupBy("model").agg(F.count(F.lit(1)).alias("series_won"))
    return won.withColumn("share", F.col("series_won") / F.sum("series_won").over(Window.partitionBy()))


def paradigm_means(bench: DataFrame) -> DataFrame:
    """Mean MAPE per paradigm with its place in the fixed order, next to the mean MASE."""
    place = F.array_position(F.array(*map(F.lit, PARADIGM_ORDER)), F.col("paradigm"))
    return bench.groupBy("paradigm").agg(F.avg("mape").alias("mean_mape"), F.avg("mase").alias("mean_mase")).withColumn(
        "paradigm_order", place.cast("int")
    )


def model_means(bench: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Mean of the five metrics per model."""
    rows = core_subset(bench, models) if models else bench
    return rows.groupBy("model").agg(*[F.avg(m).alias(f"mean_{m}") for m in METRICS])


def metric_pivot(bench: DataFrame, models: Sequence[str], metric: str = "mase") -> DataFrame:
    """Series by model table of one metric; the model list is given, so no extra pass finds it."""
    return bench.groupBy("series_id").pivot("model", list(models)).agg(F.first(metric))


def drift(val: DataFrame, test: DataFrame) -> DataFrame:
    """Validation against test per (series, model) with the change of MAE in percent."""
    picked = ("mae", "mape", "mase")
    v = val.select("series_id", "model", "paradigm", *[F.col(m).alias(f"{m}_val") for m in picked])
    t = test.select("series_id", "model", *[F.col(m).alias(f"{m}_test") for m in picked])
    delta = F.try_divide(F.col("mae_test") - F.col("mae_val"), F.col("mae_val")) * 100
    return v.join(t, ["series_id", "model"]).withColumn("mae_delta_pct", F.round(delta, 1))


def ranked_by(bench: DataFrame, metric: str = "mase") -> DataFrame:
    """Models of each series ranked by a metric; ``is_top`` marks the best."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    w = Window.partitionBy("series_id").orderBy(metric, model_position(F.col("model")), "model")
    return bench.withColumn("place", F.row_number().over(w)).withColumn("is_top", F.col("place") == 1)


def _error_pct(y: Column, yhat: Column) -> Column:
    return F.abs(yhat - y) / F.greatest(y, F.lit(1.0)) * 100


def period_breakdown(rows: DataFrame, models: Sequence[str], horizon: int = 12) -> DataFrame:
    """One row per series and step: actual, then prediction and error percent of each model."""
    inside = rows.filter((F.col("h") <= horizon) & F.col("model").isin(*models))
    wide = []
    for m in models:
        mine = F.col("model") == m
        wide += [
            F.max(F.when(mine, F.col("yhat"))).alias(f"{m} (Pred)"),
            F.max(F.when(mine, F.round(_error_pct(F.col("y"), F.col("yhat")), 1))).alias(f"{m} (Err %)"),
        ]
    return inside.groupBy("series_id", "h").agg(
        F.date_format(F.first("ts"), "yyyy-MM").alias("period"), F.first("y").alias("actual"), *wide
    )


def shock(rows: DataFrame, model: str, percent: float) -> DataFrame:
    """One model's forecast scaled by ``1 + percent/100``, as an extra model."""
    moved = F.col("yhat") * (1 + percent / 100)
    label = f"Shock ({percent:+.0f}%)"
    return rows.filter(F.col("model") == model).select(
        "series_id", F.lit(label).alias("model"), "h", "ts", "y", moved.alias("yhat"),
        F.round(_error_pct(F.col("y"), moved), 1).alias("error_pct"),
    )


def origin_trend(fold_metric_rows: DataFrame, horizon: int = 12) -> DataFrame:
    """Capped, seed-averaged MASE per series, model and origin, with the tested months as a label."""
    start = F.to_date(F.concat(F.col("origin"), F.lit("-01")))
    label = F.concat(
        F.date_format(F.add_months(start, 1), "yyyy-MM"), F.lit(" to "), F.date_format(F.add_months(start, horizon), "yyyy-MM")
    )
    capped = F.avg(F.least(F.col("mase"), F.lit(MASE_CAP))).alias("mase")
    return fold_metric_rows.groupBy("series_id", "model", "fold", "origin").agg(capped).withColumn("test_window", label)


def chart_rows(history: DataFrame, rows: DataFrame, models: Sequence[str], window: int = 24, horizon: int = 12) -> DataFrame:
    """History, actuals and forecasts in one long table with a type and an error percent."""
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ts")))
    zero = F.lit(0.0).alias("error_pct")
    past = history.withColumn("_b", back).filter(F.col("_b") <= window)
    past = past.select(
        "series_id", "ts", F.lit("Historical").alias("series"), F.col("y").alias("value"), F.col("y").alias("actual"),
        zero, F.lit("History").alias("type"),
    )
    inside = rows.filter(F.col("h") <= horizon)
    truth = inside.groupBy("series_id", "ts").agg(F.first("y").alias("value")).select(
        "series_id", "ts", F.lit("Actual Ground Truth").alias("series"), "value", F.col("value").alias("actual"),
        zero, F.lit("Actual").alias("type"),
    )
    made = inside.filter(F.col("model").isin(*models)).select(
        "series_id", "ts", F.concat("model", F.lit(" Forecast")).alias("series"), F.col("yhat").alias("value"),
        F.col("y").alias("actual"), F.round(_error_pct(F.col("y"), F.col("yhat")), 1).alias("error_pct"),
        F.lit("Forecast").alias("type"),
    )
    return past.unionByName(truth).unionByName(made)


def forecast_cache(folds: DataFrame, model_rows: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Nested record per series: history and test arrays and a map model -> forecast array.

    ``folds`` is one packed holdout fold per series, ``model_rows`` one row per
    (series, model), ``extras`` optional columns (intervals, order, parameters).
    """
    dates = lambda c: F.transform(c, lambda d: F.date_format(d, "yyyy-MM-dd"))
    base = folds.select(
        "series_id",
        dates(F.col("train_dates")).alias("history_dates"),
        F.col("train").alias("history_values"),
        dates(F.col("test_dates")).alias("test_dates"),
        F.col("test").alias("test_actuals"),
    )
    maps = model_rows.filter(F.col("yhat").isNotNull()).groupBy("series_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "yhat")))).alias("test_forecasts")
    )
    out = base.join(maps, "series_id")
    return out.join(extras, "series_id", "left") if extras is not None else out
