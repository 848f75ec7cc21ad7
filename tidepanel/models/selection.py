"""Choice of orders and parameters on a validation window."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON
from tidepanel.models import flat_trees
from tidepanel.models.linear import ridge, sarima, spec_name, spec_struct
from tidepanel.models.trees import boosted_trees, random_forest, training_rows, unscaled, usable_values
from tidepanel.operators.diagnostics import residual_tests, with_centred, with_ljung_box
from tidepanel.operators.metrics import METRICS, array_metrics
from tidepanel.session import materialised

#: Pooled fits that run at a time.
FITS_AT_ONCE = 8

# Search spaces.
ORDERS = (
    (1, 1, 1), (1, 1, 0), (0, 1, 1), (2, 1, 1), (1, 1, 2),
    (0, 1, 2), (2, 1, 0), (1, 0, 1), (1, 0, 0), (0, 1, 0),
)
SEASONAL_ORDERS = ((1, 1, 1, 12), (0, 1, 1, 12), (1, 0, 1, 12), (1, 1, 0, 12), (0, 0, 0, 12))
RIDGE_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
FOREST_GRID = ((50, 3), (100, 4), (100, 6), (150, 8), (200, 10))
BOOSTED_GRID = ((50, 2, 0.05), (100, 3, 0.05), (100, 4, 0.03), (150, 3, 0.02), (200, 4, 0.05))
CRITERIA = tuple(f"val_{m}" for m in METRICS) + ("aic", "bic")


def order_grid(
    frame: DataFrame,
    orders: Sequence[Sequence[int]] = ORDERS,
    seasonal_orders: Sequence[Sequence[int]] = SEASONAL_ORDERS,
    criterion: str = "val_mae",
    horizon: int = HORIZON,
    alpha: float = 0.05,
) -> DataFrame:
    """Every order of the grid for every series, ranked by ``criterion``.

    ``frame`` is packed with the validation rows in ``test``.  The grid is a
    literal array exploded in place, so series times orders run in parallel
    without a join.  Series without validation rows are ranked by AIC.  Specifications that could not be fitted keep null scores and
    rank last.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}; choose one of {CRITERIA}")
    specs = F.array(*[spec_struct(o, s) for o in orders for s in seasonal_orders])
    grid = frame.select("*", F.posexplode(specs).alias("spec_id", "spec"))
    fitted = sarima(grid, "yhat", F.col("spec"), horizon, keep_fit=True, multiplicative=True)
    scores = array_metrics(F.col("test"), F.col("yhat"), F.col("scale"))
    scored = fitted.select(
        "series_id", "fold", "spec_id", "spec", F.size("train").alias("train_obs"),
        F.col("yhat_fit.aic").alias("aic"), F.col("yhat_fit.bic").alias("bic"),
        *[c.alias(f"val_{name}") for name, c in scores.items()],
        F.filter("yhat_fit.resid", lambda x: x.isNotNull()).alias("_e"), (F.size("test") > 0).alias("_has_test"),
    )
    tested = with_ljung_box(with_centred(scored, "_e"), 12)
    lb_p = F.when(F.size("_e") >= 10, F.col("lb_p")[0])
    out = tested.withColumn("lb_p", lb_p).withColumn("is_white_noise", F.coalesce(F.col("lb_p") >= alpha, F.lit(False)))
    out = out.drop("_mean", "_c", "_g0", "lb_lags", "lb_stat")
    out = out.withColumn("_by", F.when(F.col("_has_test"), F.col(criterion)).otherwise(F.col("aic")))
    return rank_candidates(out, "_by", "spec_id").withColumnRenamed("_e", "resid").drop("_by", "_has_test")


def rank_candidates(scored: DataFrame, criterion: str, position: str) -> DataFrame:
    """Rank the candidates of each series; ties keep grid order, unfitted ones come last."""
    w = Window.partitionBy("series_id", "fold").orderBy(F.asc_nulls_last(criterion), position)
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("is_best", (F.col("rank") == 1) & F.col(criterion).isNotNull())


def _tuple_text(*parts: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[p.cast("string") for p in parts]), F.lit(")"))


def grid_table(grid: DataFrame) -> DataFrame:
    """The full ranked grid as a report: order texts, criteria and the best flag."""
    s = F.col("spec")
    return grid.select(
        "series_id",
        _tuple_text(s["p"], s["d"], s["q"]).alias("order"),
        _tuple_text(s["sp"], s["sd"], s["sq"], s["s"]).alias("seasonal_order"),
        "aic", "bic", *[f"val_{m}" for m in METRICS], "lb_p", "is_white_noise", "rank", "is_best",
    )


def winners_table(grid: DataFrame) -> DataFrame:
    """Best order per series, rounded as published."""
    s = F.col("spec")
    digits = {"aic": 2, "bic": 2, "val_mae": 2, "val_rmse": 2, "val_mape": 2, "val_smape": 2, "val_mase": 3, "lb_p": 4}
    return grid.filter("is_best").select(
        "series_id", "train_obs",
        _tuple_text(s["p"], s["d"], s["q"]).alias("optimal_order"),
        _tuple_text(s["sp"], s["sd"], s["sq"], s["s"]).alias("optimal_seasonal_order"),
        spec_name(s).alias("specification"),
        *[F.round(c, k).alias(c) for c, k in digits.items()],
        F.col("is_white_noise").alias("residuals_white_noise"),
    )


def winner_diagnostics(grid: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Residual tests of each series' best order."""
    best = grid.filter("is_best").select("series_id", spec_name(F.col("spec")).alias("specification"), F.col("resid").alias("values"))
    tests = residual_tests(best, 12, alpha, ("series_id", "specification"))
    return tests.select(
        "series_id", "specification",
        F.round("mean", 2).alias("residual_mean"), F.round("std", 2).alias("residual_std"),
        F.round("durbin_watson", 3).alias("durbin_watson"),
        F.round(F.col("lb_stat")[0], 3).alias("ljung_box_stat"), F.round("lb_min_p", 4).alias("ljung_box_p"),
        F.round("jb_stat", 3).alias("jarque_bera_stat"), F.round("jb_p", 4).alias("jarque_bera_p"),
        "is_normal", "is_white_noise",
    )


def best_specs(grid: DataFrame) -> DataFrame:
    """``series_id, spec`` of the winners, ready to join to a frame."""
    return grid.filter("is_best").select("series_id", "spec")


# --- tabular models ----------------------------------------------------------------------------

def _scored(frame: DataFrame, params: Column, position: Column) -> DataFrame:
    scores = array_metrics(F.col("test"), F.col("yhat"), F.col("scale"))
    return frame.select(
        "series_id", "fold", position.alias("position"), params.alias("params"),
        *[F.when(F.col("yhat").isNotNull(), c).alias(f"val_{m}") for m, c in scores.items()],
    )


def tune_ridge(frame: DataFrame, grid: Sequence[float] = RIDGE_GRID, metric: str = "mae", horizon: int = HORIZON) -> DataFrame:
    """Ridge penalties of each series ranked on the validation rows; all fits in one frame."""
    rows = frame.select("*", F.posexplode(F.array(*[F.lit(float(a)) for a in grid])).alias("position", "alpha"))
    made = ridge(rows, "yhat", horizon, alpha=F.col("alpha"))
    params = F.create_map(F.lit("alpha"), F.col("alpha"))
    return rank_candidates(_scored(made, params, F.col("position")), f"val_{metric}", "position")


def _tune_pooled(frame: DataFrame, estimators: Sequence[tuple[dict, object]], metric: str, horizon: int) -> DataFrame:
    """One fit per configuration on the same stored rows, a few at a time; one stage rolls all of them forward."""
    frame = materialised(frame)
    rows = training_rows(frame)
    # The list is a parameter, not data; the fits wait for each other's small jobs most of the time.
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        models = list(pool.map(lambda e: flat_trees.ensemble(e[1].fit(rows)), estimators)) if rows.take(1) else []
    values, last = usable_values(F.col("train")), F.element_at("train_dates", -1)
    rolled = flat_trees.with_rollouts(frame, "_rolled", {0: dict(enumerate(models))}, values, last, horizon)
    pairs = [F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, float(v))]) for params, _ in estimators]
    each = rolled.select("*", F.posexplode(F.array(*pairs)).alias("position", "params"))
    each = each.withColumn("yhat", unscaled(F.try_element_at("_rolled", F.col("position"))))
    return rank_candidates(_scored(each, F.col("params"), F.col("position")), f"val_{metric}", "position")


def tune_forest(frame: DataFrame, grid: Sequence = FOREST_GRID, metric: str = "mae", horizon: int = HORIZON, seed: int = 42) -> DataFrame:
    configs = [({"n_estimators": n, "max_depth": d}, random_forest(n, d, seed=seed)) for n, d in grid]
    return _tune_pooled(frame, configs, metric, horizon)


def tune_boosted(frame: DataFrame, grid: Sequence = BOOSTED_GRID, metric: str = "mae", horizon: int = HORIZON, seed: int = 42) -> DataFrame:
    configs = [
        ({"n_estimators": n, "max_depth": d, "learning_rate": r}, boosted_trees(n, d, r, seed)) for n, d, r in grid
    ]
    return _tune_pooled(frame, configs, metric, horizon)


def with_params(frame: DataFrame, params: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Per-series parameters (left join) with defaults where a series has none."""
    joined = frame.join(params, "series_id", "left")
    for name, value in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in params.columns else F.lit(value))
    return joined
