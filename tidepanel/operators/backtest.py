"""Forecast rows, plausibility guard, seed handling and aggregation of a rolling backtest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON, MODEL_PARADIGMS, paradigm_of
from tidepanel.operators.metrics import METRICS, metric_columns
from tidepanel.operators.quantiles import exact_percentiles
from tidepanel.operators.significance import bootstrap_ci, diebold_mariano, paired_bootstrap
from tidepanel.session import materialised

# Guard, cap, seeds and the models of special status.
UPPER_MULTIPLE = 3.0
MASE_CAP = 5.0
SEEDS = (42, 0, 1, 2, 3)
SEEDED_MODELS = ("RNN", "LSTM", "GRU", "Random Forest", "XGBoost")
TUNED_MODELS = ("SARIMA", "XGBoost")
UNGUARDED_MODELS = ("Naive", "Seasonal Naive")
KEY_PAIRS = (
    ("GRU", "LSTM"),
    ("GRU", "SARIMA"),
    ("LSTM", "SARIMA"),
    ("XGBoost", "SARIMA"),
    ("Holt-Winters", "Ridge"),
    ("Holt-Winters", "SARIMA"),
    ("Ridge", "SARIMA"),
)


# --- guard -----------------------------------------------------------------------------------

def plausible(yhat: Column, train: Column, horizon: int = HORIZON) -> Column:
    """Exactly ``horizon`` finite values within [-max, 3 max] of the training values."""
    top = F.array_max(train)
    finite = F.forall(yhat, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inside = F.forall(yhat, lambda x: (x <= UPPER_MULTIPLE * top) & (x >= -top))
    return F.coalesce((F.size(yhat) == horizon) & finite & inside, F.lit(False))


def guarded(candidates: Sequence[tuple[str, Column]], train: Column, horizon: int = HORIZON) -> Column:
    """First plausible candidate in order as ``struct(yhat, fallback)``; null when none is.

    The label is empty for the primary fit, so every substitution stays visible.
    """
    return F.coalesce(
        *[
            F.when(plausible(yhat, train, horizon), F.struct(yhat.alias("yhat"), F.lit(label).alias("fallback")))
            for label, yhat in candidates
        ]
    )


def guard_chain(model: str, forecasts: Mapping[str, Column], refits: Mapping[str, Column]) -> list[tuple[str, Column]]:
    """Primary fit, constrained refit if there is one, then seasonal naive."""
    chain = [("", forecasts[model])]
    if model in refits:
        chain.append(("constrained refit", refits[model]))
    if model not in UNGUARDED_MODELS:
        chain.append(("Seasonal Naive", forecasts["Seasonal Naive"]))
    return chain


def guarded_models(
    frame: DataFrame, forecasts: Mapping[str, str], refits: Mapping[str, str] | None = None, horizon: int = HORIZON
) -> DataFrame:
    """Wide frame -> one row per (series, fold, model, seed) with ``yhat`` and ``fallback``.

    ``forecasts`` maps model name to the array column with its forecast, a name
    ``"model#seed"`` marks one seed of a stochastic model.  ``yhat`` is null where
    no stage was plausible (see ``failures``).  ``error`` is the reason that the first stage gave, if it has one in
    ``<column>_error``, also where a later stage stepped in.
    """
    plain = {name.partition("#")[0]: F.col(c) for name, c in forecasts.items()}
    refit_columns = {m: F.col(c) for m, c in (refits or {}).items()}
    entries = []
    for name, column in forecasts.items():
        model, _, seed = name.partition("#")
        chain = guard_chain(model, {**plain, model: F.col(column)}, refit_columns)
        entries.append(
            F.struct(
                F.lit(model).alias("model"),
                F.lit(int(seed) if seed else None).cast("int").alias("seed"),
                guarded(chain, F.col("train"), horizon).alias("g"),
                (F.col(f"{column}_error") if f"{column}_error" in frame.columns else F.lit(None).cast("string")).alias("error"),
            )
        )
    keep = [c for c in ("series_id", "fold", "origin", "train", "test", "test_dates", "scale") if c in frame.columns]
    long = frame.select(*keep, F.explode(F.array(*entries)).alias("m"))
    return long.select(
        *keep,
        "m.model",
        "m.seed",
        F.coalesce(F.col("m.g.yhat"), F.lit(None).cast("array<double>")).alias("yhat"),
        F.col("m.g.fallback").alias("fallback"),
        F.col("m.error").alias("error"),
    )


def failures(model_rows: DataFrame) -> DataFrame:
    """Fits for which no stage gave a plausible forecast, with the reason of the first stage where it gave one."""
    bad = model_rows.filter(F.col("yhat").isNull())
    reason = F.lit("no plausible forecast produced")
    reason = F.coalesce(F.col("error"), reason) if "error" in model_rows.columns else reason
    return bad.select("series_id", "fold", "model", "seed", reason.alias("error"))


def all_failures(folds: DataFrame, model_rows: DataFrame, models: Sequence[str], seeds: Sequence[int | None]) -> DataFrame:
    """Fits without a plausible forecast, and expected fits that gave no row at all."""
    units = folds.select("series_id", "fold")
    gone = missing_fits(expected_fits(units, models, seeds), model_rows)
    absent = gone.select("series_id", "fold", "model", "seed", F.lit("no row produced").alias("error"))
    return failures(model_rows).unionByName(absent)


def missing_fits(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected (series, fold, model, seed) keys without a forecast (anti-join, null-safe on seed)."""
    e, p = expected.alias("e"), produced.select("series_id", "fold", "model", "seed").distinct().alias("p")
    same = (
        (F.col("e.series_id") == F.col("p.series_id"))
        & (F.col("e.fold") == F.col("p.fold"))
        & (F.col("e.model") == F.col("p.model"))
        & F.col("e.seed").eqNullSafe(F.col("p.seed"))
    )
    return e.join(p, same, "left_anti")


def forecast_rows(model_rows: DataFrame) -> DataFrame:
    """One row per step: ``h, ts, y, yhat`` with the keys, ``fallback``, ``origin`` and ``scale``."""
    zipped = F.posexplode(F.arrays_zip(F.col("test_dates").alias("ts"), F.col("test").alias("y"), F.col("yhat").alias("yhat")))
    keys = [c for c in ("series_id", "fold", "origin", "model", "seed", "fallback", "scale") if c in model_rows.columns]
    made = model_rows.filter(F.col("yhat").isNotNull()).select(*keys, zipped.alias("_h", "s"))
    return made.select(*keys, (F.col("_h") + 1).alias("h"), "s.ts", "s.y", "s.yhat")


# --- seeds -----------------------------------------------------------------------------------

def resolve_seeds(n_seeds: int | None = None, configured: Sequence[int] = SEEDS) -> list[int]:
    """The configured seeds, extended by the smallest unused integers up to ``n_seeds``."""
    if n_seeds is None:
        return list(configured)
    spare = (i for i in range(n_seeds + len(configured)) if i not in configured)
    return [*configured, *(next(spare) for _ in range(n_seeds - len(configured)))][:n_seeds]


def expected_fits(units: DataFrame, models: Sequence[str], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """One row per fit to run in each unit: stochastic models once per seed, others once with a null seed."""
    fits = [(m, s) for m in models for s in (seeds if m in SEEDED_MODELS else (None,))]
    plan = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).cast("int").alias("seed")) for m, s in fits])
    rows = units.withColumn("_fit", F.explode(plan)).select(*units.columns, "_fit.model", "_fit.seed")
    return rows.withColumn("paradigm", paradigm_of(F.col("model")))


# --- per-fold tables -------------------------------------------------------------------------

def fold_metrics(rows: DataFrame) -> DataFrame:
    """Metric row per (series, fold, model, seed) with origin, paradigm, fallback and tuning flag.

    ``series_id`` leads the key, so the aggregation reuses the partitioning of the packed panel.
    """
    made = rows.groupBy("series_id", "fold", "model", "seed").agg(
        F.first("origin").alias("origin"),
        F.first("fallback").alias("fallback"),
        *[c.alias(name) for name, c in metric_columns().items()],
    )
    return made.withColumn("paradigm", paradigm_of(F.col("model"))).withColumn(
        "params_tuned_on_test", F.col("model").isin(*TUNED_MODELS) & (F.col("fold") >= 1)
    )


def fold_errors(rows: DataFrame) -> DataFrame:
    """Absolute error of every step with its scale."""
    return rows.select(
        "series_id", "fold", "model", "seed", "h", F.abs(F.col("y") - F.col("yhat")).alias("abs_error"), "scale"
    )


# --- aggregation -----------------------------------------------------------------------------

def seed_average(fold_metric_rows: DataFrame) -> DataFrame:
    """One unit per (series, fold, model): metrics averaged over seeds, MASE capped per fit first."""
    capped = F.least(F.col("mase"), F.lit(MASE_CAP))
    return fold_metric_rows.groupBy("series_id", "fold", "model").agg(
        F.first("paradigm").alias("paradigm"),
        *[F.avg(m).alias(m) for m in METRICS if m != "mase"],
        F.avg(capped).alias("mase"),
        F.avg("mase").alias("mase_raw"),
        F.max((F.coalesce("fallback", F.lit("")) != "").cast("int")).alias("used_fallback"),
        F.when(F.count("mase") > 1, F.stddev_samp(capped)).alias("seed_std"),
    )


def seed_average_errors(errors: DataFrame) -> DataFrame:
    """Scaled step errors capped at the MASE cap, averaged over seeds."""
    scaled = F.least(F.col("abs_error") / F.col("scale"), F.lit(MASE_CAP))
    return errors.groupBy("series_id", "fold", "model", "h").agg(F.avg(scaled).alias("scaled_error"))


def with_unit_rank(units: DataFrame) -> DataFrame:
    """Rank of each model within its (series, fold); tied models share the average rank."""
    unit = Window.partitionBy("series_id", "fold")
    ties = F.count(F.lit(1)).over(Window.partitionBy("series_id", "fold", "mase"))
    return units.withColumn("unit_rank", F.rank().over(unit.orderBy("mase")) + (ties - 1) / 2)


def unit_key() -> Column:
    return F.concat_ws("|", "series_id", "fold")


def seed_spread(fold_metric_rows: DataFrame) -> DataFrame:
    """Per model: mean seed deviation, diverged units and units that used a fallback."""
    return seed_average(fold_metric_rows).groupBy("model").agg(
        F.avg("seed_std").alias("mean_seed_std"),
        F.sum((F.col("mase_raw") > MASE_CAP).cast("int")).alias("diverged_units"),
        F.sum("used_fallback").alias("fallback_units"),
    )


def summarize_models(fold_metric_rows: DataFrame, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """Leaderboard over all units with bootstrap intervals, ranked by mean MASE.

    The unit table is read by several branches, so it is written once.
    """
    units = materialised(seed_average(fold_metric_rows))
    ranked = with_unit_rank(units)
    main = ranked.groupBy("model").agg(
        F.first("paradigm").alias("paradigm"),
        F.avg("mase").alias("mean_mase"),
        F.stddev_samp("mase").alias("std_mase"),
        F.avg("mase_raw").alias("raw_mean_mase"),
        F.sum((F.col("mase_raw") > MASE_CAP).cast("int")).alias("diverged_units"),
        F.sum("used_fallback").alias("fallback_units"),
        F.avg(F.when(F.col("fold") == 0, F.col("mase"))).alias("fold0_mean_mase"),
        F.avg("seed_std").alias("mean_seed_std"),
        F.avg("unit_rank").alias("mean_rank"),
        F.count(F.lit(1)).alias("units"),
    )
    median = exact_percentiles(units, ["model"], "mase", (0.5,)).select("model", F.col("q")[0].alias("median_mase"))
    ci = bootstrap_ci(units, ["model"], unit_key(), "mase", n_boot=n_boot, seed=seed).select("model", "ci_low", "ci_high")
    joined = main.join(median, "model").join(ci, "model")
    # One row per model from here on.
    return joined.withColumn("rank", F.row_number().over(Window.orderBy("mean_mase", "model")))


def unit_counts(fold_metric_rows: DataFrame) -> DataFrame:
    """Number of distinct units, series and seeds."""
    return fold_metric_rows.agg(
        F.countDistinct("series_id", "fold").alias("n_units"),
        F.countDistinct("series_id").alias("n_series"),
        F.countDistinct("seed").alias("n_seeds"),
    )


def model_pairs(summary: DataFrame, key_pairs: Sequence[tuple[str, str]] = KEY_PAIRS) -> DataFrame:
    """Winner against every other model, then key pairs not already listed either way round.

    Works on one row per model; ``ord`` keeps the listing order.
    """
    winner = F.first("model").over(Window.orderBy("rank"))
    lead = summary.select(winner.alias("model_a"), F.col("model").alias("model_b"), F.col("rank").cast("int").alias("ord"))
    lead = lead.filter("ord > 1")
    listed = summary.sparkSession.createDataFrame(
        [(a, b, 1000 + i) for i, (a, b) in enumerate(key_pairs)], "model_a string, model_b string, ord int"
    )
    known = summary.select("model")
    listed = listed.join(known.withColumnRenamed("model", "model_a"), "model_a", "left_semi")
    listed = listed.join(known.withColumnRenamed("model", "model_b"), "model_b", "left_semi")

    def key(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_lo", F.least("model_a", "model_b")).withColumn("_hi", F.greatest("model_a", "model_b"))

    extra = key(listed).join(key(lead).select("_lo", "_hi"), ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")
    both = lead.unionByName(extra.select("model_a", "model_b", "ord"))
    return both.withColumn(
        "involves_tuned_model", F.col("model_a").isin(*TUNED_MODELS) | F.col("model_b").isin(*TUNED_MODELS)
    )


def _pair_columns(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b")) for a, b in pairs if a != b])


def paired_units(units: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """MASE difference of each listed pair in every unit that has both models.

    A unit's models become one map (at most one entry per model), so pairing
    needs neither a self-join nor all combinations.
    """
    wide = units.groupBy("series_id", "fold").agg(F.map_from_entries(F.collect_list(F.struct("model", "mase"))).alias("m"))
    rows = wide.select("series_id", "fold", "m", F.explode(_pair_columns(pairs)).alias("p"))
    diff = F.try_element_at("m", F.col("p.model_a")) - F.try_element_at("m", F.col("p.model_b"))
    return rows.select("p.model_a", "p.model_b", "series_id", "fold", diff.alias("diff")).filter(F.col("diff").isNotNull())


def paired_losses(errors: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Array ``d`` of loss differences per pair and series, oldest fold first."""
    steps = errors.groupBy("series_id", "fold", "h").agg(
        F.map_from_entries(F.collect_list(F.struct("model", "scaled_error"))).alias("m")
    )
    rows = steps.select("series_id", "fold", "h", "m", F.explode(_pair_columns(pairs)).alias("p"))
    diff = F.try_element_at("m", F.col("p.model_a")) - F.try_element_at("m", F.col("p.model_b"))
    rows = rows.select("p.model_a", "p.model_b", "series_id", "fold", "h", diff.alias("d")).filter(F.col("d").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("fold")).alias("f"), "h", "d")))
    return rows.groupBy("series_id", "model_a", "model_b").agg(F.transform(ordered, lambda s: s["d"]).alias("d"))


def compare_models(
    fold_metric_rows: DataFrame,
    errors: DataFrame,
    pairs: Sequence[tuple[str, str]],
    n_boot: int = 5000,
    seed: int = 0,
    horizon: int = HORIZON,
    alpha: float = 0.05,
) -> DataFrame:
    """Paired bootstrap over all units and Diebold-Mariano per series for the listed pairs."""
    key = ["model_a", "model_b"]
    boot = paired_bootstrap(materialised(paired_units(seed_average(fold_metric_rows), pairs)), key, unit_key(), n_boot=n_boot, alpha=alpha, seed=seed)
    losses = paired_losses(seed_average_errors(errors), pairs).filter(F.size("d") >= 2 * horizon + 1)
    dm = materialised(diebold_mariano(losses, ["series_id", *key], h=horizon).filter(F.col("p_value").isNotNull()))
    counts = dm.groupBy(*key).agg(
        F.count(F.lit(1)).alias("dm_series_tested"),
        F.sum((F.col("mean_diff") < 0).cast("int")).alias("dm_series_a_better"),
        F.sum((F.col("p_value") < alpha).cast("int")).alias("dm_series_significant"),
    )
    median = exact_percentiles(dm, key, "p_value", (0.5,)).select(*key, F.col("q")[0].alias("dm_median_p"))
    zero = {c: 0 for c in ("dm_series_tested", "dm_series_a_better", "dm_series_significant")}
    return (
        boot.join(counts, key, "left").join(median, key, "left").fillna(zero)
        .withColumn("bootstrap_significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
        .withColumn("involves_tuned_model", F.col("model_a").isin(*TUNED_MODELS) | F.col("model_b").isin(*TUNED_MODELS))
        .withColumnRenamed("n_units", "units")
    )


def known_models() -> list[str]:
    return [m for m, _ in MODEL_PARADIGMS]
