"""Pooled tree and direct multi-step forecasters on MLlib.

One model serves all series of a fold.  Values are divided by the series'
seasonal-naive scale first, so series of any size share the model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON, add_periods
from tidepanel.models import flat_trees
from tidepanel.operators.features import LAGS, WINDOWS, step_vector
from tidepanel.session import ensure_checkpoint_dir, materialised

WARM_UP = max(*LAGS, *WINDOWS)
ROUNDS_PER_CHECKPOINT = 6
#: Training rows of a partition of a pooled fit.
ROWS_PER_PARTITION = 50_000


def random_forest(n_trees: int = 100, max_depth: int = 10, min_split: int = 2, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=n_trees, maxDepth=max_depth, minInstancesPerNode=max(1, min_split // 2), seed=seed,
        featureSubsetStrategy="all", featuresCol="features", labelCol="label",
    )


def boosted_trees(n_trees: int = 100, max_depth: int = 4, learning_rate: float = 0.05, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(
        maxIter=n_trees, maxDepth=max_depth, stepSize=learning_rate, seed=seed, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", featuresCol="features", labelCol="label",
    )


def _scaled(values: Column) -> Column:
    return F.transform(values, lambda x: x / F.col("scale"))


def samples(frame: DataFrame, *keep: str) -> DataFrame:
    """One training row per period after the warm-up: scaled features and label, with the columns ``keep``."""
    n = F.size("train")
    t = F.explode(F.sequence(F.lit(WARM_UP + 1), n))
    rows = frame.filter(n > WARM_UP).select(*keep, _scaled(F.col("train")).alias("z"), "train_dates", t.alias("t"))
    return rows.select(
        *keep,
        array_to_vector(step_vector(F.col("z"), F.col("t"), F.element_at("train_dates", F.col("t")))).alias("features"),
        F.element_at("z", F.col("t")).alias("label"),
    )


def training_rows(frame: DataFrame) -> DataFrame:
    """Stored ``samples``; a fit runs hundreds of small jobs, so their tasks follow the rows, not the shuffle partitions."""
    rows = materialised(samples(frame))
    return rows.coalesce(1 + rows.count() // ROWS_PER_PARTITION)


def usable_values(values: Column) -> Column:
    """Scaled values, null for series too short to have a training row."""
    return F.when(F.size(values) > WARM_UP, _scaled(values))


def pooled(frame: DataFrame, out: str, estimator, horizon: int = HORIZON, freq: str = "month") -> DataFrame:
    """Fit one estimator on all series of ``frame`` and roll every series forward ``horizon`` steps.

    Trained trees become flat arrays, so all steps are one narrow Python stage without a shuffle or a checkpoint.
    Other MLlib regressors are applied step by step. The packed rows are stored, so the source is read once.
    """
    frame = materialised(frame)
    model = estimator.fit(training_rows(frame))
    if not flat_trees.is_tree_model(model):
        return _stepwise(frame, out, model, horizon, freq)
    values, last = usable_values(F.col("train")), F.element_at("train_dates", -1)
    made = flat_trees.with_rollouts(frame, "_rolled", {0: {0: flat_trees.ensemble(model)}}, values, last, horizon, freq=freq)
    return made.withColumn(out, unscaled(F.try_element_at("_rolled", F.lit(0)))).drop("_rolled")


def unscaled(values: Column) -> Column:
    return F.transform(values, lambda x: x * F.col("scale"))


def _stepwise(frame: DataFrame, out: str, model, horizon: int, freq: str) -> DataFrame:
    """Each round computes the next feature row from the grown history and applies the model to it.

    The grown state is checkpointed every few rounds: the plan stays short, and no later filter can be pushed into the
    chain and repeat its predictions.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    n = F.size("train")
    state = frame.withColumn("_z", usable_values(F.col("train")))
    for h in range(1, horizon + 1):
        ts = add_periods(F.element_at("train_dates", -1), F.lit(h), freq)
        # Too short series get a blank feature row and are nulled at the end.
        usable = F.coalesce(step_vector(F.col("_z"), F.size("_z") + 1, ts), F.array_repeat(F.lit(0.0), 17))
        state = state.withColumn("features", array_to_vector(usable))
        state = model.transform(state).withColumn("_z", F.array_append("_z", F.col("prediction")))
        state = state.drop("features", "prediction")
        if h % ROUNDS_PER_CHECKPOINT == 0 or h == horizon:
            state = state.checkpoint()
    tail = F.slice("_z", F.size("_z") - horizon + 1, F.lit(horizon))
    return state.withColumn(out, F.when(n > WARM_UP, unscaled(tail))).drop("_z")


class TreeForecaster:
    """A pooled model of the backtest whose trained form is flat arrays: ``make(seed=..., **params)`` gives the estimator.

    ``defaults`` are the parameters that a table of tuned ones may change per series.
    """

    def __init__(self, make: Callable[..., object], **defaults: float) -> None:
        self.make, self.defaults = make, defaults

    def estimator(self, seed: int = 42, **params: float):
        whole = {k: int(v) if isinstance(self.defaults[k], int) else float(v) for k, v in {**self.defaults, **params}.items()}
        return self.make(seed=seed, **whole)

    def fit(self, rows: DataFrame, seed: int = 42, **params: float) -> flat_trees.Ensemble:
        """Train on rows of ``samples``."""
        return flat_trees.ensemble(self.estimator(seed, **params).fit(rows))

    def __call__(self, frame: DataFrame, out: str, horizon: int = HORIZON, seed: int = 42) -> DataFrame:
        return pooled(frame, out, self.estimator(seed), horizon)

    def with_fitted(self, frame: DataFrame, out: str, seed: int = 42) -> DataFrame:
        """Add ``out``, the one-step predictions of the training rows by a fit on them; null for the first ones."""
        model = self.estimator(seed).fit(training_rows(frame))
        made = flat_trees.with_fitted(frame, "_fitted", flat_trees.ensemble(model), usable_values(F.col("train")), F.col("train_dates"))
        return made.withColumn(out, unscaled(F.col("_fitted"))).drop("_fitted")


def direct(
    frame: DataFrame,
    out: str,
    horizon: int = HORIZON,
    past: int = 12,
    estimator=None,
    trained: int | None = None,
) -> DataFrame:
    """All steps at once from the last ``past`` values: one pooled regression per step.

    ``trained`` is the number of steps the regressions cover (default: the horizon, and
    at most that); a longer horizon feeds the forecasts back as the next past values.

    Samples are windows of the training rows, min-max scaled per series with
    training limits.  Without an ``estimator`` all steps are solved by least squares
    from one pass; any MLlib regressor can be given instead (one fit per step).
    """
    if trained is not None and trained < horizon:
        if estimator is not None:
            raise ValueError("feeding forecasts back needs the least-squares form")
        return _refed(frame, out, horizon, past, trained)
    n = F.size("train")
    lo, hi = F.array_min("train"), F.array_max("train")
    base = frame.withColumn("_lo", lo).withColumn("_range", F.when(hi > lo, hi - lo).otherwise(1.0))
    base = base.withColumn("_z", F.transform("train", lambda x: (x - F.col("_lo")) / F.col("_range")))
    ends = F.explode(F.sequence(F.lit(past), n - horizon))
    windows = base.filter(n >= past + horizon).select("_z", ends.alias("t"))
    x, ahead = F.slice("_z", F.col("t") - past + 1, F.lit(past)), F.slice("_z", F.col("t") + 1, F.lit(horizon))
    samples = windows.select(x.alias("x"), ahead.alias("ahead"))
    recent = F.when(n >= past, F.slice("_z", n - past + 1, F.lit(past))).otherwise(F.array_repeat(F.lit(0.0), past))
    if estimator is None:
        weights = _multi_output_weights(samples, past, horizon)
        bias_and_x = F.concat(F.array(F.lit(1.0)), recent)
        scaled = [
            F.aggregate(F.zip_with(F.array(*map(F.lit, w)), bias_and_x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
            for w in weights
        ]
        state = base
    else:
        rows = samples.withColumn("features", array_to_vector("x")).persist()
        try:
            models = [estimator.fit(rows.select("features", F.element_at("ahead", h).alias("label"))) for h in range(1, horizon + 1)]
        finally:
            rows.unpersist()
        state = base.withColumn("features", array_to_vector(recent))
        for h, model in enumerate(models, 1):
            state = model.setPredictionCol(f"_p{h}").transform(state)
        scaled = [F.col(f"_p{h}") for h in range(1, horizon + 1)]
    steps = F.array(*[p * F.col("_range") + F.col("_lo") for p in scaled])
    return state.withColumn(out, F.when(n >= past, steps)).select(*frame.columns, out)


def direct_fitted(frame: DataFrame, out: str, horizon: int = HORIZON, past: int = 12) -> DataFrame:
    """Add ``out``, the first step of the direct regression at every period that has ``past`` values before it."""
    n = F.size("train")
    lo, hi = F.array_min("train"), F.array_max("train")
    base = frame.withColumn("_lo", lo).withColumn("_range", F.when(hi > lo, hi - lo).otherwise(1.0))
    base = base.withColumn("_z", F.transform("train", lambda x: (x - F.col("_lo")) / F.col("_range")))
    windows = base.filter(n >= past + horizon).select("_z", F.explode(F.sequence(F.lit(past), n - horizon)).alias("t"))
    samples = windows.select(F.slice("_z", F.col("t") - past + 1, F.lit(past)).alias("x"), F.slice("_z", F.col("t") + 1, F.lit(horizon)).alias("ahead"))
    bias, *weights = _multi_output_weights(samples, past, horizon)[0]
    w = F.array(*map(F.lit, weights))
    step = lambda t: F.aggregate(F.zip_with(w, F.slice("_z", t - past, F.lit(past)), lambda a, b: a * b), F.lit(bias), lambda a, v: a + v)
    made = F.transform(F.sequence(F.lit(past + 1), n), lambda t: step(t) * F.col("_range") + F.col("_lo"))
    blank = F.array_repeat(F.lit(None).cast("double"), past)
    return base.withColumn(out, F.when(n > past, F.concat(blank, made))).select(*frame.columns, out)


def _refed(frame: DataFrame, out: str, horizon: int, past: int, trained: int) -> DataFrame:
    """Direct blocks of ``trained`` steps; each block's window ends with the blocks before it."""
    n = F.size("train")
    lo, hi = F.array_min("train"), F.array_max("train")
    base = frame.withColumn("_lo", lo).withColumn("_range", F.when(hi > lo, hi - lo).otherwise(1.0))
    base = base.withColumn("_z", F.transform("train", lambda x: (x - F.col("_lo")) / F.col("_range")))
    windows = base.filter(n >= past + trained).select("_z", F.explode(F.sequence(F.lit(past), n - trained)).alias("t"))
    samples = windows.select(
        F.slice("_z", F.col("t") - past + 1, F.lit(past)).alias("x"), F.slice("_z", F.col("t") + 1, F.lit(trained)).alias("ahead")
    )
    weights = F.array(*[F.array(*map(F.lit, w)) for w in _multi_output_weights(samples, past, trained)])
    blocks = -(-horizon // trained)

    def grow(seen: Column, _: Column) -> Column:
        x = F.concat(F.array(F.lit(1.0)), F.slice(seen, -past, past))
        dot = lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.concat(seen, F.transform(weights, dot))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(blocks)), F.slice("_z", -past, past), grow)
    steps = F.transform(F.slice(grown, past + 1, horizon), lambda z: z * F.col("_range") + F.col("_lo"))
    return base.withColumn(out, F.when(n >= past, steps)).select(*frame.columns, out)


def _multi_output_weights(samples: DataFrame, past: int, horizon: int, alpha: float = 1e-3) -> list[list[float]]:
    """Least-squares weights of every step from one pass over the samples.

    All sums of products are one aggregate; what reaches the driver is a fixed
    (1 + past) x (1 + past + horizon) matrix, whatever the number of series.
    """
    left = [F.lit(1.0)] + [F.col("x")[i] for i in range(past)]
    right = left + [F.col("ahead")[i] for i in range(horizon)]
    row = samples.agg(*[F.sum(a * b) for i, a in enumerate(left) for b in right[i:]], F.count(F.lit(1))).first()
    if not row[-1]:
        raise ValueError("no training windows: every series is too short")
    k = 1 + past
    gram = np.zeros((k, k + horizon))
    cells = iter(row)
    for i in range(k):
        for j in range(i, k + horizon):
            gram[i, j] = next(cells)
            if j < k:
                gram[j, i] = gram[i, j]
    penalty = alpha * row[-1] * np.diag([0.0] + [1.0] * past)
    return np.linalg.solve(gram[:, :k] + penalty, gram[:, k:]).T.tolist()


#: The tree models of the backtest.
TREE_MODELS = {
    "Random Forest": TreeForecaster(lambda seed, n_estimators, max_depth: random_forest(n_estimators, max_depth, seed=seed), n_estimators=100, max_depth=6),
    "XGBoost": TreeForecaster(
        lambda seed, n_estimators, max_depth, learning_rate: boosted_trees(n_estimators, max_depth, learning_rate, seed),
        n_estimators=100, max_depth=3, learning_rate=0.05,
    ),
}
