import numpy as np
import pandas as pd
import pytest
from panels import monthly
from pyspark.sql import functions as F

from tidepanel.models import flat_trees, registry, trees
from tidepanel.models.fitted import fitted_values
from tidepanel.operators import splits
from tidepanel.plans import rolling
from tidepanel.sources import readers, sinks

SCHEMA = "series_id string, ts date, y double"


@pytest.fixture(scope="module")
def folds(spark):
    parts = [monthly(72, i, "2015-01-01", 1000 * (i + 1), 3000, 300, 80).assign(series_id=f"S{i}") for i in range(4)]
    return splits.packed_folds(spark.createDataFrame(pd.concat(parts), SCHEMA), n_folds=2).cache()


@pytest.mark.parametrize("estimator", [lambda: trees.random_forest(12, 5), lambda: trees.boosted_trees(15, 3, 0.1)])
def test_arrays_predict_as_the_model_does(folds, estimator):
    estimator = estimator()
    rows = trees.samples(folds.filter("fold = 0"))
    model = estimator.fit(rows)
    made = model.transform(rows).select("features", "prediction").collect()
    flat = flat_trees.ensemble(model)
    got = flat.predict(np.array([r.features.toArray() for r in made]))
    assert np.allclose(got, [r.prediction for r in made], rtol=1e-12)
    assert len(flat.roots) == model.getNumTrees and flat.depth <= estimator.getMaxDepth()


def test_rollout_equals_step_by_step_transforms(folds):
    frame = folds.filter("fold = 0")
    estimator = trees.random_forest(10, 4, seed=7)
    model = estimator.fit(trees.samples(frame))
    want = {r.series_id: r.o for r in trees._stepwise(frame, "o", model, 12, "month").collect()}
    made = trees.pooled(frame, "o", estimator)
    assert "Checkpoint" not in made._jdf.queryExecution().toString() and "Scan ExistingRDD" not in made.select("o")._jdf.queryExecution().toString()
    got = {r.series_id: r.o for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_single_leaf_and_short_series(spark, folds):
    flat = flat_trees.Ensemble([(1.0, [(0, np.inf, 0, 0, 3.5)])], mean=True)
    assert flat.depth == 0 and flat.predict(np.zeros((2, 17))).tolist() == [3.5, 3.5]
    short = folds.limit(1).withColumn("train", F.slice("train", 1, 5)).withColumn("train_dates", F.slice("train_dates", 1, 5))
    made = flat_trees.with_rollouts(short, "r", {0: {0: flat}}, trees.usable_values(F.col("train")), F.element_at("train_dates", -1), 12)
    assert made.first().r is None


def test_fitted_values_of_every_model(folds):
    suite = (*rolling.BACKTEST_SUITE, "Log + SARIMA", "Mean")
    rows = fitted_values(folds, suite).filter("fitted IS NOT NULL").toPandas()
    assert set(rows.model) == set(suite) and set(rows.fold) == {0, 1}
    assert np.allclose(rows.y - rows.fitted, rows.resid)
    # One step ahead all but the constant models follow the values.
    error = rows.groupby("model").resid.apply(lambda e: np.abs(e).mean())
    assert (error.drop(["Mean", "Naive", "Seasonal Naive"]) < 1.2 * error["Naive"]).all(), error


def test_tree_fitted_values_against_the_model(folds):
    frame = folds.filter("fold = 0 AND series_id = 'S1'")
    made = trees.TREE_MODELS["Random Forest"].with_fitted(frame, "o").first()
    rows = trees.samples(frame)
    model = trees.TREE_MODELS["Random Forest"].estimator().fit(rows)
    want = [r.prediction * made.scale for r in model.transform(rows).collect()]
    assert made.o[: trees.WARM_UP] == [None] * trees.WARM_UP and np.allclose(sorted(made.o[trees.WARM_UP :]), sorted(want))


def test_parameters_of_single_series(spark, folds):
    tuned = spark.createDataFrame([("S1", 5, 2), ("S2", 5, 2)], "series_id string, n_estimators int, max_depth int")
    penalty = spark.createDataFrame([("S3", 1000.0)], "series_id string, alpha double")
    models = ("Ridge", "Random Forest")
    key = lambda rows: {(r.series_id, r.fold, r.model): r.yhat for r in rows.collect()}
    plain = key(rolling.model_rows(folds, models, n_folds=2))
    seconds = []
    routed = rolling.with_model_params(folds, {"Random Forest": tuned, "Ridge": penalty})
    got = key(rolling.model_rows(routed, models, n_folds=2, seconds=seconds))
    changed = {(s, m) for (s, _, m), v in got.items() if not np.allclose(v, plain[s, _, m])}
    assert changed == {("S1", "Random Forest"), ("S2", "Random Forest"), ("S3", "Ridge")} and len(seconds) == 4
    with pytest.raises(ValueError):
        rolling.with_model_params(folds, {"Naive": tuned})


def test_reasons_reach_the_failures(spark, folds):
    def broken(values, steps):
        raise ArithmeticError("no such luck")

    registry.register("Broken", registry.python_forecaster(broken))
    rows = rolling.model_rows(folds, ("Broken", "Naive"), n_folds=2).collect()
    assert {r.error for r in rows if r.model == "Broken"} == {"ArithmeticError: no such luck"}
    assert {r.fallback for r in rows if r.model == "Broken"} == {"Seasonal Naive"}
    short = folds.withColumn("train", F.slice("train", -13, 13)).withColumn("train_dates", F.slice("train_dates", -13, 13))
    made = rolling.model_rows(short, ("SARIMA",), n_folds=2)
    assert all("too few" in r.error for r in made.collect())


def test_one_series_of_the_partitioned_layout(spark, tmp_path):
    rows = [(f"Game: {c}", "2020-01-01", 1.0 + i, 2, 0.5, 0.1) for i, c in enumerate("ABCD")]
    panel = spark.createDataFrame(rows, "series_id string, ts string, y double, peak long, gain double, pct_gain double").withColumn("ts", F.to_date("ts"))
    path = str(tmp_path / "layout")
    sinks.write_per_series(panel, path)
    one = readers.read_series(spark, path, " game: b ")
    assert [(r.series_id, r.y) for r in one.collect()] == [("Game: B", 2.0)]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slug" in plan and "game_b" in plan
    assert readers.read_series(spark, path, "game b").count() == 1
    with pytest.raises(ValueError):
        readers.read_series(spark, path, "game e")
