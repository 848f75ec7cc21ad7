import datetime as dt

import numpy as np
import pytest
from panels import monthly
from pyspark.sql import functions as F

from tidepanel import session
from tidepanel.functions.text import month_from_text
from tidepanel.models import registry, selection, trees
from tidepanel.models.linear import ar, ridge, sarima, spec_struct
from tidepanel.operators import backtest, coverage, diagnostics, splits
from tidepanel.plans import rolling
from tidepanel.plans.ingest import run_ingest
from tidepanel.sources import readers


def many(spark, n_series=25, n=64):
    import pandas as pd

    frames = [monthly(n, seed=i, name=f"S{i:02}") for i in range(n_series)]
    return spark.createDataFrame(pd.concat(frames), "series_id string, ts date, y double")


def test_ingest_keeps_every_series(spark, tmp_path):
    panel = many(spark)
    raw = panel.select(
        F.col("series_id").alias("gamename"), F.date_format("ts", "MMMM yyyy").alias("month"),
        F.round("y", 2).cast("string").alias("avg"), F.lit("-").alias("gain"), F.lit("-").alias("% gain"), F.lit("90000").alias("peak"),
    )
    out = run_ingest(spark, "", str(tmp_path / "a"), raw=raw)
    assert out["panel"].select("series_id").distinct().count() == 25
    few = run_ingest(spark, "", str(tmp_path / "b"), raw=raw, max_series=3, candidates=["S01", "S02", "S03", "S04"])
    assert few["panel"].select("series_id").distinct().count() == 7  # filled up as the selection rule says


def test_selection_without_limit_still_fills_when_few_pass(spark):
    panel = many(spark, 3).withColumn("peak", F.lit(90000.0))
    assert coverage.select_series(panel, max_series=None).count() == 3


def test_lag_order_of_long_series_is_not_capped(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=2500))
    df = spark.createDataFrame([("A", [float(v) for v in y])], "series_id string, values array<double>")
    row = diagnostics.adf(df).first()
    top = int(np.ceil(12 * (2500 / 100) ** 0.25))
    assert top == 27 and row.n_obs == 2500 - 1 - row.lags_used


@pytest.mark.parametrize("order,seasonal", [((1, 2, 1), (0, 0, 0, 12)), ((0, 2, 0), (0, 1, 0, 12)), ((1, 0, 0), (0, 2, 0, 12))])
def test_any_number_of_differences(spark, panel, order, seasonal):
    folds = splits.packed_folds(panel, 1)
    rows = sarima(folds, "yhat", spec_struct(order, seasonal)).collect()
    assert rows and all(r.yhat is not None and np.isfinite(r.yhat).all() for r in rows)


def test_second_differences_continue_a_parabola(spark):
    y = [float(t * t) for t in range(60)]
    folds = spark.createDataFrame([("A", y)], "series_id string, train array<double>")
    made = sarima(folds, "yhat", spec_struct((0, 2, 0)), 5).first().yhat
    assert np.allclose(made, [y[-1] + k * (y[-1] - y[-2]) for k in range(1, 6)])


def test_short_series_are_listed(spark):
    panel = spark.createDataFrame(monthly(45), "series_id string, ts date, y double")
    rows = {r.fold: r.rule for r in splits.rejected_series(panel, 3).collect()}
    assert rows == {1: "needs 52 values", 2: "needs 64 values"}


def test_malformed_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("game,month,avg\nA,May 2020,10\nB,June 2020,11,extra\n")
    raw = readers.read_raw(spark, str(tmp_path / "raw.csv"))
    assert [r[readers.CORRUPT] for r in raw.collect()] == [None, "B,June 2020,11,extra"]


def test_unset_shared_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_one_parser_per_date_text(spark):
    texts = ["March 2020", "Mar 2020", "May 2020", "March 5, 2020", "Mar 5, 2020", "2020-03-05 10:00:00", "2020-03-05", "2020-03", "2020/03/05", "03/05/2020", "20200305", " 2020-03 ", "03-2020", "Foo 2020", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(month_from_text(F.col("t"))).collect()]
    want = [dt.date(2020, 3, 1)] * 2 + [dt.date(2020, 5, 1)] + [dt.date(2020, 3, 1)] * 9 + [None] * 3
    assert got == want


def toy(f, out, h, seed=0):
    """A pooled stand-in: the last value, moved by the seed."""
    return f.withColumn(out, F.array_repeat(F.element_at("train", -1) + F.lit(float(seed)), h))


def test_backtest_fits_each_seed_and_fold_once(spark, panel, tmp_path):
    out = rolling.run_backtest(
        panel, str(tmp_path / "b"), ("Naive", "Seasonal Naive", "XGBoost", "Direct Linear"), n_folds=2, n_boot=50,
        seeds=(42, 0, 1), pooled={"XGBoost": toy, "Direct Linear": toy},
    )
    counts = {(r.model, r.fold): r["count"] for r in out["fold_metrics"].groupBy("model", "fold").count().collect()}
    assert counts == {(m, k): 2 * n for m, n in (("Naive", 1), ("Seasonal Naive", 1), ("XGBoost", 3), ("Direct Linear", 1)) for k in (0, 1)}
    assert out["fit_seconds"].count() == 2 * (3 + 1)
    assert out["failures"].count() == 0 and out["rejected"].count() == 0
    assert out["summary"].filter("model = 'XGBoost' AND mean_seed_std > 0").count() == 1


def test_missing_rows_are_failures(spark, panel):
    folds = splits.packed_folds(panel, 1)
    rows = backtest.guarded_models(folds.withColumn("a", F.array_repeat(F.lit(1.0), 12)).withColumn("b", F.col("a")), {"Naive": "a", "Seasonal Naive": "b"})
    gone = backtest.all_failures(folds, rows, ["Naive", "Mean"], (None,)).collect()
    assert {(r.model, r.error) for r in gone} == {("Mean", "no row produced")}


def test_no_python_fit_above_the_fold_filter(spark, panel):
    folds = splits.packed_folds(panel, 2)
    seen = []

    def watched(f, out, h, seed=0):
        seen.append(f._jdf.queryExecution().optimizedPlan().toString())
        return toy(f, out, h)

    rolling.model_rows(folds, ("Holt-Winters", "Ridge", "XGBoost"), n_folds=2, pooled={"XGBoost": watched})
    assert len(seen) == 2 and not any("ArrowEvalPython" in p for p in seen)


@pytest.mark.parametrize("by", ["log", "sqrt", "standard", "minmax", "robust", registry.box_cox(0.5), registry.box_cox(0)])
def test_any_transform_round_trips_around_any_forecaster(spark, panel, by):
    folds = splits.packed_folds(panel, 1)
    naive = registry.default_forecasters()["Seasonal Naive"]
    for r in registry.transformed(folds, "yhat", 12, naive, by).collect():
        assert np.allclose(r.yhat, r.train[-12:])


def test_differenced_forecaster(spark, panel):
    folds = splits.packed_folds(panel, 1)
    flat = registry.from_expression(lambda y: F.array_repeat(F.lit(2.0), 3))
    for r in registry.differenced(folds, "yhat", flat).collect():
        assert np.allclose(r.yhat, [r.train[-1] + 2, r.train[-1] + 4, r.train[-1] + 6])


def test_direct_forecast_beyond_the_trained_steps(spark, panel):
    folds = splits.packed_folds(panel, 1)
    near = {r.series_id: r.yhat for r in trees.direct(folds, "yhat", 6).collect()}
    far = {r.series_id: r.yhat for r in trees.direct(folds, "yhat", 15, trained=6).collect()}
    assert all(len(far[k]) == 15 and np.allclose(far[k][:6], near[k]) for k in near)


def test_information_criteria(spark, panel):
    folds = splits.packed_folds(panel, 1)
    for made in (ar(folds, "f", keep_fit=True), ridge(folds, "f", keep_fit=True)):
        fit = made.first().f_fit
        k = len(fit.beta)
        assert fit.aic == pytest.approx(fit.n * np.log(fit.sse / fit.n) + 2 * k)
        assert fit.bic == pytest.approx(fit.n * np.log(fit.sse / fit.n) + k * np.log(fit.n))


def test_order_search_without_validation_rows_uses_aic(spark, panel):
    folds = splits.packed_folds(panel, 1).withColumn("test", F.array().cast("array<double>"))
    grid = selection.order_grid(folds, orders=((1, 1, 1), (0, 1, 0)), seasonal_orders=((0, 0, 0, 12),))
    best = grid.filter("is_best").collect()
    assert len(best) == 2
    for r in best:
        assert r.aic == min(x.aic for x in grid.filter(F.col("series_id") == r.series_id).collect())


def test_full_run_and_stored_orders(spark, tmp_path):
    from tidepanel.plans import full_run
    from tidepanel.sources import tables

    raw = tables.raw_scrape(spark, "/root/testdata/sf0.001").withColumn("peak", F.lit("9,999,999"))
    out = full_run.run_all(
        spark, raw, str(tmp_path), validation_suites=(rolling.STATISTICAL_SUITE,), holdout_models=("Naive", "Seasonal Naive", "SARIMA"),
        n_boot=50, models=("Naive", "Seasonal Naive", "SARIMA", "XGBoost"), n_folds=2, seeds=(1, 2), pooled={"XGBoost": toy},
    )
    n = out["ingest"]["panel"].select("series_id").distinct().count()
    assert n >= 4 and out["validation"]["validation_0"].count() == n * len(rolling.STATISTICAL_SUITE)
    assert out["validation"]["drift"].count() > 0 and out["backtest"]["summary"].count() == 4
    orders = out["orders"]["order_selection"].select(
        F.col("series_id").alias("Game"), F.col("optimal_order").alias("Optimal_Order"), F.col("optimal_seasonal_order").alias("Optimal_Seasonal_Order")
    )
    orders.coalesce(1).write.option("header", True).csv(str(tmp_path / "orders.csv"))
    specs = {r.series_id: r.spec.asDict() for r in full_run.stored_specs(spark, str(tmp_path / "orders.csv")).collect()}
    assert specs == {r.series_id: r.spec.asDict() for r in out["orders"]["specs"].collect()}


def test_machine_learning_validation_suite(spark):
    from tidepanel.sources import tables

    panel = tables.orders_priority_month(spark, "/root/testdata/sf0.001")
    rows = rolling.validation_benchmark(panel, rolling.ML_SUITE)
    assert {r.model for r in rows.collect()} == set(rolling.ML_SUITE)
