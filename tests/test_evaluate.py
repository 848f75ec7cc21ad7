import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import backtest, metrics, reports, significance

ROWS = "series_id string, fold int, model string, seed int, h int, ts date, y double, yhat double, scale double"
FM = "series_id string, fold int, model string, paradigm string, seed int, fallback string, mae double, rmse double, mape double, smape double, mase double"


def _rows(spark, y, f, scale=1.0, model="m"):
    return spark.createDataFrame([("a", 0, model, None, i + 1, None, float(u), float(v), scale) for i, (u, v) in enumerate(zip(y, f))], ROWS)


def test_metric_values(spark):
    r = metrics.metrics(_rows(spark, (100, 200, 300), (110, 190, 300))).first()
    assert r.mae == pytest.approx(20 / 3) and r.rmse == pytest.approx(np.sqrt(200 / 3)) and r.mape == pytest.approx(5)
    with pytest.raises(ValueError):
        metrics.score(_rows(spark, (1,), (1,)), "r2")


def test_truncated_metrics(spark):
    rows = _rows(spark, (100, 200, 300, 400), (90, 220, 330, 0), scale=0.0)
    got = metrics.metrics_by_horizon(rows).orderBy("h").collect()
    assert got[2].mae == pytest.approx(20) and got[2].mase == 0


def test_plausibility(spark):
    nan = float("nan")
    cases = [[180.0] * 12, [1e6] * 12, [-1e6] * 12, [180.0] * 11 + [nan], [180.0] * 11, [180.0] * 11 + [None], None]
    df = spark.createDataFrame([([100.0, 200.0, 150.0], c) for c in cases], "t array<double>, f array<double>")
    got = [r.ok for r in df.select(backtest.plausible(F.col("f"), F.col("t")).alias("ok")).collect()]
    assert got == [True] + [False] * 6


def test_guard_order(spark):
    df = spark.createDataFrame([([1.0, 2.0], [9.0] * 12, [2.0] * 12, [1.0] * 12)], "train array<double>, a array<double>, r array<double>, s array<double>")
    df = df.withColumn("series_id", F.lit("x")).withColumn("fold", F.lit(0))
    rows = backtest.guarded_models(df, {"SARIMA": "a", "Seasonal Naive": "s", "Ridge": "a"}, {"SARIMA": "r"}).collect()
    got = {r.model: (r.fallback, r.yhat and r.yhat[0]) for r in rows}
    assert got == {"SARIMA": ("constrained refit", 2.0), "Seasonal Naive": ("", 1.0), "Ridge": ("Seasonal Naive", 1.0)}
    bad = backtest.guarded_models(df.withColumn("s", F.col("a")), {"Seasonal Naive": "s"})
    assert backtest.failures(bad).count() == 1


def test_seeds():
    assert backtest.resolve_seeds(None) == [42, 0, 1, 2, 3] and backtest.resolve_seeds(2) == [42, 0]
    assert backtest.resolve_seeds(7) == [42, 0, 1, 2, 3, 4, 5]


@pytest.fixture()
def fold_table(spark):
    out = []
    for g in ("A", "B"):
        for k in (0, 1):
            out.append((g, k, "Stable", "P", None, "", 1.0, 1.0, 1.0, 1.0, 1.0))
            for s, m in ((0, 0.5), (1, 1.5)):
                out.append((g, k, "Noisy", "Q", s, "", 1.0, 1.0, 1.0, 1.0, m))
    return spark.createDataFrame(out, FM)


def test_seed_average_and_summary(fold_table, spark):
    units = backtest.seed_average(fold_table)
    assert units.count() == 8
    s = {r.model: r for r in backtest.summarize_models(fold_table, n_boot=200).collect()}
    assert s["Noisy"].mean_mase == 1.0 and s["Noisy"].mean_seed_std == pytest.approx(np.std([0.5, 1.5], ddof=1))
    assert s["Stable"].mean_seed_std is None and s["Stable"].units == 4 and s["Stable"].mean_rank == 1.5
    wild = fold_table.withColumn("mase", F.when((F.col("model") == "Stable") & (F.col("series_id") == "A") & (F.col("fold") == 0), 1e9).otherwise(F.col("mase")))
    w = {r.model: r for r in backtest.summarize_models(wild, n_boot=200).collect()}["Stable"]
    assert w.diverged_units == 1 and w.mean_mase == (3 * 1 + 5) / 4 and w.median_mase == 1


def test_bootstrap_interval(spark):
    v = (0.5, 0.7, 0.6, 0.9, 0.4, 0.8)
    df = spark.createDataFrame([("m", str(i), x) for i, x in enumerate(v)], "model string, u string, v double")
    a, b = (significance.bootstrap_ci(df, ["model"], F.col("u"), "v", 2000).first() for _ in range(2))
    assert a == b and a.ci_low < np.mean(v) < a.ci_high
    rng = np.random.default_rng(0)
    means = rng.choice(v, (20000, 6)).mean(1)
    assert a.ci_low == pytest.approx(np.quantile(means, 0.025), abs=0.02)


def _dm(d, h):
    n, c = len(d), d - d.mean()
    lrv = c @ c / n + sum(2 * (1 - k / h) * (c[k:] @ c[:-k]) / n for k in range(1, min(h, n)))
    return d.mean() / np.sqrt(lrv / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


def test_diebold_mariano(spark):
    d = np.random.default_rng(1).normal(0.3, 1, 48)
    df = spark.createDataFrame([("x", d.tolist()), ("same", [0.0] * 30), ("shift", [1.0] * 30)], "k string, d array<double>")
    got = {r.k: r for r in significance.diebold_mariano(df, ["k"], 12).collect()}
    assert got["x"].statistic == pytest.approx(_dm(d, 12)) and 0 < got["x"].p_value < 1
    assert got["same"].p_value == 1 and got["shift"].p_value is None and got["same"].statistic is None


def test_pair_list(spark):
    s = spark.createDataFrame([("HW", 1), ("GRU", 2), ("LSTM", 3)], "model string, rank int")
    got = [(r.model_a, r.model_b) for r in backtest.model_pairs(s, (("GRU", "HW"), ("GRU", "LSTM"), ("GRU", "X"))).orderBy("ord").collect()]
    assert got == [("HW", "GRU"), ("HW", "LSTM"), ("GRU", "LSTM")]


def test_leaderboard_and_winners(spark):
    rows = [("a", "Naive", 10.0, 1.2), ("a", "Ridge", 10.0, 0.8), ("b", "Naive", 5.0, 1.0), ("b", "Ridge", 7.0, 0.9)]
    bench = spark.createDataFrame([(s, m, m, mae, mae, 1.0, 1.0, mase) for s, m, mae, mase in rows], "series_id string, model string, paradigm string, mae double, rmse double, mape double, smape double, mase double")
    board = {r.model: r for r in reports.leaderboard(bench).collect()}
    # A tie in MAE goes to the model listed first.
    assert board["Naive"].series_won == 2 and board["Ridge"].series_won == 0
    assert board["Ridge"]["rank"] == 1 and board["Ridge"].median_mae == 8.5
