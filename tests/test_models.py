import numpy as np
import pandas as pd
import pytest
from panels import monthly
from pyspark.sql import functions as F

from tidepanel.functions import stats
from tidepanel.models import baseline, future, registry, selection, trees
from tidepanel.models.fitted import fitted_values
from tidepanel.models.linear import ar, ridge, sarima, spec_struct
from tidepanel.models.smoothing import holt_winters
from tidepanel.operators import decomposition, diagnostics, features, splits

SCHEMA = "series_id string, ts date, y double"


@pytest.fixture()
def folds(spark):
    a = monthly(72, 42, "2015-01-01", 1000, 3000, 300, 50)
    b = a.assign(series_id="B", y=a.y * 20)
    return splits.packed_folds(spark.createDataFrame(pd.concat([a, b]), SCHEMA), n_folds=1)


def _one(frame, column="o"):
    return frame.filter("series_id = 'A'").select("train", "train_dates", "test", column).first()


def test_tails(spark):
    df = spark.range(1).select(
        stats.normal_cdf(F.lit(1.96)).alias("n"), stats.normal_ppf(F.lit(0.975)).alias("q"),
        stats.chi2_sf(F.lit(21.026), F.lit(12)).alias("c12"), stats.chi2_sf(F.lit(7.815), F.lit(3)).alias("c3"),
        stats.t_two_sided(F.lit(2.201), F.lit(11)).alias("t11"), stats.t_two_sided(F.lit(2.228), F.lit(10)).alias("t10"),
        stats.chi2_sf(F.lit(3.841), F.lit(1)).alias("c1"), stats.t_two_sided(F.lit(12.706), F.lit(1)).alias("t1"),
        stats.t_two_sided(F.lit(4.303), F.lit(2)).alias("t2"),
    ).first()
    assert df.n == pytest.approx(0.975, abs=1e-4) and df.q == pytest.approx(1.959964, abs=1e-6)
    for v in (df.c12, df.c3, df.c1, df.t11, df.t10, df.t1, df.t2):
        assert v == pytest.approx(0.05, abs=2e-4)


def test_baselines_repeat(folds):
    made = folds.withColumn("n", baseline.naive(F.col("train"), 12)).withColumn("o", baseline.seasonal_naive(F.col("train"), 30))
    r = _one(made)
    assert r.o == (r.train[-12:] * 3)[:30]
    with pytest.raises(ValueError):
        baseline.naive(F.col("train"), 0)
    with pytest.raises(ValueError):
        baseline.seasonal_naive(F.col("train"), 12, 1)


def test_future_dates_follow_frequency(panel):
    out = future.forecast(panel, {"Naive": registry.from_expression(lambda y: baseline.naive(y, 3))}, 3)
    rows = out.filter("series_id = 'A'").orderBy("h").collect()
    assert [str(r.ts) for r in rows] == ["2021-01-01", "2021-02-01", "2021-03-01"]


def test_holt_winters_matches_a_plain_loop(folds):
    r = _one(folds.withColumn("o", holt_winters(F.col("train"), 12)))
    y, f, m = np.array(r.train), r.o, 12
    level, slope = y[:m].mean(), (y[m:2 * m].sum() - y[:m].sum()) / m**2
    s = list(y[:m] - level)
    sse = 0.0
    for t in range(m, len(y)):
        base, seas = level + slope, s[t % m]
        sse += (y[t] - base - seas) ** 2
        new = f.alpha * (y[t] - seas) + (1 - f.alpha) * base
        s[t % m] = f.gamma * (y[t] - base) + (1 - f.gamma) * seas
        slope = f.beta * (new - level) + (1 - f.beta) * slope
        level = new
    want = [level + h * slope + s[(len(y) + h - 1) % m] for h in range(1, 13)]
    assert f.sse == pytest.approx(sse) and np.allclose(f.yhat, want)


def test_holt_winters_refuses(spark):
    short = spark.createDataFrame([("A", [1.0] * 23), ("B", [0.0] + [1.0] * 40)], "series_id string, train array<double>")
    add = short.select("series_id", holt_winters(F.col("train"))["yhat"].alias("f")).collect()
    assert add[0].f is None and add[1].f is not None
    mul = short.select(holt_winters(F.col("train"), seasonal="mul")["yhat"].alias("f")).collect()
    assert mul[1].f is None


def test_ar_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    y = [0.0, 0.0]
    for e in rng.normal(0, 1, 800):
        y.append(float(2 + 0.5 * y[-1] + 0.2 * y[-2] + e))
    df = spark.createDataFrame([(y,)], "train array<double>")
    r = ar(df, "o", 5, lags=2, keep_fit=True).first()
    assert np.allclose(r.o_fit.beta[1:], [0.5, 0.2], atol=0.08)
    h = list(y)
    for _ in range(5):
        h.append(r.o_fit.beta[0] + r.o_fit.beta[1] * h[-1] + r.o_fit.beta[2] * h[-2])
    assert np.allclose(r.o, h[-5:])


def test_arma_recovery_and_interval(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(0, 1, 900)
    y = np.zeros(900)
    for t in range(1, 900):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    df = spark.createDataFrame([((y + 50).tolist(),)], "train array<double>")
    r = sarima(df, "o", spec_struct((1, 0, 1)), alpha=0.05, keep_fit=True).first()
    assert r.o_fit.ar[0] == pytest.approx(0.6, abs=0.12) and r.o_fit.ma[0] == pytest.approx(0.4, abs=0.15)
    assert r.o_fit.sigma == pytest.approx(1.0, abs=0.1)
    width = np.array(r.o_hi) - np.array(r.o_lo)
    assert (width > 0).all() and (np.diff(width) >= -1e-9).all()
    assert all(lo < m < hi for lo, m, hi in zip(r.o_lo, r.o, r.o_hi))


@pytest.mark.parametrize("name", ["Holt-Winters", "ARIMA(1,1,1)", "SARIMA", "Ridge", "Log + SARIMA", "Holt-Winters (Damped)"])
def test_model_contract(folds, name):
    r = _one(registry.all_forecasters()[name](folds, "o"))
    assert len(r.o) == 12 and np.isfinite(r.o).all()
    # The wave is learnt better than by repeating the last value.
    assert name.startswith("ARIMA") or np.abs(np.array(r.o) - r.test).mean() < np.abs(r.train[-1] - np.array(r.test)).mean()


def test_ridge_matches_closed_form(folds, spark):
    r = _one(ridge(folds, "o"))
    rows = [("A", d, float(v)) for d, v in zip(r.train_dates, r.train)]
    m = features.feature_matrix(spark.createDataFrame(rows, SCHEMA)).orderBy("ts").toPandas()
    names = features.feature_names()
    x, y = m[names].astype(float).to_numpy(), m.y.to_numpy()
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + np.eye(17), c.T @ (y - y.mean()))
    nxt = features.next_step_features(splits.pack(spark.createDataFrame(rows, SCHEMA))).toPandas()[names].astype(float).to_numpy()[0]
    assert r.o[0] == pytest.approx(y.mean() + (nxt - x.mean(0)) @ w, rel=1e-9)


def test_pooled_trees_and_direct(folds):
    model = trees.random_forest(10, 4, seed=7)
    a, b = (_one(trees.pooled(folds, "o", model)).o for _ in range(2))
    assert a == b and len(a) == 12
    d = trees.direct(folds, "o").select("series_id", "o").orderBy("series_id").collect()
    # Scaling per series makes the second series an exact multiple of the first.
    assert np.allclose(np.array(d[1].o), 20 * np.array(d[0].o))


def test_fitted_values_start(folds):
    rows = fitted_values(folds).filter("series_id = 'A'").orderBy("model", "ts").collect()
    naive = [r for r in rows if r.model == "Naive"]
    seasonal = [r for r in rows if r.model == "Seasonal Naive"]
    assert naive[0].resid == 0 and naive[1].fitted == naive[0].y
    assert all(r.fitted is None for r in seasonal[:12]) and seasonal[12].fitted == seasonal[0].y


def test_python_plug_in(folds):
    registry.register("Median", registry.python_forecaster(lambda y, h: np.repeat(np.median(y), h)))
    r = _one(registry.all_forecasters()["Median"](folds, "o"))
    assert r.o == [np.median(r.train)] * 12


def test_order_grid_ranks(folds):
    grid = selection.order_grid(folds, ((1, 1, 1), (0, 1, 0)), ((0, 1, 1, 12), (0, 0, 0, 12))).filter("series_id = 'A'").persist()
    rows = grid.orderBy("rank").collect()
    assert len(rows) == 4 and [r.is_best for r in rows] == [True, False, False, False]
    assert rows[0].val_mae == min(r.val_mae for r in rows if r.val_mae is not None)
    assert selection.winners_table(grid).first().specification.startswith("SARIMA(")
    with pytest.raises(ValueError):
        selection.order_grid(folds, criterion="r2")


def test_acf_pacf_match_numpy(spark):
    y = monthly(70).y.to_numpy()
    df = spark.createDataFrame([("A", y.tolist())], "series_id string, values array<double>")
    c = y - y.mean()
    r = np.array([c[k:] @ c[: len(c) - k] for k in range(13)]) / (c @ c)
    got = [x.acf for x in diagnostics.acf(df, 12).orderBy("lag").collect()]
    assert np.allclose(got, r)
    want = [1.0]
    for k in range(1, 13):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(toeplitz, r[1:k + 1])[-1])
    assert np.allclose([x.pacf for x in diagnostics.pacf(df, 12).orderBy("lag").collect()], want)


def test_stationarity_of_noise_and_walk(spark):
    e = np.random.default_rng(11).normal(0, 1, 150)
    df = spark.createDataFrame([("noise", e.tolist()), ("walk", e.cumsum().tolist())], "series_id string, values array<double>")
    got = {r.series_id: r for r in diagnostics.stationarity(df).collect()}
    assert got["noise"].is_stationary and got["noise"].adf_p < 0.01
    assert not got["walk"].is_stationary and got["walk"].adf_p > 0.05


def test_adf_statistic_matches_numpy(spark):
    y = np.random.default_rng(2).normal(0, 1, 80).cumsum()
    df = spark.createDataFrame([("a", y.tolist())], "series_id string, values array<double>")
    got = diagnostics.adf(df).first()
    p, d = got.lags_used, np.diff(y)
    rows = range(p, len(d))
    x = np.array([[1, y[t], *[d[t - k] for k in range(1, p + 1)]] for t in rows])
    z = d[p:]
    beta, sse, *_ = np.linalg.lstsq(x, z, rcond=None)
    se = np.sqrt(sse[0] / (len(z) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got.n_obs == len(z) and got.statistic == pytest.approx(beta[1] / se)
    assert got.crit_1 < got.crit_5 < got.crit_10 < 0


def test_decompositions_add_up(panel):
    c = decomposition.classical(panel).filter("trend is not null")
    assert c.agg(F.max(F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("y")))).first()[0] < 1e-8
    s = decomposition.stl_panel(panel).toPandas()
    assert len(s) == 120 and np.allclose(s.trend + s.seasonal + s.resid, s.y)
    a = s[s.series_id == "A"].sort_values("ts")
    wave = 500 * np.sin(2 * np.pi * np.arange(60) / 12)
    assert np.corrcoef(a.seasonal, wave)[0, 1] > 0.97 and np.corrcoef(a.trend, np.arange(60))[0, 1] > 0.99
