import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import gram
from tidepanel.operators import diagnostics, transforms


def plain_adf(y, top):
    """Each lag order solved alone by numpy, as the textbook has it."""
    d = np.diff(y)

    def design(p, first):
        t = np.arange(first, len(d))
        return np.column_stack([np.ones(len(t)), y[t], *(d[t - k] for k in range(1, p + 1))]), d[t]

    def aic(p):
        x, z = design(p, top)
        e = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
        return len(z) * np.log(e @ e / len(z)) + 2 * (p + 2)

    best = min(range(top + 1), key=lambda p: (aic(p), p))
    x, z = design(best, best)
    beta = np.linalg.lstsq(x, z, rcond=None)[0]
    e = z - x @ beta
    return best, len(z), beta[1] / np.sqrt(e @ e / (len(z) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])


def test_unit_root_from_products_against_single_regressions(spark):
    rng = np.random.default_rng(6)
    rows = {f"s{i}": 1e5 + 300 * (rng.normal(size=n).cumsum() if i % 2 else rng.normal(size=n)) for i, n in enumerate([15, 40, 40, 97, 300, 300, 1500])}
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()] + [("flat", [7.0] * 30), ("few", [1.0] * 14)], "series_id string, values array<double>")
    got = {r.series_id: r for r in diagnostics.adf(frame).collect()}
    assert "few" not in got and got["flat"].statistic is None
    for k, y in rows.items():
        top = min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
        best, n, tau = plain_adf(y, top)
        assert (got[k].lags_used, got[k].n_obs) == (best, n) and got[k].statistic == pytest.approx(tau, rel=1e-7)


def test_products_do_not_grow_with_the_series(spark):
    frame = spark.createDataFrame([([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]],)], "c array<array<double>>")
    assert frame.select(gram.products(F.col("c")).alias("g")).first().g == [14.0, 32.0, 77.0]
    at, whole = next(gram.matrices(pd.Series([None, [14.0, 32.0, 77.0], [np.nan] * 3])))
    assert at.tolist() == [1] and whole.tolist() == [[[14.0, 32.0], [32.0, 77.0]]]


def test_power_against_a_full_grid(spark):
    rng = np.random.default_rng(3)
    series = {"log": np.exp(rng.normal(5, 0.6, 90)), "root": (5 + rng.normal(0, 1, 90)) ** 2, "low": rng.normal(0, 1, 60) - 3.0, "flat": np.full(10, 4.0)}
    train = spark.createDataFrame([(k, float(v)) for k, y in series.items() for v in y], "series_id string, y double")
    got = {r.series_id: r for r in transforms.fit_boxcox(train).collect()}
    for k in ("log", "root", "low"):
        y = series[k] + got[k].offset
        assert got[k].offset == (0.0 if k != "low" else pytest.approx(1 - series[k].min()))
        x = y / np.exp(np.log(y).mean())
        score = lambda l: -np.log((np.log(x) if l == 0 else (x**l - 1) / l).var())
        best = max(np.round(np.arange(-20000, 20001) / 10000, 4), key=score)
        assert got[k].lam == pytest.approx(best, abs=2e-4)
    assert got["flat"].lam is None
