import numpy as np
import pandas as pd
import pytest
from panels import monthly
from pyspark.sql import functions as F

from tidepanel.operators import features, splits, transforms
from tidepanel.operators.quantiles import exact_percentiles


@pytest.mark.parametrize("kind", ["minmax", "standard", "robust"])
def test_scaling_uses_train_only_and_inverts(panel, kind):
    rows = splits.split_rows(panel)
    params = transforms.fit_scaler(rows.filter("split = 'train'"), kind)
    out = transforms.invert_scaler(transforms.apply_scaler(rows, params), params)
    top = out.agg(F.max(F.abs(F.col("y") - F.col("y_restored"))).alias("e"), F.max(F.when(F.col("split") == "test", F.col("y_scaled"))).alias("m")).first()
    assert top.e < 1e-8 and top.m > 1


def test_scaler_on_two_columns(spark):
    df = spark.createDataFrame([("a", i + 1, float(10 * (i + 1)), float(100 * (i + 1))) for i in range(4)], "series_id string, ts int, u double, v double")
    p = transforms.fit_scaler(df, "minmax", ("u", "v"))
    got = transforms.apply_scaler(df, p, ("u", "v")).orderBy("ts").collect()
    assert np.allclose([r.u_scaled for r in got], [0, 1 / 3, 2 / 3, 1]) and np.allclose([r.v_scaled for r in got], [0, 1 / 3, 2 / 3, 1])
    with pytest.raises(ValueError, match="not fitted"):
        transforms.apply_scaler(df, p, ("w",))


def test_log_offset(spark):
    df = spark.createDataFrame([("a", i, y) for i, y in enumerate((-5.0, 0.0, 10.0, 20.0))], "series_id string, ts int, y double")
    p = transforms.fit_log(df)
    assert p.first().offset == 6
    out = transforms.invert_log(transforms.apply_log(df, p), p)
    assert out.agg(F.max(F.abs(F.col("y") - F.col("y_restored")))).first()[0] < 1e-9
    with pytest.raises(Exception, match="offset too small"):
        transforms.fit_log(df, offset=1.0).collect()


def test_boxcox_lambda_and_inverse(spark):
    rng = np.random.default_rng(1)
    y = np.exp(rng.normal(3, 0.5, 400))
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "ts": range(400), "y": y}))
    p = transforms.fit_boxcox(df)
    assert abs(p.first().lam) < 0.15  # log-normal data
    out = transforms.invert_boxcox(transforms.apply_boxcox(df, p), p)
    assert out.agg(F.max(F.abs(F.col("y") - F.col("y_restored")))).first()[0] < 1e-6


@pytest.mark.parametrize("order,season", [(1, 0), (0, 12), (1, 12)])
def test_difference_inverts_beyond_one_season(spark, order, season):
    y = monthly(70).y.to_numpy()
    d = y.copy()
    for lag in [1] * order + ([season] if season else []):
        d = np.r_[np.full(lag, np.nan), d[lag:] - d[:-lag]]
    df = spark.createDataFrame([(y[:50].tolist(), d[50:].tolist())], "h array<double>, d array<double>")
    got = df.select(transforms.undo_difference(F.col("h"), F.col("d"), order, season).alias("y")).first().y
    assert np.allclose(got, y[50:])
    with pytest.raises(ValueError):
        transforms.undo_difference(F.col("h"), F.col("d"), 2)


def test_rolling_excludes_current_row(panel):
    rows = features.rolling_features(panel.filter("series_id = 'A'"), windows=(3,), metrics=("mean",)).orderBy("ts").collect()
    assert rows[2].rolling_mean_3 is None
    assert rows[3].rolling_mean_3 == pytest.approx(np.mean([r.y for r in rows[:3]]))
    with pytest.raises(ValueError):
        features.rolling_columns(shift=0)
    with pytest.raises(ValueError):
        features.lag_columns([0])


def test_matrix_shape_and_no_leakage(panel):
    a = panel.filter("series_id = 'A'")
    m = features.feature_matrix(a)
    names = features.feature_names()
    assert len(names) == 17 and m.count() == 48
    changed = a.withColumn("y", F.when(F.col("ts") >= "2020-06-01", 1e6).otherwise(F.col("y")))
    until = "ts <= '2020-06-01'"
    same = m.filter(until).select("ts", *names).exceptAll(features.feature_matrix(changed).filter(until).select("ts", *names))
    assert same.count() == 0


def test_next_step_equals_matrix_row(panel):
    whole = features.feature_matrix(panel).filter("ts = '2020-12-01'").orderBy("series_id").toPandas()
    step = features.next_step_features(splits.pack(panel.filter("ts < '2020-12-01'"))).orderBy("series_id").toPandas()
    names = features.feature_names()
    assert np.allclose(whole[names].astype(float), step[names].astype(float))


def test_calendar_flags(spark):
    df = spark.createDataFrame(monthly(12, start="2020-01-01"), "series_id string, ts date, y double")
    rows = features.calendar_features(df).collect()
    assert [r.month for r in rows if r.is_summer] == [6, 7] and [r.month for r in rows if r.is_winter_holiday] == [1, 12]


def test_sequence_samples(spark):
    df = spark.createDataFrame(monthly(40), "series_id string, ts date, y double")
    assert features.sequence_windows(df).count() == 17


def test_gap_fill(spark):
    y = [None, 1.0, None, 3.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "series_id string, ts int, y double")
    assert [r.y_filled for r in transforms.fill_gaps(df).orderBy("ts").collect()] == [1, 1, 2, 3, 3]


def test_percentiles_of_one_hot_group(spark):
    rng = np.random.default_rng(0)
    hot = np.r_[np.full(4000, 7.5), rng.normal(0, 50, 6000)]
    df = spark.createDataFrame(pd.DataFrame({"k": ["hot"] * 10000 + ["tiny"], "v": np.r_[hot, 3.0]}))
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    assert np.allclose(got["hot"].q, np.quantile(hot, probs)) and got["hot"].n == 10000
    assert got["tiny"].q == [3.0] * 5
