"""Forecasts beyond the last observed period."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON, SEASON, add_periods
from tidepanel.models.registry import Forecaster, add_forecasts
from tidepanel.operators.splits import pack, seasonal_scale, spread


def whole_history(panel: DataFrame, season: int = SEASON) -> DataFrame:
    """Packed frame whose ``train`` is everything observed."""
    packed = pack(panel).withColumnRenamed("ys", "train").withColumnRenamed("dates", "train_dates")
    return spread(packed.withColumn("scale", seasonal_scale(F.col("train"), season)), "series_id")


def forecast(
    panel: DataFrame,
    forecasters: Mapping[str, Forecaster],
    horizon: int = HORIZON,
    freq: str = "month",
    season: int = SEASON,
) -> DataFrame:
    """Long table ``series_id, model, h, ts, yhat`` for the next ``horizon`` periods.

    Dates follow the panel frequency; a refused series has no rows for that model.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    wide, columns = add_forecasts(whole_history(panel, season), dict(forecasters))
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat")) for m, c in columns.items()]
    rows = wide.select("series_id", F.element_at("train_dates", -1).alias("_last"), F.explode(F.array(*entries)).alias("m"))
    rows = rows.filter(F.col("m.yhat").isNotNull()).select(
        "series_id", "m.model", "_last", F.posexplode("m.yhat").alias("_i", "yhat")
    )
    h = F.col("_i") + 1
    return rows.select("series_id", "model", h.alias("h"), add_periods(F.col("_last"), h, freq).alias("ts"), "yhat")
