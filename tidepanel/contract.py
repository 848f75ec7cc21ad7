"""Names shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES, TS, VALUE, PEAK = "series_id", "ts", "y", "peak"
HORIZON, SEASON = 12, 12

# Canonical columns of a published panel, in order.
CANONICAL_COLUMNS = ("Game_Name", "Month_Year", "Avg_players", "Peak_Players", "Gain", "Percent_Gain")
PANEL_COLUMNS = ("series_id", "ts", "y", "peak", "gain", "pct_gain")

# Fixed values: (model, paradigm) in report order.
MODEL_PARADIGMS = (
    ("Naive", "Naive Baseline"),
    ("Seasonal Naive", "Seasonal Baseline"),
    ("Holt-Winters", "Exponential Smoothing"),
    ("ARIMA(1,1,1)", "Econometric Baseline"),
    ("SARIMA", "Econometric"),
    ("Ridge", "Linear ML"),
    ("Random Forest", "Tree Ensemble ML"),
    ("XGBoost", "Gradient Boosted ML"),
    ("RNN", "Recurrent DL Baseline"),
    ("LSTM", "Recurrent DL"),
    ("GRU", "Recurrent DL"),
)

# Models beyond the report list.
OWN_PARADIGMS = (
    ("Mean", "Naive Baseline"),
    ("AR(1)", "Econometric Baseline"),
    ("Log + SARIMA", "Econometric"),
    ("Holt-Winters (Damped)", "Exponential Smoothing"),
    ("Direct Linear", "Direct Multi-step"),
    ("Direct Boosted", "Direct Multi-step"),
)


def in_time(*keys: str) -> WindowSpec:
    """Window over one series (or one series and fold) in time order.

    A panel is unique on its keys and period, so a partition never holds more
    rows than the calendar has periods, whatever the size of the source table.
    """
    return Window.partitionBy(*(keys or (SERIES,))).orderBy(TS)


def steps(n: int) -> Column:
    """Array 1..n; the horizon is a parameter, never data."""
    return F.sequence(F.lit(1), F.lit(n))


def add_periods(ts: Column, k: Column, freq: str = "month") -> Column:
    """Move a period start by ``k`` periods."""
    if freq == "month":
        return F.add_months(ts, k.cast("int"))
    if freq == "day":
        return F.date_add(ts, k.cast("int"))
    if freq == "hour":
        return ts + F.make_dt_interval(hours=k.cast("int"))
    raise ValueError(f"unknown frequency {freq!r}")


def period_step(freq: str) -> Column:
    """Interval literal of one period, for ``sequence``."""
    if freq not in ("month", "day", "hour"):
        raise ValueError(f"unknown frequency {freq!r}")
    return F.expr(f"interval 1 {freq}")


def paradigm_of(model: Column) -> Column:
    """Paradigm label of a model name; unknown models keep their own name."""
    pairs = [F.lit(x) for pair in MODEL_PARADIGMS + OWN_PARADIGMS for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), model), model)
