"""Leak-free features from window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import add_periods, in_time

LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)
METRICS = ("mean", "std")
CALENDAR = ("month", "quarter", "month_sin", "month_cos", "is_summer", "is_winter_holiday")
AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "var": F.var_samp}


def lag_columns(lags: Sequence[int] = LAGS, keys: Sequence[str] = ("series_id",)) -> dict[str, Column]:
    if any(k < 1 for k in lags):
        raise ValueError("lags must be at least 1")
    return {f"lag_{k}": F.lag("y", k).over(in_time(*keys)) for k in lags}


def rolling_columns(
    windows: Sequence[int] = WINDOWS,
    metrics: Sequence[str] = METRICS,
    shift: int = 1,
    min_periods: int | None = None,
    keys: Sequence[str] = ("series_id",),
) -> dict[str, Column]:
    """Moments of the ``w`` rows that end ``shift`` rows before the current one."""
    if shift < 1:
        raise ValueError("shift must be at least 1, or the row would see itself")
    if any(w < 2 for w in windows):
        raise ValueError("windows must span at least 2 rows")
    out = {}
    for w in windows:
        frame = in_time(*keys).rowsBetween(-(w + shift - 1), -shift)
        enough = F.count("y").over(frame) >= (min_periods or w)
        for m in metrics:
            out[f"rolling_{m}_{w}"] = F.when(enough, AGGREGATES[m]("y").over(frame))
    return out


def calendar_of(ts: Column) -> dict[str, Column]:
    """Fixed rules: summer is June and July, winter is December and January."""
    month = F.month(ts)
    angle = 2 * F.pi() * month / 12
    return {
        "month": month,
        "quarter": F.quarter(ts),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "is_summer": month.isin(6, 7).cast("int"),
        "is_winter_holiday": month.isin(12, 1).cast("int"),
    }


def _add(panel: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return panel.select("*", *[c.alias(name) for name, c in columns.items()])


def lag_features(panel: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    return _add(panel, lag_columns(lags))


def rolling_features(panel: DataFrame, **options) -> DataFrame:
    return _add(panel, rolling_columns(**options))


def rolling_stats(panel: DataFrame, windows: Sequence[int] = (6, 12)) -> DataFrame:
    """Mean, deviation and variance of the last ``w`` rows including the current one."""
    out = {}
    for w in windows:
        frame = in_time().rowsBetween(-(w - 1), 0)
        for m in ("mean", "std", "var"):
            out[f"{m}_{w}"] = AGGREGATES[m]("y").over(frame)
    return _add(panel, out)


def calendar_features(panel: DataFrame) -> DataFrame:
    return _add(panel, calendar_of(F.col("ts")))


def feature_names(
    lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, metrics: Sequence[str] = METRICS
) -> list[str]:
    return [f"lag_{k}" for k in lags] + [f"rolling_{m}_{w}" for w in windows for m in metrics] + list(CALENDAR)


def feature_matrix(
    panel: DataFrame,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    metrics: Sequence[str] = METRICS,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """All features next to ``y``; rows with a null feature are dropped.

    Lags and frames share one window specification, so this costs one sort.
    """
    made = _add(
        panel,
        {
            **lag_columns(lags, keys),
            **rolling_columns(windows, metrics, keys=keys),
            **calendar_of(F.col("ts")),
        },
    )
    return made.dropna(subset=feature_names(lags, windows, metrics))


def _moments(values: Column, start: Column, width: int, shift: Column) -> dict[str, Column]:
    """Mean and sample variance of ``width`` values from one pass, taken around ``shift`` for accuracy."""
    sums = F.aggregate(
        F.slice(values, start, F.lit(width)),
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct(
            (a["s"] + (x - shift)).alias("s"), (a["q"] + (x - shift) * (x - shift)).alias("q")
        ),
        lambda a: F.struct(
            (shift + a["s"] / width).alias("mean"),
            F.greatest((a["q"] - a["s"] * a["s"] / width) / (width - 1), F.lit(0.0)).alias("var"),
        ),
    )
    return {"mean": sums["mean"], "var": sums["var"], "std": F.sqrt(sums["var"])}


def step_columns(
    values: Column,
    t: Column,
    step_ts: Column,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    metrics: Sequence[str] = METRICS,
) -> dict[str, Column]:
    """Features of position ``t`` (1-based) from the values before it, named as in ``feature_matrix``.

    ``t`` may be one past the end of the array: the next period.  Null when fewer
    values precede ``t`` than the longest lag or window.
    """
    enough = t > max(*lags, *windows)
    out = {f"lag_{k}": F.when(enough, F.element_at(values, (t - k).cast("int"))) for k in lags}
    for w in windows:
        start = F.greatest(t - w, F.lit(1)).cast("int")
        tail = F.slice(values, start, F.lit(w))
        made = _moments(values, start, w, F.element_at(values, (t - 1).cast("int")))
        made.update({"min": F.array_min(tail), "max": F.array_max(tail)})
        for m in metrics:
            out[f"rolling_{m}_{w}"] = F.when(enough, made[m])
    out.update(calendar_of(step_ts))
    return out


def step_vector(values: Column, t: Column, step_ts: Column, **options) -> Column:
    """The features of ``step_columns`` as one array in ``feature_names`` order."""
    return F.array(*[c.cast("double") for c in step_columns(values, t, step_ts, **options).values()])


def next_step_features(packed: DataFrame, freq: str = "month") -> DataFrame:
    """One feature row per series for the first unseen period (input of ``splits.pack``)."""
    step_ts = add_periods(F.element_at("dates", -1), F.lit(1), freq)
    frame = packed.select("series_id", step_ts.alias("ts"), "ys")
    return _add(frame, step_columns(F.col("ys"), F.size("ys") + 1, F.col("ts"))).drop("ys")


def sequence_windows(panel: DataFrame, past: int = 12, ahead: int = 12, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Supervised samples: the last ``past`` values and the ``ahead`` values that follow."""
    w = in_time(*keys)
    x = F.collect_list("y").over(w.rowsBetween(-(past - 1), 0))
    y = F.collect_list("y").over(w.rowsBetween(1, ahead))
    made = panel.select(*keys, "ts", x.alias("x"), y.alias("y_next"))
    return made.filter((F.size("x") == past) & (F.size("y_next") == ahead))
