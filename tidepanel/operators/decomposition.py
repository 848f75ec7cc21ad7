"""Seasonal decomposition: moving-average and loess based (STL)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import SEASON, in_time
from tidepanel.operators.splits import pack
from tidepanel.operators.transforms import fill_gaps

# Ship this module's functions with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def classical(panel: DataFrame, period: int = SEASON, model: str = "additive") -> DataFrame:
    """Trend by centred moving average, seasonal by normalised phase means, remainder.

    Needs two full periods; trend and remainder are null at both ends.  Gaps in ``y``
    are interpolated first, so every value keeps its phase.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    add = model == "additive"
    whole = Window.partitionBy("series_id")
    reach = period // 2
    frame = in_time().rowsBetween(-reach, reach)
    whole_y = fill_gaps(panel).withColumn("y", F.col("y_filled")).drop("y_filled").filter(F.col("y").isNotNull())
    p = whole_y.withColumn("pos", F.row_number().over(in_time())).withColumn("_n", F.count(F.lit(1)).over(whole))
    p = p.filter(F.col("_n") >= 2 * period)
    total = F.sum("y").over(frame)
    if period % 2 == 0:
        total = total - 0.5 * (F.lag("y", reach).over(in_time()) + F.lead("y", reach).over(in_time()))
    p = p.withColumn("trend", F.when(F.count("y").over(frame) == 2 * reach + 1, total / period))
    p = p.withColumn("_phase", F.pmod(F.col("pos") - 1, F.lit(period)))
    loose = F.col("y") - F.col("trend") if add else F.col("y") / F.col("trend")
    p = p.withColumn("_mean", F.avg(loose).over(Window.partitionBy("series_id", "_phase")))
    level = F.avg(F.when(F.col("pos") <= period, F.col("_mean"))).over(whole)
    p = p.withColumn("seasonal", F.col("_mean") - level if add else F.col("_mean") / level)
    left = F.col("y") - F.col("trend") - F.col("seasonal") if add else F.col("y") / (F.col("trend") * F.col("seasonal"))
    return p.withColumn("resid", left).drop("_n", "_phase", "_mean")


# --- STL -------------------------------------------------------------------------------------

def _odd_above(x: float) -> int:
    """Smallest odd integer that is not below ``x``."""
    i = int(-(-x // 1))
    return i if i % 2 else i + 1


def _loess_matrix(n: int, q: int, points: np.ndarray) -> np.ndarray:
    """Weights of a local linear fit with ``q`` nearest neighbours: one row per evaluation point.

    They depend on positions only, so one matrix smooths every series of a length.
    """
    out = np.zeros((len(points), n))
    for r, x in enumerate(points):
        left = int(np.clip(x - (q - 1) // 2, 0, max(n - q, 0)))
        j = np.arange(left, min(left + q, n))
        reach = float(max(x - j[0], j[-1] - x) + max(q - n, 0) // 2)
        d = np.abs(j - x)
        w = (1 - (d / reach) ** 3) ** 3
        w[d > 0.999 * reach], w[d <= 0.001 * reach] = 0.0, 1.0
        w /= w.sum()
        centre = w @ j
        spread = w @ (j - centre) ** 2
        if np.sqrt(spread) > 0.001 * (n - 1):
            w = w * (1 + (x - centre) / spread * (j - centre))
        out[r, j] = w
    return out


def _moving_average(v: np.ndarray, width: int) -> np.ndarray:
    c = np.cumsum(np.pad(v, ((0, 0), (1, 0))), axis=1)
    return (c[:, width:] - c[:, :-width]) / width


def _stl_block(y: np.ndarray, period: int, seasonal: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of many series of equal length (rows of ``y``)."""
    n = y.shape[1]
    trend_q, low_q = _odd_above(1.5 * period / (1 - 1.5 / seasonal)), _odd_above(period + 1)
    every = np.arange(n)
    to_low, to_trend = _loess_matrix(n, low_q, every).T, _loess_matrix(n, trend_q, every).T
    sizes = {len(range(p, n, period)) for p in range(period)}
    # Each phase is smoothed one period beyond both ends.
    to_phase = {m: _loess_matrix(m, seasonal, np.arange(-1, m + 1)).T for m in sizes}
    trend, season = np.zeros_like(y), np.zeros_like(y)
    for _ in range(inner):
        loose = y - trend
        wide = np.empty((len(y), n + 2 * period))
        for p in range(period):
            phase = loose[:, p::period]
            wide[:, p::period] = phase @ to_phase[phase.shape[1]]
        low = _moving_average(_moving_average(_moving_average(wide, period), period), 3) @ to_low
        season = wide[:, period:period + n] - low
        trend = (y - season) @ to_trend
    return trend, season


def stl(packed: DataFrame, period: int = SEASON, seasonal: int = 13, inner: int = 2) -> DataFrame:
    """Seasonal-trend decomposition by loess of packed series (``ys``, ``dates``).

    Two inner passes, degree 1, no robustness pass; a series needs two full
    periods.  Loess without robustness weights is linear, so a batch of series of
    equal length is a few matrix products.
    """
    parts = T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in ("trend", "seasonal")])

    @F.pandas_udf(parts)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"trend": [None] * len(batch), "seasonal": [None] * len(batch)}, dtype=object)
            for _, group in batch.groupby(batch.map(len)):
                y = np.stack(group.to_list()).astype(float)
                trend, season = _stl_block(y, period, seasonal, inner)
                for i, t, s in zip(batch.index.get_indexer(group.index), trend, season):
                    out.iat[i, 0], out.iat[i, 1] = t, s
            yield out

    base = packed.filter(F.size("ys") >= 2 * period).withColumn("_d", run.asNondeterministic()("ys"))
    zipped = F.arrays_zip(
        F.col("dates").alias("ts"), F.col("ys").alias("y"), F.col("_d.trend").alias("trend"), F.col("_d.seasonal").alias("seasonal")
    )
    rows = base.select("series_id", F.explode(zipped).alias("s"))
    resid = F.col("s.y") - F.col("s.trend") - F.col("s.seasonal")
    return rows.select("series_id", "s.ts", "s.y", "s.trend", "s.seasonal", resid.alias("resid"))


def stl_panel(panel: DataFrame, period: int = SEASON, seasonal: int = 13, inner: int = 2) -> DataFrame:
    """``stl`` of a long panel; gaps in ``y`` are interpolated first, so every value keeps its phase."""
    whole = fill_gaps(panel).select("series_id", "ts", F.col("y_filled").alias("y"))
    return stl(pack(whole), period, seasonal, inner)
