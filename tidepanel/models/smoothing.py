"""Exponential smoothing by grid search, many series and all grid points at a time.

The recursion runs along time; numpy advances every (series, grid point) lane of
an Arrow batch together.  A JVM fold over the same grid does one lane at a time.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import HORIZON, SEASON

# Ship this module's functions with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOUBLES = T.ArrayType(T.DoubleType())
FIT = T.StructType([
    T.StructField(name, DOUBLES if name in ("yhat", "fitted") else T.DoubleType())
    for name in ("yhat", "sse", "alpha", "beta", "gamma", "phi", "fitted", "aic", "bic")
])
# Coarse grid, its refinement and the damping factors.
COARSE = (0.1, 0.3, 0.5, 0.7, 0.9)
REFINE = (-0.08, -0.04, 0.0, 0.04, 0.08)
DAMPING = (0.8, 0.9, 0.98)
MAX_LANES = 400_000


def _grid(values, use_trend: bool, use_season: bool, damped: bool) -> np.ndarray:
    axes = [values, values if use_trend else (0.0,), values if use_season else (0.0,), DAMPING if damped else (1.0,)]
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")])


def _smooth(y: np.ndarray, grid: np.ndarray, trend, seasonal, m: int, horizon: int):
    """Run all lanes: ``y`` is (series, time), ``grid`` (4, series, lanes). Returns sse, forecast, fitted."""
    a, b, g, phi = grid
    shape = a.shape
    if seasonal:
        level = np.broadcast_to(y[:, :m].mean(axis=1)[:, None], shape).copy()
        slope = (y[:, m:2 * m].sum(axis=1) - y[:, :m].sum(axis=1)) / m**2
        season = y[:, :m] - level[:, :1] if seasonal == "add" else y[:, :m] / level[:, :1]
        season = np.broadcast_to(season.T[:, :, None], (m, *shape)).copy()
        start = m
    else:
        level = np.broadcast_to(y[:, :1], shape).copy()
        slope, season, start = y[:, 1] - y[:, 0], None, 1
    if trend == "mul":
        slope = 1 + slope / level[:, 0]
    slope = np.broadcast_to(slope[:, None], shape).copy()
    sse = np.zeros(shape)
    fitted = np.full((y.shape[1], *shape), np.nan)

    def carried(lv, sl):
        if trend == "add":
            return lv + phi * sl
        if trend == "mul":
            return lv * sl**phi
        return lv

    with np.errstate(all="ignore"):
        for t in range(start, y.shape[1]):
            base = carried(level, slope)
            s = season[t % m] if seasonal else None
            fit = base + s if seasonal == "add" else base * s if seasonal else base
            obs = y[:, t][:, None]
            fitted[t] = fit
            sse += (obs - fit) ** 2
            plain = obs - s if seasonal == "add" else obs / s if seasonal else obs
            new = a * plain + (1 - a) * base
            if seasonal == "add":
                season[t % m] = g * (obs - base) + (1 - g) * s
            elif seasonal:
                season[t % m] = g * (obs / base) + (1 - g) * s
            if trend == "add":
                slope = b * (new - level) + (1 - b) * phi * slope
            elif trend == "mul":
                slope = b * (new / level) + (1 - b) * slope**phi
            level = new
        out, n = [], y.shape[1]
        for h in range(horizon):
            level = carried(level, slope)
            slope = phi * slope if trend == "add" else slope**phi if trend == "mul" else slope
            s = season[(n + h) % m] if seasonal else None
            out.append(level + s if seasonal == "add" else level * s if seasonal else level)
    return sse, np.stack(out), fitted


def _fit_block(y: np.ndarray, trend, seasonal, damped: bool, m: int, horizon: int) -> list[tuple]:
    """Coarse grid, then a finer one around each series' own winner."""
    rows = np.arange(len(y))
    coarse = _grid(COARSE, bool(trend), bool(seasonal), damped)
    lanes = np.repeat(coarse[:, None, :], len(y), axis=1)
    sse, _, _ = _smooth(y, lanes, trend, seasonal, m, horizon)
    best = coarse[:, np.where(np.isfinite(sse), sse, np.inf).argmin(axis=1)]
    near = _grid(REFINE, bool(trend), bool(seasonal), False)
    near[3] = 0.0
    lanes = best[:, :, None] + near[:, None, :]
    sse, ahead, fitted = _smooth(y, lanes, trend, seasonal, m, horizon)
    win = np.where(np.isfinite(sse), sse, np.inf).argmin(axis=1)
    start = m if seasonal else 1
    n = y.shape[1] - start
    k = 1 + 2 * bool(trend) + (1 + m) * bool(seasonal) + bool(damped) + 1
    out = []
    for i, j in zip(rows, win):
        if not np.isfinite(sse[i, j]) or not np.isfinite(ahead[:, i, j]).all():
            out.append((None,) * 9)
            continue
        one = fitted[:, i, j]
        base = n * np.log(max(sse[i, j], 1e-300) / n)
        out.append((
            ahead[:, i, j], float(sse[i, j]), *map(float, lanes[:, i, j]),
            [None if np.isnan(v) else float(v) for v in one], float(base + 2 * k), float(base + k * np.log(n)),
        ))
    return out


def holt_winters(
    train: Column,
    horizon: int = HORIZON,
    trend: str | None = "add",
    seasonal: str | None = "add",
    damped: bool = False,
    season: int = SEASON,
) -> Column:
    """Best smoothing of the grid as ``struct(yhat, sse, alpha, beta, gamma, phi, fitted, aic, bic)``.

    Null for series shorter than two seasons (four values without a season), and
    for multiplicative forms of series that reach zero.  ``trend=None`` and
    ``seasonal=None`` give Holt's linear method and simple smoothing.
    """
    for kind in (trend, seasonal):
        if kind not in ("add", "mul", None):
            raise ValueError(f"unknown component {kind!r}")
    if damped and trend is None:
        raise ValueError("only a trend can be damped")
    need = 2 * season if seasonal else 4
    positive = "mul" in (trend, seasonal)

    # Not over an iterator: forms in one ``select`` then share a Python worker.
    @F.pandas_udf(FIT)
    def fit(batch: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None,) * 9] * len(batch)
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(batch):
            if v is not None and len(v) >= need:
                y = np.asarray(v, dtype=float)
                if np.isfinite(y).all() and not (positive and y.min() <= 0):
                    by_length.setdefault(len(y), []).append(i)
        for length, places in by_length.items():
            # The fitted path of every lane is held, so blocks are sized by lanes x time.
            size = max(1, MAX_LANES // (125 * (3 if damped else 1) * max(1, length // 50)))
            for lo in range(0, len(places), size):
                part = places[lo:lo + size]
                y = np.stack([np.asarray(batch.iloc[i], dtype=float) for i in part])
                for i, row in zip(part, _fit_block(y, trend, seasonal, damped, season, horizon)):
                    out[i] = row
        return pd.DataFrame(out, columns=FIT.names)

    # Not inlined by the optimizer: each series is smoothed once however often the fit is read.
    return fit.asNondeterministic()(train)
