"""Least squares from sums of products: Spark reduces a series to a k x k matrix, numpy factors the matrices of a batch.

What reaches Python does not grow with the series. Columns are centred or scaled before, where the statistic allows it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.stats import array_sum

# Ship this module's functions with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT_ROOT = T.StructType().add("lags_used", T.IntegerType()).add("n_obs", T.IntegerType()).add("statistic", T.DoubleType())


def products(columns: Column) -> Column:
    """Upper triangle, row by row, of the products of equally long columns (an array of arrays)."""
    dot = lambda a, b: array_sum(F.zip_with(a, b, lambda x, y: x * y))
    size = F.size(columns)
    return F.flatten(F.transform(columns, lambda a, i: F.transform(F.slice(columns, i + 1, size - i), lambda b: dot(a, b))))


def matrices(flat: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, symmetric matrices) of each size in a batch of triangles; null, empty and non-finite ones are left out."""
    sizes = flat.map(lambda v: 0 if v is None else len(v)).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        k = int((np.sqrt(8 * size + 1) - 1) / 2)
        at = np.flatnonzero(sizes == size)
        upper = np.vstack([np.asarray(v, dtype=float) for v in flat.iloc[at]])
        sane = np.isfinite(upper).all(axis=1)
        out = np.zeros((int(sane.sum()), k, k))
        rows, cols = np.triu_indices(k)
        out[:, rows, cols] = out[:, cols, rows] = upper[sane]
        yield at[sane], out


def factors(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which matrices are positive definite, and their Cholesky factors."""
    scale = np.sqrt(np.maximum(np.einsum("rii->ri", gram), 1e-300))
    unit = gram / scale[:, :, None] / scale[:, None, :]
    good = np.linalg.eigvalsh(unit)[:, 0] > 1e-13
    return good, np.linalg.cholesky(unit[good]) * scale[good][:, :, None]


def nested_orders(gram: np.ndarray, base: int, n: np.ndarray) -> np.ndarray:
    """Columns beyond the first ``base`` with the least AIC for each matrix, whose last column is the target; -1 for none.

    The leading blocks of one factor solve all nested designs: each column takes z**2 off the sum of squares.
    """
    out = np.full(len(gram), -1)
    good, low = factors(gram[:, :-1, :-1])
    z = np.linalg.solve(low, gram[good][:, :-1, -1:])[:, :, 0]
    sse = gram[good][:, -1, -1:] - np.cumsum(z * z, axis=1)[:, base - 1 :]
    m = n[good].astype(float)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        aic = m * np.log(sse / m) + 2 * np.arange(base, base + sse.shape[1])
    sane = np.isfinite(aic)
    out[good] = np.where(sane.any(axis=1), np.argmin(np.where(sane, aic, np.inf), axis=1), -1)
    return out


def coefficient(gram: np.ndarray, which: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficient ``which`` of each system and its standard error; NaN where it has none."""
    beta, se = np.full(len(gram), np.nan), np.full(len(gram), np.nan)
    good, low = factors(gram[:, :-1, :-1])
    if good.any():
        z = np.linalg.solve(low, gram[good][:, :-1, -1:])[:, :, 0]
        inverse = np.linalg.inv(low)
        beta[good] = np.einsum("rj,rj->r", inverse[:, :, which], z)
        sse = gram[good][:, -1, -1] - (z**2).sum(axis=1)
        dof = n[good].astype(float) - low.shape[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            se[good] = np.sqrt(np.where(dof > 0, sse / dof, np.nan) * (inverse[:, :, which] ** 2).sum(axis=1))
    return beta, se


def early_rows(heads: np.ndarray, used: int, top: int) -> np.ndarray:
    """Rows 1, y[t-1], dy[t-1], ..., dy[t-used], dy[t] of the periods from used + 2 to top + 1, which a shorter lag adds."""
    d = np.diff(heads, axis=1)
    rows = [
        np.column_stack([np.ones(len(heads)), heads[:, t - 2], *(d[:, t - 2 - k] for k in range(1, used + 1)), d[:, t - 2]])
        for t in range(used + 2, top + 2)
    ]
    return np.stack(rows, axis=1) if rows else np.zeros((len(heads), 0, used + 3))


@F.pandas_udf(UNIT_ROOT)
def _unit_root(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for flat, _, head, length in batches:
        made = np.full((len(flat), 3), np.nan)
        for at, whole in matrices(flat):
            top = whole.shape[1] - 3
            n = length.iloc[at].to_numpy()
            best = nested_orders(whole, 2, n - top - 1)
            for used in np.unique(best[best >= 0]):
                mine = np.flatnonzero(best == used)
                heads = np.vstack([np.asarray(head.iloc[i], dtype=float) for i in at[mine]])
                early = early_rows(heads, used, top)
                keep = np.r_[0 : used + 2, top + 2]
                own = whole[mine][:, keep][:, :, keep] + np.einsum("rti,rtj->rij", early, early)
                beta, se = coefficient(own, 1, n[mine] - used - 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    made[at[mine]] = np.column_stack([np.full(len(mine), used), n[mine] - used - 1, beta / se])
        out = {"lags_used": made[:, 0], "n_obs": made[:, 1], "statistic": made[:, 2]}
        whole_number = lambda v: [None if np.isnan(x) else int(x) for x in v]
        yield pd.DataFrame({
            "lags_used": pd.Series(whole_number(out["lags_used"]), dtype=object), "n_obs": pd.Series(whole_number(out["n_obs"]), dtype=object),
            "statistic": pd.Series([x if np.isfinite(x) else None for x in out["statistic"]], dtype=object),
        })


def unit_root(triangle: Column, head: Column, n: Column) -> Column:
    """``struct(lags_used, n_obs, statistic)`` of a Dickey-Fuller regression from the products of its largest design.

    The columns are 1, y[t-1], dy[t-1] to dy[t-top], and dy[t]; ``head`` has the first top + 1 values.  The triangle is
    read twice, so Spark evaluates it before the Python step instead of inside it.
    """
    return _unit_root.asNondeterministic()(triangle, F.size(triangle), head, n)
