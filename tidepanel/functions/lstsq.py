"""Least squares on small per-row designs: Spark builds the rows, numpy solves them in Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's functions with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOUBLES = T.ArrayType(T.DoubleType())
FIT = (
    T.StructType().add("beta", DOUBLES).add("sse", T.DoubleType()).add("n", T.IntegerType()).add("inv_diag", DOUBLES)
)


def _solve(rows, k: int, alpha: float) -> tuple:
    a = np.vstack([np.asarray(r, dtype=float) for r in rows]) if rows is not None and len(rows) else np.empty((0, k + 1))
    x, y = a[:, :k], a[:, -1]
    if len(a) < (2 if alpha else k) or not np.isfinite(a).all():
        return None, None, len(a), None
    if alpha:
        # Centring leaves the intercept (first column) unpenalised.
        mx, my = x[:, 1:].mean(axis=0), y.mean()
        c = x[:, 1:] - mx
        slope = np.linalg.solve(c.T @ c + alpha * np.eye(k - 1), c.T @ (y - my))
        beta = np.r_[my - mx @ slope, slope]
    else:
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
    resid = y - x @ beta
    return beta, float(resid @ resid), len(a), np.diag(np.linalg.pinv(x.T @ x))


@F.pandas_udf(FIT)
def _least_squares(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    for design, rows, used, alpha in batches:
        fits = [
            _solve(d, int(k), float(a)) if n > 0 else (None, None, 0, None)
            for d, n, k, a in zip(design, rows, used, alpha)
        ]
        yield pd.DataFrame(fits, columns=FIT.names)


# Keeps the optimizer from copying the call into each place that reads the fit,
# so every design is solved once.
_least_squares = _least_squares.asNondeterministic()


def with_fit(frame: DataFrame, out: str, design: Column, used: Column, alpha: float | Column = 0.0) -> DataFrame:
    """Add ``out = struct(beta, sse, n, inv_diag)``: the last entry of each design row on its first ``used`` entries.

    ``alpha`` is a ridge penalty on all but the first coefficient; ``beta`` is null
    when there are too few rows.  The design is a column of its own and read
    twice, so Spark evaluates it before the Python step instead of inside it.
    """
    penalty = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    made = frame.withColumn("_design", design)
    rows = F.coalesce(F.size("_design"), F.lit(0))
    return made.withColumn(out, _least_squares("_design", rows, used.cast("int"), penalty)).drop("_design")


def standard_error(fit: Column, i: int) -> Column:
    """Standard error of coefficient ``i``."""
    dof = fit["n"] - F.size(fit["beta"])
    return F.sqrt(fit["sse"] / F.when(dof > 0, dof) * fit["inv_diag"][i])
