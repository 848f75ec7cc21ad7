"""Trained tree ensembles as flat arrays, evaluated over Arrow batches.

A forecast of H steps feeds each step's value into the next step's features. With the trees as arrays a task does all
steps of its series, for all ensembles, in one pass; the arrays are bounded by trees and depth and travel as a broadcast.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import add_periods, steps
from tidepanel.operators.features import LAGS, METRICS, WINDOWS, calendar_of

# Ship this module's functions with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH_OF_HISTORY = max(*LAGS, *WINDOWS)
_TREE = re.compile(r"\s*Tree (\d+) \(weight (\S+)\):")
_SPLIT = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


class Ensemble:
    """Nodes of all trees in one table; a leaf points to itself."""

    def __init__(self, trees: Sequence[tuple[float, list[tuple]]], mean: bool) -> None:
        """``trees``: weight and nodes (feature, threshold, left, right, value), the root first; children by position."""
        sizes = [len(nodes) for _, nodes in trees]
        self.roots = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        shifted = [(f, t, a + r, b + r, v) for (_, nodes), r in zip(trees, self.roots) for f, t, a, b, v in nodes]
        feature, threshold, left, right, value = zip(*shifted)
        self.feature, self.threshold = np.array(feature, dtype=np.int64), np.array(threshold, dtype=float)
        self.left, self.right, self.value = np.array(left), np.array(right), np.array(value, dtype=float)
        self.weights = np.array([w for w, _ in trees]) / (len(trees) if mean else 1)
        self.depth = max(self._depth(r) for r in self.roots)

    def _depth(self, root: int) -> int:
        level, depth = [root], 0
        while level := [c for n in level if self.left[n] != n for c in (self.left[n], self.right[n])]:
            depth += 1
        return depth

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of feature rows."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.value[at] @ self.weights


def parsed_trees(text: str) -> list[tuple[float, list[tuple]]]:
    """Weights and nodes of the trees in the model's own description, whose numbers are exact."""
    trees: list[tuple[float, list[tuple]]] = []
    open_nodes: list[int] = []

    def attach(nodes: list, new: int) -> None:
        """The node is the left child of the last open split, or its right one if it has a left one."""
        if open_nodes:
            f, t, a, _, v = nodes[open_nodes[-1]]
            if a is None:
                nodes[open_nodes[-1]] = (f, t, new, None, v)
            else:
                nodes[open_nodes.pop()] = (f, t, a, new, v)

    for line in text.splitlines():
        if found := _TREE.match(line):
            trees.append((float(found[2]), []))
            open_nodes = []
        elif found := _SPLIT.match(line):
            nodes = trees[-1][1]
            attach(nodes, len(nodes))
            nodes.append((int(found[1]), float(found[2]), None, None, 0.0))
            open_nodes.append(len(nodes) - 1)
        elif found := _LEAF.match(line):
            nodes = trees[-1][1]
            attach(nodes, len(nodes))
            nodes.append((0, np.inf, len(nodes), len(nodes), float(found[1])))
        elif " in {" in line:
            raise ValueError("categorical splits are not part of the feature rows")
    return trees


def is_tree_model(model) -> bool:
    return hasattr(model, "trees") and hasattr(model, "treeWeights")


def ensemble(model) -> Ensemble:
    """The arrays of an MLlib forest (mean of its trees) or boosted ensemble (weighted sum)."""
    return Ensemble(parsed_trees(model.toDebugString), mean="RandomForest" in type(model).__name__)


def feature_rows(seen: np.ndarray, calendar: np.ndarray) -> np.ndarray:
    """``features.step_vector`` of the period after the last column of ``seen``, with the same order of sums."""
    last = seen[:, -1]
    columns = [seen[:, -k] for k in LAGS]
    for w in WINDOWS:
        s, q = np.zeros(len(seen)), np.zeros(len(seen))
        for j in range(w, 0, -1):
            d = seen[:, -j] - last
            s, q = s + d, q + d * d
        made = {"mean": last + s / w, "std": np.sqrt(np.maximum((q - s * s / w) / (w - 1), 0.0))}
        columns += [made[m] for m in METRICS]
    return np.column_stack([*columns, calendar])


def roll(model: Ensemble, tails: np.ndarray, calendars: np.ndarray) -> np.ndarray:
    """Recursive forecasts of series (rows) from their last values and the calendar features of the steps."""
    seen = tails
    for h in range(calendars.shape[1]):
        made = model.predict(feature_rows(seen[:, -DEPTH_OF_HISTORY:], calendars[:, h]))
        seen = np.column_stack([seen, made])
    return seen[:, tails.shape[1] :]


def history_tail(values: Column) -> Column:
    return F.slice(values, -DEPTH_OF_HISTORY, DEPTH_OF_HISTORY)


def step_calendars(last: Column, horizon: int, freq: str = "month") -> Column:
    """Calendar features of the ``horizon`` periods after ``last``, step after step in one array."""
    each = lambda h: F.array(*[c.cast("double") for c in calendar_of(add_periods(last, h, freq)).values()])
    return F.flatten(F.transform(steps(horizon), each))


def with_rollouts(frame: DataFrame, out: str, models: Mapping[int, Mapping[int, Ensemble]], values: Column, last: Column, horizon: int, group: Column | None = None, freq: str = "month") -> DataFrame:
    """Add ``out``, a map from fit number to its forecast array; ``models`` has the fits of each ``group`` (default 0).

    ``values`` is null for rows that get no forecast. One Python step does all fits and horizons.
    """
    shared = frame.sparkSession.sparkContext.broadcast({g: dict(m) for g, m in models.items()})

    @F.pandas_udf(T.MapType(T.IntegerType(), T.ArrayType(T.DoubleType())))
    def rolled(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tails, calendars, groups in batches:
            out = pd.Series([None] * len(tails), dtype=object)
            usable = tails.notna()
            for g in groups[usable].unique():
                at = np.flatnonzero(usable & (groups == g))
                held = np.vstack([np.asarray(x, dtype=float) for x in tails.iloc[at]])
                dates = np.vstack([np.asarray(x, dtype=float) for x in calendars.iloc[at]]).reshape(len(at), horizon, -1)
                made = {i: roll(m, held, dates) for i, m in shared.value.get(g, {}).items()}
                for row, k in enumerate(at):
                    out.iloc[k] = {i: v[row].tolist() for i, v in made.items()}
            yield out

    tail = F.when(values.isNotNull(), history_tail(values))
    rows = frame.withColumn("_tail", tail).withColumn("_calendar", step_calendars(last, horizon, freq)).withColumn("_group", F.lit(0) if group is None else group.cast("int"))
    return rows.withColumn(out, rolled.asNondeterministic()("_tail", "_calendar", "_group")).drop("_tail", "_calendar", "_group")


def with_fitted(frame: DataFrame, out: str, model: Ensemble, values: Column, dates: Column) -> DataFrame:
    """Add ``out``, the one-step predictions of all training rows in one pass; null for the first rows of a series.

    Every period is predicted from the true values before it.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fitted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(z, calendar):
            if z is None or len(z) <= DEPTH_OF_HISTORY:
                return None
            z, calendar = np.asarray(z, dtype=float), np.asarray(calendar, dtype=float).reshape(len(z), -1)
            past = np.lib.stride_tricks.sliding_window_view(z, DEPTH_OF_HISTORY)[:-1]
            made = shared.value.predict(feature_rows(past, calendar[DEPTH_OF_HISTORY:]))
            return [None] * DEPTH_OF_HISTORY + made.tolist()

        for z, calendar in batches:
            yield pd.Series([one(a, b) for a, b in zip(z, calendar)], dtype=object)

    each = lambda ts: F.array(*[c.cast("double") for c in calendar_of(ts).values()])
    rows = frame.withColumn("_z", values).withColumn("_calendar", F.flatten(F.transform(dates, each)))
    return rows.withColumn(out, fitted.asNondeterministic()("_z", "_calendar")).drop("_z", "_calendar")
