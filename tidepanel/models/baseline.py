"""Naive forecasters and simple shared helpers, as expressions on a packed ``train`` array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.stats import array_mean


def _check(horizon: int) -> None:
    if horizon < 1:
        raise ValueError("horizon must be at least 1")


def naive(train: Column, horizon: int) -> Column:
    """Last value, repeated."""
    _check(horizon)
    return F.when(F.size(train) >= 1, F.array_repeat(F.try_element_at(train, F.lit(-1)), horizon))


def mean(train: Column, horizon: int) -> Column:
    """Training mean, repeated."""
    _check(horizon)
    return F.when(F.size(train) >= 1, F.array_repeat(array_mean(train), horizon))


def seasonal_naive(train: Column, horizon: int, season: int = 12) -> Column:
    """The last season, repeated; null for series shorter than a season."""
    _check(horizon)
    if season < 2:
        raise ValueError("a season has at least 2 periods")
    start = F.size(train) - season + 1
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    return F.when(F.size(train) >= season, F.transform(steps, lambda h: F.element_at(train, start + F.pmod(h, F.lit(season)))))


def naive_fitted(train: Column) -> Column:
    """One-step fitted values: the previous value, the first value for the first step."""
    return F.concat(F.slice(train, 1, 1), F.slice(train, F.lit(1), F.size(train) - 1))


def mean_fitted(train: Column) -> Column:
    return F.array_repeat(array_mean(train), F.size(train))


def seasonal_naive_fitted(train: Column, season: int = 12) -> Column:
    """The value one season earlier; null for the first season."""
    blank = F.array_repeat(F.lit(None).cast("double"), season)
    return F.when(F.size(train) >= season, F.concat(blank, F.slice(train, F.lit(1), F.size(train) - season)))
