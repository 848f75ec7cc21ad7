"""Autoregressive, ARIMA-type and ridge forecasters on packed arrays.

Regression rows are built and recursions are folded by Spark expressions; only
the small normal equations are solved in ``with_fit``.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON, SEASON, add_periods
from tidepanel.functions.lstsq import with_fit
from tidepanel.functions.stats import array_sum
from tidepanel.models import arma
from tidepanel.operators.features import LAGS, WINDOWS, feature_names, step_vector


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def roll_out(history: Column, horizon: int, predict) -> Column:
    """Recursive forecast: ``predict(values so far, step)`` is appended ``horizon`` times."""
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), history, lambda h, k: F.array_append(h, predict(h, k)))
    return F.slice(grown, F.size(history) + 1, F.lit(horizon))


def information(sse: Column, n: Column, k: Column) -> dict[str, Column]:
    """Gaussian conditional AIC and BIC."""
    base = n * F.ln(sse / n)
    return {"aic": base + 2 * k, "bic": base + k * F.ln(n.cast("double"))}


def _fit_struct(fitted: Column, k: Column) -> Column:
    """Coefficients, errors, information criteria and fitted values of a least-squares fit in ``_fit``."""
    info = information(F.col("_fit.sse"), F.col("_fit.n"), k)
    return F.struct(
        "_fit.beta", "_fit.sse", "_fit.n", info["aic"].alias("aic"), info["bic"].alias("bic"), fitted.alias("fitted")
    )


# --- autoregression --------------------------------------------------------------------------

def _deterministic(t: Column, trend: str, seasonal: bool, period: int) -> list[Column]:
    if trend not in ("n", "c", "t", "ct"):
        raise ValueError(f"unknown trend {trend!r}")
    out = []
    if "c" in trend:
        out.append(F.lit(1.0))
    if "t" in trend:
        out.append(t.cast("double"))
    if seasonal:
        # With a constant one phase is the reference level.
        for phase in range(1 if "c" in trend else 0, period):
            out.append(F.when(F.pmod(t - 1, F.lit(period)) == phase, 1.0).otherwise(0.0))
    return out


def ar(
    frame: DataFrame,
    out: str,
    horizon: int = HORIZON,
    lags: int | Sequence[int] = 1,
    trend: str = "c",
    seasonal: bool = False,
    period: int = SEASON,
    keep_fit: bool = False,
) -> DataFrame:
    """AR forecast of ``train`` as array column ``out``; with ``keep_fit`` also ``<out>_fit``.

    ``<out>_fit`` holds ``beta, sse, n, aic, bic`` and ``fitted`` (null for the first rows).
    """
    used = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    if not used or used[0] < 1:
        raise ValueError("lags must be at least 1")
    deep = max(used)
    train, n = F.col("train"), F.size("train")

    def row(values: Column, t: Column) -> Column:
        past = [F.element_at(values, (t - k).cast("int")) for k in used]
        return F.array(*_deterministic(t, trend, seasonal, period), *past)

    k = len(_deterministic(F.lit(1), trend, seasonal, period)) + len(used)
    ts = F.when(n > deep, F.sequence(F.lit(deep + 1), n)).otherwise(F.array().cast("array<int>"))
    design = F.transform(ts, lambda t: F.array_append(row(train, t), F.element_at(train, t)))
    fitted = with_fit(frame, "_fit", design, F.lit(k))
    beta = F.col("_fit.beta")
    made = fitted.withColumn(
        out, F.when(beta.isNotNull(), roll_out(train, horizon, lambda h, s: dot(beta, row(h, F.size(h) + 1))))
    )
    if keep_fit:
        values = F.concat(
            F.array_repeat(F.lit(None).cast("double"), deep), F.transform(ts, lambda t: dot(beta, row(train, t)))
        )
        made = made.withColumn(f"{out}_fit", _fit_struct(values, F.lit(k)))
    return made.drop("_fit")


# --- ARIMA and seasonal ARIMA ------------------------------------------------------------------

def spec_struct(order: Sequence[int], seasonal: Sequence[int] = (0, 0, 0, SEASON)) -> Column:
    """Model orders as a struct column ``p, d, q, sp, sd, sq, s``."""
    names = ("p", "d", "q", "sp", "sd", "sq", "s")
    return F.struct(*[F.lit(int(v)).alias(k) for k, v in zip(names, (*order, *seasonal))])


def spec_from_arrays(order: Column, seasonal: Column) -> Column:
    """The same from the parsed tuple arrays of an order table."""
    return F.struct(
        *[order[i].alias(k) for i, k in enumerate(("p", "d", "q"))],
        *[seasonal[i].alias(k) for i, k in enumerate(("sp", "sd", "sq", "s"))],
    )


def spec_name(spec: Column) -> Column:
    return F.format_string(
        "SARIMA(%d, %d, %d)x(%d, %d, %d, %d)", *[spec[k] for k in ("p", "d", "q", "sp", "sd", "sq", "s")]
    )


def sarima(
    frame: DataFrame,
    out: str,
    spec: Column,
    horizon: int = HORIZON,
    constrained: bool = False,
    alpha: float | None = None,
    keep_fit: bool = False,
    log: bool = False,
    trend: str | None = None,
    multiplicative: bool = False,
    errors: bool = False,
) -> DataFrame:
    """Seasonal ARIMA forecast of ``train`` by two least-squares stages (Hannan-Rissanen); see ``arma``.

    A long autoregression gives innovations; the second regression uses lags
    {1..p, s..P s} of the differenced series and {1..q, s..Q s} of the innovations,
    with a constant only when nothing is differenced.  ``spec`` may differ per
    row, so a whole order grid is one frame.  ``trend`` (n, c, t, ct) makes it a regression on a constant and a line
    with ARMA errors, of which differencing removes what it removes; ``multiplicative`` multiplies the plain and the
    seasonal polynomial.  Both are fitted by Gauss-Newton steps on the conditional sum of squares from the two stages.

    ``constrained`` shrinks an explosive autoregressive part and makes the moving average invertible; ``alpha`` adds
    ``<out>_lo`` and ``<out>_hi``; ``keep_fit`` adds ``<out>_fit`` (``fitted, resid, aic, bic, sigma, ar, ma, ar_lags,
    ma_lags, trend, error``); ``log`` works on logarithms.  A series that cannot be fitted has a null forecast and its reason in ``error``;
    ``errors`` adds the reason as ``<out>_error``.
    """
    src = F.transform("train", lambda x: F.ln(x)) if log else F.col("train")
    base = frame.withColumn("_y", src).withColumn("_spec", spec)
    base = base.withColumn("_arma", arma.udf(horizon, constrained, trend, multiplicative)("_y", "_spec"))
    fit = F.col("_arma")
    back_to_level = (lambda c: F.transform(c, lambda x: F.exp(x))) if log else (lambda c: c)
    sigma = F.sqrt(fit["sse"] / F.greatest(fit["n"] - fit["k"], F.lit(1)))
    columns = {out: back_to_level(fit["yhat"])}
    if alpha is not None:
        z = NormalDist().inv_cdf(1 - alpha / 2)
        base = base.withColumn("_half", F.transform(
            F.sequence(F.lit(1), F.lit(horizon)),
            lambda h: z * sigma * F.sqrt(array_sum(F.transform(F.slice(fit["psi"], F.lit(1), h), lambda x: x * x))),
        ))
        columns[f"{out}_lo"] = back_to_level(F.zip_with(fit["yhat"], "_half", lambda a, b: a - b))
        columns[f"{out}_hi"] = back_to_level(F.zip_with(fit["yhat"], "_half", lambda a, b: a + b))
    if errors:
        columns[f"{out}_error"] = fit["error"]
    if keep_fit:
        info = information(fit["sse"], fit["n"], fit["k"])
        resid = F.concat(F.array_repeat(F.lit(None).cast("double"), F.size("_y") - fit["n"]), fit["resid"])
        columns[f"{out}_fit"] = F.struct(
            F.zip_with("_y", resid, lambda a, e: a - e).alias("fitted"), resid.alias("resid"), info["aic"].alias("aic"),
            info["bic"].alias("bic"), sigma.alias("sigma"), *[fit[c].alias(c) for c in ("ar", "ma", "ar_lags", "ma_lags", "trend", "error")],
        )
    return base.select(*frame.columns, *[c.alias(name) for name, c in columns.items()])


# --- ridge on tabular features -----------------------------------------------------------------

def ridge(
    frame: DataFrame,
    out: str,
    horizon: int = HORIZON,
    alpha: float | Column = 1.0,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    freq: str = "month",
    keep_fit: bool = False,
) -> DataFrame:
    """Ridge regression on the tabular features of each series with recursive forecasts.

    Training rows and forecast steps use the same feature expression on the
    values before the row, so no row can see its own future.
    """
    options = {"lags": tuple(lags), "windows": tuple(windows)}
    warm = max(*lags, *windows)
    train, dates, n = F.col("train"), F.col("train_dates"), F.size("train")

    def features(values: Column, t: Column, ts: Column) -> Column:
        return F.concat(F.array(F.lit(1.0)), step_vector(values, t, ts, **options))

    ts = F.when(n > warm, F.sequence(F.lit(warm + 1), n)).otherwise(F.array().cast("array<int>"))
    design = F.transform(
        ts, lambda t: F.array_append(features(train, t, F.element_at(dates, t)), F.element_at(train, t))
    )
    k = 1 + len(feature_names(lags, windows))
    made = with_fit(frame, "_fit", design, F.lit(k), alpha)
    beta = F.col("_fit.beta")
    step = lambda h, s: dot(beta, features(h, F.size(h) + 1, add_periods(F.element_at(dates, -1), s, freq)))
    made = made.withColumn(out, F.when(beta.isNotNull(), roll_out(train, horizon, step)))
    if keep_fit:
        fitted = F.concat(
            F.array_repeat(F.lit(None).cast("double"), F.least(F.lit(warm), n)),
            F.transform(ts, lambda t: dot(beta, features(train, t, F.element_at(dates, t)))),
        )
        made = made.withColumn(f"{out}_fit", _fit_struct(fitted, F.lit(k)))
    return made.drop("_fit")

