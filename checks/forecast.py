"""Queries on diagnostics, decomposition, forecasters and model selection."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import BRA, DAY, HOUR, NAT, POS, PRI, R, W, query, rounded
from checks.evaluate import ONE, fold_ctes
from tidepanel.functions import stats
from tidepanel.models import baseline, future, registry, selection, trees
from tidepanel.models.fitted import fitted_values
from tidepanel.models.linear import ar, ridge, sarima, spec_struct
from tidepanel.models.smoothing import holt_winters
from tidepanel.operators import backtest, decomposition, diagnostics, splits
from tidepanel.plans.rolling import BACKTEST_SUITE, intervals, model_rows, with_model_params
from tidepanel.sources import tables

H = 12


def nation(spark, d):
    return tables.orders_nation_month(spark, d)


def one_fold(spark, d, bind=tables.orders_priority_month, hold_out=0):
    return splits.packed_folds(bind(spark, d), n_folds=1, hold_out=hold_out)


def long(frame, column="yhat"):
    """Forecast array -> rows ``series_id, h, ts, yhat``."""
    rows = frame.filter(F.col(column).isNotNull()).select(
        "series_id", F.posexplode(F.arrays_zip(F.col("test_dates").alias("ts"), F.col(column).alias("yhat"))).alias("i", "z")
    )
    return rows.select("series_id", (F.col("i") + 1).alias("h"), "z.ts", "z.yhat")


def solve_sql(source: str, name: str, penalty: str = "0.0") -> str:
    """Least squares in SQL: ``source`` has ``gid, x, y``; ``name`` gets ``gid, k, n, beta, sse, inv2``.

    ``penalty`` is added to the diagonal but for the first entry.

    Normal equations with the right side and the second unit vector as last columns, eliminated one column a step.
    """
    return f"""{name}_r AS (SELECT gid, list(x) AS xs, list(y) AS ys, sum(y * y) AS yy, count(*) AS n, len(any_value(x)) AS k FROM {source} GROUP BY gid),
{name}_m AS (SELECT gid, yy, n, k, [[list_dot_product([r[i] for r in xs]::double[], [r[j] for r in xs]::double[]) + CASE WHEN i = j AND i > 1 THEN {penalty} ELSE 0.0 END for j in range(1, k + 1)] for i in range(1, k + 1)] AS a,
    [list_dot_product([r[i] for r in xs]::double[], ys::double[]) for i in range(1, k + 1)] AS b FROM {name}_r),
{name}_e AS (SELECT gid, yy, n, k, b, 1 AS c, [list_concat(a[i], [b[i], CASE WHEN i = 2 THEN 1.0 ELSE 0.0 END]) for i in range(1, k + 1)] AS m FROM {name}_m
    UNION ALL SELECT gid, yy, n, k, b, c + 1, [[m[i][j] - CASE WHEN i = c THEN 0.0 ELSE m[i][c] / m[c][c] END * m[c][j] for j in range(1, k + 3)] for i in range(1, k + 1)]
    FROM {name}_e WHERE c <= k),
{name} AS (SELECT gid, k, n, [m[i][k + 1] / m[i][i] for i in range(1, k + 1)] AS beta, yy - list_sum([b[i] * m[i][k + 1] / m[i][i] for i in range(1, k + 1)]) AS sse,
    m[2][k + 2] / m[2][2] AS inv2 FROM {name}_e WHERE c = k + 1)"""


# --- diagnostics -----------------------------------------------------------------------------

LAGS = """c AS (SELECT series_id, pos, n, y - avg(y) OVER (PARTITION BY series_id) AS c FROM q),
g AS (SELECT a.series_id, any_value(a.n) AS n, a.pos - b.pos AS lag, sum(a.c * b.c) AS g FROM c a
    JOIN c b ON a.series_id = b.series_id AND a.pos - b.pos BETWEEN 0 AND 40 GROUP BY 1, 3),
rk AS (SELECT series_id, n, lag, g / first_value(g) OVER (PARTITION BY series_id ORDER BY lag) AS r FROM g)"""


@query(
    "acf",
    W(NAT, POS, LAGS)
    + f"""SELECT series_id, cast(lag as integer) AS lag, {R('r', 6)} AS acf, {R('r - h', 6)} AS low, {R('r + h', 6)} AS high FROM (
    SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r ELSE 0.0 END)
    OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / n) END AS h
    FROM rk WHERE lag <= least(24, n // 2 - 1))""",
)
def acf(spark, d):
    return rounded(diagnostics.acf(diagnostics.pack_values(nation(spark, d))), 6)


PACF = """pc AS (SELECT series_id, any_value(n) AS n, list(r ORDER BY lag) AS r FROM rk WHERE lag <= least(24, n // 2 - 1) GROUP BY 1),
pr AS (SELECT series_id, n, r, 1 AS k, []::double[] AS phi, 1.0::double AS v, r[2] AS a FROM pc WHERE len(r) > 1
    UNION ALL SELECT series_id, n, r, k + 1, f, w, (r[k + 2] - list_sum([f[j] * r[k + 2 - j] for j in range(1, k + 1)])) / w
    FROM (SELECT *, list_append([phi[j] - a * phi[k - j] for j in range(1, k)], a) AS f, v * (1 - a * a) AS w FROM pr WHERE k + 1 < len(r)))"""


@query(
    "pacf",
    W(NAT, POS, LAGS, PACF).replace("WITH", "WITH RECURSIVE", 1)
    + f"""SELECT series_id, cast(k as integer) AS lag, {R('a', 6)} AS pacf, {R('a - 1.959963984540054 / sqrt(n)', 6)} AS low, {R('a + 1.959963984540054 / sqrt(n)', 6)} AS high FROM pr
    UNION ALL SELECT series_id, 0, 1.0, 1.0, 1.0 FROM pc WHERE len(r) > 1""",
)
def pacf(spark, d):
    return rounded(diagnostics.pacf(diagnostics.pack_values(nation(spark, d))), 6)


DEC = """d0 AS (SELECT *, CASE WHEN count(*) OVER f = 13 THEN (sum(y) OVER f - 0.5 * (lag(y, 6) OVER w + lead(y, 6) OVER w)) / 12 END AS trend
    FROM q WHERE n >= 24 WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING),
    w AS (PARTITION BY series_id ORDER BY ts)),
d1 AS (SELECT *, (pos - 1) % 12 AS ph, avg({loose}) OVER (PARTITION BY series_id, (pos - 1) % 12) AS pm FROM d0),
d2 AS (SELECT *, pm {op} avg(CASE WHEN pos <= 12 THEN pm END) OVER (PARTITION BY series_id) AS seasonal FROM d1)"""


@query(
    "classical_decomposition",
    W(NAT, POS, DEC.format(loose="y - trend", op="-"))
    + f"SELECT series_id, ts, {R('trend', 3)} AS trend, {R('seasonal', 3)} AS seasonal, {R('y - trend - seasonal', 3)} AS resid FROM d2",
)
def classical_decomposition(spark, d):
    return rounded(decomposition.classical(nation(spark, d)).drop("y", "peak", "pos"), 3)


@query(
    "multiplicative_decomposition",
    W(NAT, POS, DEC.format(loose="y / trend", op="/"))
    + f"SELECT series_id, ts, {R('trend', 3)} AS trend, {R('seasonal', 6)} AS seasonal, {R('y / (trend * seasonal)', 6)} AS resid FROM d2",
)
def multiplicative_decomposition(spark, d):
    out = decomposition.classical(nation(spark, d), model="multiplicative").drop("y", "peak", "pos")
    return rounded(out, 6, trend=3)


GAPPY = (
    "g0 AS (SELECT series_id, ts, CASE WHEN month(ts) = 5 THEN NULL ELSE y END AS y0, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM p0)",
    "g1 AS (SELECT *, last_value(y0 IGNORE NULLS) OVER w AS a, last_value(CASE WHEN y0 IS NOT NULL THEN k END IGNORE NULLS) OVER w AS ka, "
    "first_value(y0 IGNORE NULLS) OVER v AS b, first_value(CASE WHEN y0 IS NOT NULL THEN k END IGNORE NULLS) OVER v AS kb FROM g0 "
    "WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "v AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    "p AS (SELECT series_id, ts, coalesce(y0, a + (b - a) * (k - ka) / (kb - ka), b, a) AS y FROM g1)",
)


def gappy(spark, d):
    """The nation panel without a value in any May."""
    return nation(spark, d).withColumn("y", F.when(F.month("ts") != 5, F.col("y")))


@query(
    "classical_decomposition_gaps",
    W(NAT.replace("p AS", "p0 AS", 1), *GAPPY, POS, DEC.format(loose="y - trend", op="-"))
    + f"SELECT series_id, ts, {R('trend', 3)} AS trend, {R('seasonal', 3)} AS seasonal, {R('y - trend - seasonal', 3)} AS resid FROM d2",
)
def classical_decomposition_gaps(spark, d):
    return rounded(decomposition.classical(gappy(spark, d)).drop("y", "peak", "pos"), 3)


@query("stl")
def stl(spark, d):
    return decomposition.stl_panel(nation(spark, d))


RES = "rs AS (SELECT series_id, ts, pos, y - coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY pos), y) AS e FROM fr WHERE pos <= cut)"


def naive_residuals(spark, d):
    rows = fitted_values(one_fold(spark, d, tables.orders_nation_month), ("Naive",))
    return rows.select("series_id", "ts", "resid")


def residual_report(spark, d):
    return diagnostics.residual_tests(diagnostics.pack_values(naive_residuals(spark, d), value="resid"))


@query(
    "durbin_watson",
    f"""WITH {fold_ctes(NAT, 1)}, {RES}, l AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM rs)
    SELECT series_id, cast(count(*) as integer) AS n, {R('avg(e)', 3)} AS mean, {R('stddev_samp(e)', 3)} AS std,
    {R('sum((e - p) * (e - p)) / sum(e * e)', 6)} AS durbin_watson FROM l GROUP BY 1""",
)
def durbin_watson(spark, d):
    out = residual_report(spark, d).select("series_id", "n", "mean", "std", "durbin_watson")
    return rounded(out, 3, durbin_watson=6)


@query(
    "jarque_bera",
    f"""WITH {fold_ctes(NAT, 1)}, {RES}, m AS (SELECT *, e - avg(e) OVER (PARTITION BY series_id) AS c FROM rs),
    k AS (SELECT series_id, count(*) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM m GROUP BY 1),
    j AS (SELECT *, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt, n / 6.0::double * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM k)
    SELECT series_id, {R('skew', 6)} AS skew, {R('kurt', 6)} AS kurtosis, {R('jb', 6)} AS jb_stat, {R('exp(-jb / 2)', 6)} AS jb_p, exp(-jb / 2) >= 0.05 AS is_normal FROM j""",
)
def jarque_bera(spark, d):
    return rounded(residual_report(spark, d).select("series_id", "skew", "kurtosis", "jb_stat", "jb_p", "is_normal"), 6)


@query(
    "ljung_box",
    f"""WITH {fold_ctes(NAT, 1)}, {RES}, c AS (SELECT series_id, pos, e - avg(e) OVER (PARTITION BY series_id) AS c, count(*) OVER (PARTITION BY series_id) AS n FROM rs),
    g AS (SELECT a.series_id, any_value(a.n) AS n, a.pos - b.pos AS lag, sum(a.c * b.c) AS g FROM c a
        JOIN c b ON a.series_id = b.series_id AND a.pos - b.pos BETWEEN 0 AND 12 GROUP BY 1, 3),
    r AS (SELECT *, g / first_value(g) OVER (PARTITION BY series_id ORDER BY lag) AS r FROM g),
    s AS (SELECT series_id, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)) AS x FROM r WHERE lag > 0 GROUP BY 1),
    pv AS (SELECT *, exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6 + pow(x / 2, 4) / 24 + pow(x / 2, 5) / 120) AS p FROM s)
    SELECT series_id, {R('x', 6)} AS lb_stat, {R('p', 6)} AS lb_min_p, p >= 0.05 AS is_white_noise FROM pv""",
)
def ljung_box(spark, d):
    out = residual_report(spark, d).select("series_id", F.col("lb_stat")[0].alias("lb_stat"), "lb_min_p", "is_white_noise")
    return rounded(out, 6)


KPSS = """k0 AS (SELECT series_id, any_value(n) AS n, max(g) FILTER (lag = 0) AS g0,
    (max(g) FILTER (lag = 0) + 2 * coalesce(sum(g) FILTER (lag BETWEEN 1 AND floor(pow(n, 2.0 / 9.0))), 0)) / any_value(n) AS s0,
    2 * coalesce(sum(lag * g) FILTER (lag BETWEEN 1 AND floor(pow(n, 2.0 / 9.0))), 0) / any_value(n) AS s1 FROM g GROUP BY 1),
k1 AS (SELECT *, cast(least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3.0) * pow(n, 1.0 / 3.0)), n - 1) as integer) AS lags_used FROM k0 WHERE n >= 15),
k2 AS (SELECT k1.series_id, any_value(k1.n) AS n, any_value(lags_used) AS lags_used, (any_value(g0) +
    coalesce(sum(2 * g * (1 - lag / (lags_used + 1.0::double))) FILTER (lag BETWEEN 1 AND lags_used), 0)) / any_value(k1.n) AS v
    FROM k1 JOIN g ON k1.series_id = g.series_id GROUP BY 1),
k3 AS (SELECT series_id, sum(s * s) AS ss FROM (SELECT series_id, sum(c) OVER (PARTITION BY series_id ORDER BY pos) AS s FROM c) GROUP BY 1),
k4 AS (SELECT k2.series_id, n, lags_used, ss / (n * n * v) AS x FROM k2 JOIN k3 USING (series_id)),
k5 AS (SELECT *, CASE WHEN x <= 0.347 THEN 0.1 WHEN x <= 0.463 THEN 0.1 + (x - 0.347) * (-0.05 / 0.116) WHEN x <= 0.574 THEN 0.05 + (x - 0.463) * (-0.025 / 0.111)
    WHEN x <= 0.739 THEN 0.025 + (x - 0.574) * (-0.015 / 0.165) ELSE 0.01 END AS p FROM k4)"""


@query(
    "kpss",
    W(NAT, POS, LAGS, KPSS)
    + f"SELECT series_id, cast(n as integer) AS n, lags_used, {R('x', 6)} AS statistic, {R('p', 6)} AS p_value, p >= 0.05 AS is_stationary FROM k5",
)
def kpss(spark, d):
    return rounded(diagnostics.kpss(diagnostics.pack_values(nation(spark, d))), 6)


# The same statistic of the residuals of a line, with its own critical values.
DETRENDED = """m0 AS (SELECT series_id, pos, n, y - avg(y) OVER (PARTITION BY series_id) AS c FROM q),
c AS (SELECT series_id, pos, n, c - sum(c * (pos - (n + 1) / 2.0)) OVER (PARTITION BY series_id) / (n * (n * n - 1.0) / 12) * (pos - (n + 1) / 2.0) AS c FROM m0),
g AS (SELECT a.series_id, any_value(a.n) AS n, a.pos - b.pos AS lag, sum(a.c * b.c) AS g FROM c a
    JOIN c b ON a.series_id = b.series_id AND a.pos - b.pos BETWEEN 0 AND 40 GROUP BY 1, 3)"""
KPSS_TREND = KPSS[: KPSS.index("k5 AS")] + """k5 AS (SELECT *, CASE WHEN x <= 0.119 THEN 0.1 WHEN x <= 0.146 THEN 0.1 + (x - 0.119) * (-0.05 / 0.027) WHEN x <= 0.176 THEN 0.05 + (x - 0.146) * (-0.025 / 0.030)
    WHEN x <= 0.216 THEN 0.025 + (x - 0.176) * (-0.015 / 0.040) ELSE 0.01 END AS p FROM k4)"""


@query(
    "kpss_trend",
    W(NAT, POS, DETRENDED, KPSS_TREND)
    + f"SELECT series_id, cast(n as integer) AS n, lags_used, {R('x', 6)} AS statistic, {R('p', 6)} AS p_value, p >= 0.05 AS is_stationary FROM k5",
)
def kpss_trend(spark, d):
    return rounded(diagnostics.kpss(diagnostics.pack_values(nation(spark, d)), "ct"), 6)


# Values in units of their mean size and centred, which leaves the statistic as it is.
ADF = f"""v AS (SELECT series_id, n, list((y - m) / s ORDER BY pos) AS y FROM (SELECT *, avg(y) OVER w AS m, avg(abs(y)) OVER w AS s FROM q WINDOW w AS (PARTITION BY series_id))
    WHERE n >= 15 GROUP BY 1, 2),
t0 AS (SELECT *, cast(least(ceil(12.0 * pow(n / 100.0, 0.25)), floor(n / 2) - 2) as integer) AS top FROM v),
z1 AS (SELECT {{'s': series_id, 'p': p}} AS gid, list_concat([1.0, y[t - 1]], [y[t - j] - y[t - j - 1] for j in range(1, p + 1)]) AS x, y[t] - y[t - 1] AS y
    FROM (SELECT *, unnest(range(top + 2, n + 1)) AS t FROM (SELECT *, unnest(range(0, top + 1)) AS p FROM t0))),
{solve_sql('z1', 's1')},
bp AS (SELECT gid.s AS series_id, gid.p AS p FROM s1 QUALIFY row_number() OVER (PARTITION BY gid.s ORDER BY n * ln(sse / n) + 2 * (gid.p + 2), gid.p) = 1),
z2 AS (SELECT {{'s': series_id, 'p': p}} AS gid, list_concat([1.0, y[t - 1]], [y[t - j] - y[t - j - 1] for j in range(1, p + 1)]) AS x, y[t] - y[t - 1] AS y
    FROM (SELECT v.*, bp.p, unnest(range(bp.p + 2, n + 1)) AS t FROM v JOIN bp USING (series_id))),
{solve_sql('z2', 's2')},
ad AS (SELECT gid.s AS series_id, gid.p AS lags_used, n, beta[2] / sqrt(sse / (n - k) * inv2) AS tau FROM s2)"""


@query(
    "adf",
    W(NAT, POS, ADF).replace("WITH", "WITH RECURSIVE", 1)
    + f"""SELECT series_id, cast(lags_used as integer) AS lags_used, cast(n as integer) AS n_obs, {R('tau', 4)} AS statistic,
    {R('-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n)', 6)} AS critical_5 FROM ad""",
)
def adf(spark, d):
    out = diagnostics.adf(diagnostics.pack_values(nation(spark, d)))
    return rounded(out.select("series_id", "lags_used", "n_obs", "statistic", F.col("crit_5").alias("critical_5")), 4, critical_5=6)


def _adf_threshold() -> float:
    """The statistic whose p-value is 0.05, by bisection on the published polynomial."""
    a, b, c = diagnostics.ADF_SMALL_P
    lo, hi = -6.0, -1.7
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if NormalDist().cdf(a + b * mid + c * mid * mid) < 0.05 else (lo, mid)
    return lo


# Both tests on the series and on its first differences, told apart by the name's ending.
VARIANTS = (
    "p AS (SELECT series_id || '/raw' AS series_id, ts, y FROM p0 UNION ALL SELECT * FROM (SELECT series_id || '/first difference' AS series_id, ts, "
    "y - lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS y FROM p0) WHERE y IS NOT NULL)"
)


@query(
    "stationarity_table",
    W(PRI.replace("p AS", "p0 AS", 1), VARIANTS, POS, ADF, LAGS.replace("AND 40", "AND 4000"), KPSS).replace("WITH", "WITH RECURSIVE", 1)
    + f"""SELECT split_part(series_id, '/', 1) AS series_id, split_part(series_id, '/', 2) AS variant, {R('tau', 4)} AS adf_stat, cast(ad.lags_used as integer) AS adf_lags,
    {R('k5.x', 6)} AS kpss_stat, k5.lags_used AS kpss_lags, tau < {_adf_threshold()} AND k5.p >= 0.05 AS is_stationary,
    CASE WHEN tau < {_adf_threshold()} THEN CASE WHEN k5.p >= 0.05 THEN 'Stationary (both tests agree)' ELSE 'Difference / Trend Stationary (ADF stationary, KPSS rejects)' END
    WHEN k5.p >= 0.05 THEN 'Ambiguous / Strict Stationarity (ADF fails to reject, KPSS fails to reject)' ELSE 'Non-Stationary (Unit Root; both tests agree)' END AS conclusion
    FROM ad JOIN k5 USING (series_id)""",
)
def stationarity_table(spark, d):
    out = diagnostics.stationarity_table(tables.orders_priority_month(spark, d))
    shown = out.select("series_id", "variant", "adf_stat", "adf_lags", "kpss_stat", "kpss_lags", "is_stationary", "conclusion")
    return rounded(shown, 6, adf_stat=4)


@query(
    "residual_standardised",
    f"WITH {fold_ctes(NAT, 1)}, {RES} SELECT series_id, ts, {R('e', 3)} AS resid, {R('(e - avg(e) OVER w) / stddev_samp(e) OVER w', 6)} AS z FROM rs WINDOW w AS (PARTITION BY series_id)",
)
def residual_standardised(spark, d):
    return rounded(diagnostics.residual_panel(naive_residuals(spark, d))["standardised"], 6, resid=3)


@query(
    "residual_density",
    f"""WITH {fold_ctes(NAT, 1)}, {RES}, b AS (SELECT series_id, e, min(e) OVER w AS lo, (max(e) OVER w - min(e) OVER w) / 15 AS wd, count(*) OVER w AS n FROM rs WINDOW w AS (PARTITION BY series_id))
    SELECT series_id, cast(least(floor((e - lo) / wd) + 1, 15) as integer) AS bin, {R('count(*) / (any_value(n) * any_value(wd)) * 1e6', 3)} AS density_e6,
    {R('any_value(lo) + (cast(least(floor((e - lo) / wd) + 1, 15) as integer) - 1) * any_value(wd)', 3)} AS bin_start FROM b GROUP BY 1, 2""",
)
def residual_density(spark, d):
    out = diagnostics.residual_panel(naive_residuals(spark, d))["density"]
    return rounded(out.select("series_id", "bin", (F.col("density") * 1e6).alias("density_e6"), "bin_start"), 3)


def _horner_sql(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_CENTRE = f"({_horner_sql(stats.PPF_A, '((q - 0.5) * (q - 0.5))')} * (q - 0.5) / {_horner_sql(stats.PPF_B, '((q - 0.5) * (q - 0.5))')})"
_TAIL = f"({_horner_sql(stats.PPF_C, 'sqrt(-2 * ln(least(q, 1 - q)))')} / {_horner_sql(stats.PPF_D, 'sqrt(-2 * ln(least(q, 1 - q)))')})"


@query(
    "residual_qq",
    f"""WITH {fold_ctes(NAT, 1)}, {RES}, o AS (SELECT series_id, e, row_number() OVER (PARTITION BY series_id ORDER BY e, ts) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM rs WHERE e IS NOT NULL),
    z AS (SELECT series_id, e, CASE WHEN k = n THEN pow(0.5, 1.0 / n) WHEN k = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (k - 0.3175) / (n + 0.365) END::double AS q FROM o)
    SELECT series_id, {R('e', 3)} AS sample, {R(f'CASE WHEN q < {stats.PPF_LOW} THEN {_TAIL} WHEN q > 1 - {stats.PPF_LOW} THEN -{_TAIL} ELSE {_CENTRE} END', 6)} AS theoretical FROM z""",
)
def residual_qq(spark, d):
    return rounded(diagnostics.residual_panel(naive_residuals(spark, d))["qq"], 6, sample=3)


@query(
    "residual_acf",
    f"""WITH {fold_ctes(NAT, 1)}, {RES}, c AS (SELECT series_id, pos, e - avg(e) OVER (PARTITION BY series_id) AS c, count(*) OVER (PARTITION BY series_id) AS n FROM rs),
    g AS (SELECT a.series_id, any_value(a.n) AS n, a.pos - b.pos AS lag, sum(a.c * b.c) AS g FROM c a
        JOIN c b ON a.series_id = b.series_id AND a.pos - b.pos BETWEEN 0 AND 24 GROUP BY 1, 3),
    r AS (SELECT *, g / first_value(g) OVER (PARTITION BY series_id ORDER BY lag) AS r FROM g)
    SELECT series_id, cast(lag as integer) AS lag, {R('r', 6)} AS acf, {R('-1.96 / sqrt(n)', 6)} AS low, {R('1.96 / sqrt(n)', 6)} AS high FROM r WHERE lag <= least(24, n // 2 - 1)""",
)
def residual_acf(spark, d):
    return rounded(diagnostics.residual_panel(naive_residuals(spark, d))["acf"], 6)


# --- baselines -------------------------------------------------------------------------------

LAST = "la AS (SELECT series_id, max(ts) AS last_ts, max_by(y, ts) AS last_y, avg(y) AS mean_y FROM p GROUP BY 1)"


@query(
    "naive_forecast",
    W(HOUR, LAST) + "SELECT series_id, 'Naive' AS model, h::integer AS h, strftime(last_ts + to_hours(h), '%Y-%m-%d %H') AS hour, last_y AS yhat FROM la, range(1, 25) r(h)",
)
def naive_forecast(spark, d):
    make = {"Naive": registry.from_expression(lambda y: baseline.naive(y, 24))}
    out = future.forecast(tables.events_period(spark, d, "hour"), make, 24, "hour", 24)
    return out.select("series_id", "model", "h", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "yhat")


@query(
    "mean_forecast",
    W(BRA, LAST) + f"SELECT series_id, 'Mean' AS model, h::integer AS h, cast(last_ts + to_months(h::integer) as date) AS ts, {R('mean_y')} AS yhat FROM la, range(1, 13) r(h)",
)
def mean_forecast(spark, d):
    make = {"Mean": registry.from_expression(lambda y: baseline.mean(y, H))}
    return rounded(future.forecast(tables.brand_ship_month(spark, d), make))


@query(
    "seasonal_naive_forecast",
    W(DAY, POS)
    + "SELECT series_id, 'Seasonal Naive' AS model, h::integer AS h, cast(max(ts) + to_days(h::integer) as date) AS ts, max(y) FILTER (pos = n - 7 + ((h - 1) % 7) + 1) AS yhat "
    "FROM q, range(1, 15) r(h) GROUP BY series_id, h",
)
def seasonal_naive_forecast(spark, d):
    make = {"Seasonal Naive": registry.from_expression(lambda y: baseline.seasonal_naive(y, 14, 7))}
    return future.forecast(tables.events_period(spark, d, "day"), make, 14, "day", 7)


@query(
    "fitted_residuals",
    f"""WITH {ONE}, t AS (SELECT series_id, ts, pos, y FROM fr WHERE pos <= cut), f AS (
        SELECT series_id, 'Naive' AS model, ts, y, coalesce(lag(y) OVER w, y) AS fitted FROM t WINDOW w AS (PARTITION BY series_id ORDER BY pos)
        UNION ALL SELECT series_id, 'Mean', ts, y, avg(y) OVER (PARTITION BY series_id) FROM t
        UNION ALL SELECT series_id, 'Seasonal Naive', ts, y, lag(y, 12) OVER (PARTITION BY series_id ORDER BY pos) FROM t)
    SELECT series_id, model, ts, {R('fitted', 3)} AS fitted, {R('y - fitted', 3)} AS resid FROM f""",
)
def fitted_residuals(spark, d):
    return rounded(fitted_values(one_fold(spark, d)).drop("y", "fold"), 3)


@query("fitted_models")
def fitted_models(spark, d):
    return fitted_values(one_fold(spark, d), (*BACKTEST_SUITE, "Log + SARIMA"))


# --- autoregression, smoothing -----------------------------------------------------------------

@query(
    "ar1_forecast",
    f"""WITH {ONE}, l AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS x FROM fr WHERE pos <= cut),
    b AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM l GROUP BY 1)
    SELECT series_id, cast(h as integer) AS h, ts, {R('c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * last_y', 2)} AS yhat FROM te JOIN b USING (series_id)""",
)
def ar1_forecast(spark, d):
    return rounded(long(ar(one_fold(spark, d), "yhat", H, lags=1)), 2)


AR_SEASONAL = f"""sz AS (SELECT series_id, cut, avg(abs(y)) AS s, list(y ORDER BY pos) AS raw FROM fr WHERE pos <= cut GROUP BY 1, 2),
yy AS (SELECT series_id, cut AS n, s, [v / s for v in raw] AS y FROM sz),
az AS (SELECT series_id AS gid, list_concat([1.0, t / 10.0], [CASE WHEN (t - 1) % 12 = j THEN 1.0 ELSE 0.0 END for j in range(1, 12)], [y[t - 1], y[t - 2], y[t - 12]]) AS x, y[t] AS y
    FROM (SELECT *, unnest(range(13, n + 1)) AS t FROM yy)),
{{solve}},
af AS (SELECT series_id, s, yy.n, 0 AS h, y, beta FROM yy JOIN sa ON gid = series_id
    UNION ALL SELECT series_id, s, n, h + 1, list_append(y, list_dot_product(beta::double[], list_concat([1.0, (n + h + 1) / 10.0],
        [CASE WHEN (n + h) % 12 = j THEN 1.0 ELSE 0.0 END for j in range(1, 12)], [y[n + h], y[n + h - 1], y[n + h - 11]])::double[])), beta FROM af WHERE h < 12)"""


@query(
    "ar_seasonal_forecast",
    f"WITH RECURSIVE {ONE}, " + AR_SEASONAL.replace("{solve}", solve_sql("az", "sa"))
    + f" SELECT te.series_id, te.h::integer AS h, te.ts, {R('af.y[af.n + te.h] * s', 1)} AS yhat FROM af JOIN te USING (series_id) WHERE af.h = 12",
)
def ar_seasonal_forecast(spark, d):
    return rounded(long(ar(one_fold(spark, d), "yhat", H, lags=[1, 2, 12], trend="ct", seasonal=True)), 1)


def _hw_recursion(name: str, grid: str) -> str:
    fit = "(r.l + r.b + r.s[1])"
    new = "(r.al * (i.ys[r.t + 1] - r.s[1]) + (1 - r.al) * (r.l + r.b))"
    return f"""{name} AS (SELECT g.series_id, al, be, ga, 12 AS t, l0 AS l, b0 AS b, s0 AS s, 0.0::double AS sse FROM {grid} g JOIN ini USING (series_id)
    UNION ALL SELECT r.series_id, r.al, r.be, r.ga, r.t + 1, {new}, r.be * ({new} - r.l) + (1 - r.be) * r.b,
    list_append(r.s[2:12], r.ga * (i.ys[r.t + 1] - (r.l + r.b)) + (1 - r.ga) * r.s[1]),
    r.sse + (i.ys[r.t + 1] - {fit}) * (i.ys[r.t + 1] - {fit}) FROM {name} r JOIN ini i ON i.series_id = r.series_id WHERE r.t < i.n)"""


HOLT_WINTERS = f"""WITH RECURSIVE {ONE}, arr AS (SELECT series_id, list(y ORDER BY pos) AS ys, count(*) AS n FROM fr WHERE pos <= cut GROUP BY 1),
    i0 AS (SELECT *, list_sum(ys[1:12]) / 12 AS l0, (list_sum(ys[13:24]) - list_sum(ys[1:12])) / 144 AS b0 FROM arr),
    ini AS (SELECT *, [ys[k] - l0 for k in range(1, 13)] AS s0 FROM i0),
    ax AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::double AS v), rf AS (SELECT unnest([-0.08, -0.04, 0.0, 0.04, 0.08])::double AS v),
    g1 AS (SELECT series_id, a.v AS al, b.v AS be, c.v AS ga FROM ini, ax a, ax b, ax c), {_hw_recursion('r1', 'g1')},
    b1 AS (SELECT r1.series_id, al, be, ga FROM r1 JOIN ini USING (series_id) WHERE t = n QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse, al, be, ga) = 1),
    g2 AS (SELECT series_id, al + a.v AS al, be + b.v AS be, ga + c.v AS ga FROM b1, rf a, rf b, rf c), {_hw_recursion('r2', 'g2')},
    b2 AS (SELECT r2.* FROM r2 JOIN ini USING (series_id) WHERE t = n QUALIFY row_number() OVER (PARTITION BY r2.series_id ORDER BY sse, al, be, ga) = 1)
    """


@query(
    "holt_winters_grid",
    HOLT_WINTERS + f"""SELECT series_id, {R('al', 2)} AS alpha, {R('be', 2)} AS beta, {R('ga', 2)} AS gamma, {R('sse / 1e6', 2)} AS sse_e6, h::integer AS h,
    {R('l + h * b + s[(h - 1) % 12 + 1]', 2)} AS yhat FROM b2, range(1, 13) r(h)""",
)
def holt_winters_grid(spark, d):
    made = one_fold(spark, d).withColumn("f", holt_winters(F.col("train"), H))
    rows = made.select(
        "series_id", "f.alpha", "f.beta", "f.gamma", (F.col("f.sse") / 1e6).alias("sse_e6"), F.posexplode("f.yhat").alias("i", "yhat")
    )
    return rounded(rows.withColumn("h", F.col("i") + 1).drop("i"), 2)


@query("holt_winters_variants")
def holt_winters_variants(spark, d):
    folds = one_fold(spark, d, tables.orders_nation_month)
    forms = {"mul_mul": ("mul", "mul", False), "add_mul": ("add", "mul", False), "damped": ("add", "add", True), "holt": ("add", None, False), "simple": (None, None, False)}
    fits = [holt_winters(F.col("train"), H, t, s, damped)["yhat"].alias(name) for name, (t, s, damped) in forms.items()]
    rows = folds.select("series_id", *fits).select("series_id", F.posexplode(F.arrays_zip(*forms)).alias("i", "z"))
    return rows.select("series_id", (F.col("i") + 1).alias("h"), *[F.col(f"z.{n}").alias(n) for n in forms])


@query(
    "holt_winters_fallback",
    HOLT_WINTERS + f"SELECT te.series_id, te.h::integer AS h, te.ts, {R('l + te.h * b + s[(te.h - 1) % 12 + 1]', 2)} AS yhat FROM b2 JOIN te USING (series_id)",
)
def holt_winters_fallback(spark, d):
    return rounded(long(registry.holt_winters_with_fallback(one_fold(spark, d), "yhat")), 2)


# --- ARIMA family ------------------------------------------------------------------------------

def sarima_sql(ar_lags: tuple, ma_lags: tuple, seasonal: bool, log: bool = False) -> str:
    """Both least-squares stages, innovations and forecasts of a once differenced model without constant."""
    value = "ln(y)" if log else "y"
    first = "[u[i] - u[i - 12] for i in range(13, n + 1)]" if seasonal else "u"
    undo = "u[len(u)] + u[len(u) - 11] - u[len(u) - 12]" if seasonal else "u[len(u)]"
    row = lambda lags, v: "[" + ", ".join(f"CASE WHEN t > {k} THEN {v}[t - {k}] ELSE 0.0 END" for k in lags) + "]"
    x = f"list_concat({row(ar_lags, 'w')}, {row(ma_lags, 'e')})::double[]"
    top = max(ar_lags)
    back = f"exp(u[n + te.h] * s)" if log else "u[n + te.h] * s"
    return f"""WITH RECURSIVE {ONE}, sz AS (SELECT series_id, cut AS n, avg(abs({value})) AS s, list({value} ORDER BY pos) AS raw FROM fr WHERE pos <= cut GROUP BY 1, 2),
uu AS (SELECT series_id, n, s, [v / s for v in raw] AS u FROM sz),
w0 AS (SELECT *, {first} AS d FROM uu),
ww AS (SELECT series_id, n, s, u, [d[i] - d[i - 1] for i in range(2, len(d) + 1)] AS w, len(d) - 1 AS m, cast(greatest(1, least(12, floor((len(d) - 1) / 3))) as bigint) AS lo FROM w0),
p1 AS (SELECT series_id AS gid, [w[t - k] for k in range(1, lo + 1)] AS x, w[t] AS y FROM (SELECT *, unnest(range(lo + 1, m + 1)) AS t FROM ww)),
{solve_sql('p1', 'f1')},
ee AS (SELECT ww.*, beta, [CASE WHEN t <= lo THEN 0.0 ELSE w[t] - list_sum([beta[k] * w[t - k] for k in range(1, lo + 1)]) END for t in range(1, m + 1)] AS e, greatest({top}, lo) AS cutoff
    FROM ww JOIN f1 ON gid = series_id),
p2 AS (SELECT series_id AS gid, {x} AS x, w[t] AS y FROM (SELECT *, unnest(range(cutoff + 1, m + 1)) AS t FROM ee)),
{solve_sql('p2', 'f2')},
rs AS (SELECT ee.series_id, ee.n, s, u, w, m, cutoff, f2.beta::double[] AS beta, 1 AS t, []::double[] AS e FROM ee JOIN f2 ON gid = series_id
    UNION ALL SELECT series_id, n, s, u, w, m, cutoff, beta, t + 1, list_append(e, CASE WHEN t <= cutoff THEN 0.0 ELSE w[t] - list_dot_product(beta, {x}) END) FROM rs WHERE t <= m),
fo AS (SELECT series_id, n, s, u, w, beta, list_concat(e, [0.0 for i in range(12)]) AS e, m + 1 AS t, 0 AS h FROM rs WHERE t = m + 1
    UNION ALL SELECT series_id, n, s, list_append(u, {undo} + f), list_append(w, f), beta, e, t + 1, h + 1
    FROM (SELECT *, list_dot_product(beta, {x}) AS f FROM fo WHERE h < 12))
SELECT te.series_id, te.h::integer AS h, te.ts, {R(back, 1)} AS yhat FROM fo JOIN te USING (series_id) WHERE fo.h = 12"""


@query("arima_forecast", sarima_sql((1,), (1,), False))
def arima_forecast(spark, d):
    return rounded(long(sarima(one_fold(spark, d), "yhat", spec_struct((1, 1, 1)))), 1)


@query("sarima_forecast", sarima_sql((1, 12), (1,), True))
def sarima_forecast(spark, d):
    return rounded(long(sarima(one_fold(spark, d), "yhat", spec_struct((1, 1, 1), (1, 1, 0, 12)))), 1)


@query("sarima_constrained")
def sarima_constrained(spark, d):
    return long(sarima(one_fold(spark, d), "yhat", spec_struct((1, 1, 1), (1, 1, 0, 12)), constrained=True))


@query(
    "sarima_intervals",
    sarima_sql((1, 12), (1,), True).rpartition("\nSELECT te.series_id")[0]
    + f""",
ps AS (SELECT series_id, beta, 1 AS k, [1.0::double] AS pw, [1.0::double] AS p, s * sqrt(list_sum([power(v, 2) for v in e[cutoff + 1 :]]) / greatest(m - cutoff - 3, 1)) AS sigma
    FROM rs WHERE t = m + 1 UNION ALL SELECT series_id, beta, k + 1, list_append(pw, v), list_append(p, v + p[k]), sigma
    FROM (SELECT *, beta[1] * pw[k] + CASE WHEN k = 1 THEN beta[3] ELSE 0.0 END AS v FROM ps WHERE k < 12)),
iv AS (SELECT series_id, te.h, s * u[n + te.h] AS mid, 1.959963984540054 * sigma * sqrt(list_sum([power(v, 2) for v in p[1 : te.h]])) AS half
    FROM fo JOIN ps USING (series_id) JOIN te USING (series_id) WHERE fo.h = 12 AND ps.k = 12)
SELECT series_id, cast(h as integer) AS h, {R('mid - half', 0)} AS lower, {R('mid + half', 0)} AS upper FROM iv""",
)
def sarima_intervals(spark, d):
    made = sarima(one_fold(spark, d), "o", spec_struct((1, 1, 1), (1, 1, 0, 12)), alpha=0.05)
    rows = made.select("series_id", F.posexplode(F.arrays_zip(F.col("o_lo").alias("lower"), F.col("o_hi").alias("upper"))).alias("i", "z"))
    return rounded(rows.select("series_id", (F.col("i") + 1).alias("h"), "z.lower", "z.upper"), 0)


@query("holdout_intervals")
def holdout_intervals(spark, d):
    """Intervals of the model that the holdout uses, with the text of its orders."""
    return intervals(one_fold(spark, d))


def trend_sql(trend: str) -> str:
    """Regression on a constant and a line with AR(1) errors: the two parts are solved in turn until they settle."""
    level = {
        "n": "0.0::double AS a, 0.0::double AS b", "c": "cy / cc AS a, 0.0::double AS b", "t": "0.0::double AS a, ty / tt AS b",
        "ct": "(cy * tt - ct * ty) / (cc * tt - ct * ct) AS a, (cc * ty - ct * cy) / (cc * tt - ct * ct) AS b",
    }[trend]
    return f"""WITH RECURSIVE {ONE}, z AS (SELECT series_id, cut AS n, avg(abs(y)) AS s, list(y ORDER BY pos) AS raw FROM fr WHERE pos <= cut GROUP BY 1, 2),
it AS (SELECT series_id, n, s, [v / s for v in raw] AS y, 0 AS k, 0.0::double AS f, 0.0::double AS a, 0.0::double AS b FROM z
    UNION ALL SELECT series_id, n, s, y, k + 1, list_sum([(y[t] - a - b * t) * (y[t - 1] - a - b * (t - 1)) for t in range(2, n + 1)])
        / list_sum([power(y[t - 1] - a - b * (t - 1), 2) for t in range(2, n + 1)]), a, b
    FROM (SELECT series_id, n, s, y, k, {level} FROM (SELECT series_id, n, s, y, k, (n - 1) * (1 - f) * (1 - f) AS cc, (1 - f) * list_sum([t - f * (t - 1) for t in range(2, n + 1)]) AS ct,
        list_sum([power(t - f * (t - 1), 2) for t in range(2, n + 1)]) AS tt, (1 - f) * list_sum([y[t] - f * y[t - 1] for t in range(2, n + 1)]) AS cy,
        list_sum([(t - f * (t - 1)) * (y[t] - f * y[t - 1]) for t in range(2, n + 1)]) AS ty FROM it WHERE k < 60)))
SELECT te.series_id, te.h::integer AS h, te.ts, {R('s * (a + b * (n + te.h) + power(f, te.h) * (it.y[n] - a - b * n))', 1)} AS yhat FROM it JOIN te USING (series_id) WHERE it.k = 60"""


def _add_trend(trend: str) -> None:
    @query(f"arima_trend_{trend}", trend_sql(trend))
    def arima_trend(spark, d):
        return rounded(long(sarima(one_fold(spark, d), "yhat", spec_struct((1, 0, 0)), trend=trend)), 1)


for _trend in ("n", "c", "t", "ct"):
    _add_trend(_trend)


@query(
    "sarima_multiplicative",
    f"""WITH RECURSIVE {ONE}, z AS (SELECT series_id, cut AS n, avg(abs(y)) AS s, list(y ORDER BY pos) AS raw FROM fr WHERE pos <= cut GROUP BY 1, 2),
w AS (SELECT series_id, n, s, raw, [(raw[i] - raw[i - 1]) / s for i in range(2, n + 1)] AS w, n - 1 AS m FROM z),
it AS (SELECT series_id, n, s, raw, w, m, 0 AS k, 0.0::double AS f, 0.0::double AS g FROM w
    UNION ALL SELECT series_id, n, s, raw, w, m, k + 1, list_sum([(w[t] - g * w[t - 12]) * (w[t - 1] - g * w[t - 13]) for t in range(14, m + 1)])
        / list_sum([power(w[t - 1] - g * w[t - 13], 2) for t in range(14, m + 1)]), g
    FROM (SELECT * EXCLUDE g, list_sum([(w[t] - f * w[t - 1]) * (w[t - 12] - f * w[t - 13]) for t in range(14, m + 1)])
        / list_sum([power(w[t - 12] - f * w[t - 13], 2) for t in range(14, m + 1)]) AS g FROM it WHERE k < 200)),
fo AS (SELECT series_id, n, s, f, g, w, raw[n] / s AS u, 0 AS h, []::double[] AS o FROM it WHERE k = 200
    UNION ALL SELECT series_id, n, s, f, g, list_append(w, v), u + v, h + 1, list_append(o, u + v)
    FROM (SELECT *, f * w[len(w)] + g * w[len(w) - 11] - f * g * w[len(w) - 12] AS v FROM fo WHERE h < 12))
SELECT te.series_id, te.h::integer AS h, te.ts, {R('s * o[te.h]', 1)} AS yhat, {R('f', 5)} AS ar_1, {R('g', 5)} AS ar_12, {R('-f * g', 5)} AS ar_13
FROM fo JOIN te USING (series_id) WHERE fo.h = 12""",
)
def sarima_multiplicative(spark, d):
    """(1 - f B)(1 - g B^12) of the differenced series: the cross lag 13 is minus the product."""
    made = sarima(one_fold(spark, d), "yhat", spec_struct((1, 1, 0), (1, 0, 0, 12)), multiplicative=True, keep_fit=True)
    lag = made.select("series_id", *[F.col("yhat_fit.ar")[i].alias(f"ar_{k}") for i, k in enumerate((1, 12, 13))])
    return rounded(rounded(long(made), 1).join(lag, "series_id"), 5, skip=("yhat",))


@query("log_sarima", sarima_sql((1, 12), (1,), True, log=True))
def log_sarima(spark, d):
    return rounded(long(registry.transformed(one_fold(spark, d), "yhat")), 1)


def _grid(spark, d):
    return selection.order_grid(one_fold(spark, d, hold_out=H))


@query("sarima_order_grid")
def sarima_order_grid(spark, d):
    return selection.grid_table(_grid(spark, d))


@query("order_winners")
def order_winners(spark, d):
    return selection.winners_table(_grid(spark, d))


@query("order_winner_diagnostics")
def order_winner_diagnostics(spark, d):
    return selection.winner_diagnostics(_grid(spark, d))


# --- tabular and pooled models -----------------------------------------------------------------

@query("ridge_forecast")
def ridge_forecast(spark, d):
    return long(ridge(one_fold(spark, d, tables.brand_ship_month), "yhat"))


@query("ridge_tuning")
def ridge_tuning(spark, d):
    return selection.tune_ridge(one_fold(spark, d, tables.brand_ship_month, hold_out=H))


@query("forest_forecast")
def forest_forecast(spark, d):
    return long(trees.pooled(one_fold(spark, d, tables.brand_ship_month), "yhat", trees.random_forest(100, 6)))


@query("forest_tuning")
def forest_tuning(spark, d):
    return selection.tune_forest(one_fold(spark, d, tables.orders_nation_month, hold_out=H))


@query("boosted_forecast")
def boosted_forecast(spark, d):
    return long(trees.pooled(one_fold(spark, d, tables.brand_ship_month), "yhat", trees.boosted_trees(100, 3, 0.05)))


@query("boosted_tuning")
def boosted_tuning(spark, d):
    return selection.tune_boosted(one_fold(spark, d, tables.brand_ship_month, hold_out=H))


@query(
    "direct_forecast",
    f"""WITH RECURSIVE {fold_ctes(BRA, 1)}, ar AS (SELECT series_id, cut AS n, min(y) AS lo, CASE WHEN max(y) > min(y) THEN max(y) - min(y) ELSE 1.0 END AS rg, list(y ORDER BY pos) AS raw
        FROM fr WHERE pos <= cut GROUP BY 1, 2),
    zz AS (SELECT series_id, n, lo, rg, [(v - lo) / rg for v in raw] AS z FROM ar),
    dz AS (SELECT h AS gid, list_concat([1.0], z[t - 11 : t]) AS x, z[t + h] AS y FROM (SELECT *, unnest(range(12, n - 11)) AS t FROM zz WHERE n >= 24), range(1, 13) r(h)),
    {solve_sql('dz', 'sd', '0.001 * n')}
    SELECT te.series_id, te.h::integer AS h, te.ts, {R('list_dot_product(beta::double[], list_concat([1.0], z[n - 11 : n])::double[]) * rg + lo', 2)} AS yhat
    FROM (SELECT series_id, zz.n, lo, rg, z, gid, beta FROM zz, sd) JOIN te USING (series_id) WHERE te.h = gid""",
)
def direct_forecast(spark, d):
    return rounded(long(trees.direct(one_fold(spark, d, tables.brand_ship_month), "yhat")), 2)


@query(
    "params_lookup",
    W(NAT)
    + """SELECT series_id, CASE WHEN count(*) >= 80 THEN 200 ELSE 100 END AS n_estimators, CASE WHEN count(*) >= 80 THEN 4 ELSE 3 END AS max_depth,
    0.05::double AS learning_rate FROM p GROUP BY 1""",
)
def params_lookup(spark, d):
    sizes = nation(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    tuned = sizes.filter("n >= 80").select("series_id", F.lit(200).alias("n_estimators"), F.lit(4).alias("max_depth"))
    return selection.with_params(sizes.drop("n"), tuned, {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.05})


# --- whole guarded backtest ----------------------------------------------------------------------

_SUITE = ", ".join(f"'{m}'" for m in BACKTEST_SUITE)


@query(
    "guarded_backtest_metrics",
    f"""WITH {fold_ctes(PRI, 4)}, u AS (SELECT DISTINCT series_id, fold FROM te), m AS (SELECT unnest([{_SUITE}]) AS model)
    SELECT u.series_id, cast(u.fold as integer) AS fold, m.model, 12 AS steps, {R('mae', 2)} AS naive_mae, {R('mase', 4)} AS naive_mase
    FROM u CROSS JOIN m LEFT JOIN mt ON mt.series_id = u.series_id AND mt.fold = u.fold AND mt.model = m.model""",
)
def guarded_backtest_metrics(spark, d):
    """The whole suite over four folds with real pooled fits: every model has all steps of every fold, and the errors of the naive models."""
    folds = splits.packed_folds(tables.orders_priority_month(spark, d))
    rows = backtest.forecast_rows(model_rows(folds, BACKTEST_SUITE, n_folds=4))
    finite = F.col("yhat").isNotNull() & ~F.isnan("yhat")
    steps = rows.groupBy("series_id", "fold", "model").agg(F.count(F.when(finite, 1)).cast("int").alias("steps"))
    naive = backtest.fold_metrics(rows.filter(F.col("model").isin("Naive", "Seasonal Naive")))
    naive = naive.select("series_id", "fold", "model", F.round("mae", 2).alias("naive_mae"), F.round("mase", 4).alias("naive_mase"))
    return steps.join(naive, ["series_id", "fold", "model"], "left")


@query(
    "seeded_backtest_counts",
    f"""WITH {fold_ctes(PRI, 2)}, u AS (SELECT DISTINCT series_id, fold FROM te), m AS (SELECT unnest(['Naive', 'Direct Linear', 'XGBoost', 'XGBoost', 'Random Forest', 'Random Forest']) AS model,
        unnest([NULL, NULL, 42, 0, 42, 0]) AS seed) SELECT model, cast(fold as integer) AS fold, cast(seed as integer) AS seed, count(*) AS fits,
        cast(sum(CASE WHEN model IN ('XGBoost', 'Random Forest') THEN 1 ELSE 0 END) as bigint) AS moved_by_seed FROM u, m GROUP BY ALL""",
)
def seeded_backtest_counts(spark, d):
    """Fits of a backtest: one per fold for deterministic models, one per seed and fold for the others, whose forecasts differ."""
    folds = splits.packed_folds(tables.orders_priority_month(spark, d), n_folds=2)
    rows = model_rows(folds, ("Naive", "Direct Linear", "XGBoost", "Random Forest"), n_folds=2, seeds=(42, 0))
    kinds = F.size(F.collect_set("yhat").over(Window.partitionBy("series_id", "fold", "model")))
    marked = rows.withColumn("kinds", kinds)
    return marked.groupBy("model", "fold", "seed").agg(
        F.count(F.lit(1)).alias("fits"), F.sum(F.when((F.col("kinds") > 1) & F.col("seed").isNotNull(), 1).otherwise(0)).alias("moved_by_seed")
    )


@query(
    "tuned_parameters_in_a_backtest",
    f"""WITH {fold_ctes(NAT, 1)}, u AS (SELECT DISTINCT series_id, cast(fold as integer) AS fold FROM te)
    SELECT series_id, fold, model, model = 'Random Forest' AND cast(series_id as integer) % 5 = 0 OR model = 'Ridge' AND cast(series_id as integer) % 4 = 0 AS is_changed
    FROM u, (SELECT unnest(['Naive', 'Ridge', 'Random Forest']) AS model)""",
)
def tuned_parameters_in_a_backtest(spark, d):
    """Forecasts change for the series with parameters of their own, and for no other."""
    folds = splits.packed_folds(nation(spark, d), n_folds=1)
    named = folds.select("series_id").distinct()
    params = {
        "Random Forest": named.filter("cast(series_id as int) % 5 = 0").select("series_id", F.lit(20).alias("n_estimators"), F.lit(2).alias("max_depth")),
        "Ridge": named.filter("cast(series_id as int) % 4 = 0").select("series_id", F.lit(1000.0).alias("alpha")),
    }
    models = ("Naive", "Ridge", "Random Forest")
    keys = ["series_id", "fold", "model"]
    plain = model_rows(folds, models).select(*keys, F.col("yhat").alias("plain"))
    tuned = model_rows(with_model_params(folds, params), models).select(*keys, "yhat")
    apart = F.exists(F.zip_with("yhat", "plain", lambda a, b: F.abs(a - b) > 1e-9 * F.abs(b)), lambda x: x)
    return plain.join(tuned, keys).select(*keys, apart.alias("is_changed"))


_POWER = "CASE WHEN {l} = 0 THEN ln(v) ELSE (power(v, {l}) - 1) / {l} END"


@query(
    "boxcox_mean_forecast",
    f"""WITH {ONE}, t AS (SELECT series_id, y AS v, y / exp(avg(ln(y)) OVER (PARTITION BY series_id)) AS x FROM fr WHERE pos <= cut),
    c AS (SELECT series_id, i / 100.0::double AS l, -ln(var_pop({_POWER.format(l='(i / 100.0::double)').replace('(v', '(x')})) AS s FROM t, range(-200, 201) r(i) GROUP BY series_id, i),
    c1 AS (SELECT series_id, l AS l0 FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s DESC, l) = 1),
    e AS (SELECT series_id, round(l0 + i / 10000.0::double, 4) AS l FROM c1, range(-100, 101) r(i)),
    f AS (SELECT series_id, l, -ln(var_pop({_POWER.format(l='l').replace('(v', '(x')})) AS s FROM t JOIN e USING (series_id) GROUP BY 1, 2),
    b AS (SELECT series_id, l FROM f QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s DESC, l) = 1),
    z AS (SELECT series_id, any_value(l) AS l, avg({_POWER.format(l='l')}) AS z FROM t JOIN b USING (series_id) GROUP BY 1)
    SELECT te.series_id, te.h::integer AS h, te.ts, {R('CASE WHEN l = 0 THEN exp(z) ELSE power(z * l + 1, 1 / l) END', 0)} AS yhat FROM te JOIN z USING (series_id)""",
)
def boxcox_mean_forecast(spark, d):
    """The mean of the transformed values, each series with its own fitted power, and back."""
    made = registry.transformed(one_fold(spark, d), "yhat", H, registry.extra_forecasters(H)["Mean"], "boxcox")
    return rounded(long(made), 0)


@query("transformed_forecasts")
def transformed_forecasts(spark, d):
    """A transform of every kind around one forecaster."""
    made = one_fold(spark, d, tables.orders_nation_month)
    ridge_of = registry.default_forecasters()["Ridge"]
    for kind in registry.TRANSFORMS:
        made = registry.transformed(made, kind, H, ridge_of, kind)
    rows = made.select("series_id", F.posexplode(F.arrays_zip(*registry.TRANSFORMS)).alias("i", "z"))
    return rows.select("series_id", (F.col("i") + 1).alias("h"), *[F.col(f"z.{k}").alias(k) for k in registry.TRANSFORMS])
