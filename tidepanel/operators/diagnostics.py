"""Autocorrelation, residual tests, unit-root and stationarity tests.

All of them work on one packed array per series (``keys`` + ``values``), so a
whole panel needs one shuffle and the tests are projections after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import gram
from tidepanel.functions.stats import array_mean, array_sum, chi2_sf, lagged_products, normal_cdf, normal_ppf

Z95 = 1.959963984540054

# KPSS critical values at p = .10, .05, .025, .01 (Kwiatkowski et al. 1992).
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}

# MacKinnon response surfaces for the unit-root test with constant
# (p-value polynomials 1994, lowest power first; critical values 2010).
ADF_TAU_MIN, ADF_TAU_STAR, ADF_TAU_MAX = -18.83, -1.61, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def pack_values(rows: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "y", order: str = "ts") -> DataFrame:
    """Ordered finite values per key as ``values``; nulls, NaN and infinities are dropped."""
    finite = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return finite.groupBy(*keys).agg(packed.alias("_r")).select(*keys, F.col("_r.v").alias("values"))


def with_centred(frame: DataFrame, values: str = "values") -> DataFrame:
    """Add ``_mean``, the centred values ``_c`` and their sum of squares ``_g0``.

    Each is a column read more than once by the next step, so Spark computes it
    once per row instead of once per element inside a lambda.
    """
    made = frame.withColumn("_mean", array_mean(F.col(values)))
    centred = F.transform(values, lambda x: x - F.col("_mean"))
    made = made.withColumn("_c", F.when(F.col("_mean").isNotNull(), centred))
    return made.withColumn("_g0", F.when(F.size("_c") > 0, lagged_products(F.col("_c"), F.lit(0))))


def acf_array(nlags: Column) -> Column:
    """Autocorrelations at lags 0..nlags of a frame from ``with_centred``."""
    c = F.col("_c")
    r = F.transform(F.sequence(F.lit(0), nlags), lambda k: lagged_products(c, k) / F.col("_g0"))
    return F.when(F.col("_g0") > 0, r)


def usable_lags(values: Column, nlags: int) -> Column:
    return F.least(F.lit(nlags), (F.floor(F.size(values) / 2) - 1).cast("int"))


def acf(packed: DataFrame, nlags: int = 24, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Autocorrelation per lag with Bartlett bounds; series too short for one lag give no rows."""
    usable = with_centred(packed.withColumn("_k", usable_lags(F.col("values"), nlags)).filter("_k >= 1"))
    long = usable.select(*keys, F.size("values").alias("n"), F.posexplode(acf_array(F.col("_k"))).alias("lag", "acf"))
    before = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    # Lag 0 is exact; later variances use the squares of lags 1..k-1.
    squares = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(0.0)).over(before)
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z95 * F.sqrt((1 + 2 * squares) / F.col("n")))
    return long.select(*keys, "lag", "acf", (F.col("acf") - half).alias("low"), (F.col("acf") + half).alias("high"))


def _levinson(s: Column, out: Column) -> Column:
    a = F.element_at(out, -1)
    kept = F.zip_with(s["phi"], F.reverse(s["phi"]), lambda p, q: p - a * q)
    return F.struct(F.array_append(kept, a).alias("phi"), (s["v"] * (1 - a * a)).alias("v"), out.alias("out"))


def pacf_array(r: Column) -> Column:
    """Partial autocorrelations by the Durbin-Levinson recursion on autocorrelations ``r[0..K]``."""
    start = F.struct(
        F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("out")
    )

    def reflect(s: Column, k: Column) -> Column:
        terms = F.transform(s["phi"], lambda p, j: p * F.element_at(r, (k - j).cast("int")))
        return F.try_divide(F.element_at(r, (k + 1).cast("int")) - array_sum(terms), s["v"])

    def step(s: Column, k: Column) -> Column:
        # The new coefficient is appended first and then read back from the output array.
        out = F.array_append(s["out"], reflect(s, k))
        moved = F.transform(F.array(F.struct(out.alias("out"))), lambda o: _levinson(s, o["out"]))
        return F.element_at(moved, 1)

    return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, step, lambda s: s["out"])


def pacf(packed: DataFrame, nlags: int = 24, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Yule-Walker partial autocorrelation per lag with bounds of +-z/sqrt(n)."""
    usable = with_centred(packed.withColumn("_k", usable_lags(F.col("values"), nlags)).filter("_k >= 1"))
    usable = usable.withColumn("_r", acf_array(F.col("_k"))).filter(F.size("_r") > 1)
    long = usable.select(*keys, F.size("values").alias("n"), F.posexplode(pacf_array(F.col("_r"))).alias("lag", "pacf"))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z95 / F.sqrt(F.col("n").cast("double")))
    return long.select(*keys, "lag", "pacf", (F.col("pacf") - half).alias("low"), (F.col("pacf") + half).alias("high"))


# --- residual tests --------------------------------------------------------------------------

def with_ljung_box(frame: DataFrame, lags: int | Sequence[int] = 12) -> DataFrame:
    """Add ``lb_lags``, ``lb_stat`` and ``lb_p`` arrays to a frame from ``with_centred``."""
    c = F.col("_c")
    n = F.size(c)
    wanted = [lags] if isinstance(lags, int) else list(lags)
    cap = F.greatest(F.lit(1), F.least(F.lit(max(wanted)), (F.floor(n / 2) - 1).cast("int")))
    if isinstance(lags, int):
        used = F.array(cap)
    else:
        inside = F.filter(F.array(*map(F.lit, wanted)), lambda k: k <= cap)
        used = F.when(F.size(inside) > 0, inside).otherwise(F.array(cap))

    def statistic(m: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(1), m), lambda k: F.pow(lagged_products(c, k) / F.col("_g0"), F.lit(2.0)) / (n - k))
        return n * (n + 2) * array_sum(terms)

    made = frame.withColumn("lb_lags", used)
    made = made.withColumn("lb_stat", F.when(F.col("_g0") > 0, F.transform("lb_lags", statistic)))
    return made.withColumn("lb_p", F.zip_with("lb_stat", "lb_lags", chi2_sf))


def residual_tests(packed: DataFrame, lags: int | Sequence[int] = 12, alpha: float = 0.05, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Ljung-Box, Jarque-Bera, Durbin-Watson and moments of residuals; needs 10 values."""
    v, d = F.col("values"), F.col("_c")
    n = F.size(v)
    power = lambda p: array_sum(F.transform(d, lambda x: F.pow(x, F.lit(float(p))))) / n
    steps = F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda a, b: (a - b) * (a - b))
    made = with_ljung_box(with_centred(packed.filter(n >= 10)), lags)
    made = made.withColumn("_m2", power(2)).withColumn("_m3", power(3)).withColumn("_m4", power(4))
    out = made.select(
        *keys,
        n.alias("n"),
        F.col("_mean").alias("mean"),
        F.sqrt(F.col("_m2") * n / (n - 1)).alias("std"),
        (array_sum(steps) / array_sum(F.transform(v, lambda x: x * x))).alias("durbin_watson"),
        (F.col("_m3") / F.pow(F.col("_m2"), F.lit(1.5))).alias("skew"),
        (F.col("_m4") / (F.col("_m2") * F.col("_m2"))).alias("kurtosis"),
        "lb_lags", "lb_stat", "lb_p",
    )
    jb = F.col("n") / 6.0 * (F.pow("skew", F.lit(2.0)) + F.pow(F.col("kurtosis") - 3, F.lit(2.0)) / 4)
    out = out.withColumn("jb_stat", jb).withColumn("jb_p", F.exp(-F.col("jb_stat") / 2))
    out = out.withColumn("is_normal", F.col("jb_p") >= alpha).withColumn("lb_min_p", F.array_min("lb_p"))
    return out.withColumn("is_white_noise", F.col("lb_min_p") >= alpha)


def residual_panel(residuals: DataFrame, bins: int = 15) -> dict[str, DataFrame]:
    """Tables behind the four residual charts: standardised residuals, density, Q-Q pairs, ACF.

    ``residuals`` has ``series_id, ts, resid``.
    """
    whole = Window.partitionBy("series_id")
    r = residuals.filter(F.col("resid").isNotNull())
    z = r.withColumn("z", F.try_divide(F.col("resid") - F.avg("resid").over(whole), F.stddev_samp("resid").over(whole)))
    lo, hi = F.min("resid").over(whole), F.max("resid").over(whole)
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col("resid") - lo) / width) + 1, F.lit(bins)).cast("int")
    binned = r.select("series_id", "resid", slot.alias("bin"), width.alias("width"), lo.alias("lo"), F.count(F.lit(1)).over(whole).alias("n"))
    density = binned.groupBy("series_id", "bin").agg(
        (F.count(F.lit(1)) / (F.first("n") * F.first("width"))).alias("density"),
        (F.first("lo") + (F.col("bin") - 1) * F.first("width")).alias("bin_start"),
    )
    order = F.row_number().over(whole.orderBy("resid", "ts"))
    n = F.count(F.lit(1)).over(whole)
    # Filliben's positions: the ends are the medians of the extreme order statistics.
    end = F.pow(F.lit(0.5), 1.0 / n)
    place = F.when(order == n, end).when(order == 1, 1 - end).otherwise((order - 0.3175) / (n + 0.365))
    qq = r.select("series_id", F.col("resid").alias("sample"), place.alias("_p")).select(
        "series_id", "sample", normal_ppf(F.col("_p")).alias("theoretical")
    )
    packed = pack_values(r, value="resid")
    lines = acf(packed, 24).join(packed.select("series_id", F.size("values").alias("n")), "series_id")
    bound = F.lit(1.96) / F.sqrt(F.col("n").cast("double"))
    return {
        "standardised": z.select("series_id", "ts", "resid", "z"),
        "density": density,
        "qq": qq,
        "acf": lines.select("series_id", "lag", "acf", (-bound).alias("low"), bound.alias("high")),
    }


# --- stationarity ----------------------------------------------------------------------------

def kpss(packed: DataFrame, regression: str = "c", alpha: float = 0.05, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Level (``c``) or trend (``ct``) stationarity test with the automatic lag of Hobijn et al."""
    if regression not in KPSS_CRITICAL:
        raise ValueError(f"unknown regression {regression!r}")
    base = with_centred(packed.filter(F.size("values") >= 15)).withColumn("n", F.size("values"))
    n = F.col("n").cast("double")
    if regression == "ct":
        cross = array_sum(F.transform("_c", lambda x, i: x * (i + 1 - (F.col("n") + 1) / 2)))
        base = base.withColumn("_slope", cross / (n * (n * n - 1) / 12))
        line = F.transform("_c", lambda x, i: x - F.col("_slope") * (i + 1 - (F.col("n") + 1) / 2))
        base = base.withColumn("_c", F.when(F.col("_slope").isNotNull(), line))
        base = base.withColumn("_g0", F.when(F.size("_c") > 0, lagged_products(F.col("_c"), F.lit(0))))
    e = F.col("_c")
    m = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
    base = base.withColumn("_near", F.transform(F.sequence(F.lit(1), m), lambda i: lagged_products(e, i) * 2 / n))
    s0 = F.col("_g0") / n + array_sum(F.col("_near"))
    s1 = array_sum(F.transform("_near", lambda g, i: g * (i + 1)))
    base = base.withColumn("_ratio", s1 / s0)
    gamma = 1.1447 * F.pow(F.col("_ratio") * F.col("_ratio"), F.lit(1.0 / 3.0))
    base = base.withColumn("lags_used", F.least(F.floor(gamma * F.pow(n, F.lit(1.0 / 3.0))).cast("int"), F.col("n") - 1))
    tail = F.aggregate(
        F.sequence(F.lit(0), F.col("lags_used")),
        F.lit(0.0),
        lambda a, i: a + F.when(i > 0, 2 * lagged_products(e, i) * (1 - i / (F.col("lags_used") + 1.0))).otherwise(0.0),
    )
    variance = (F.col("_g0") + tail) / n
    run = F.aggregate(
        e,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + (a["s"] + x) * (a["s"] + x)).alias("q")),
        lambda a: a["q"],
    )
    stat = run / (n * n * variance)
    out = base.select(*keys, "n", "lags_used", stat.alias("statistic"))
    crit = KPSS_CRITICAL[regression]
    p = F.when(F.col("statistic") <= crit[0], KPSS_P[0])
    for (c0, p0), (c1, p1) in zip(zip(crit, KPSS_P), list(zip(crit, KPSS_P))[1:]):
        p = p.when(F.col("statistic") <= c1, p0 + (F.col("statistic") - c0) * ((p1 - p0) / (c1 - c0)))
    out = out.withColumn("p_value", F.when(F.col("statistic").isNotNull(), p.otherwise(KPSS_P[-1])))
    return out.withColumn("is_stationary", F.col("p_value") >= alpha)


def _adf_columns(scaled: Column, steps: Column, first: Column, used: Column) -> Column:
    """Columns 1, y[t-1], dy[t-1], ..., dy[t-used], dy[t] for t > first; ``steps`` holds dy from the second value on."""
    m = F.size(scaled) - first
    lagged = F.transform(F.slice(F.sequence(F.lit(0), used), F.lit(2), used), lambda k: F.slice(steps, first - k, m))
    return F.concat(F.array(F.array_repeat(F.lit(1.0), m), F.slice(scaled, first, m)), lagged, F.array(F.slice(steps, first, m)))


def adf(packed: DataFrame, alpha: float = 0.05, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Augmented Dickey-Fuller test with constant, lag order by AIC; needs 15 values.

    A series is reduced to the sums of products of the sample that all lag orders share; one factor of that matrix
    solves them all.  The best order is solved on its own, longer sample, whose few more rows come from the first
    values.  The statistic does not change with the level and unit of the values, so they are centred and scaled first.
    """
    v = F.col("values")
    n = F.size(v)
    top = F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))).cast("int")
    top = F.least(top, (F.floor(n / 2) - 2).cast("int"))
    centre = array_sum(v) / n
    spread = F.sqrt(array_sum(F.transform(v, lambda x: (x - F.col("_centre")) * (x - F.col("_centre")))) / n)
    base = packed.filter(n >= 15).select(*keys, "values", top.alias("_top"), centre.alias("_centre")).withColumn("_spread", spread)
    unit = F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(1.0)
    base = base.withColumn("_y", F.transform(v, lambda x: (x - F.col("_centre")) / unit))
    m = F.size("_y") - 1
    steps = F.zip_with(F.slice("_y", F.lit(2), m), F.slice("_y", F.lit(1), m), lambda a, b: a - b)
    base = base.select(*keys, "_top", "_y", steps.alias("_d"))
    top = F.col("_top")
    common = gram.products(_adf_columns(F.col("_y"), F.col("_d"), top + 1, top))
    reduced = base.select(*keys, common.alias("_gram"), F.slice("_y", F.lit(1), top + 1).alias("_head"), F.size("_y").alias("_n"))
    made = reduced.withColumn("_fit", gram.unit_root(F.col("_gram"), F.col("_head"), F.col("_n")))
    out = made.select(*keys, "_fit.lags_used", "_fit.n_obs", "_fit.statistic")
    t = F.col("statistic")

    def poly(coefs: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for c in reversed(coefs):
            total = total * t + F.lit(c)
        return total

    p = (
        F.when(t > ADF_TAU_MAX, 1.0)
        .when(t < ADF_TAU_MIN, 0.0)
        .when(t <= ADF_TAU_STAR, normal_cdf(poly(ADF_SMALL_P)))
        .when(t.isNotNull(), normal_cdf(poly(ADF_LARGE_P)))
    )
    size = F.col("n_obs").cast("double")
    crits = [
        (b[0] + b[1] / size + b[2] / F.pow(size, F.lit(2.0)) + b[3] / F.pow(size, F.lit(3.0))).alias(name)
        for name, b in ADF_CRITICAL.items()
    ]
    return out.select("*", p.alias("p_value"), *crits).withColumn("is_stationary", F.col("p_value") < alpha)


def stationarity(packed: DataFrame, alpha: float = 0.05, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Both tests side by side with the joint verdict."""
    a = adf(packed, alpha, keys).select(
        *keys, F.col("statistic").alias("adf_stat"), F.col("p_value").alias("adf_p"),
        F.col("lags_used").alias("adf_lags"), F.col("is_stationary").alias("adf_stationary"),
    )
    k = kpss(packed, "c", alpha, keys).select(
        *keys, F.col("statistic").alias("kpss_stat"), F.col("p_value").alias("kpss_p"),
        F.col("lags_used").alias("kpss_lags"), F.col("is_stationary").alias("kpss_stationary"),
    )
    both = a.join(k, list(keys))
    x, y = F.col("adf_stationary"), F.col("kpss_stationary")
    # The four verdict texts.
    verdict = (
        F.when(x & y, "Stationary (both tests agree)")
        .when(~x & ~y, "Non-Stationary (Unit Root; both tests agree)")
        .when(x & ~y, "Difference / Trend Stationary (ADF stationary, KPSS rejects)")
        .when(~x & y, "Ambiguous / Strict Stationarity (ADF fails to reject, KPSS fails to reject)")
    )
    return both.withColumn("conclusion", verdict).withColumn("is_stationary", x & y)


def stationarity_table(panel: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The verdict for each series as observed and after one difference."""
    from tidepanel.operators.transforms import difference

    raw = panel.select("series_id", F.lit("raw").alias("variant"), "ts", "y")
    diff = difference(panel, 1, drop_null=True).select(
        "series_id", F.lit("first difference").alias("variant"), "ts", F.col("y_diff").alias("y")
    )
    keys = ("series_id", "variant")
    return stationarity(pack_values(raw.unionByName(diff), keys), alpha, keys)
