"""Distribution tails and small array statistics as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile (P. J. Acklam).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0)
PPF_LOW = 0.02425

# Complementary error function, Chebyshev fit (Numerical Recipes erfcc).
ERFC_COEFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _horner(coefs: tuple[float, ...], x: Column) -> Column:
    """Polynomial with the highest power first."""
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function, relative error below 1.2e-7."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    value = t * F.exp(-z * z + _horner(ERFC_COEFS[::-1], t))
    return F.when(x >= 0, value).otherwise(2.0 - value)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / F.lit(2.0**0.5))


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function on (0, 1)."""
    q = p - 0.5
    r = q * q
    central = _horner(PPF_A, r) * q / _horner(PPF_B, r)

    def outer(tail: Column) -> Column:
        u = F.sqrt(-2.0 * F.ln(tail))
        return _horner(PPF_C, u) / _horner(PPF_D, u)

    return (
        F.when(p < PPF_LOW, outer(p))
        .when(p > 1 - PPF_LOW, -outer(1.0 - p))
        .when((p > 0) & (p < 1), central)
    )


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper chi-square tail for integer degrees of freedom (closed forms)."""
    half = x / 2.0
    even = F.exp(-half) * F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(df / 2).cast("int"), F.lit(1))),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * half / k).alias("t")),
        lambda a: a["s"],
    )
    # Odd: erfc term plus the half-integer series x^(k-1/2) / Gamma(k+1/2).
    first = F.exp(-half) * F.sqrt(half) / F.lit(0.5 * 3.141592653589793**0.5)
    odd = erfc(F.sqrt(half)) + F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2).cast("int"), F.lit(1))),
        F.struct(F.lit(0.0).alias("s"), first.alias("t")),
        lambda a, k: F.struct(
            (a["s"] + F.when(k <= (df - 1) / 2, a["t"]).otherwise(0.0)).alias("s"),
            (a["t"] * half / (k + 0.5)).alias("t"),
        ),
        lambda a: a["s"],
    )
    return F.when(x <= 0, 1.0).otherwise(F.when(df % 2 == 0, even).otherwise(odd))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student p-value for integer df (Abramowitz & Stegun 26.7.3-4)."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(theta), 2)

    def series(count: Column, numerator, denominator) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1))),
            F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
            lambda a, k: F.struct(
                (a["s"] + F.when(k <= count, a["t"]).otherwise(0.0)).alias("s"),
                (a["t"] * cos2 * numerator(k) / denominator(k)).alias("t"),
            ),
            lambda a: a["s"],
        )

    odd_sum = series((df - 1) / 2, lambda k: 2.0 * k, lambda k: 2.0 * k + 1.0)
    even_sum = series(df / 2, lambda k: 2.0 * k - 1.0, lambda k: 2.0 * k)
    odd = 2.0 / F.pi() * (theta + F.sin(theta) * F.cos(theta) * odd_sum)
    even = F.sin(theta) * even_sum
    inside = F.when(df % 2 == 1, odd).otherwise(even)
    return F.greatest(F.lit(0.0), 1.0 - inside)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def lagged_products(values: Column, lag: Column) -> Column:
    """Sum of ``values[t] * values[t - lag]`` over an array."""
    n = F.size(values)
    return F.when(
        n > lag,
        array_sum(F.zip_with(F.slice(values, lag + 1, n - lag), F.slice(values, 1, n - lag), lambda a, b: a * b)),
    ).otherwise(0.0)
