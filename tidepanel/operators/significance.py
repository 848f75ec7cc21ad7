"""Bootstrap intervals and paired tests over (series, fold) units."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.stats import array_mean, lagged_products, normal_cdf, t_two_sided


# Upper ends of the Poisson(1) distribution, in parts of 2^32, for the weights 0, 1, 2, ...
POISSON_ENDS = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(9))


def _weight(replicate: Column, unit: Column, seed: int) -> Column:
    """Poisson(1) weight of a unit in a replicate from a hash, so every retry of a task draws the same."""
    text = F.concat_ws("|", replicate.cast("string"), unit, F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    weight = F.when(u < POISSON_ENDS[0], 0)
    for k, end in enumerate(POISSON_ENDS[1:], 1):
        weight = weight.when(u < end, k)
    return weight.otherwise(len(POISSON_ENDS))


def bootstrap_means(
    units: DataFrame, keys: Sequence[str], unit: Column, value: str, n_boot: int = 5000, seed: int = 0
) -> DataFrame:
    """Mean of every Poisson resample: ``keys, b, boot_mean`` (null where no unit was drawn).

    Each unit has a hashed Poisson(1) weight in each replicate, so a resample is a
    weighted mean: its sums combine on the map side, and nothing is joined, numbered
    or gathered, whatever the number of units.
    """
    keys = list(keys)
    rows = units.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), unit.alias("_u"))
    draws = rows.select(*keys, "_v", "_u", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    draws = draws.select(*keys, "b", "_v", _weight(F.col("b"), F.col("_u"), seed).alias("_w")).filter("_w > 0")
    return draws.groupBy(*keys, "b").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("boot_mean"))


def bootstrap_ci(
    units: DataFrame, keys: Sequence[str], unit: Column, value: str,
    n_boot: int = 5000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Mean and percentile interval of the mean per key (``n_boot`` values per percentile)."""
    ends = F.percentile("boot_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    ci = bootstrap_means(units, keys, unit, value, n_boot, seed).groupBy(*keys).agg(ends.alias("_e"))
    whole = units.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n_units"))
    return whole.join(ci, list(keys)).select(
        *keys, "mean", F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"), "n_units"
    )


def paired_bootstrap(
    diffs: DataFrame, keys: Sequence[str], unit: Column, value: str = "diff",
    n_boot: int = 5000, alpha: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Mean difference, interval and two-sided p per pair."""
    below = F.avg((F.col("boot_mean") <= 0).cast("int"))
    above = F.avg((F.col("boot_mean") >= 0).cast("int"))
    ends = F.percentile("boot_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    boot = bootstrap_means(diffs, keys, unit, value, n_boot, seed).groupBy(*keys).agg(
        ends.alias("_e"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("boot_p")
    )
    whole = diffs.groupBy(*keys).agg(F.avg(value).alias("mean_diff"), F.count(value).alias("n_units"))
    return whole.join(boot, list(keys)).select(
        *keys, "mean_diff", F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"), "boot_p", "n_units"
    )


def diebold_mariano(losses: DataFrame, keys: Sequence[str], h: int = 12, correct: bool = True) -> DataFrame:
    """``keys, n, mean_diff, statistic, p_value`` from an ordered array ``d`` of loss differences per key.

    Long-run variance with Bartlett weights to lag ``h - 1``; with the small-sample
    factor the p-value is Student-t on n - 1 degrees of freedom.  Without variance the p-value is 1 for equal losses and null otherwise.
    """
    base = losses.select(*keys, "d", F.size("d").alias("n"), array_mean(F.col("d")).alias("mean_diff"))
    c = F.transform("d", lambda x: x - F.col("mean_diff"))
    base = base.withColumn("_c", F.when(F.col("mean_diff").isNotNull(), c))
    lags = F.filter(F.sequence(F.lit(0), F.lit(h - 1)), lambda k: k < F.col("n"))
    weight = lambda k: F.when(k == 0, 1.0).otherwise(2 * (1 - k / float(h)))
    total = F.aggregate(lags, F.lit(0.0), lambda a, k: a + weight(k) * lagged_products(F.col("_c"), k))
    parts = base.select(*keys, "n", "mean_diff", F.when(F.size("_c") >= 2, total / F.col("n")).alias("lrv"))
    n = F.col("n")
    raw = F.col("mean_diff") / F.sqrt(F.when(F.col("lrv") > 1e-15, F.col("lrv")) / n)
    factor = (n + 1 - 2 * h + h * (h - 1) / n) / n
    stat = F.when(factor > 0, raw * F.sqrt(F.greatest(factor, F.lit(0.0)))) if correct else raw
    out = parts.withColumn("statistic", stat)
    tail = t_two_sided(F.col("statistic"), n - 1) if correct else 2 * (1 - normal_cdf(F.abs("statistic")))
    p = F.when(F.col("statistic").isNotNull(), tail).when(
        (F.col("lrv") <= 1e-15) & (F.abs("mean_diff") < 1e-12), 1.0
    )
    return out.withColumn("p_value", p).drop("lrv")
