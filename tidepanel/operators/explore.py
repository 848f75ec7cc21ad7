"""Tables behind exploratory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import in_time
from tidepanel.operators.quantiles import exact_percentiles


def indexed_growth(panel: DataFrame) -> DataFrame:
    """Value relative to the first observation, base 100."""
    return panel.withColumn("growth_index", F.try_divide(F.col("y"), F.first("y").over(in_time())) * 100)


def peak_ratio(panel: DataFrame) -> DataFrame:
    """Mean peak-to-average ratio per series, the average floored at 1."""
    ratio = F.col("peak") / F.greatest(F.col("y"), F.lit(1.0))
    return panel.groupBy("series_id").agg(F.avg(ratio).alias("mean_ratio"), F.max(ratio).alias("max_ratio"))


def seasonal_deviation(panel: DataFrame) -> DataFrame:
    """Percent deviation of each value from the mean of its series and year."""
    year_mean = F.avg("y").over(Window.partitionBy("series_id", "year"))
    dated = panel.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    return dated.withColumn("deviation_pct", F.try_divide(F.col("y") - year_mean, year_mean) * 100)


def month_quartiles(panel: DataFrame) -> DataFrame:
    """Box-plot numbers of the seasonal deviation per calendar month over all series."""
    dev = seasonal_deviation(panel).select("month", "deviation_pct")
    q = exact_percentiles(dev, ["month"], "deviation_pct", (0.25, 0.5, 0.75))
    fence = 1.5 * (F.col("q")[2] - F.col("q")[0])
    low, high = F.col("q")[0] - fence, F.col("q")[2] + fence
    inside = F.col("deviation_pct").between(low, high)
    return (
        dev.join(q, "month")
        .groupBy("month")
        .agg(
            F.first(F.col("q")[0]).alias("q1"),
            F.first(F.col("q")[1]).alias("median"),
            F.first(F.col("q")[2]).alias("q3"),
            F.min(F.when(inside, F.col("deviation_pct"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("deviation_pct"))).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("n_outliers"),
        )
    )


def seasonal_profile(panel: DataFrame) -> DataFrame:
    """Mean value per series and calendar month."""
    return panel.groupBy("series_id", F.month("ts").alias("month")).agg(F.avg("y").alias("mean_y"))


def seasonal_subseries(panel: DataFrame) -> DataFrame:
    """Values of each calendar month by year, next to the mean of that month."""
    dated = panel.select("series_id", F.month("ts").alias("month"), F.year("ts").alias("year"), "y")
    return dated.withColumn("month_mean", F.avg("y").over(Window.partitionBy("series_id", "month")))


def series_overview(panel: DataFrame) -> DataFrame:
    """Span, size, mean, highest peak and latest value per series, longest first."""
    return (
        panel.groupBy("series_id")
        .agg(
            F.min("ts").alias("first_period"),
            F.max("ts").alias("last_period"),
            F.count("y").alias("n"),
            F.avg("y").alias("mean_y"),
            F.max("peak").alias("max_peak"),
            F.max_by("y", "ts").alias("latest_y"),
        )
        .orderBy(F.desc("n"), "series_id")
    )


def series_profile(panel: DataFrame) -> DataFrame:
    """Size, span, mean, highest peak and sample deviation per series."""
    return panel.groupBy("series_id").agg(
        F.count("y").alias("n"),
        F.min("ts").alias("first_period"),
        F.max("ts").alias("last_period"),
        F.avg("y").alias("mean_y"),
        F.max("peak").alias("max_peak"),
        F.stddev_samp("y").alias("std_y"),
    )


def recent_history(panel: DataFrame, k: int = 12) -> DataFrame:
    """Latest ``k`` rows of each series."""
    if not 1 <= k:
        raise ValueError("k must be at least 1")
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ts")))
    return panel.withColumn("rows_back", back).filter(F.col("rows_back") <= k)
