"""Binding of fact tables to the panel contract.

Each binding aggregates the fact table to one row per (series, period).  The
mean is an exact decimal sum over a count, so the result does not depend on the
order in which partial sums are merged (retries and skew splits included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def period_start(ts: Column, freq: str) -> Column:
    if freq == "month":
        return F.trunc(ts.cast("date"), "MM")
    if freq == "day":
        return ts.cast("date")
    if freq == "hour":
        return F.date_trunc("hour", ts).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


def period_panel(
    facts: DataFrame,
    series: str,
    ts: str,
    value: str,
    freq: str = "month",
    dimension: DataFrame | None = None,
    link: tuple[str, str] | None = None,
    scale: int = 6,
) -> DataFrame:
    """Panel ``series_id, ts, y, peak`` of the period mean and maximum of ``value``.

    With a ``dimension`` table, ``series`` names a column of it and ``link`` is the
    (fact column, dimension key).  The facts are then pre-aggregated per link key
    and period before the join, so a key holding a large share of all rows is
    combined on the map side and reaches the join as at most one row per period.
    Decimal values keep their own type; others are summed with ``scale`` decimals
    and 18 digits before the point.
    """
    own = dict(facts.dtypes)[value]
    exact = F.col(value) if own.startswith("decimal") else F.col(value).cast(f"decimal({18 + scale},{scale})")
    row = facts.select(
        F.col(link[0] if link else series).alias("_key"),
        period_start(F.col(ts), freq).alias("ts"),
        exact.alias("_v"),
    ).filter(F.col("ts").isNotNull() & F.col("_v").isNotNull())
    part = row.groupBy("_key", "ts").agg(
        F.sum("_v").alias("_s"), F.count("_v").alias("_n"), F.max("_v").alias("_m")
    )
    if dimension is not None:
        names = dimension.select(F.col(link[1]).alias("_key"), F.col(series).alias("series_id"))
        part = (
            part.join(names, "_key")
            .groupBy("series_id", "ts")
            .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.max("_m").alias("_m"))
        )
    else:
        part = part.withColumnRenamed("_key", "series_id")
    return part.filter(F.col("series_id").isNotNull()).select(
        F.col("series_id").cast("string").alias("series_id"),
        "ts",
        (F.col("_s").cast("double") / F.col("_n")).alias("y"),
        F.col("_m").cast("double").alias("peak"),
    )


def orders_priority_month(spark: SparkSession, folder: str) -> DataFrame:
    return period_panel(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def orders_nation_month(spark: SparkSession, folder: str) -> DataFrame:
    return period_panel(
        table(spark, folder, "orders"), "c_nationkey", "o_orderdate", "o_totalprice",
        dimension=table(spark, folder, "customer"), link=("o_custkey", "c_custkey"),
    )


def brand_ship_month(spark: SparkSession, folder: str) -> DataFrame:
    return period_panel(
        table(spark, folder, "lineitem"), "p_brand", "l_shipdate", "l_extendedprice",
        dimension=table(spark, folder, "part"), link=("l_partkey", "p_partkey"),
    )


def events_period(spark: SparkSession, folder: str, freq: str) -> DataFrame:
    return period_panel(table(spark, folder, "events"), "event_type", "ts", "value", freq=freq)


def raw_scrape(spark: SparkSession, folder: str) -> DataFrame:
    """The priority panel rendered as a messy all-text table.

    Aliased headers, three date formats, thousands commas, signs, placeholders,
    padded names, duplicate months and marker rows that are no month at all.
    """
    panel = orders_priority_month(spark, folder)
    cents = F.floor(F.col("y") * 100).cast("long")
    whole = F.floor(F.col("peak")).cast("long")
    m = F.month("ts")
    base = panel.select(
        F.concat(F.lit("  "), "series_id", F.lit(" ")).alias("gamename"),
        F.when(m % 3 == 0, F.date_format("ts", "MMMM yyyy"))
        .when(m % 3 == 1, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "MMM yyyy"))
        .alias("month"),
        F.concat(
            F.format_number(F.floor(cents / 100), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
        ).alias("Avg. Players"),
        F.when(m % 4 == 0, F.lit("-")).otherwise(F.lit("+1,234.50")).alias("gain"),
        F.when(m % 4 == 0, F.lit("-")).otherwise(F.lit("+2.45%")).alias("% gain"),
        F.when(m % 5 == 0, F.lit("NA")).otherwise(F.format_number(whole, 0)).alias("peak"),
        m.alias("_m"),
    )
    double = base.filter(F.col("_m") == 3).withColumn("peak", F.lit("15"))
    marker = F.try_element_at(F.array(*map(F.lit, ("Last 30 Days", "All Time", "Invalid Date String", "Total"))), F.col("_m"))
    markers = base.filter(F.col("_m") <= 4).withColumn("month", marker)
    return base.unionByName(double).unionByName(markers).drop("_m")
