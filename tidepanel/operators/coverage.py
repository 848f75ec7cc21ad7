"""Gaps, coverage and choice of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import add_periods, in_time, period_step


def missing_periods(panel: DataFrame, freq: str = "month") -> DataFrame:
    """Periods without a row between the first and last row of each series.

    Each row looks back to the previous one and lists the periods in between, so
    no calendar table and no join is needed.
    """
    one = F.lit(1)
    gap = panel.select("series_id", "ts", F.lag("ts").over(in_time()).alias("_prev"))
    gap = gap.filter(F.col("ts") > add_periods(F.col("_prev"), one, freq))
    between = F.sequence(
        add_periods(F.col("_prev"), one, freq), add_periods(F.col("ts"), -one, freq), period_step(freq)
    )
    return gap.select("series_id", F.explode(between).alias("ts"))


def coverage(panel: DataFrame) -> DataFrame:
    """Continuity measures, mean and highest peak per series (monthly panels)."""
    expected = (F.months_between("end_date", "start_date") + 1).cast("int")
    return (
        panel.groupBy("series_id")
        .agg(
            F.min("ts").alias("start_date"),
            F.max("ts").alias("end_date"),
            # A panel is unique on (series, period), so rows are distinct periods.
            F.count("ts").cast("int").alias("total_months"),
            F.round(F.avg("y"), 2).alias("mean_y"),
            F.max("peak").alias("max_peak"),
        )
        .withColumn("expected_months", expected)
        .withColumn("missing_months", F.col("expected_months") - F.col("total_months"))
        .withColumn("span_years", F.round(F.col("total_months") / 12.0, 2))
        .withColumn("is_continuous", F.col("missing_months") == 0)
    )


def ordered_coverage(panel: DataFrame) -> DataFrame:
    return coverage(panel).orderBy(
        F.desc("is_continuous"), F.desc("span_years"), F.desc("mean_y"), F.asc("series_id")
    )


def _judged(summary: DataFrame, min_months: int, min_years: float, max_gaps: int) -> DataFrame:
    short = (F.col("total_months") < min_months) | (F.col("span_years") < min_years)
    gappy = F.col("missing_months") > max_gaps
    return summary.withColumn(
        "reason", F.when(short, "insufficient history").when(gappy, "significant gaps")
    )


def select_series(
    panel: DataFrame,
    candidates: Sequence[str] | None = None,
    min_months: int = 36,
    min_years: float = 3.0,
    max_gaps: int = 2,
    max_series: int | None = 10,
    few: int = 5,
    fill_to: int = 7,
) -> DataFrame:
    """Chosen series with their order: ``series_id, choice_rank, source``.

    Candidates keep their given order (all series in coverage order without a
    list).  With fewer than ``few`` choices, continuous series with enough months
    follow in coverage order until ``fill_to``.  Every ranking is a top-k of at
    most ``max_series + fill_to`` rows, so the global order never meets in one task.
    ``max_series=None`` takes every series that passes; they are not ranked then
    (``choice_rank`` is null) unless a candidate list or too few choices bound them.
    """
    judged = _judged(coverage(panel), min_months, min_years, max_gaps)
    order = [F.desc("is_continuous"), F.desc("span_years"), F.desc("mean_y"), F.asc("series_id")]
    good = judged.filter(F.col("reason").isNull())
    if max_series is None:
        if candidates:
            max_series = len(candidates)
        elif len(good.take(few)) == few:
            return good.select("series_id", F.lit(None).cast("int").alias("choice_rank"), F.lit("candidate").alias("source"))
        else:
            max_series = few
    if candidates:
        given = F.array_position(F.array(*map(F.lit, candidates)), F.col("series_id"))
        good = good.withColumn("_given", given).filter(F.col("_given") > 0)
        first = good.orderBy("_given").limit(max_series)
        rank = F.row_number().over(Window.orderBy("_given"))
    else:
        first = good.orderBy(*order).limit(max_series)
        rank = F.row_number().over(Window.orderBy(*order))
    chosen = first.select("series_id", rank.alias("choice_rank"), F.lit("candidate").alias("source"))
    spare = (
        judged.filter((F.col("total_months") >= min_months) & F.col("is_continuous"))
        .join(chosen.select("series_id"), "series_id", "left_anti")
        .orderBy(*order)
        .limit(fill_to)
    )
    # From here on at most max_series + fill_to rows.
    pool = chosen.unionByName(
        spare.select("series_id", F.row_number().over(Window.orderBy(*order)).alias("choice_rank"), F.lit("fill").alias("source"))
    )
    is_fill = F.col("source") == "fill"
    n_chosen = F.count(F.when(~is_fill, 1)).over(Window.partitionBy())
    pool = pool.withColumn("_n", n_chosen)
    rank = F.when(is_fill, F.col("_n") + F.col("choice_rank")).otherwise(F.col("choice_rank")).cast("int")
    pool = pool.withColumn("choice_rank", rank)
    return pool.filter(~is_fill | ((F.col("_n") < few) & (F.col("choice_rank") <= fill_to))).drop("_n")


def exclusions(panel: DataFrame, min_months: int = 36, min_years: float = 3.0, max_gaps: int = 2) -> DataFrame:
    """Series that fail the selection rules, with the reason."""
    judged = _judged(coverage(panel), min_months, min_years, max_gaps)
    return judged.filter(F.col("reason").isNotNull()).select("series_id", "reason", "total_months", "missing_months")


def rows_of(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen series (semi-join)."""
    return panel.join(chosen.select("series_id"), "series_id", "left_semi")
