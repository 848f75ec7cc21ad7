"""Rule checks on a cleaned panel, all computed in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import PANEL_COLUMNS

#: Positions compared in one task.
RANGE = 1_000_000

DATE_TYPES = ("date", "timestamp", "timestamp_ntz")


def _bad(rule) -> F.Column:
    return F.sum(F.when(rule, 1).otherwise(0))


def _order_breaks(panel: DataFrame, position: str) -> DataFrame:
    """Count of rows whose date is before the row ahead of it in the series, by an explicit position column.

    Rows are compared within ranges of positions and then at the ranges' ends, so
    no task sees more of a series than one range and one row per range.
    """
    row = panel.select("series_id", "ts", F.col(position).cast("long").alias("_i"))
    ranged = row.withColumn("_range", F.floor(F.col("_i") / RANGE))
    inside = Window.partitionBy("series_id", "_range").orderBy("_i")
    back = ranged.withColumn("_back", (F.lag("ts").over(inside) > F.col("ts")).cast("int"))
    ends = back.groupBy("series_id", "_range").agg(
        F.sum(F.coalesce("_back", F.lit(0))).alias("_inside"),
        F.min_by("ts", "_i").alias("_first"),
        F.max_by("ts", "_i").alias("_last"),
    )
    between = Window.partitionBy("series_id").orderBy("_range")
    seam = F.coalesce((F.lag("_last").over(between) > F.col("_first")).cast("int"), F.lit(0))
    return ends.withColumn("_seam", seam).agg(F.coalesce(F.sum(F.col("_inside") + F.col("_seam")), F.lit(0)).alias("n_bad"))


def validate(panel: DataFrame, position: str | None = None) -> DataFrame:
    """One row per rule: ``check_name, ok, n_bad``.

    A missing column fails the rules that need it instead of raising.  Rows of a
    table have no order of their own, so the order rule needs a ``position`` column
    of the source (a line number, say) and is left out without one.
    """
    types = dict(panel.dtypes)
    have = set(types)
    missing = [c for c in PANEL_COLUMNS if c not in have]
    primary = [c for c in ("series_id", "ts", "y") if c in have]
    rules = {"canonical_columns": F.lit(len(missing))}
    nulls = F.lit(3 - len(primary))
    for c in primary:
        nulls = nulls + _bad(F.col(c).isNull())
    rules["no_null_primary_fields"] = nulls
    if types.get("ts") in DATE_TYPES:
        rules["dates_are_month_starts"] = _bad(F.dayofmonth("ts") != 1)
    else:
        rules["dates_are_month_starts"] = F.count(F.lit(1))
    if {"y", "peak"} <= have:
        rules["averages_not_negative"] = _bad(F.col("y") < 0)
        rules["peak_at_least_average"] = _bad(F.col("peak") < F.col("y"))
    one_pass = panel.agg(*[rule.cast("long").alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_bad")) for n in rules])
    report = one_pass.select(F.explode(pairs).alias("r")).select("r.check_name", "r.n_bad")
    if {"series_id", "ts"} <= have:
        copies = panel.groupBy("series_id", "ts").count().agg(
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_bad")
        )
        report = report.unionByName(copies.select(F.lit("no_duplicate_periods").alias("check_name"), "n_bad"))
    if position is not None and {"series_id", "ts", position} <= have:
        report = report.unionByName(
            _order_breaks(panel, position).select(F.lit("periods_in_order").alias("check_name"), "n_bad")
        )
    return report.select("check_name", (F.col("n_bad") == 0).alias("ok"), "n_bad")


def totals(panel: DataFrame) -> DataFrame:
    """Record count, series count and date range of a panel."""
    return panel.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("series_id").alias("total_series"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("date_max"),
    )


def require_valid(panel: DataFrame, label: str) -> None:
    """Raise when any rule fails; at most one row per rule reaches the driver."""
    failed = validate(panel).filter(~F.col("ok")).collect()
    if failed:
        raise ValueError(f"{label}: " + ", ".join(f"{r.check_name} ({r.n_bad})" for r in failed))
