"""Chronological splits and rolling folds; all positional within a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON, SEASON, in_time


def with_position(panel: DataFrame) -> DataFrame:
    """Add 1-based ``pos`` and series length ``n``."""
    return panel.withColumn("pos", F.row_number().over(in_time())).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    )


def split_rows(panel: DataFrame, val: int = 12, test: int = 12) -> DataFrame:
    """Label each row ``train``, ``val`` or ``test``; series without a train row are dropped."""
    if val < 0 or test < 0:
        raise ValueError("split sizes must not be negative")
    label = (
        F.when(F.col("pos") > F.col("n") - test, "test")
        .when(F.col("pos") > F.col("n") - test - val, "val")
        .otherwise("train")
    )
    return with_position(panel).filter(F.col("n") >= val + test + 1).withColumn("split", label)


def split_summary(labelled: DataFrame) -> DataFrame:
    """Sizes and boundary dates of the three parts per series."""
    parts = []
    for part in ("train", "val", "test"):
        inside = F.col("split") == part
        parts += [
            F.count(F.when(inside, 1)).alias(f"{part}_n"),
            F.min(F.when(inside, F.col("ts"))).alias(f"{part}_start"),
            F.max(F.when(inside, F.col("ts"))).alias(f"{part}_end"),
        ]
    return labelled.groupBy("series_id").agg(*parts)


def expanding_folds(panel: DataFrame, n_splits: int = 3, horizon: int = 12, min_train: int = 24) -> DataFrame:
    """Expanding-window cross-validation rows: window k trains on everything before it."""
    rows = with_position(panel).filter(F.col("n") >= min_train + n_splits * horizon)
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    end = F.col("n") - (n_splits - F.col("fold")) * horizon
    role = F.when(F.col("pos") <= end, "train").when(F.col("pos") <= end + horizon, "test")
    return rows.withColumn("role", role).filter(F.col("role").isNotNull())


def rolling_folds(panel: DataFrame, n_folds: int = 4, horizon: int = HORIZON, min_train: int = 28) -> DataFrame:
    """Rolling-origin rows; fold 0 tests the newest ``horizon`` rows."""
    rows = with_position(panel).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    end = F.col("n") - horizon * (F.col("fold") + 1)
    role = F.when(F.col("pos") <= end, "train").when(F.col("pos") <= end + horizon, "test")
    return rows.filter(end >= min_train).withColumn("role", role).filter(F.col("role").isNotNull())


def fold_origins(rows: DataFrame) -> DataFrame:
    """Sizes and origin (last training month) of every fold."""
    train = F.col("role") == "train"
    return rows.groupBy("series_id", "fold").agg(
        F.count(F.when(train, 1)).alias("train_n"),
        F.count(F.when(~train, 1)).alias("test_n"),
        F.date_format(F.max(F.when(train, F.col("ts"))), "yyyy-MM").alias("origin"),
    )


def history(labelled: DataFrame) -> DataFrame:
    """Train and validation rows: what a final model may see."""
    return labelled.filter(F.col("split").isin("train", "val"))


def pack(panel: DataFrame) -> DataFrame:
    """One row per series: ``series_id, n, ys, dates`` in time order.

    This is the only shuffle the array models need: folds, fits, forecasts and
    metrics are then computed in place.  An array holds one value per calendar
    period, so its size does not grow with the source table.  Null values are
    dropped, and a series without any value has no row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "y")))
    seen = panel.filter(F.col("y").isNotNull())
    return seen.groupBy("series_id").agg(ordered.alias("_rows")).select(
        "series_id",
        F.size("_rows").alias("n"),
        F.col("_rows.y").alias("ys"),
        F.col("_rows.ts").alias("dates"),
    )


def rejected_series(panel: DataFrame, n_folds: int = 4, horizon: int = HORIZON, min_train: int = 28, hold_out: int = 0) -> DataFrame:
    """Folds that a series is too short for: ``series_id, fold, n, rule``.

    ``n`` counts known values; a series without any has 0 and is listed for every fold.
    """
    known = panel.groupBy("series_id").agg(F.count("y").cast("int").alias("n"))
    rows = known.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    need = hold_out + horizon * (F.col("fold") + 1) + min_train
    rule = F.format_string("needs %d values", need.cast("int"))
    return rows.filter(F.col("n") < need).select("series_id", "fold", "n", rule.alias("rule"))


def seasonal_scale(train, season: int = SEASON):
    """In-sample seasonal-naive error: 1 for short history, never below 1e-8."""
    n = F.size(train)
    steps = F.zip_with(F.slice(train, season + 1, F.greatest(n - season, F.lit(0))),
                       F.slice(train, 1, F.greatest(n - season, F.lit(0))), lambda a, b: F.abs(a - b))
    mean = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - season)
    return F.when(n > season, F.greatest(mean, F.lit(1e-8))).otherwise(1.0)


def packed_folds(
    panel: DataFrame, n_folds: int = 4, horizon: int = HORIZON, min_train: int = 28, season: int = SEASON,
    hold_out: int = 0,
) -> DataFrame:
    """Rolling folds as arrays: ``series_id, fold, origin, train, test, test_dates, scale``.

    ``hold_out`` drops that many of the newest rows first (validation folds).
    """
    end = F.col("n") - hold_out - horizon * (F.col("fold") + 1)
    folds = (
        pack(panel)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        .filter(end >= min_train)
        .select(
            "series_id",
            "fold",
            F.date_format(F.element_at("dates", end.cast("int")), "yyyy-MM").alias("origin"),
            F.slice("ys", F.lit(1), end).alias("train"),
            F.slice("ys", end + 1, F.lit(horizon)).alias("test"),
            F.slice("dates", F.lit(1), end).alias("train_dates"),
            F.slice("dates", end + 1, F.lit(horizon)).alias("test_dates"),
        )
    )
    return spread(folds.withColumn("scale", seasonal_scale(F.col("train"), season)), "series_id", "fold")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Spread packed rows over the session's shuffle partitions before the costly fits.

    Small frames would otherwise end up in one task.  The exchange also fixes the
    arrays: without it the optimizer may move the expression behind an array into
    the lambda that reads it and evaluate it once per element.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, *keys)
