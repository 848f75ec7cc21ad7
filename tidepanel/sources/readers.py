"""Readers: raw scrape, processed panel, forecast cache, chosen orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contract import CANONICAL_COLUMNS, PANEL_COLUMNS
from tidepanel.functions.text import ints_from_text, slug

CORRUPT = "_corrupt_record"
PANEL_SCHEMA = "series_id string, ts date, y double, peak bigint, gain double, pct_gain double"
CACHE_SCHEMA = (
    "series_id string, history_dates array<string>, history_values array<double>, "
    "test_dates array<string>, test_actuals array<double>, "
    "test_forecasts map<string,array<double>>, sarima_ci_lower array<double>, sarima_ci_upper array<double>, "
    "optimal_sarima_order string, optimal_xgb_params map<string,double>"
)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV with a header; every column stays text, so no extra pass infers types.

    Lines that do not fit the header are kept whole in ``_corrupt_record``, which the profile counts.
    """
    # All columns are parsed, whatever is selected, so a line is malformed or not for every reader of the table.
    source = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
    names = source.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    return source.option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed panel under library names; CSV files carry the published headers."""
    if fmt == "csv":
        types = [f.split()[1] for f in PANEL_SCHEMA.split(", ")]
        published = ", ".join(f"`{c}` {t}" for c, t in zip(CANONICAL_COLUMNS, types))
        frame = spark.read.option("header", True).schema(published).csv(path)
        return frame.toDF(*PANEL_COLUMNS)
    frame = spark.read.parquet(path)
    if "Game_Name" in frame.columns:
        frame = frame.select(*[F.col(c).alias(p) for c, p in zip(CANONICAL_COLUMNS, PANEL_COLUMNS)])
    return frame


def pick_series(panel: DataFrame, name: str) -> DataFrame:
    """Rows of one title in time order: exact match ignoring case, else by slug.

    Raises ``ValueError`` when neither matches.  The check reads at most one row.
    """
    exact = panel.filter(F.lower("series_id") == F.lower(F.trim(F.lit(name))))
    if not exact.take(1):
        exact = panel.filter(slug(F.col("series_id")) == slug(F.lit(name)))
        if not exact.take(1):
            raise ValueError(f"no series named {name!r} in the panel")
    return exact.orderBy("ts")


def read_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one title in time order from the layout of ``sinks.write_per_series``.

    The slug is a partition of that layout, so the files of other titles are not opened. Of titles with one slug the one
    of the same name, ignoring case, is taken, else all of them. Raises ``ValueError`` when there is none.
    """
    types = [f.split()[1] for f in PANEL_SCHEMA.split(", ")]
    published = ", ".join(f"`{c}` {t}" for c, t in zip(CANONICAL_COLUMNS, types))
    stored = spark.read.option("header", True).schema(f"{published}, slug string").csv(path)
    rows = stored.filter(F.col("slug") == slug(F.lit(name))).drop("slug").toDF(*PANEL_COLUMNS)
    exact = rows.filter(F.lower("series_id") == F.lower(F.trim(F.lit(name))))
    found = exact if exact.take(1) else rows
    if found is rows and not rows.take(1):
        raise ValueError(f"no series named {name!r} under {path}")
    return found.orderBy("ts")


def list_series(panel: DataFrame) -> DataFrame:
    """Sorted distinct series names."""
    return panel.select("series_id").distinct().orderBy("series_id")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).json(path)


def cache_rows(cache: DataFrame) -> DataFrame:
    """History and test values of a forecast cache as (series_id, ts, y) rows."""

    def pairs(dates: str, values: str) -> DataFrame:
        return cache.select(
            "series_id", F.explode(F.arrays_zip(F.col(dates).alias("d"), F.col(values).alias("v"))).alias("p")
        )

    rows = pairs("history_dates", "history_values").unionByName(pairs("test_dates", "test_actuals"))
    return rows.select("series_id", F.to_date("p.d").alias("ts"), F.col("p.v").alias("y"))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Chosen orders per series from a report CSV, tuple texts parsed to int arrays."""
    frame = spark.read.option("header", True).csv(path)
    return frame.select(
        F.col("Game").alias("series_id"),
        ints_from_text(F.col("Optimal_Order")).alias("order"),
        ints_from_text(F.col("Optimal_Seasonal_Order")).alias("seasonal_order"),
    )
