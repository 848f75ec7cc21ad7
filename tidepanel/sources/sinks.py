"""Writers: combined panel, one folder per series, Parquet, report tables, forecast cache."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import CANONICAL_COLUMNS, PANEL_COLUMNS
from tidepanel.functions.text import slug


def published(panel: DataFrame) -> DataFrame:
    """Panel under the published column names with the date as ``yyyy-MM-dd`` text."""
    renamed = panel.select(*[F.col(p).alias(c) for p, c in zip(PANEL_COLUMNS, CANONICAL_COLUMNS)])
    return renamed.withColumn("Month_Year", F.date_format("Month_Year", "yyyy-MM-dd"))


def write_panel_csv(panel: DataFrame, path: str) -> None:
    published(panel).write.mode("overwrite").option("header", True).csv(path)


def write_per_series(panel: DataFrame, path: str) -> None:
    """One folder per series slug.

    Rows are spread by (slug, year) before the write, so a series is written by
    several tasks and each task keeps only a few files open.
    """
    rows = published(panel).withColumn("slug", slug(F.col("Game_Name")))
    rows = rows.repartition("slug", F.substring("Month_Year", 1, 4))
    rows.write.mode("overwrite").option("header", True).partitionBy("slug").csv(path)


def write_panel_parquet(panel: DataFrame, path: str) -> None:
    panel.select(*PANEL_COLUMNS).write.mode("overwrite").parquet(path)


def write_reports(tables: Mapping[str, DataFrame], folder: str, single_file: tuple[str, ...] = ()) -> None:
    """One CSV folder per report table.

    Tables named in ``single_file`` (a row per model or pair, so bounded by the
    model list) are written as one file; all others keep their partitions.
    """
    for name, frame in tables.items():
        out = frame.coalesce(1) if name in single_file else frame
        out.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)
