"""Ingest job: read, profile, clean, validate, select, validate, summarise, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidepanel.operators import cleaning, coverage, validation
from tidepanel.sources import readers, sinks


def run_ingest(
    spark: SparkSession, raw_path: str, out_dir: str, candidates: Sequence[str] | None = None, raw: DataFrame | None = None,
    max_series: int | None = None,
) -> dict[str, DataFrame]:
    """Clean a raw table and write the selected panel in three layouts.

    The cleaned panel is written once and read back, so validation, selection and
    the writers do not repeat the cleaning, and a lost executor costs only its own
    tasks.  A failing rule stops the job before anything is published.  All series
    that pass the selection rules are kept unless ``max_series`` is given.
    """
    raw = raw if raw is not None else readers.read_raw(spark, raw_path)
    report = cleaning.profile(raw)
    staged = f"{out_dir}/_cleaned"
    cleaning.clean(raw).write.mode("overwrite").parquet(staged)
    panel = spark.read.parquet(staged)
    validation.require_valid(panel, "cleaned panel")
    chosen = coverage.select_series(panel, candidates, max_series=max_series)
    selected = coverage.rows_of(panel, chosen)
    validation.require_valid(selected, "selected panel")
    sinks.write_panel_csv(selected, f"{out_dir}/combined_csv")
    sinks.write_per_series(selected, f"{out_dir}/per_series")
    sinks.write_panel_parquet(selected, f"{out_dir}/panel")
    return {
        "profile": report,
        "panel": readers.read_panel(spark, f"{out_dir}/panel"),
        "chosen": chosen,
        "exclusions": coverage.exclusions(panel),
        "coverage": coverage.ordered_coverage(selected),
        "validation": validation.validate(selected),
        "totals": validation.totals(selected),
    }
