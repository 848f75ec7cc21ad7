"""Order search and the full run over a raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.contract import HORIZON
from tidepanel.models import selection
from tidepanel.models.linear import spec_from_arrays
from tidepanel.operators import diagnostics, explore, reports, splits
from tidepanel.plans.ingest import run_ingest
from tidepanel.plans.rolling import ML_SUITE, STATISTICAL_SUITE, run_backtest, run_holdout, validation_benchmark
from tidepanel.sources import readers, sinks


def run_order_search(panel: DataFrame, out_dir: str, criterion: str = "val_mae") -> dict[str, DataFrame]:
    """Order grid on the validation window, winners and their residual tests.

    The scored grid is written once and the three reports read it back.
    """
    folds = splits.packed_folds(panel, 1, hold_out=HORIZON)
    selection.order_grid(folds, criterion=criterion).write.mode("overwrite").parquet(f"{out_dir}/_grid")
    grid = panel.sparkSession.read.parquet(f"{out_dir}/_grid")
    tables = {
        "order_selection": selection.winners_table(grid),
        "order_grid": selection.grid_table(grid),
        "residual_diagnostics": selection.winner_diagnostics(grid),
    }
    sinks.write_reports(tables, f"{out_dir}/reports")
    return {"specs": selection.best_specs(grid), **tables}


def stored_specs(spark: SparkSession, path: str) -> DataFrame:
    """``series_id, spec`` from an order table written as a report."""
    orders = readers.read_orders(spark, path)
    return orders.select("series_id", spec_from_arrays(F.col("order"), F.col("seasonal_order")).alias("spec"))


def exploratory_tables(panel: DataFrame) -> dict[str, DataFrame]:
    return {
        "overview": explore.series_overview(panel),
        "profile": explore.series_profile(panel),
        "growth": explore.indexed_growth(panel),
        "peak_ratio": explore.peak_ratio(panel),
        "seasonal_deviation": explore.seasonal_deviation(panel),
        "month_quartiles": explore.month_quartiles(panel),
        "seasonal_profile": explore.seasonal_profile(panel),
        "stationarity": diagnostics.stationarity_table(panel),
    }


def run_all(
    spark: SparkSession, raw: DataFrame, out_dir: str, validation_suites: tuple = (STATISTICAL_SUITE, ML_SUITE),
    holdout_models: tuple | None = None, n_boot: int = 5000, orders_path: str | None = None, **backtest_options,
) -> dict[str, dict[str, DataFrame]]:
    """Ingest, exploratory tables, order search, validation suites, holdout and backtest.

    ``orders_path`` names an order table of an earlier run; its orders are used and the search is left out.
    """
    ingest = run_ingest(spark, "", f"{out_dir}/ingest", raw=raw)
    panel = ingest["panel"]
    eda = exploratory_tables(panel)
    sinks.write_reports(eda, f"{out_dir}/eda")
    search = {"specs": stored_specs(spark, orders_path)} if orders_path else run_order_search(panel, f"{out_dir}/orders")
    specs = search["specs"]
    validation = {}
    for i, suite in enumerate(validation_suites):
        validation_benchmark(panel, suite, specs).write.mode("overwrite").parquet(f"{out_dir}/validation_{i}")
        validation[f"validation_{i}"] = spark.read.parquet(f"{out_dir}/validation_{i}")
    holdout = run_holdout(panel, f"{out_dir}/holdout", *([holdout_models] if holdout_models else []), specs=specs)
    if validation:
        # A model in both suites has the same validation row in each.
        seen = list(validation.values())
        val = seen[0]
        for other in seen[1:]:
            val = val.unionByName(other.join(val.select("series_id", "model"), ["series_id", "model"], "left_anti"))
        validation["drift"] = reports.drift(val, holdout["benchmarks"])
    tested = run_backtest(panel, f"{out_dir}/backtest", specs=specs, n_boot=n_boot, **backtest_options)
    return {"ingest": ingest, "eda": eda, "orders": search, "validation": validation, "holdout": holdout, "backtest": tested}
