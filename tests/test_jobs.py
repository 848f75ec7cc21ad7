import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, connect
from tidepanel.contract import HORIZON
from tidepanel.operators import splits
from tidepanel.plans.full_run import run_order_search
from tidepanel.plans.ingest import run_ingest
from tidepanel.plans.rolling import run_backtest, run_holdout
from tidepanel.sources import readers, tables

SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["clean_raw", "feature_matrix", "holt_winters_grid", "model_summary", "kpss"])
def test_some_queries_match_sql(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), entry.oracle_sql()[name]) == ""


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and duckdb.__version__


def test_ingest_job(spark, tmp_path):
    raw = tables.raw_scrape(spark, SMALL)
    # A missing peak becomes the rounded average, which may lie below it: the job must stop.
    with pytest.raises(ValueError, match="peak_at_least_average"):
        run_ingest(spark, "", f"{tmp_path}/bad", raw=raw)
    out = run_ingest(spark, "", str(tmp_path), raw=raw.withColumn("peak", F.lit("9,999,999")))
    n = out["chosen"].count()
    assert n >= 4 and out["panel"].select("series_id").distinct().count() == n
    assert all(r.ok for r in out["validation"].collect())
    assert len(list((tmp_path / "per_series").glob("slug=*"))) == n


def test_holdout_job_writes_cache(spark, tmp_path):
    panel = tables.orders_priority_month(spark, SMALL)
    out = run_holdout(panel, str(tmp_path), ("Naive", "Seasonal Naive", "SARIMA"))
    assert out["benchmarks"].count() == 15 and out["step_errors"].count() == 15 * HORIZON
    cache = readers.read_cache(spark, f"{tmp_path}/forecast_cache")
    first = cache.first()
    assert set(first.test_forecasts) == {"Naive", "Seasonal Naive", "SARIMA"} and len(first.sarima_ci_lower) == 12
    assert readers.cache_rows(cache).count() == panel.count()
    assert json.loads(next((tmp_path / "forecast_cache").glob("*.json")).read_text().splitlines()[0])


def test_backtest_job_counts(spark, tmp_path):
    panel = tables.orders_priority_month(spark, SMALL)
    models = ("Naive", "Seasonal Naive", "Ridge")
    out = run_backtest(panel, str(tmp_path), models, n_folds=2, n_boot=200)
    units = splits.packed_folds(panel, 2).count()
    assert out["fold_metrics"].count() == 3 * units and out["errors"].count() == 3 * units * HORIZON
    assert out["summary"].count() == 3 and out["significance"].count() >= 2 and out["failures"].count() == 0
    with pytest.raises(ValueError, match="unknown models"):
        run_backtest(panel, str(tmp_path), ("Nothing",))


def test_order_search_job(spark, tmp_path):
    out = run_order_search(tables.orders_priority_month(spark, SMALL), str(tmp_path))
    assert out["order_grid"].count() == 250 and out["order_selection"].count() == 5
    assert out["residual_diagnostics"].count() == 5


@pytest.mark.parametrize("name", ["backtest_metrics", "feature_matrix", "model_summary", "select_series", "month_quartiles"])
def test_plans_have_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
