"""Queries that write to the shared folder and read back: readers, sinks and whole jobs on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import NAT, PRI, R, W, query, rounded
from checks.evaluate import BEN, ONE, base_forecasts, fold_ctes, holdout_rows
from checks.prepare import CLEAN, SCRAPE
from tidepanel.operators import cleaning, reports, splits
from tidepanel.plans.full_run import stored_specs
from tidepanel.plans.ingest import run_ingest
from tidepanel.plans.rolling import evaluate_window, validation_benchmark
from tidepanel.session import shared_dir
from tidepanel.sources import readers, sinks, tables


def fresh(spark, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/checks/{name}-{uuid.uuid4().hex}"


def cleaned(spark, d) -> DataFrame:
    return cleaning.clean(tables.raw_scrape(spark, d))


# --- raw tables --------------------------------------------------------------------------------

@query("raw_csv_read_back", f"WITH {SCRAPE} SELECT gamename, month, avg_text, gain, pct, peak_text, NULL AS broken FROM raw")
def raw_csv_read_back(spark, d):
    """A scrape written as CSV text and read without types; no line is malformed."""
    path = fresh(spark, "raw")
    tables.raw_scrape(spark, d).toDF("gamename", "month", "avg_text", "gain", "pct", "peak_text").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return readers.read_raw(spark, path).withColumnRenamed(readers.CORRUPT, "broken")


@query(
    "raw_csv_broken_lines",
    """WITH t AS (SELECT o_orderpriority, cast(cast(o_orderdate as date) as varchar) AS d, o_orderkey FROM orders)
    SELECT o_orderkey % 7 = 0 AS is_broken, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS n_named FROM t GROUP BY 1""",
)
def raw_csv_broken_lines(spark, d):
    """Every seventh line has a field too many; it is kept whole beside its first fields."""
    path = fresh(spark, "broken")
    rows = tables.table(spark, d, "orders")
    line = F.concat_ws(",", "o_orderpriority", F.col("o_orderdate").cast("date").cast("string"), F.col("o_totalprice").cast("string"))
    broken = F.col("o_orderkey") % 7 == 0
    lines = rows.select(F.when(broken, F.concat(line, F.lit(",extra"))).otherwise(line).alias("value"))
    # One column of whole lines: no field is quoted, and each file has its header.
    lines.toDF("Game,Month,Average").write.option("header", True).option("sep", "\t").csv(path)
    read = readers.read_raw(spark, path)
    whole = F.col(readers.CORRUPT)
    return read.groupBy(whole.isNotNull().alias("is_broken")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(whole.isNull(), F.col("Game"))).alias("n_named"))


@query(
    "month_and_year_columns",
    f"""{W(PRI)[:-1]} SELECT series_id, ts, {R('y', 2)} AS y, cast(round_even(greatest(floor(peak), {R('y', 2)}), 0) as bigint) AS peak FROM p""",
)
def month_and_year_columns(spark, d):
    """Separate month and year columns become one period."""
    panel = tables.orders_priority_month(spark, d)
    raw = panel.select(
        F.col("series_id").alias("Title"), F.date_format("ts", "MMMM").alias("Month"), F.year("ts").alias("Year"), F.round("y", 2).alias("Average Players"), F.floor("peak").alias("Peak")
    )
    return cleaning.parse_rows(raw).select("series_id", "ts", "y", "peak")


@query(
    "unusable_rows_dropped",
    f"""WITH {CLEAN}, n AS (SELECT series_id, ts, y, peak, CASE WHEN month(ts) = 5 THEN 'nan' WHEN month(ts) = 7 THEN '' ELSE series_id END AS name FROM typed)
    SELECT name AS series_id, ts, y, peak FROM n WHERE name NOT IN ('', 'nan') AND month(ts) <> 9""",
)
def unusable_rows_dropped(spark, d):
    """Rows without a name, with the name NaN, with a negative average or without a period go; the others are typed."""
    typed = cleaning.parse_rows(tables.raw_scrape(spark, d))
    month = F.month("ts")
    name = F.when(month == 5, F.lit(" NaN ")).when(month == 7, F.lit("  ")).otherwise(F.col("series_id"))
    y = F.when(month == 9, F.lit("-3")).otherwise(F.col("y").cast("string"))
    raw = typed.select(name.alias("Game"), F.col("ts").cast("string").alias("Month"), y.alias("Avg. Players"), F.col("peak").cast("string").alias("Peak Players"))
    return cleaning.parse_rows(raw).select("series_id", "ts", "y", "peak")


# --- panels ------------------------------------------------------------------------------------

_PANEL = f"WITH {CLEAN} SELECT series_id, ts, y, peak, gain, pct_gain FROM cl"


@query("panel_csv_read_back", _PANEL)
def panel_csv_read_back(spark, d):
    path = fresh(spark, "panel")
    sinks.write_panel_csv(cleaned(spark, d), path)
    return readers.read_panel(spark, path, "csv")


@query("panel_parquet_read_back", _PANEL)
def panel_parquet_read_back(spark, d):
    path = fresh(spark, "panel")
    sinks.write_panel_parquet(cleaned(spark, d), path)
    return readers.read_panel(spark, path)


@query("series_of_partitioned_layout", _PANEL + " WHERE series_id = '4-NOT SPECIFIED'")
def series_of_partitioned_layout(spark, d):
    """One folder per title; one title is read by its partition."""
    path = fresh(spark, "layout")
    sinks.write_per_series(cleaned(spark, d), path)
    return readers.read_series(spark, path, "4 not specified")


@query("series_picked", f"WITH {CLEAN} SELECT series_id, ts, y, peak, gain, pct_gain FROM cl WHERE series_id IN ('1-URGENT', '5-LOW')")
def series_picked(spark, d):
    """By name, ignoring case and blanks, and by slug."""
    panel = cleaned(spark, d)
    return readers.pick_series(panel, " 1-urgent ").unionByName(readers.pick_series(panel, "5 low"))


# --- reports, caches, orders -------------------------------------------------------------------

@query(
    "report_csv_read_back",
    f"WITH {ONE}, {BEN} SELECT series_id, model, paradigm, cast(mae as double) AS mae, cast(rmse as double) AS rmse, cast(mape as double) AS mape, "
    "cast(smape as double) AS smape, cast(mase as double) AS mase FROM bn",
)
def report_csv_read_back(spark, d):
    path = fresh(spark, "reports")
    made = reports.benchmark(holdout_rows(spark, d))
    sinks.write_reports({"benchmark": made}, path, single_file=("benchmark",))
    read = spark.read.option("header", True).csv(f"{path}/benchmark")
    return read.select("series_id", "model", "paradigm", *[F.col(c).cast("double").alias(c) for c in ("mae", "rmse", "mape", "smape", "mase")])


@query("cache_json_read_back", f"WITH {ONE} SELECT series_id, ts, {R('y', 6)} AS y FROM fr")
def cache_json_read_back(spark, d):
    """History and test rows of a forecast cache written as JSON lines."""
    folds = splits.packed_folds(tables.orders_priority_month(spark, d), n_folds=1)
    path = fresh(spark, "cache")
    sinks.write_cache(reports.forecast_cache(folds, base_forecasts(folds)), path)
    return rounded(readers.cache_rows(readers.read_cache(spark, path)), 6)


_ORDERED = f"""{W(NAT)[:-1]}, g AS (SELECT series_id, count(*) AS n FROM p GROUP BY 1)"""


@query(
    "orders_csv_read_back",
    _ORDERED + " SELECT series_id, cast(n % 3 as integer) AS p, 1 AS d, cast(n % 2 as integer) AS q, cast(n % 2 as integer) AS sp, 0 AS sd, 1 AS sq, 12 AS s FROM g",
)
def orders_csv_read_back(spark, d):
    """Chosen orders written as a report with tuple texts and parsed again."""
    n = tables.orders_nation_month(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    order = F.format_string("(%d, 1, %d)", F.col("n") % 3, F.col("n") % 2)
    seasonal = F.format_string("(%d, 0, 1, 12)", F.col("n") % 2)
    path = fresh(spark, "orders")
    sinks.write_reports({"orders": n.select(F.col("series_id").alias("Game"), order.alias("Optimal_Order"), seasonal.alias("Optimal_Seasonal_Order"))}, path)
    return stored_specs(spark, f"{path}/orders").select("series_id", "spec.*")


# --- jobs --------------------------------------------------------------------------------------

@query(
    "ingest_job_panel",
    f"""WITH {CLEAN}, n AS (SELECT series_id, ts, y, cast(9999999 as bigint) AS peak, gain, pct_gain FROM cl) SELECT * FROM n""",
)
def ingest_job_panel(spark, d):
    """The whole ingest job: profile, clean, validate, select, write three layouts; its Parquet panel."""
    raw = tables.raw_scrape(spark, d)
    peak = [c for c in raw.columns if "peak" in c.lower()][0]
    return run_ingest(spark, "", fresh(spark, "ingest"), raw=raw.withColumn(peak, F.lit("9,999,999")))["panel"]


_VALID = fold_ctes(PRI, 1, 12)


@query(
    "validation_window_metrics",
    f"WITH {_VALID}, {BEN} SELECT series_id, model, paradigm, mae, rmse, mape, smape, mase FROM bn WHERE model <> 'Mean'",
)
def validation_window_metrics(spark, d):
    """Both suites of the validation window, by the naive models that SQL can say."""
    made = validation_benchmark(tables.orders_priority_month(spark, d), ("Naive", "Seasonal Naive"))
    return made.select("series_id", "model", "paradigm", "mae", "rmse", "mape", "smape", "mase")


@query(
    "validation_window_rows",
    f"WITH {_VALID} SELECT series_id, model, cast(h as integer) AS h, ts, {R('y')} AS y, {R('yhat')} AS yhat FROM fc WHERE model = 'Seasonal Naive'",
)
def validation_window_rows(spark, d):
    """The window ends before the test rows."""
    _, _, rows = evaluate_window(tables.orders_priority_month(spark, d), ("Seasonal Naive",), hold_out=12)
    return rounded(rows.select("series_id", "model", "h", "ts", "y", "yhat"))
