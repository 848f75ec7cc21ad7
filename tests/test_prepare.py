import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.text import header_key, slug
from tidepanel.operators import cleaning, coverage, splits, validation
from tidepanel.sources import readers, sinks

DIRTY = [
    ("Last 30 Days", "Dota 2", "512,345.50", "+12,245.25", "+2.45%", "850,000"),
    ("September 2021", "Dota 2", "500,100.25", "+20,100.25", "+4.19%", "820,500"),
    ("August 2021", "Dota 2", "480,000.00", "-10,500.00", "-2.14%", "790,000"),
    ("July 2021", "Dota 2", "490,500.00", "+20,500.00", "+4.36%", "810,000"),
    ("June 2021", "Dota 2", "470,000.00", "-", "-", "780,000"),
    ("September 2021", "Dota 2", "500,100.25", "+20,100.25", "+4.19%", "820,500"),
    ("Invalid Date String", "Dota 2", "10,000.00", "-", "-", "15,000"),
]


@pytest.fixture()
def dirty(spark):
    return spark.createDataFrame(DIRTY, ["Month_Year", "Game_Name", "Avg_players", "Gain", "% Gain", "Peak_Players"])


def test_cleaning_a_dirty_table(dirty):
    rows = {r.ts: r for r in cleaning.clean(dirty).collect()}
    assert sorted(rows) == [dt.date(2021, m, 1) for m in (6, 7, 8, 9)]
    assert rows[dt.date(2021, 6, 1)].gain is None
    assert rows[dt.date(2021, 7, 1)].gain == 20500.0
    assert all(r.peak >= r.y for r in rows.values())


def test_cleaned_table_is_valid(dirty):
    report = validation.validate(cleaning.clean(dirty).orderBy("series_id", "ts")).collect()
    assert len(report) == 6 and all(r.ok for r in report)


def test_corrupt_table_fails(spark):
    bad = spark.createDataFrame([("A", dt.date(2020, 1, 15), -50.0, 10.0)], "series_id string, ts date, y double, peak double")
    failed = {r.check_name for r in validation.validate(bad).collect() if not r.ok}
    assert failed == {"canonical_columns", "dates_are_month_starts", "averages_not_negative"}
    with pytest.raises(ValueError, match="averages_not_negative"):
        validation.require_valid(bad, "panel")


def test_rows_out_of_order_are_found(spark):
    days = [dt.date(2020, m, 1) for m in (1, 3, 2, 4)]
    rows = [("A", d, 1.0, 1, None, None, i) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, readers.PANEL_SCHEMA + ", line int").repartition(3)
    bad = {r.check_name: r.n_bad for r in validation.validate(df, position="line").collect()}
    assert bad["periods_in_order"] == 1


def test_sorted_panel_in_several_files_is_valid(spark, tmp_path):
    days = [dt.date(2000 + y, m, 1) for y in range(20) for m in range(1, 13)]
    rows = [("A", d, 1.0, 1, None, None) for d in days]
    spark.createDataFrame(rows, readers.PANEL_SCHEMA).repartitionByRange(7, "ts").write.parquet(str(tmp_path / "p"))
    report = {r.check_name: r.ok for r in validation.validate(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert all(report.values()) and "periods_in_order" not in report


def test_header_variants(spark):
    df = spark.createDataFrame([("X", "May 2020", "1", "2", "3", "4")], ["gamename", "month", "Avg. Players", "gain", "% gain", "peak"])
    assert cleaning.standardize(df).columns == ["series_id", "ts", "y", "peak", "gain", "pct_gain"]
    assert header_key("Avg. Players") == "avg_players"
    parts = spark.createDataFrame([("TF2", 2020, "March", 50000.0)], "game string, year int, month string, avg double")
    assert cleaning.standardize(parts).first().ts == "March 2020"
    assert cleaning.clean(parts).first().ts == dt.date(2020, 3, 1)
    with pytest.raises(ValueError, match="cannot identify"):
        cleaning.standardize(spark.createDataFrame([(1,)], "other int"))


def test_slugs(spark):
    names = ["Counter-Strike: Global Offensive", "Tom Clancy's Rainbow Six Siege", "Dota 2"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(slug(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["counter_strike_global_offensive", "tom_clancy_s_rainbow_six_siege", "dota_2"]


def _months(name, first, n, skip=()):
    out = []
    for i in range(n):
        m = first[1] - 1 + i
        day = dt.date(first[0] + m // 12, m % 12 + 1, 1)
        if day not in skip:
            out.append((name, day, 100.0, 200, None, None))
    return out


def test_missing_periods(spark):
    gap = dt.date(2020, 3, 1)
    df = spark.createDataFrame(_months("a", (2020, 1), 12) + _months("b", (2020, 1), 4, (gap,)), readers.PANEL_SCHEMA)
    assert [(r.series_id, r.ts) for r in coverage.missing_periods(df).collect()] == [("b", gap)]
    cov = {r.series_id: r for r in coverage.coverage(df).collect()}
    assert cov["a"].is_continuous and cov["a"].total_months == 12 and not cov["b"].is_continuous


def test_selection_needs_history(spark):
    df = spark.createDataFrame(_months("long", (2015, 1), 80) + _months("short", (2021, 1), 8), readers.PANEL_SCHEMA)
    assert [r.series_id for r in coverage.select_series(df).collect()] == ["long"]
    assert [r.reason for r in coverage.exclusions(df).collect()] == ["insufficient history"]
    assert coverage.rows_of(df, coverage.select_series(df)).count() == 80


def test_split_sizes_and_rejection(panel, spark):
    s = splits.split_summary(splits.split_rows(panel)).first()
    assert (s.train_n, s.val_n, s.test_n) == (36, 12, 12)
    assert s.train_end < s.val_start and s.val_end < s.test_start
    assert splits.split_rows(panel.filter("ts < '2018-01-01'")).count() == 0
    with pytest.raises(ValueError):
        splits.split_rows(panel, val=-1)


def test_expanding_and_rolling_folds(panel, spark):
    a = panel.filter("series_id = 'A'")
    sizes = splits.expanding_folds(a).filter("role = 'train'").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [24, 36, 48]
    from panels import monthly

    for n, folds in ((70, [0, 1, 2]), (40, [0]), (30, [])):
        df = spark.createDataFrame(monthly(n), "series_id string, ts date, y double")
        got = splits.fold_origins(splits.rolling_folds(df)).orderBy("fold").collect()
        assert [r.fold for r in got] == folds
        packed = splits.packed_folds(df).select("fold", "origin").orderBy("fold").collect()
        assert [(r.fold, r.origin) for r in packed] == [(r.fold, r.origin) for r in got]


def test_sources_round_trip(spark, dirty, tmp_path):
    panel = cleaning.clean(dirty)
    sinks.write_panel_csv(panel, f"{tmp_path}/csv")
    sinks.write_panel_parquet(panel, f"{tmp_path}/pq")
    sinks.write_per_series(panel, f"{tmp_path}/each")
    want = sorted(map(tuple, panel.collect()))
    assert sorted(map(tuple, readers.read_panel(spark, f"{tmp_path}/csv", "csv").collect())) == want
    assert sorted(map(tuple, readers.read_panel(spark, f"{tmp_path}/pq").collect())) == want
    assert (tmp_path / "each" / "slug=dota_2").is_dir()
    assert readers.pick_series(panel, " DOTA 2 ").count() == 4
    assert readers.pick_series(panel, "dota-2").count() == 4
    with pytest.raises(ValueError):
        readers.pick_series(panel, "nothing")
    assert readers.list_series(panel).first().series_id == "Dota 2"
    dirty.write.option("header", True).csv(f"{tmp_path}/raw")
    raw = readers.read_raw(spark, f"{tmp_path}/raw")
    assert {t for _, t in raw.dtypes} == {"string"} and cleaning.clean(raw).count() == 4


def test_orders_file(spark, tmp_path):
    rows = [("A", "(1, 1, 0)", "(0, 1, 1, 12)")]
    df = spark.createDataFrame(rows, "Game string, Optimal_Order string, Optimal_Seasonal_Order string")
    df.write.option("header", True).csv(f"{tmp_path}/o")
    got = readers.read_orders(spark, f"{tmp_path}/o").first()
    assert (got.order, got.seasonal_order) == ([1, 1, 0], [0, 1, 1, 12])
