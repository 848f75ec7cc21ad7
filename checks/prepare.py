"""Queries on reading, cleaning, coverage and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BRA, DAY, HOUR, NAT, POS, PRI, SPLIT, R, W, query, rounded
from tidepanel.functions.text import slug
from tidepanel.operators import cleaning, coverage, splits, validation
from tidepanel.sources import readers, tables

SCRAPE = f"""{PRI}, s0 AS (SELECT *, cast(floor(y * 100) as bigint) AS c, cast(floor(peak) as bigint) AS w,
    month(ts) AS m FROM p),
base AS (SELECT '  ' || series_id || ' ' AS gamename,
    CASE WHEN m % 3 = 0 THEN strftime(ts, '%B %Y') WHEN m % 3 = 1 THEN strftime(ts, '%Y-%m-%d')
         ELSE strftime(ts, '%b %Y') END AS month,
    format('{{:,}}', c // 100) || '.' || lpad(cast(c % 100 as varchar), 2, '0') AS avg_text,
    CASE WHEN m % 4 = 0 THEN '-' ELSE '+1,234.50' END AS gain,
    CASE WHEN m % 4 = 0 THEN '-' ELSE '+2.45%' END AS pct,
    CASE WHEN m % 5 = 0 THEN 'NA' ELSE format('{{:,}}', w) END AS peak_text, m FROM s0),
raw AS (SELECT gamename, month, avg_text, gain, pct, peak_text FROM base
    UNION ALL SELECT gamename, month, avg_text, gain, pct, '15' FROM base WHERE m = 3
    UNION ALL SELECT gamename, ['Last 30 Days', 'All Time', 'Invalid Date String', 'Total'][m],
        avg_text, gain, pct, peak_text FROM base WHERE m <= 4)"""
NUM = "try_cast(nullif(nullif(translate(trim({0}), ',%+', ''), '-'), 'NA') as double)"
CLEAN = f"""{SCRAPE}, parsed AS (SELECT trim(gamename) AS series_id,
    cast(date_trunc('month', coalesce(try_strptime(month, '%B %Y'), try_strptime(month, '%b %Y'),
        try_strptime(month, '%Y-%m-%d'))) as date) AS ts,
    {NUM.format('avg_text')} AS y, {NUM.format('peak_text')} AS pk FROM raw
    WHERE NOT regexp_matches(lower(trim(month)), 'last\\s*30\\s*days|all\\s*time|total')),
typed AS (SELECT series_id, ts, y, cast(round_even(greatest(coalesce(pk, y), y), 0) as bigint) AS peak
    FROM parsed WHERE ts IS NOT NULL AND y >= 0),
dedup AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY peak DESC, y DESC) = 1),
cl AS (SELECT series_id, ts, y, peak, {R('y - lag(y) OVER w', 2)} AS gain,
    {R('(y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) * 100', 2)} AS pct_gain
    FROM dedup WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""


@query("clean_raw", f"WITH {CLEAN} SELECT * FROM cl")
def clean_raw(spark, d):
    return cleaning.clean(tables.raw_scrape(spark, d))


@query(
    "validate_rules",
    f"""WITH {CLEAN}, v AS (SELECT
        sum(CASE WHEN series_id IS NULL OR ts IS NULL OR y IS NULL THEN 1 ELSE 0 END) AS a,
        sum(CASE WHEN day(ts) <> 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN y < 0 THEN 1 ELSE 0 END) AS c,
        sum(CASE WHEN peak < y THEN 1 ELSE 0 END) AS e, count(*) - count(DISTINCT (series_id, ts)) AS f FROM cl),
    r AS (SELECT 'canonical_columns' AS check_name, 0 AS n_bad UNION ALL SELECT 'no_null_primary_fields', a FROM v
        UNION ALL SELECT 'dates_are_month_starts', b FROM v UNION ALL SELECT 'averages_not_negative', c FROM v
        UNION ALL SELECT 'peak_at_least_average', e FROM v UNION ALL SELECT 'no_duplicate_periods', f FROM v)
    SELECT check_name, n_bad = 0 AS ok, cast(n_bad as bigint) AS n_bad FROM r""",
)
def validate_rules(spark, d):
    return validation.validate(cleaning.clean(tables.raw_scrape(spark, d)))


@query(
    "validate_order",
    """WITH o AS (SELECT lag(cast(o_orderdate as date)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > cast(o_orderdate as date) AS back FROM orders)
    SELECT 'periods_in_order' AS check_name, count(*) FILTER (WHERE back) = 0 AS ok, count(*) FILTER (WHERE back) AS n_bad FROM o""",
)
def validate_order(spark, d):
    """The orders in order of their key, by priority."""
    rows = tables.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"), "o_orderkey"
    )
    return validation.validate(rows, position="o_orderkey").filter("check_name = 'periods_in_order'")


@query(
    "panel_totals",
    f"""WITH {CLEAN} SELECT count(*) AS total_records, count(DISTINCT series_id) AS total_series,
    strftime(min(ts), '%Y-%m-%d') AS date_min, strftime(max(ts), '%Y-%m-%d') AS date_max FROM cl""",
)
def panel_totals(spark, d):
    return validation.totals(cleaning.clean(tables.raw_scrape(spark, d)))


_CELLS = [
    ("gamename", "gamename", "series_id"), ("month", "month", "ts"), ("Avg. Players", "avg_text", "y"),
    ("gain", "gain", "gain"), ("% gain", "pct", "pct_gain"), ("peak", "peak_text", "peak"),
]


@query(
    "profile_raw",
    f"WITH {SCRAPE} "
    + " UNION ALL ".join(
        f"SELECT '{shown}' AS column_name, 'string' AS column_type, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_null, '{canonical}' AS canonical, false AS has_month_and_year, "
        f"(SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM raw ORDER BY v LIMIT 3)) AS samples FROM raw"
        for shown, c, canonical in _CELLS
    ),
)
def profile_raw(spark, d):
    return cleaning.profile(tables.raw_scrape(spark, d))


@query(
    "slug_names",
    "SELECT DISTINCT p_name, lower(regexp_replace(regexp_replace(trim(p_name || ': ' || p_brand), '[^a-zA-Z0-9]+', '_', 'g'), "
    "'^_+|_+$', '', 'g')) AS slug FROM part",
)
def slug_names(spark, d):
    name = F.concat("p_name", F.lit(": "), "p_brand")
    return tables.table(spark, d, "part").select("p_name", slug(name).alias("slug")).distinct()


@query("series_list", W(BRA) + "SELECT DISTINCT series_id FROM p")
def series_list(spark, d):
    return readers.list_series(tables.brand_ship_month(spark, d))


for _name, _cte, _bind in (
    ("panel_priority_month", PRI, tables.orders_priority_month),
    ("panel_nation_month", NAT, tables.orders_nation_month),
    ("panel_brand_month", BRA, tables.brand_ship_month),
):
    query(_name, W(_cte) + "SELECT series_id, ts, y, peak FROM p")(_bind)


@query("panel_event_day", W(DAY) + "SELECT series_id, ts, y, peak FROM p")
def panel_event_day(spark, d):
    return tables.events_period(spark, d, "day")


@query("panel_event_hour", W(HOUR) + "SELECT series_id, strftime(ts, '%Y-%m-%d %H') AS hour, y, peak FROM p")
def panel_event_hour(spark, d):
    panel = tables.events_period(spark, d, "hour")
    return panel.select("series_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "y", "peak")


# --- coverage ----------------------------------------------------------------------------------

COV = f"""{NAT}, cov AS (SELECT series_id, min(ts) AS start_date, max(ts) AS end_date,
    cast(count(DISTINCT ts) as integer) AS total_months, {R('avg(y)', 2)} AS mean_y, max(peak) AS max_peak,
    cast(date_diff('month', min(ts), max(ts)) + 1 as integer) AS expected_months FROM p GROUP BY 1),
cv AS (SELECT *, expected_months - total_months AS missing_months, {R('total_months / 12.0::double', 2)} AS span_years,
    expected_months = total_months AS is_continuous FROM cov)"""


@query(
    "missing_months",
    W(NAT, "b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1)")
    + "SELECT g.series_id, cast(g.m as date) AS ts FROM (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b) g "
    "LEFT JOIN p ON p.series_id = g.series_id AND p.ts = g.m WHERE p.ts IS NULL",
)
def missing_months(spark, d):
    return coverage.missing_periods(tables.orders_nation_month(spark, d))


@query("coverage_summary", f"WITH {COV} SELECT * FROM cv")
def coverage_summary(spark, d):
    return coverage.ordered_coverage(tables.orders_nation_month(spark, d))


_CHOICE = f"""{COV}, good AS (SELECT *, row_number() OVER (ORDER BY is_continuous DESC, span_years DESC, mean_y DESC, series_id) AS rk
    FROM cv WHERE total_months >= 36 AND span_years >= 3 AND missing_months <= 2)"""


@query(
    "select_series",
    f"WITH {_CHOICE} SELECT series_id, cast(rk as integer) AS choice_rank, 'candidate' AS source FROM good WHERE rk <= 10",
)
def select_series(spark, d):
    return coverage.select_series(tables.orders_nation_month(spark, d))


@query(
    "select_series_candidates",
    f"""WITH {COV}, given AS (SELECT unnest(['7', '3', '11', 'none']) AS series_id, unnest([1, 2, 3, 4]) AS o),
    a AS (SELECT series_id, row_number() OVER (ORDER BY o) AS rk FROM cv JOIN given USING (series_id)
        WHERE total_months >= 36 AND span_years >= 3 AND missing_months <= 2),
    b AS (SELECT series_id, row_number() OVER (ORDER BY span_years DESC, mean_y DESC, series_id) + (SELECT count(*) FROM a) AS rk
        FROM cv WHERE total_months >= 36 AND is_continuous AND series_id NOT IN (SELECT series_id FROM a))
    SELECT series_id, cast(rk as integer) AS choice_rank, 'candidate' AS source FROM a
    UNION ALL SELECT series_id, cast(rk as integer), 'fill' FROM b WHERE rk <= 7 AND (SELECT count(*) FROM a) < 5""",
)
def select_series_candidates(spark, d):
    return coverage.select_series(tables.orders_nation_month(spark, d), candidates=["7", "3", "11", "none"])


@query("selected_rows", f"WITH {_CHOICE} SELECT series_id, ts, y, peak FROM p WHERE series_id IN (SELECT series_id FROM good WHERE rk <= 10)")
def selected_rows(spark, d):
    panel = tables.orders_nation_month(spark, d)
    return coverage.rows_of(panel, coverage.select_series(panel))


@query(
    "excluded_series",
    f"""WITH {COV} SELECT series_id,
    CASE WHEN total_months < 80 OR span_years < 3 THEN 'insufficient history' ELSE 'significant gaps' END AS reason,
    total_months, missing_months FROM cv WHERE total_months < 80 OR span_years < 3 OR missing_months > 0""",
)
def excluded_series(spark, d):
    return coverage.exclusions(tables.orders_nation_month(spark, d), min_months=80, max_gaps=0)


# --- splits ------------------------------------------------------------------------------------

@query("split_labels", W(NAT, POS, SPLIT) + "SELECT series_id, ts, y, pos, split FROM sp")
def split_labels(spark, d):
    return splits.split_rows(tables.orders_nation_month(spark, d)).select("series_id", "ts", "y", "pos", "split")


@query(
    "split_boundaries",
    W(NAT, POS, SPLIT)
    + "SELECT series_id, "
    + ", ".join(
        f"count(*) FILTER (split = '{s}') AS {s}_n, min(ts) FILTER (split = '{s}') AS {s}_start, max(ts) FILTER (split = '{s}') AS {s}_end"
        for s in ("train", "val", "test")
    )
    + " FROM sp GROUP BY 1",
)
def split_boundaries(spark, d):
    return splits.split_summary(splits.split_rows(tables.orders_nation_month(spark, d)))


@query("final_history", W(NAT, POS, SPLIT) + "SELECT series_id, ts, y FROM sp WHERE split <> 'test'")
def final_history(spark, d):
    return splits.history(splits.split_rows(tables.orders_nation_month(spark, d))).select("series_id", "ts", "y")


@query(
    "expanding_cv",
    W(NAT, POS)
    + """SELECT series_id, ts, fold, CASE WHEN pos <= n - (3 - fold) * 12 THEN 'train' ELSE 'test' END AS role
    FROM q, (SELECT unnest([0, 1, 2]) AS fold) WHERE n >= 60 AND pos <= n - (3 - fold) * 12 + 12""",
)
def expanding_cv(spark, d):
    return splits.expanding_folds(tables.orders_nation_month(spark, d)).select("series_id", "ts", "fold", "role")


FOLDS = """fr AS (SELECT *, CASE WHEN pos <= n - 12 * (fold + 1) THEN 'train' ELSE 'test' END AS role
    FROM q, (SELECT unnest([0, 1, 2, 3]) AS fold) WHERE n - 12 * (fold + 1) >= 28 AND pos <= n - 12 * fold)"""


@query("rolling_origin", W(NAT, POS, FOLDS) + "SELECT series_id, ts, y, fold, role FROM fr")
def rolling_origin(spark, d):
    return splits.rolling_folds(tables.orders_nation_month(spark, d)).select("series_id", "ts", "y", "fold", "role")


@query(
    "fold_origins",
    W(NAT, POS, FOLDS)
    + """SELECT series_id, fold, count(*) FILTER (role = 'train') AS train_n, count(*) FILTER (role = 'test') AS test_n,
    strftime(max(ts) FILTER (role = 'train'), '%Y-%m') AS origin FROM fr GROUP BY 1, 2""",
)
def fold_origins(spark, d):
    return splits.fold_origins(splits.rolling_folds(tables.orders_nation_month(spark, d)))


@query(
    "packed_rolling_folds",
    W(NAT, POS, FOLDS)
    + f""", o AS (SELECT *, abs(y - lag(y, 12) OVER (PARTITION BY series_id, fold ORDER BY ts)) AS step FROM fr)
    SELECT series_id, fold, count(*) FILTER (role = 'train') AS train_n,
    {R("coalesce(avg(step) FILTER (role = 'train'), 1.0)")} AS scale,
    list(ts ORDER BY ts) FILTER (role = 'test') AS test_dates FROM o GROUP BY 1, 2""",
)
def packed_rolling_folds(spark, d):
    folds = splits.packed_folds(tables.orders_nation_month(spark, d))
    return folds.select("series_id", "fold", F.size("train").cast("long").alias("train_n"), F.round("scale", 4).alias("scale"), "test_dates")


@query(
    "panel_tax_share_month",
    f"""SELECT l_returnflag AS series_id, cast(date_trunc('month', l_shipdate) as date) AS ts, {R('avg(v)', 6)} AS y, max(v) AS peak
    FROM (SELECT *, l_quantity / 16.0 + 0.0625 AS v FROM lineitem) GROUP BY 1, 2""",
)
def panel_tax_share_month(spark, d):
    """Values of four decimals keep them."""
    facts = tables.table(spark, d, "lineitem").withColumn("v", F.col("l_quantity") / 16.0 + 0.0625)
    return rounded(tables.period_panel(facts, "l_returnflag", "l_shipdate", "v"), 6)


@query(
    "rejected_series",
    W(NAT, "k AS (SELECT series_id, cast(count(y) as integer) AS n FROM p GROUP BY 1)")
    + """SELECT series_id, cast(f as integer) AS fold, n, 'needs ' || (12 * (f + 1) + 28) || ' values' AS rule FROM k, range(7) r(f) WHERE n < 12 * (f + 1) + 28""",
)
def rejected_series(spark, d):
    return splits.rejected_series(tables.orders_nation_month(spark, d), n_folds=7)
