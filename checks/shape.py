"""Queries on transforms, features and exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BRA, HOUR, NAT, POS, PRI, SPLIT, R, W, query, rounded
from tidepanel.operators import explore, features, splits, transforms
from tidepanel.sources import tables


def _labelled(spark, d):
    """Brand panel with split labels; parameters come from the train rows only."""
    panel = splits.split_rows(tables.brand_ship_month(spark, d)).select("series_id", "ts", "y", "peak", "split")
    return panel, panel.filter("split = 'train'")


def _scaled(kind, sql):
    def run(spark, d):
        panel, train = _labelled(spark, d)
        params = transforms.fit_scaler(train, kind)
        out = transforms.invert_scaler(transforms.apply_scaler(panel, params), params)
        return rounded(out.select("series_id", "ts", "y_scaled", "y_restored"), y_scaled=6)

    query(
        f"scale_{kind}",
        W(BRA, POS, SPLIT, f"f AS (SELECT series_id, {sql} FROM sp WHERE split = 'train' GROUP BY 1)")
        + f"SELECT series_id, ts, {R('(y - c) / s', 6)} AS y_scaled, {R('(y - c) / s * s + c')} AS y_restored FROM sp JOIN f USING (series_id)",
    )(run)


_scaled("minmax", "min(y) AS c, CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END AS s")
_scaled("standard", "avg(y) AS c, CASE WHEN stddev_pop(y) = 0 THEN 1.0 ELSE stddev_pop(y) END AS s")
_scaled("robust", "quantile_cont(y, 0.5) AS c, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS s")


@query(
    "scale_two_columns",
    W(BRA, POS, SPLIT, "f AS (SELECT series_id, avg(y) AS a, stddev_pop(y) AS b, avg(peak) AS c, stddev_pop(peak) AS e FROM sp WHERE split = 'train' GROUP BY 1)")
    + f"SELECT series_id, ts, {R('(y - a) / b', 6)} AS y_scaled, {R('(peak - c) / (CASE WHEN e = 0 THEN 1.0 ELSE e END)', 6)} AS peak_scaled FROM sp JOIN f USING (series_id)",
)
def scale_two_columns(spark, d):
    panel, train = _labelled(spark, d)
    cols = ("y", "peak")
    out = transforms.apply_scaler(panel, transforms.fit_scaler(train, "standard", cols), cols)
    return rounded(out.select("series_id", "ts", "y_scaled", "peak_scaled"), 6)


@query(
    "log_transform",
    W(BRA, POS, SPLIT, "f AS (SELECT series_id, CASE WHEN min(y) <= 0 THEN 1 - min(y) ELSE 0.0 END AS c FROM sp WHERE split = 'train' GROUP BY 1)")
    + f"SELECT series_id, ts, {R('ln(y + c)', 8)} AS y_log, {R('exp(ln(y + c)) - c')} AS y_restored FROM sp JOIN f USING (series_id)",
)
def log_transform(spark, d):
    panel, train = _labelled(spark, d)
    params = transforms.fit_log(train)
    out = transforms.invert_log(transforms.apply_log(panel, params), params)
    return rounded(out.select("series_id", "ts", "y_log", "y_restored"), y_log=8)


_BC = "CASE WHEN {l} = 0 THEN ln(x) ELSE (pow(x, {l}) - 1) / {l} END"


@query(
    "boxcox_grid",
    W(
        BRA, POS, SPLIT,
        "t AS (SELECT series_id, y FROM sp WHERE split = 'train')",
        "g AS (SELECT series_id, exp(avg(ln(y))) AS gm FROM t GROUP BY 1)",
        "x AS (SELECT series_id, y / gm AS x FROM t JOIN g USING (series_id))",
        f"c AS (SELECT series_id, i / 100.0::double AS l, -ln(var_pop({_BC.format(l='(i / 100.0::double)')})) AS s FROM x, range(-200, 201) r(i) GROUP BY series_id, i)",
        "c1 AS (SELECT series_id, l AS l0 FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s DESC, l) = 1)",
        f"e AS (SELECT series_id, round(l0 + i / 10000.0::double, 4) AS l FROM c1, range(-100, 101) r(i))",
        f"f AS (SELECT e.series_id, l, -ln(var_pop({_BC.format(l='l')})) AS s FROM x JOIN e ON x.series_id = e.series_id GROUP BY 1, 2)",
    )
    + f"SELECT series_id, {R('l', 3)} AS lam, 0.0::double AS c FROM f QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s DESC, l) = 1",
)
def boxcox_grid(spark, d):
    _, train = _labelled(spark, d)
    fit = transforms.fit_boxcox(train)
    return fit.select("series_id", F.round("lam", 3).alias("lam"), F.col("offset").alias("c"))


@query("boxcox_round_trip", W(BRA, POS, SPLIT) + "SELECT series_id, ts, y, true AS restored FROM sp")
def boxcox_round_trip(spark, d):
    panel, train = _labelled(spark, d)
    params = transforms.fit_boxcox(train)
    out = transforms.invert_boxcox(transforms.apply_boxcox(panel, params), params)
    # Near lambda = -2 the transform leaves few significant digits, so the bound is a relative 1e-7.
    restored = F.abs(F.col("y_restored") - F.col("y")) < 1e-7 * F.abs(F.col("y"))
    return out.select("series_id", "ts", "y", restored.alias("restored"))


# --- differencing ----------------------------------------------------------------------------

_W = "OVER (PARTITION BY series_id ORDER BY ts)"


@query("diff_regular", W(NAT, f"a AS (SELECT *, y - lag(y) {_W} AS d1 FROM p)") + f"SELECT series_id, ts, {R('d1')} AS d1, {R(f'd1 - lag(d1) {_W}')} AS d2 FROM a")
def diff_regular(spark, d):
    panel = tables.orders_nation_month(spark, d)
    one = transforms.difference(panel, 1).withColumnRenamed("y_diff", "d1")
    return rounded(transforms.difference(one, 2).select("series_id", "ts", "d1", F.col("y_diff").alias("d2")))


@query(
    "diff_seasonal",
    W(NAT, f"a AS (SELECT *, y - lag(y) {_W} AS d1 FROM p)", f"b AS (SELECT *, d1 - lag(d1, 12) {_W} AS x FROM a)")
    + f"SELECT series_id, ts, {R('x')} AS y_diff FROM b WHERE x IS NOT NULL",
)
def diff_seasonal(spark, d):
    out = transforms.difference(tables.orders_nation_month(spark, d), 1, 12, drop_null=True)
    return rounded(out.select("series_id", "ts", "y_diff"))


@query(
    "undo_regular",
    W(NAT, POS) + f"SELECT series_id, ts, {R('y', 5)} AS level FROM q WHERE pos > n - 12 AND n > 12",
)
def undo_regular(spark, d):
    rows = splits.with_position(tables.orders_nation_month(spark, d)).filter("n > 12")
    delta = transforms.difference(rows, 1).filter("pos > n - 12").select("series_id", "ts", F.col("y_diff").alias("delta"))
    last = rows.filter("pos = n - 12").select("series_id", F.col("y").alias("last_y"))
    return rounded(transforms.undo_regular(delta, last).select("series_id", "ts", "level"), 5)


@query(
    "undo_seasonal",
    W(NAT, POS) + f"SELECT series_id, ts, {R('y', 5)} AS level FROM q WHERE pos > n - 18 AND n >= 31",
)
def undo_seasonal(spark, d):
    rows = splits.with_position(tables.orders_nation_month(spark, d)).filter("n >= 31")
    steps = transforms.difference(rows, 0, 12).filter("pos > n - 18")
    steps = steps.select("series_id", "ts", (F.col("pos") - F.col("n") + 18).alias("h"), F.col("y_diff").alias("delta"))
    base = rows.filter("pos > n - 30 and pos <= n - 18").select(
        "series_id", (F.col("pos") - F.col("n") + 29).alias("phase"), F.col("y").alias("base_y")
    )
    return rounded(transforms.undo_seasonal(steps, base).select("series_id", "ts", "level"), 5)


@query(
    "undo_combined",
    W(NAT, POS) + f"SELECT series_id, pos - n + 18 AS h, {R('y', 5)} AS level FROM q WHERE pos > n - 18 AND n >= 31",
)
def undo_combined(spark, d):
    rows = splits.with_position(tables.orders_nation_month(spark, d)).filter("n >= 31")
    history = transforms.boundary_history(rows.filter("pos <= n - 18"), 1, 12)
    deltas = transforms.difference(rows, 1, 12).filter("pos > n - 18").groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "y_diff"))).alias("r")
    )
    level = transforms.undo_difference(F.col("history"), F.col("r.y_diff"), 1, 12)
    out = history.join(deltas, "series_id").select("series_id", F.posexplode(level).alias("i", "level"))
    return rounded(out.select("series_id", (F.col("i") + 1).cast("long").alias("h"), "level"), 5)


@query(
    "boundary_history",
    W(NAT, POS) + "SELECT series_id, list(y ORDER BY ts) AS history FROM q WHERE pos > n - 13 GROUP BY 1",
)
def boundary_history(spark, d):
    return transforms.boundary_history(tables.orders_nation_month(spark, d), 1, 12)


@query(
    "gap_fill",
    W(
        HOUR,
        "b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1)",
        "g AS (SELECT b.series_id, t AS ts FROM b, LATERAL (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t))",
        "j AS (SELECT g.series_id, g.ts, p.y FROM g LEFT JOIN p ON p.series_id = g.series_id AND p.ts = g.ts)",
        f"k AS (SELECT *, row_number() {_W} AS pos FROM j)",
        "m AS (SELECT *, last_value(y IGNORE NULLS) OVER w AS y0, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0, "
        "first_value(y IGNORE NULLS) OVER v AS y1, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS p1 FROM k "
        "WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "v AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    )
    + f"SELECT series_id, strftime(ts, '%Y-%m-%d %H') AS hour, {R('coalesce(y, y0 + (y1 - y0) * (pos - p0) / (p1 - p0), y1, y0)')} AS y_filled FROM m",
)
def gap_fill(spark, d):
    panel = tables.events_period(spark, d, "hour")
    # A full hourly spine per series: the span is bounded by the calendar.
    spine = panel.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        "series_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("ts")
    )
    full = spine.join(panel.select("series_id", "ts", "y"), ["series_id", "ts"], "left")
    out = transforms.fill_gaps(full)
    return rounded(out.select("series_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "y_filled"))


# --- features --------------------------------------------------------------------------------

_LAGS = ", ".join(f"lag(y, {k}) {_W} AS lag_{k}" for k in (1, 2, 3, 6, 12))
_CAL = (
    "month(ts) AS month, quarter(ts) AS quarter, sin(2 * pi() * month(ts) / 12) AS month_sin, "
    "cos(2 * pi() * month(ts) / 12) AS month_cos, CASE WHEN month(ts) IN (6, 7) THEN 1 ELSE 0 END AS is_summer, "
    "CASE WHEN month(ts) IN (12, 1) THEN 1 ELSE 0 END AS is_winter_holiday"
)


def _frame(w, shift=1):
    return f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {w + shift - 1} PRECEDING AND {shift} PRECEDING)"


def _roll(metrics, windows):
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return ", ".join(
        f"CASE WHEN count(y) {_frame(w)} >= {w} THEN {fn[m]}(y) {_frame(w)} END AS rolling_{m}_{w}" for w in windows for m in metrics
    )


@query("lag_features", W(NAT) + f"SELECT series_id, ts, {_LAGS} FROM p")
def lag_features(spark, d):
    return features.lag_features(tables.orders_nation_month(spark, d)).drop("y", "peak")


_RNAMES = [f"rolling_{m}_{w}" for w in (3, 6, 12) for m in ("mean", "std", "min", "max")]


@query(
    "rolling_features",
    W(NAT, f"a AS (SELECT series_id, ts, {_roll(('mean', 'std', 'min', 'max'), (3, 6, 12))} FROM p)")
    + "SELECT series_id, ts, " + ", ".join(f"{R(c, 3)} AS {c}" for c in _RNAMES) + " FROM a",
)
def rolling_features(spark, d):
    out = features.rolling_features(tables.orders_nation_month(spark, d), metrics=("mean", "std", "min", "max"))
    return rounded(out.drop("y", "peak"), 3)


def _stat(fn, w):
    return f"{fn}(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


@query(
    "rolling_stats",
    W(NAT)
    + "SELECT series_id, ts, "
    + ", ".join(
        f"{R(_stat(fn, w), dg)} AS {m}_{w}" for w in (6, 12) for m, fn, dg in (("mean", "avg", 3), ("std", "stddev_samp", 3), ("var", "var_samp", 0))
    )
    + " FROM p",
)
def rolling_stats(spark, d):
    return rounded(features.rolling_stats(tables.orders_nation_month(spark, d)).drop("y", "peak"), 3, var_6=0, var_12=0)


@query("calendar_features", W(NAT) + f"SELECT series_id, ts, {_CAL.replace('sin(2 * pi() * month(ts) / 12)', R('sin(2 * pi() * month(ts) / 12)', 8)).replace('cos(2 * pi() * month(ts) / 12)', R('cos(2 * pi() * month(ts) / 12)', 8))} FROM p")
def calendar_features(spark, d):
    return rounded(features.calendar_features(tables.orders_nation_month(spark, d)).drop("y", "peak"), 8)


_MATRIX = f"fm AS (SELECT series_id, ts, y, {_LAGS}, {_roll(('mean', 'std'), (3, 6, 12))}, {_CAL} FROM p)"


def _matrix_out(extra=""):
    names = features.feature_names()
    cols = ", ".join(f"{R(c, 3)} AS {c}" if c.startswith(("rolling", "month_", "lag")) else c for c in names)
    return f"SELECT series_id, ts, {cols}{extra} FROM fm"


@query("feature_matrix", W(NAT, _MATRIX) + _matrix_out() + " WHERE lag_12 IS NOT NULL AND rolling_std_12 IS NOT NULL")
def feature_matrix(spark, d):
    return rounded(features.feature_matrix(tables.orders_nation_month(spark, d)).drop("y", "peak"), 3)


@query(
    "next_step_features",
    W(
        NAT.replace("p AS (", "p0 AS ("),
        "p AS (SELECT * FROM p0 UNION ALL SELECT series_id, cast(max(ts) + INTERVAL 1 MONTH as date), NULL, NULL FROM p0 GROUP BY 1)",
        _MATRIX,
    )
    + _matrix_out() + " WHERE y IS NULL",
)
def next_step_features(spark, d):
    out = features.next_step_features(splits.pack(tables.orders_nation_month(spark, d)))
    return rounded(out, 3)


@query(
    "sequence_windows",
    W(NAT, POS)
    + "SELECT series_id, ts, list(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x, "
    "list(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS y_next FROM q "
    "QUALIFY pos >= 12 AND pos <= n - 12",
)
def sequence_windows(spark, d):
    return features.sequence_windows(tables.orders_nation_month(spark, d))


# --- exploratory tables ----------------------------------------------------------------------

@query("indexed_growth", W(BRA) + f"SELECT series_id, ts, {R(f'y / first_value(y) {_W} * 100')} AS growth_index FROM p")
def indexed_growth(spark, d):
    return rounded(explore.indexed_growth(tables.brand_ship_month(spark, d)).select("series_id", "ts", "growth_index"))


@query("peak_ratio", W(BRA) + f"SELECT series_id, {R('avg(peak / greatest(y, 1.0))', 6)} AS mean_ratio, {R('max(peak / greatest(y, 1.0))', 6)} AS max_ratio FROM p GROUP BY 1")
def peak_ratio(spark, d):
    return rounded(explore.peak_ratio(tables.brand_ship_month(spark, d)), 6)


_DEV = (
    "dv AS (SELECT series_id, ts, month(ts) AS month, year(ts) AS year, "
    "(y - avg(y) OVER (PARTITION BY series_id, year(ts))) / avg(y) OVER (PARTITION BY series_id, year(ts)) * 100 AS deviation_pct FROM p)"
)


@query("seasonal_deviation", W(BRA, _DEV) + f"SELECT series_id, ts, {R('deviation_pct', 6)} AS deviation_pct FROM dv")
def seasonal_deviation(spark, d):
    out = explore.seasonal_deviation(tables.brand_ship_month(spark, d))
    return rounded(out.select("series_id", "ts", "deviation_pct"), 6)


@query(
    "month_quartiles",
    W(
        BRA, _DEV,
        "mq AS (SELECT month, quantile_cont(deviation_pct, 0.25) AS q1, quantile_cont(deviation_pct, 0.5) AS median, quantile_cont(deviation_pct, 0.75) AS q3 FROM dv GROUP BY 1)",
    )
    + f"""SELECT month, {R('any_value(q1)', 6)} AS q1, {R('any_value(median)', 6)} AS median, {R('any_value(q3)', 6)} AS q3,
    {R('min(deviation_pct) FILTER (deviation_pct BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 6)} AS whisker_low,
    {R('max(deviation_pct) FILTER (deviation_pct BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 6)} AS whisker_high,
    count(*) FILTER (NOT deviation_pct BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM dv JOIN mq USING (month) GROUP BY 1""",
)
def month_quartiles(spark, d):
    return rounded(explore.month_quartiles(tables.brand_ship_month(spark, d)), 6)


@query("seasonal_profile", W(BRA) + f"SELECT series_id, month(ts) AS month, {R('avg(y)')} AS mean_y FROM p GROUP BY 1, 2")
def seasonal_profile(spark, d):
    return rounded(explore.seasonal_profile(tables.brand_ship_month(spark, d)))


@query(
    "seasonal_subseries",
    W(BRA) + f"SELECT series_id, month(ts) AS month, year(ts) AS year, y, {R('avg(y) OVER (PARTITION BY series_id, month(ts))')} AS month_mean FROM p",
)
def seasonal_subseries(spark, d):
    return rounded(explore.seasonal_subseries(tables.brand_ship_month(spark, d)), skip=("y",))


@query(
    "series_overview",
    W(BRA) + f"SELECT series_id, min(ts) AS first_period, max(ts) AS last_period, count(y) AS n, {R('avg(y)')} AS mean_y, max(peak) AS max_peak, max_by(y, ts) AS latest_y FROM p GROUP BY 1",
)
def series_overview(spark, d):
    return rounded(explore.series_overview(tables.brand_ship_month(spark, d)), skip=("latest_y", "max_peak"))


@query(
    "series_profile",
    W(BRA) + f"SELECT series_id, count(y) AS n, min(ts) AS first_period, max(ts) AS last_period, {R('avg(y)')} AS mean_y, max(peak) AS max_peak, {R('stddev_samp(y)')} AS std_y FROM p GROUP BY 1",
)
def series_profile(spark, d):
    return rounded(explore.series_profile(tables.brand_ship_month(spark, d)), skip=("max_peak",))


@query(
    "recent_history",
    W(BRA) + "SELECT series_id, ts, y, cast(row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) as integer) AS rows_back FROM p QUALIFY rows_back <= 24",
)
def recent_history(spark, d):
    return explore.recent_history(tables.brand_ship_month(spark, d), 24).select("series_id", "ts", "y", "rows_back")
