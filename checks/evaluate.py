"""Queries on metrics, backtests, significance and reports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import NAT, POS, PRI, R, W, query, rounded
from tidepanel.contract import paradigm_of
from tidepanel.models import baseline
from tidepanel.operators import backtest, metrics, reports, significance, splits
from tidepanel.operators.quantiles import exact_percentiles
from tidepanel.sources import tables

H = 12
BASE_MODELS = ("Naive", "Seasonal Naive", "Mean")
PAIRS = (("Seasonal Naive", "Naive"), ("Mean", "Naive"), ("Mean", "Seasonal Naive"), ("Naive", "SARIMA"))


def base_forecasts(folds):
    """Three naive models in guarded form, one row per (series, fold, model)."""
    train = F.col("train")
    wide = folds.withColumn("_a", baseline.naive(train, H)).withColumn("_b", baseline.seasonal_naive(train, H))
    wide = wide.withColumn("_c", baseline.mean(train, H))
    return backtest.guarded_models(wide, {"Naive": "_a", "Seasonal Naive": "_b", "Mean": "_c"})


def holdout_rows(spark, d, bind=tables.orders_priority_month, hold_out=0):
    folds = splits.packed_folds(bind(spark, d), n_folds=1, hold_out=hold_out)
    return backtest.forecast_rows(base_forecasts(folds))


def nation_model_rows(spark, d):
    return base_forecasts(splits.packed_folds(tables.orders_nation_month(spark, d)))


def nation_rows(spark, d):
    return backtest.forecast_rows(nation_model_rows(spark, d))


def fold_ctes(cte: str, n_folds: int, hold_out: int = 0) -> str:
    """Forecast rows of the three naive models as row-window SQL."""
    folds = ", ".join(str(k) for k in range(n_folds))
    return f"""{cte}, {POS}, fr AS (SELECT series_id, ts, y, pos, n, fold, n - {hold_out} - 12 * (fold + 1) AS cut
    FROM q, (SELECT unnest([{folds}]) AS fold) WHERE n - {hold_out} - 12 * (fold + 1) >= 28 AND pos <= n - {hold_out} - 12 * fold),
sc AS (SELECT series_id, fold, greatest(coalesce(avg(abs(y - y12)), 1.0), 1e-8) AS scale FROM
    (SELECT *, lag(y, 12) OVER (PARTITION BY series_id, fold ORDER BY pos) AS y12 FROM fr WHERE pos <= cut) GROUP BY 1, 2),
tr AS (SELECT series_id, fold, max_by(y, pos) AS last_y, avg(y) AS mean_y, max(y) AS top, strftime(max(ts), '%Y-%m') AS origin
    FROM fr WHERE pos <= cut GROUP BY 1, 2),
te AS (SELECT fr.series_id, fr.fold, fr.pos - fr.cut AS h, fr.ts, fr.y, last_y, mean_y, top, origin, scale, b.y AS season_y
    FROM fr JOIN tr USING (series_id, fold) JOIN sc USING (series_id, fold)
    JOIN q b ON b.series_id = fr.series_id AND b.pos = fr.pos - 12 WHERE fr.pos > fr.cut),
cand AS (SELECT *, 'Naive' AS model, last_y AS yhat FROM te UNION ALL SELECT *, 'Seasonal Naive', season_y FROM te
    UNION ALL SELECT *, 'Mean', mean_y FROM te),
fc AS (SELECT *, CASE model WHEN 'Seasonal Naive' THEN 'Seasonal Baseline' ELSE 'Naive Baseline' END AS paradigm FROM cand),
mt AS (SELECT series_id, fold, model, any_value(paradigm) AS paradigm, any_value(origin) AS origin, avg(abs(y - yhat)) AS mae,
    sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat) / greatest(abs(y), 1e-8)) * 100 AS mape,
    avg(abs(y - yhat) / greatest((abs(y) + abs(yhat)) / 2, 1e-8)) * 100 AS smape, avg(abs(y - yhat)) / any_value(scale) AS mase
    FROM fc GROUP BY 1, 2, 3),
un AS (SELECT *, least(mase, 5.0) AS cm FROM mt)"""


ONE = fold_ctes(PRI, 1)
FOUR = fold_ctes(NAT, 4)
MET = ", ".join(f"{R(m, 4)} AS {m}" for m in ("mae", "rmse", "mape", "smape", "mase"))
BEN = f"""bn AS (SELECT series_id, model, paradigm, {R('mae', 2)} AS mae, {R('rmse', 2)} AS rmse, {R('mape', 2)} AS mape,
    {R('smape', 2)} AS smape, {R('mase', 3)} AS mase, CASE model WHEN 'Naive' THEN 1 WHEN 'Seasonal Naive' THEN 2 ELSE 12 END AS mo FROM mt)"""
WON = "wn AS (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mae, mo, model) = 1)"
LEAD = f"""ld AS (SELECT model, any_value(paradigm) AS paradigm, {R('avg(mae)')} AS mean_mae, {R('avg(rmse)')} AS mean_rmse,
    {R('avg(mape)')} AS mean_mape, {R('avg(smape)')} AS mean_smape, {R('avg(mase)', 6)} AS mean_mase, {R('quantile_cont(mae, 0.5)')} AS median_mae,
    avg(mase) AS k FROM bn GROUP BY 1)"""


def bench(spark, d, hold_out=0):
    return reports.benchmark(holdout_rows(spark, d, hold_out=hold_out))


@query(
    "flagship_holdout_leaderboard",
    f"""WITH {ONE}, {BEN}, {WON}, {LEAD} SELECT ld.model, paradigm, mean_mae, mean_rmse, mean_mape, mean_smape, mean_mase, median_mae,
    (SELECT count(*) FROM wn WHERE wn.model = ld.model) AS series_won, cast(row_number() OVER (ORDER BY k, ld.model) as integer) AS rank FROM ld""",
)
def flagship_holdout_leaderboard(spark, d):
    return rounded(reports.leaderboard(bench(spark, d)), mean_mase=6)


query("leaderboard", f"""WITH {fold_ctes(NAT, 1)}, {BEN}, {WON}, {LEAD} SELECT ld.model, paradigm, mean_mae, mean_rmse, mean_mape,
    mean_smape, mean_mase, median_mae, (SELECT count(*) FROM wn WHERE wn.model = ld.model) AS series_won,
    cast(row_number() OVER (ORDER BY k, ld.model) as integer) AS rank FROM ld""")(
    lambda spark, d: rounded(reports.leaderboard(reports.benchmark(holdout_rows(spark, d, tables.orders_nation_month))), mean_mase=6)
)


# --- metrics ---------------------------------------------------------------------------------

@query("metrics_all", f"WITH {ONE} SELECT series_id, fold, model, {MET} FROM mt")
def metrics_all(spark, d):
    return rounded(metrics.metrics(holdout_rows(spark, d)).drop("seed"))


@query("score_mase", f"WITH {ONE} SELECT series_id, model, {R('mase')} AS score FROM mt")
def score_mase(spark, d):
    return rounded(metrics.score(holdout_rows(spark, d), "MASE", ("series_id", "model")))


@query(
    "train_scale",
    f"WITH {ONE} SELECT series_id, {R('scale')} AS scale FROM sc",
)
def train_scale(spark, d):
    labelled = splits.split_rows(tables.orders_priority_month(spark, d), val=0)
    return rounded(metrics.train_scale(splits.history(labelled)))


@query(
    "metrics_by_horizon",
    f"""WITH {ONE} SELECT series_id, model, cast(h as integer) AS h, {R('avg(abs(y - yhat)) OVER w')} AS mae,
    {R('sqrt(avg((y - yhat) * (y - yhat)) OVER w)')} AS rmse, {R('avg(abs(y - yhat) / greatest(y, 1.0)) OVER w * 100')} AS mape,
    {R('avg(2 * abs(y - yhat) / greatest(abs(y) + abs(yhat), 1.0)) OVER w * 100')} AS smape,
    {R('avg(abs(y - yhat)) OVER w / scale')} AS mase FROM fc
    WINDOW w AS (PARTITION BY series_id, model ORDER BY h ROWS UNBOUNDED PRECEDING)""",
)
def metrics_by_horizon(spark, d):
    return rounded(metrics.metrics_by_horizon(holdout_rows(spark, d), ("series_id", "model")))


@query(
    "step_errors",
    f"WITH {ONE} SELECT series_id, model, cast(h as integer) AS h, ts, {R('abs(y - yhat)')} AS abs_error, {R('abs(y - yhat) / abs(y) * 100')} AS pct_error FROM fc",
)
def step_errors(spark, d):
    return rounded(metrics.step_errors(holdout_rows(spark, d)).drop("fold", "seed"))


HE = "he AS (SELECT model, cast(h as integer) AS h, avg(abs(y - yhat) / greatest(abs(y), 1e-8) * 100) AS e FROM fc GROUP BY 1, 2)"


@query("horizon_errors", f"WITH {ONE}, {HE} SELECT model, h, {R('e', 6)} AS mean_pct_error FROM he")
def horizon_errors(spark, d):
    return rounded(metrics.horizon_errors(holdout_rows(spark, d)), 6)


@query(
    "horizon_growth",
    f"WITH {ONE}, {HE} SELECT model, h, {R('e', 6)} AS mean_pct_error, {R('e / greatest(first_value(e) OVER (PARTITION BY model ORDER BY h), 1e-4)', 6)} AS relative_growth FROM he",
)
def horizon_growth(spark, d):
    return rounded(metrics.horizon_growth(holdout_rows(spark, d)), 6)


@query(
    "exact_percentiles_by_flag",
    "SELECT l_returnflag, " + ", ".join(f"{R(f'quantile_cont(l_extendedprice, {p})')} AS q{i}" for i, p in enumerate((0.05, 0.5, 0.95))) + ", count(*) AS n FROM lineitem GROUP BY 1",
)
def exact_percentiles_by_flag(spark, d):
    out = exact_percentiles(tables.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.05, 0.5, 0.95))
    return rounded(out.select("l_returnflag", *[F.col("q")[i].alias(f"q{i}") for i in range(3)], "n"))


# --- backtest --------------------------------------------------------------------------------

@query(
    "plausibility",
    f"""WITH {FOUR} SELECT series_id, fold, model, count(*) = 12 AND max(yhat) <= 3 * any_value(top) AND min(yhat) >= -any_value(top) AS ok,
    1.5 * max(yhat) <= any_value(top) * 3 AND 4 * min(yhat) <= any_value(top) * 3 AND 4 * max(yhat) <= 3 * any_value(top) AS ok_times_4 FROM fc GROUP BY 1, 2, 3""",
)
def plausibility(spark, d):
    rows = nation_model_rows(spark, d)
    big = F.transform("yhat", lambda x: 4 * x)
    return rows.select(
        "series_id", "fold", "model", backtest.plausible(F.col("yhat"), F.col("train")).alias("ok"),
        backtest.plausible(big, F.col("train")).alias("ok_times_4"),
    )


@query(
    "fallback_chain",
    f"""WITH {FOUR}, j AS (SELECT series_id, fold, max(mean_y) * 4 <= 3 * any_value(top) AS a, max(mean_y) * 2 <= 3 * any_value(top) AS b,
        max(season_y) <= 3 * any_value(top) AS c, any_value(mean_y) AS m, min_by(season_y, h) AS s1 FROM te GROUP BY 1, 2)
    SELECT series_id, fold, CASE WHEN a THEN '' WHEN b THEN 'constrained refit' WHEN c THEN 'Seasonal Naive' END AS fallback,
    {R('CASE WHEN a THEN 4 * m WHEN b THEN 2 * m WHEN c THEN s1 END')} AS first_step FROM j""",
)
def fallback_chain(spark, d):
    folds = splits.packed_folds(tables.orders_nation_month(spark, d))
    train = F.col("train")
    mean4 = F.transform(baseline.mean(train, H), lambda x: 4 * x)
    mean2 = F.transform(baseline.mean(train, H), lambda x: 2 * x)
    wide = folds.withColumn("_a", mean4).withColumn("_r", mean2).withColumn("_s", baseline.seasonal_naive(train, H))
    rows = backtest.guarded_models(wide, {"SARIMA": "_a", "Seasonal Naive": "_s"}, {"SARIMA": "_r"}).filter("model = 'SARIMA'")
    return rounded(rows.select("series_id", "fold", "fallback", F.element_at("yhat", 1).alias("first_step")))


@query(
    "backtest_metrics",
    f"WITH {FOUR} SELECT series_id, fold, model, paradigm, origin, '' AS fallback, false AS params_tuned_on_test, {MET} FROM mt",
)
def backtest_metrics(spark, d):
    return rounded(backtest.fold_metrics(nation_rows(spark, d)).drop("seed"))


@query(
    "backtest_errors",
    f"WITH {FOUR} SELECT series_id, fold, model, cast(h as integer) AS h, {R('abs(y - yhat)')} AS abs_error, {R('scale')} AS scale FROM fc",
)
def backtest_errors(spark, d):
    return rounded(backtest.fold_errors(nation_rows(spark, d)).drop("seed"))


@query(
    "backtest_failures",
    f"""WITH {FOUR} SELECT series_id, fold, 'Naive' AS model, 'no plausible forecast produced' AS error FROM te
    GROUP BY 1, 2 HAVING max(last_y) * 4 > 3 * any_value(top)""",
)
def backtest_failures(spark, d):
    folds = splits.packed_folds(tables.orders_nation_month(spark, d))
    wide = folds.withColumn("_a", F.transform(baseline.naive(F.col("train"), H), lambda x: 4 * x))
    return backtest.failures(backtest.guarded_models(wide, {"Naive": "_a"})).drop("seed")


@query(
    "missing_fits",
    f"""WITH {FOUR}, w AS (SELECT DISTINCT series_id, fold FROM te), m AS (SELECT unnest(['Naive', 'Mean', 'GRU', 'GRU', 'GRU']) AS model,
        unnest([NULL, NULL, 42, 0, 1]) AS seed) SELECT series_id, fold, model, seed FROM w, m WHERE model = 'GRU'""",
)
def missing_fits(spark, d):
    rows = nation_model_rows(spark, d)
    units = rows.select("series_id", "fold").distinct()
    expected = backtest.expected_fits(units, ["Naive", "Mean", "GRU"], [42, 0, 1])
    return backtest.missing_fits(expected, rows).drop("paradigm")


@query(
    "seed_table",
    """WITH m AS (SELECT unnest(['Naive', 'SARIMA', 'GRU']) AS model, unnest(['Naive Baseline', 'Econometric', 'Recurrent DL']) AS paradigm),
    s AS (SELECT unnest([42, 0, 1, 2, 3, 4, 5]) AS seed), f AS (SELECT model, seed, paradigm FROM m, s WHERE model = 'GRU'
        UNION ALL SELECT model, NULL, paradigm FROM m WHERE model <> 'GRU')
    SELECT o_orderpriority AS series_id, model, seed, paradigm FROM (SELECT DISTINCT o_orderpriority FROM orders), f""",
)
def seed_table(spark, d):
    series = tables.orders_priority_month(spark, d).select("series_id").distinct()
    return backtest.expected_fits(series, ["Naive", "SARIMA", "GRU"], backtest.resolve_seeds(7))


# Seeded copies of the naive forecasts: seed s scales the forecast by 1 + s / 50.
SEEDED = f"""{FOUR}, sd AS (SELECT * FROM (SELECT fc.*, NULL::integer AS seed, yhat AS f FROM fc WHERE model <> 'Mean'
        UNION ALL SELECT fc.*, s, yhat * (1 + s / 50.0::double) FROM fc, (SELECT unnest([0, 10, 400]) AS s) WHERE model = 'Mean')),
fm AS (SELECT series_id, fold, CASE model WHEN 'Mean' THEN 'GRU' ELSE model END AS model, seed, any_value(origin) AS origin,
    CASE WHEN model = 'Mean' THEN 'Recurrent DL' ELSE any_value(paradigm) END AS paradigm, avg(abs(y - f)) AS mae,
    sqrt(avg((y - f) * (y - f))) AS rmse, avg(abs(y - f) / greatest(abs(y), 1e-8)) * 100 AS mape,
    avg(abs(y - f) / greatest((abs(y) + abs(f)) / 2, 1e-8)) * 100 AS smape, avg(abs(y - f)) / any_value(scale) AS mase
    FROM sd GROUP BY series_id, fold, model, seed),
su AS (SELECT series_id, fold, model, any_value(paradigm) AS paradigm, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape,
    avg(smape) AS smape, avg(least(mase, 5.0)) AS mase, avg(mase) AS mase_raw,
    CASE WHEN count(*) > 1 THEN stddev_samp(least(mase, 5.0)) END AS seed_std FROM fm GROUP BY 1, 2, 3),
er AS (SELECT series_id, fold, CASE model WHEN 'Mean' THEN 'GRU' ELSE model END AS model, cast(h as integer) AS h,
    avg(least(abs(y - f) / scale, 5.0)) AS scaled_error FROM sd GROUP BY 1, 2, 3, 4)"""


def seeded_rows(spark, d):
    rows = nation_rows(spark, d)
    plain = rows.filter("model <> 'Mean'")
    varied = rows.filter("model = 'Mean'").withColumn("seed", F.explode(F.array(F.lit(0), F.lit(10), F.lit(400))))
    varied = varied.withColumn("yhat", F.col("yhat") * (1 + F.col("seed") / 50)).withColumn("model", F.lit("GRU"))
    return plain.unionByName(varied)


def seeded_metrics(spark, d):
    return backtest.fold_metrics(seeded_rows(spark, d))


@query(
    "seed_avg_units",
    f"WITH {SEEDED} SELECT series_id, fold, model, paradigm, {MET}, {R('mase_raw')} AS mase_raw, 0 AS used_fallback, {R('seed_std')} AS seed_std FROM su",
)
def seed_avg_units(spark, d):
    return rounded(backtest.seed_average(seeded_metrics(spark, d)))


@query("seed_avg_errors", f"WITH {SEEDED} SELECT series_id, fold, model, h, {R('scaled_error', 6)} AS scaled_error FROM er")
def seed_avg_errors(spark, d):
    return rounded(backtest.seed_average_errors(backtest.fold_errors(seeded_rows(spark, d))), 6)


UR = "ur AS (SELECT *, rank() OVER (PARTITION BY series_id, fold ORDER BY mase) + (count(*) OVER (PARTITION BY series_id, fold, mase) - 1) / 2.0::double AS unit_rank FROM su)"


@query("unit_ranks", f"WITH {SEEDED}, {UR} SELECT series_id, fold, model, unit_rank FROM ur")
def unit_ranks(spark, d):
    return backtest.with_unit_rank(backtest.seed_average(seeded_metrics(spark, d))).select("series_id", "fold", "model", "unit_rank")


@query(
    "seed_std",
    f"""WITH {SEEDED} SELECT model, {R('avg(seed_std)', 6)} AS mean_seed_std, cast(sum(CASE WHEN mase_raw > 5 THEN 1 ELSE 0 END) as bigint) AS diverged_units,
    cast(0 as bigint) AS fallback_units FROM su GROUP BY 1""",
)
def seed_std(spark, d):
    return rounded(backtest.seed_spread(seeded_metrics(spark, d)), 6)


@query("unit_counts", f"WITH {SEEDED} SELECT count(DISTINCT (series_id, fold)) AS n_units, count(DISTINCT series_id) AS n_series, count(DISTINCT seed) AS n_seeds FROM fm")
def unit_counts(spark, d):
    return backtest.unit_counts(seeded_metrics(spark, d))


def boot_sql(source: str, keys: str, value: str, n_boot: int) -> str:
    """Poisson resampling over ``source`` with unit text ``u``."""
    ends = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(9)]
    weight = " ".join(f"WHEN h < {e} THEN {k}" for k, e in enumerate(ends))
    return f"""dr AS (SELECT {keys}, r.b AS b, {value} AS v, cast('0x' || substr(md5(concat_ws('|', r.b, u, '0')), 1, 8) as bigint) AS h
    FROM {source}, range({n_boot}) r(b) WHERE {value} IS NOT NULL),
wt AS (SELECT {keys}, b, v, CASE {weight} ELSE 9 END AS w FROM dr),
bm AS (SELECT {keys}, b, sum(w * v) / sum(w) AS m FROM wt WHERE w > 0 GROUP BY ALL)"""


SU2 = "s2 AS (SELECT *, series_id || '|' || fold AS u FROM su)"


@query(
    "bootstrap_ci",
    f"""WITH {SEEDED}, {SU2}, {boot_sql('s2', 'model', 'mase', 5000)}, c AS (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1)
    SELECT model, {R('avg(mase)', 6)} AS mean, {R('any_value(lo)', 6)} AS ci_low, {R('any_value(hi)', 6)} AS ci_high, count(*) AS n_units
    FROM su JOIN c USING (model) GROUP BY 1""",
)
def bootstrap_ci(spark, d):
    units = backtest.seed_average(seeded_metrics(spark, d))
    return rounded(significance.bootstrap_ci(units, ["model"], backtest.unit_key(), "mase", n_boot=5000), 6)


PAIRED = f"""pr AS (SELECT unnest({[a for a, _ in PAIRS]}) AS model_a, unnest({[b for _, b in PAIRS]}) AS model_b),
pu AS (SELECT pr.model_a, pr.model_b, a.series_id, a.fold, a.series_id || '|' || a.fold AS u, a.mase - b.mase AS diff
    FROM pr JOIN su a ON a.model = pr.model_a JOIN su b ON b.model = pr.model_b AND a.series_id = b.series_id AND a.fold = b.fold)"""
PBOOT = f"""{boot_sql('pu', 'model_a, model_b', 'diff', 5000)},
pb AS (SELECT model_a, model_b, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi,
    least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0::double ELSE 0 END), avg(CASE WHEN m >= 0 THEN 1.0::double ELSE 0 END))) AS p FROM bm GROUP BY 1, 2)"""
SEED_PAIRS = f"{SEEDED}, {PAIRED.replace(chr(39) + 'Mean' + chr(39), chr(39) + 'GRU' + chr(39))}"
GRU_PAIRS = tuple((a.replace("Mean", "GRU"), b.replace("Mean", "GRU")) for a, b in PAIRS)


@query(
    "paired_bootstrap",
    f"""WITH {SEED_PAIRS}, {PBOOT} SELECT model_a, model_b, {R('avg(diff)', 6)} AS mean_diff, {R('any_value(lo)', 6)} AS ci_low,
    {R('any_value(hi)', 6)} AS ci_high, {R('any_value(p)', 6)} AS boot_p, count(*) AS n_units FROM pu JOIN pb USING (model_a, model_b) GROUP BY 1, 2""",
)
def paired_bootstrap(spark, d):
    units = backtest.paired_units(backtest.seed_average(seeded_metrics(spark, d)), GRU_PAIRS)
    return rounded(significance.paired_bootstrap(units, ["model_a", "model_b"], backtest.unit_key(), n_boot=5000), 6)


DM = """ls AS (SELECT pr.model_a, pr.model_b, a.series_id, a.scaled_error - b.scaled_error AS d,
    row_number() OVER (PARTITION BY pr.model_a, pr.model_b, a.series_id ORDER BY a.fold DESC, a.h) AS t
    FROM pr JOIN er a ON a.model = pr.model_a JOIN er b ON b.model = pr.model_b AND a.series_id = b.series_id AND a.fold = b.fold AND a.h = b.h),
cd AS (SELECT *, d - avg(d) OVER w AS c, avg(d) OVER w AS md, count(*) OVER w AS n FROM ls WINDOW w AS (PARTITION BY model_a, model_b, series_id)),
g AS (SELECT x.model_a, x.model_b, x.series_id, any_value(x.n) AS n, any_value(x.md) AS md,
    sum(x.c * y.c * CASE WHEN x.t = y.t THEN 1.0 ELSE 2 * (1 - (x.t - y.t) / 12.0::double) END) / any_value(x.n) AS lrv
    FROM cd x JOIN cd y ON x.model_a = y.model_a AND x.model_b = y.model_b AND x.series_id = y.series_id AND x.t - y.t BETWEEN 0 AND 11
    GROUP BY 1, 2, 3),
dm AS (SELECT *, CASE WHEN lrv > 1e-15 AND (n + 1 - 24 + 132.0::double / n) / n > 0
    THEN md / sqrt(lrv / n) * sqrt((n + 1 - 24 + 132.0::double / n) / n) END AS stat FROM g)"""


@query(
    "diebold_mariano",
    f"WITH {SEED_PAIRS}, {DM} SELECT model_a, model_b, series_id, cast(n as integer) AS n, {R('md', 6)} AS mean_diff, {R('stat', 6)} AS statistic FROM dm WHERE n >= 25",
)
def diebold_mariano(spark, d):
    losses = backtest.paired_losses(backtest.seed_average_errors(backtest.fold_errors(seeded_rows(spark, d))), GRU_PAIRS)
    out = significance.diebold_mariano(losses.filter(F.size("d") >= 25), ["model_a", "model_b", "series_id"])
    return rounded(out.drop("p_value"), 6)


@query(
    "compare_models",
    f"""WITH {SEED_PAIRS}, {PBOOT}, {DM}, b AS (SELECT model_a, model_b, avg(diff) AS md, any_value(lo) AS lo, any_value(hi) AS hi,
        any_value(p) AS p, count(*) AS units FROM pu JOIN pb USING (model_a, model_b) GROUP BY 1, 2),
    t AS (SELECT model_a, model_b, count(*) AS tested, cast(sum(CASE WHEN md < 0 THEN 1 ELSE 0 END) as bigint) AS better FROM dm
        WHERE n >= 25 AND stat IS NOT NULL GROUP BY 1, 2)
    SELECT model_a, model_b, {R('b.md', 6)} AS mean_diff, {R('lo', 6)} AS ci_low, {R('hi', 6)} AS ci_high, {R('p', 6)} AS boot_p, units,
    coalesce(tested, 0) AS dm_series_tested, coalesce(better, 0) AS dm_series_a_better, lo > 0 OR hi < 0 AS bootstrap_significant,
    false AS involves_tuned_model FROM b LEFT JOIN t USING (model_a, model_b)""",
)
def compare_models(spark, d):
    rows = seeded_rows(spark, d)
    out = backtest.compare_models(backtest.fold_metrics(rows), backtest.fold_errors(rows), GRU_PAIRS, n_boot=5000)
    return rounded(out.drop("dm_series_significant", "dm_median_p"), 6)


@query("compare_models_p_values")
def compare_models_p_values(spark, d):
    rows = seeded_rows(spark, d)
    losses = backtest.paired_losses(backtest.seed_average_errors(backtest.fold_errors(rows)), GRU_PAIRS)
    return significance.diebold_mariano(losses.filter(F.size("d") >= 25), ["model_a", "model_b", "series_id"])


SUMMARY = f"""{SU2}, {UR}, {boot_sql('s2', 'model', 'mase', 5000)}, c AS (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1),
sm AS (SELECT model, any_value(paradigm) AS paradigm, avg(mase) AS mean_mase, stddev_samp(mase) AS std_mase, avg(mase_raw) AS raw_mean_mase,
    cast(sum(CASE WHEN mase_raw > 5 THEN 1 ELSE 0 END) as bigint) AS diverged_units, avg(mase) FILTER (fold = 0) AS fold0_mean_mase,
    avg(seed_std) AS mean_seed_std, avg(unit_rank) AS mean_rank, count(*) AS units, quantile_cont(mase, 0.5) AS median_mase,
    cast(row_number() OVER (ORDER BY avg(mase), model) as integer) AS rank FROM ur GROUP BY 1)"""


@query(
    "model_summary",
    f"WITH {SEEDED}, {SUMMARY} SELECT model, paradigm, "
    + ", ".join(f"{R(c, 6)} AS {c}" for c in ("mean_mase", "std_mase", "raw_mean_mase", "fold0_mean_mase", "mean_seed_std", "mean_rank", "median_mase"))
    + f", {R('lo', 6)} AS ci_low, {R('hi', 6)} AS ci_high, diverged_units, cast(0 as bigint) AS fallback_units, units, rank FROM sm JOIN c USING (model)",
)
def model_summary(spark, d):
    return rounded(backtest.summarize_models(seeded_metrics(spark, d), n_boot=5000), 6)


@query(
    "model_pairs",
    f"""WITH {SEEDED}, {SUMMARY}, best AS (SELECT model FROM sm WHERE rank = 1), lead AS (SELECT (SELECT model FROM best) AS model_a, model AS model_b, rank AS ord FROM sm WHERE rank > 1),
    kp AS (SELECT unnest(['GRU', 'Seasonal Naive', 'GRU']) AS model_a, unnest(['Naive', 'GRU', 'LSTM']) AS model_b, unnest([1000, 1001, 1002]) AS ord)
    SELECT *, false AS involves_tuned_model FROM (SELECT model_a, model_b, ord FROM lead UNION ALL SELECT model_a, model_b, ord FROM kp
        WHERE model_a IN (SELECT model FROM sm) AND model_b IN (SELECT model FROM sm) AND NOT EXISTS (SELECT 1 FROM lead l
            WHERE least(l.model_a, l.model_b) = least(kp.model_a, kp.model_b) AND greatest(l.model_a, l.model_b) = greatest(kp.model_a, kp.model_b)))""",
)
def model_pairs(spark, d):
    units = backtest.seed_average(seeded_metrics(spark, d))
    ranks = units.groupBy("model").agg(F.avg("mase").alias("mean_mase"))
    summary = ranks.withColumn("rank", F.row_number().over(Window.orderBy("mean_mase", "model")))
    return backtest.model_pairs(summary, (("GRU", "Naive"), ("Seasonal Naive", "GRU"), ("GRU", "LSTM")))


# --- report tables ---------------------------------------------------------------------------

@query("benchmark_rows", f"WITH {ONE}, {BEN} SELECT series_id, model, paradigm, mae, rmse, mape, smape, mase FROM bn")
def benchmark_rows(spark, d):
    return bench(spark, d)


@query("core_subset", f"WITH {ONE}, {BEN} SELECT series_id, model, paradigm, mae, rmse, mape, smape, mase FROM bn WHERE model IN ('Naive', 'Mean')")
def core_subset(spark, d):
    return reports.core_subset(bench(spark, d), ("Naive", "Mean"))


@query("series_winners", f"WITH {ONE}, {BEN}, {WON} SELECT series_id, model, mae FROM wn")
def series_winners(spark, d):
    return reports.winners(bench(spark, d))


@query("win_shares", f"WITH {ONE}, {BEN}, {WON} SELECT model, count(*) AS series_won, {R('count(*) / (SELECT count(*) FROM wn)::double', 6)} AS share FROM wn GROUP BY 1")
def win_shares(spark, d):
    return rounded(reports.win_shares(bench(spark, d)), 6)


@query(
    "paradigm_means",
    f"WITH {ONE}, {BEN} SELECT paradigm, {R('avg(mape)', 6)} AS mean_mape, {R('avg(mase)', 6)} AS mean_mase, CASE paradigm WHEN 'Naive Baseline' THEN 1 ELSE 2 END AS paradigm_order FROM bn GROUP BY 1",
)
def paradigm_means(spark, d):
    return rounded(reports.paradigm_means(bench(spark, d)), 6)


@query("metric_means", f"WITH {ONE}, {BEN} SELECT model, " + ", ".join(f"{R(f'avg({m})', 6)} AS mean_{m}" for m in metrics.METRICS) + " FROM bn GROUP BY 1")
def metric_means(spark, d):
    return rounded(reports.model_means(bench(spark, d)), 6)


@query("metric_pivot", f"WITH {ONE}, {BEN} SELECT series_id, " + ", ".join(f"max(mase) FILTER (model = '{m}') AS \"{m}\"" for m in BASE_MODELS) + " FROM bn GROUP BY 1")
def metric_pivot(spark, d):
    return reports.metric_pivot(bench(spark, d), BASE_MODELS)


@query(
    "val_test_drift",
    f"""WITH {ONE}, {BEN}, v AS (SELECT * FROM ({"WITH " + fold_ctes(PRI, 1, 12) + ", " + BEN + " SELECT * FROM bn"}))
    SELECT series_id, model, v.paradigm, v.mae AS mae_val, v.mape AS mape_val, v.mase AS mase_val, bn.mae AS mae_test, bn.mape AS mape_test,
    bn.mase AS mase_test, {R('(bn.mae - v.mae) / v.mae * 100', 1)} AS mae_delta_pct FROM bn JOIN v USING (series_id, model)""",
)
def val_test_drift(spark, d):
    return reports.drift(bench(spark, d, hold_out=12), bench(spark, d))


@query(
    "top_by_metric",
    f"""WITH {ONE}, {BEN}, r AS (SELECT *, cast(row_number() OVER (PARTITION BY series_id ORDER BY mape, mo, model) as integer) AS place FROM bn)
    SELECT series_id, model, mape, place, place = 1 AS is_top FROM r""",
)
def top_by_metric(spark, d):
    return reports.ranked_by(bench(spark, d), "mape").select("series_id", "model", "mape", "place", "is_top")


ERR = "abs(yhat - y) / greatest(y, 1.0) * 100"


@query(
    "period_breakdown",
    f"WITH {ONE} SELECT series_id, cast(h as integer) AS h, strftime(any_value(ts), '%Y-%m') AS period, {R('any_value(y)')} AS actual, "
    + ", ".join(f"{R(f'''max(yhat) FILTER (model = '{m}')''')} AS \"{m} (Pred)\", max({R(ERR, 1)}) FILTER (model = '{m}') AS \"{m} (Err %)\"" for m in BASE_MODELS)
    + " FROM fc GROUP BY 1, 2",
)
def period_breakdown(spark, d):
    out = reports.period_breakdown(holdout_rows(spark, d), BASE_MODELS)
    return rounded(out)


@query(
    "shock_scenario",
    f"WITH {ONE} SELECT series_id, 'Shock (+10%)' AS model, cast(h as integer) AS h, ts, {R('y')} AS y, {R('yhat * 1.1::double')} AS yhat, "
    f"{R('abs(yhat * 1.1::double - y) / greatest(y, 1.0) * 100', 1)} AS error_pct FROM fc WHERE model = 'Naive'",
)
def shock_scenario(spark, d):
    return rounded(reports.shock(holdout_rows(spark, d), "Naive", 10.0))


@query(
    "origin_trend",
    f"""WITH {SEEDED} SELECT series_id, model, fold, origin, {R('avg(least(mase, 5.0))')} AS mase,
    strftime(strptime(origin || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') || ' to ' ||
    strftime(strptime(origin || '-01', '%Y-%m-%d') + INTERVAL 12 MONTH, '%Y-%m') AS test_window FROM fm GROUP BY 1, 2, 3, 4""",
)
def origin_trend(spark, d):
    return rounded(reports.origin_trend(seeded_metrics(spark, d)))


@query(
    "chart_rows",
    f"""WITH {ONE}, past AS (SELECT * FROM fr WHERE pos <= cut QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 24)
    SELECT series_id, ts, 'Historical' AS series, {R('y')} AS value, {R('y')} AS actual, 0.0::double AS error_pct, 'History' AS type FROM past
    UNION ALL SELECT series_id, ts, 'Actual Ground Truth', {R('y')}, {R('y')}, 0.0::double, 'Actual' FROM te
    UNION ALL SELECT series_id, ts, model || ' Forecast', {R('yhat')}, {R('y')}, {R(ERR, 1)}, 'Forecast' FROM fc WHERE model <> 'Mean'""",
)
def chart_rows(spark, d):
    panel = tables.orders_priority_month(spark, d)
    labelled = splits.split_rows(panel, val=12, test=12)
    return rounded(reports.chart_rows(splits.history(labelled), holdout_rows(spark, d), ("Naive", "Seasonal Naive")))


@query(
    "forecast_cache",
    f"""WITH {ONE}, hist AS (SELECT series_id, list(strftime(ts, '%Y-%m-%d') ORDER BY ts) AS history_dates, list({R('y', 3)} ORDER BY ts) AS history_values
        FROM fr WHERE pos <= cut GROUP BY 1), tst AS (SELECT series_id, list(strftime(ts, '%Y-%m-%d') ORDER BY ts) AS test_dates, list({R('y', 3)} ORDER BY ts) AS test_actuals FROM te GROUP BY 1),
    f AS (SELECT series_id, model, list({R('yhat', 3)} ORDER BY h) AS v FROM fc GROUP BY 1, 2)
    SELECT series_id, history_dates, history_values, test_dates, test_actuals,
    (SELECT v FROM f WHERE f.series_id = hist.series_id AND model = 'Seasonal Naive') AS seasonal_naive,
    (SELECT v FROM f WHERE f.series_id = hist.series_id AND model = 'Naive') AS naive FROM hist JOIN tst USING (series_id)""",
)
def forecast_cache(spark, d):
    folds = splits.packed_folds(tables.orders_priority_month(spark, d), n_folds=1)
    cache = reports.forecast_cache(folds, base_forecasts(folds))
    r3 = lambda c: F.transform(c, lambda x: F.round(x, 3))
    return cache.select(
        "series_id", "history_dates", r3(F.col("history_values")).alias("history_values"), "test_dates",
        r3(F.col("test_actuals")).alias("test_actuals"),
        r3(F.col("test_forecasts")["Seasonal Naive"]).alias("seasonal_naive"),
        r3(F.col("test_forecasts")["Naive"]).alias("naive"),
    )


@query("paradigm_lookup", f"WITH {ONE} SELECT DISTINCT model, paradigm FROM fc")
def paradigm_lookup(spark, d):
    return holdout_rows(spark, d).select("model", paradigm_of(F.col("model")).alias("paradigm")).distinct()
