"""A Python step holds one worker in each running task, so a stage must not hold many of them."""

import checks.forecast as forecast
from tidepanel.models import fitted, registry
from tidepanel.operators import splits

DIR = "/root/testdata/sf0.001"


def python_steps(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_forms_of_smoothing_share_a_worker(spark):
    assert python_steps(forecast.holt_winters_variants(spark, DIR)) == 1


def test_models_do_not_pile_up_in_one_stage(spark, panel):
    folds = splits.packed_folds(panel, n_folds=1)
    makers = registry.all_forecasters()
    made, columns = registry.add_forecasts(folds, {m: makers[m] for m in ("Naive", "Holt-Winters", "AR(1)", "SARIMA", "Ridge")})
    assert len(columns) == 5 and made.count() == folds.count() and python_steps(made) == 0
    plain, _ = registry.add_forecasts(folds, {"Naive": makers["Naive"]})
    assert python_steps(plain) == 0 and "forecast_0" in plain.columns
    assert python_steps(fitted.fitted_values(folds, ("Holt-Winters", "AR(1)", "Ridge", "SARIMA"))) == 0
