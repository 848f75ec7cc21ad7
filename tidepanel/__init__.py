"""Panel forecasting and backtesting expressed as Spark DataFrame jobs.

A *panel* is a DataFrame unique on ``(series_id, ts)`` with the observed value
in ``y`` (and optionally ``peak``, ``gain``, ``pct_gain``).  Every operator takes
and returns DataFrames; nothing is collected to the driver.
"""
