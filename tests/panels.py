"""Panels that tests share."""

import numpy as np
import pandas as pd


def monthly(n=60, seed=42, start="2016-01-01", lo=1000.0, hi=5000.0, amp=500.0, noise=100.0, name="A"):
    """Trend, yearly wave and noise."""
    rng = np.random.default_rng(seed)
    y = np.linspace(lo, hi, n) + amp * np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(0, noise, n)
    ts = pd.date_range(start, periods=n, freq="MS").date
    return pd.DataFrame({"series_id": name, "ts": ts, "y": y})
