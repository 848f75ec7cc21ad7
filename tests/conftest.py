import sys
from pathlib import Path

import pandas as pd
import pytest
from panels import monthly

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidepanel.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture()
def panel(spark):
    """Two series, the second 1.5 times the first."""
    a = monthly()
    b = a.assign(series_id="B", y=a.y * 1.5)
    return spark.createDataFrame(pd.concat([a, b]), "series_id string, ts date, y double")
