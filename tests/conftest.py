import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle_check import session

    made = session()
    yield made
    made.stop()


@pytest.fixture(scope="session")
def hand_panel(spark):
    """Ties, gaps, a leading gap, a single-row instrument, a constant series."""
    import datetime as dt

    rows = []
    series = {
        1: [5.0, 5.0, 7.0, None, 3.0, 9.0, 9.0, 1.0, None, None, 4.0, 8.0],
        2: [None, 2.0, 2.0, 6.0, 1.5, 2.5, -3.0, 0.0, 4.0, 4.0, 4.0, 4.0],
        3: [1.0] * 12,
        4: [10.0],
    }
    for instrument, values in series.items():
        for i, v in enumerate(values):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i + (5 if i > 6 else 0))
            rows.append((day, instrument, v, float((i * 7 + instrument) % 5)))
    return spark.createDataFrame(rows, "datetime date, instrument long, x double, y double").cache()
