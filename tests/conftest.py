import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = check.session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def walk():
    """Three price series of different length, with calendar gaps, as a pandas frame."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    parts = []
    for name, n in (("A", 700), ("B", 260), ("C", 1)):
        days = pd.date_range("2015-01-01", periods=n * 2, freq="D")[np.sort(rng.choice(n * 2, n, replace=False))]
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        high, low = close * (1 + rng.uniform(0, 0.02, n)), close * (1 - rng.uniform(0, 0.02, n))
        parts.append(pd.DataFrame({
            "symbol": name, "date": days.date, "open": close, "high": high, "low": low, "close": close,
            "volume": rng.integers(1, 100, n).astype(float), "sp500_return": rng.normal(0, 1, n), "nasdaq_return": rng.normal(0, 1, n)}))
    return pd.concat(parts, ignore_index=True)
