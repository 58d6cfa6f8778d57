"""Bars for tests: seeded random walks."""

import numpy as np
import pandas as pd


def walk(days=12, seed=1, drift=0.0, symbol="NQ"):
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2024-03-04", periods=days * 1440, freq="min", tz="UTC")
    ts = ts[ts.dayofweek < 5]
    step = rng.normal(drift, 1.2, len(ts))
    close = 15000 + np.cumsum(step)
    open_ = np.concatenate([[15000.0], close[:-1]])
    spread = rng.uniform(0, 1.0, (2, len(ts)))
    high, low = np.maximum(open_, close) + spread[0], np.minimum(open_, close) - spread[1]
    return pd.DataFrame({"symbol": symbol, "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": 1.0})
