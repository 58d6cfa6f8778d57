"""Statistics, as-of joins and scans' warnings against numpy, pandas and plain sums."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.walks import walk
from zonestudy.functions.timeframe import seconds
from zonestudy.operators import bars as B
from zonestudy.operators import controls as C
from zonestudy.operators import stats as G
from zonestudy.operators.touches import asof_join
from zonestudy.plans.scan import scan
from zonestudy.plans.spec import Spec, validate
from zonestudy.sources.scratch import kept


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    groups = {"even": rng.normal(size=20_001), "ties": np.round(rng.exponential(size=30_000), 1), "one": np.array([5.0]), "wide": np.r_[np.zeros(8000), rng.normal(size=8000) * 1e6], "two": rng.normal(size=2)}
    rows = pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in groups.items()] + [pd.DataFrame({"g": ["none", "two"], "x": [None, None]})])
    rows = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "g string, x double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0]
    got = {r.g: r.q for r in G.quantiles(rows, ["g"], "x", probs).collect()}
    assert sorted(got) == sorted(groups)
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, probs), rtol=1e-12)


def test_quantiles_of_values_that_crowd(spark, monkeypatch):
    """Few values may be ranked, so that bins are cut again and again: values of any size, a crowd in a hair's breadth, and ties."""
    monkeypatch.setattr(G, "RANKED", 20)
    rng = np.random.default_rng(6)
    groups = {"sizes": np.exp(rng.normal(size=3000) * 60) * rng.choice([-1, 1], 3000), "hair": 1e9 + rng.normal(size=3000) * 1e-6, "ties": rng.integers(0, 3, 3000) * 1.0, "tiny": rng.normal(size=3000) * 1e-200, "all": np.r_[-1.7e308, 1.7e308, rng.normal(size=500)]}
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in groups.items()]))
    probs = [0.0, 0.01, 0.3333, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in G.quantiles(rows, ["g"], "x", probs).collect()}
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, probs), rtol=1e-12, atol=0), g
    monkeypatch.setattr(G, "BOUNDS", 0)
    assert {r.g: r.q for r in G.quantiles(rows, ["g"], "x", probs).collect()} == got


def test_quantiles_meet_no_group_in_one_task(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("g"), F.rand(1).alias("x"))
    plan = G.quantiles(rows, ["g"], "x", [0.25, 0.5])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_bootstrap_of_a_few_values(spark):
    """A hundred million wins and losses are two values; the bounds are as wide as the normal ones."""
    n, k = 100_000_000, 36_000_000
    few = spark.range(0, n, 1, 8).select(F.col("id").alias("event_id"), F.when(F.col("id") < k, 2.0).otherwise(-1.0).alias("r_fixed"))
    r = G.bootstrap_mean(few).first()
    p = k / n
    half = 1.96 * 3 * math.sqrt(p * (1 - p) / n)
    assert r["mean"] == pytest.approx(3 * p - 1) and r.high - r.low == pytest.approx(2 * half, rel=0.06) and r.low < r["mean"] < r.high


def test_equity_curve_over_days(spark):
    rng = np.random.default_rng(7)
    rows = [(s, (pd.Timestamp("2024-03-01") + pd.Timedelta(minutes=int(m))).to_pydatetime(), f"{s}{i}", None if i % 9 == 0 else float(v)) for s in "ab" for i, (m, v) in enumerate(zip(rng.integers(0, 9 * 1440, 300), rng.normal(size=300)))]
    rows += [("c", datetime(2024, 3, d), f"c{d}", v) for d, v in ((1, None), (3, None), (5, 1.5))]
    got = {(r.symbol, r.event_id): r.equity for r in G.equity_curve(spark.createDataFrame(rows, "symbol string, ts timestamp, event_id string, r_fixed double")).collect()}
    for s in "abc":
        total, seen = 0.0, False
        for _, _, e, v in sorted(r for r in rows if r[0] == s):
            total, seen = total + (v or 0.0), seen or v is not None
            assert got[s, e] == pytest.approx(total) if seen else got[s, e] is None
    assert len(got) == len(rows)


def test_binomial_against_all_terms():
    def plain(k, n, p):
        terms = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        return min(1.0, sum(t for t in terms if t <= terms[k] * (1 + 1e-7)))

    for k, n, p in [(0, 1, 0.3), (3, 10, 0.3), (10, 10, 0.5), (40, 100, 0.33), (0, 60, 0.02), (333, 1000, 0.31)]:
        assert G._binomial_p(k, n, p) == pytest.approx(plain(k, n, p), rel=1e-9)
    assert G._binomial_p(33_005_000, 100_000_000, 0.33) == pytest.approx(0.287, abs=0.002)
    assert G._binomial_p(90_000_000, 100_000_000, 0.33) == 0.0 and math.isnan(G._binomial_p(0, 0, 0.5))


def test_bootstrap_bounds_have_the_right_width(spark):
    x = np.random.default_rng(3).normal(0.2, 1.5, 4000)
    events = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None), (-2, float("nan"))], "event_id long, r_fixed double")
    r = G.bootstrap_mean(events, n_boot=2000).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert r["mean"] == pytest.approx(x.mean()) and r.low == pytest.approx(x.mean() - half, abs=0.2 * half) and r.high == pytest.approx(x.mean() + half, abs=0.2 * half)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_pandas(spark, strict):
    rng = np.random.default_rng(5)
    at = lambda n, days: pd.Timestamp("2024-02-27") + pd.to_timedelta(rng.integers(0, days * 24 * 60, n), unit="min")
    left = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 400), "t": at(400, 90), "i": range(400)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "s": at(60, 60), "v": rng.normal(size=60)}).drop_duplicates(["k", "s"])
    right.loc[:5, "s"] = left["t"][:6].to_numpy()
    right = right.drop_duplicates(["k", "s"])
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "t", "s", ["k"], strict).toPandas().sort_values("i")
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("s"), left_on="t", right_on="s", by="k", allow_exact_matches=not strict).sort_values("i")
    assert np.allclose(got["v"].astype(float), want["v"], equal_nan=True) and got["v"].notna().sum() > 100


def test_lengths_of_time():
    assert [seconds(x) for x in ("15min", "4h", "1h30min", "1 h 30 min", "h", "2 hours", "90s", "1.5h", "D")] == [900, 14400, 5400, 5400, 3600, 7200, 90, 5400, 86400]
    for x in ("", None, "min0", "0min", "x", "5", "1h30", "1h-3min", "1h 0min"):
        with pytest.raises(ValueError):
            seconds(x)


def test_random_entries_follow_a_trend(spark):
    """In a rising market long trades at random bars win more often than the third that a flat one gives."""
    bars = kept(spark.createDataFrame(pd.concat([walk(12, 4, drift=0.15, symbol="up"), walk(12, 4, symbol="flat")])))
    rules = {"timeframe": "5min", "direction": "long", "zone": {"detector": "order_block", "params": {"displacement_atr": 1.2}}}
    events = kept(scan(bars, Spec.from_dict(rules)).events)
    rate = {r.symbol: r.rate for r in C.drift_baseline(kept(B.with_bar_seq(bars)), events, Spec.from_dict(rules).scoring).collect()}
    assert abs(rate["flat"] - 1 / 3) < 0.06 and rate["up"] > rate["flat"] + 0.08


def test_warnings_of_a_scan(spark):
    flat = walk(3, 2, symbol="still").assign(open=5.0, high=5.0, low=5.0, close=5.0)
    bars = kept(spark.createDataFrame(pd.concat([walk(6, 2, symbol="moves"), flat])))
    study = scan(bars, Spec.from_dict({"timeframe": "5min", "zone": {"detector": "fvg"}, "htf": {"timeframe": "4h"}}))
    counts = {r.symbol: r for r in study.counts().collect()}
    assert counts["still"].n_zones == counts["still"].n_events == 0 and counts["moves"].n_zones > 0
    assert {(r.symbol, r.warning[:8]) for r in study.warnings().collect() if r.symbol == "still"} == {("still", "no zones")}


def test_filters_on_a_higher_timeframe_need_one(spark):
    rules = {"timeframe": "5min", "zone": {"detector": "fvg"}, "htf": {"timeframe": ""}}
    assert validate(Spec.from_dict(rules | {"filters": ["session == 'htf_bias'"]})) == []
    assert len(validate(Spec.from_dict(rules | {"filters": ["1 < 2 and aligned == 1", "htf_bias > 0"]}))) == 1
