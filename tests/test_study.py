"""The study on random walks: scoring and visits against plain loops, no look-ahead, calibration, controls."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.walks import walk
from zonestudy.operators import bars as B
from zonestudy.operators import controls as C
from zonestudy.operators import features as X
from zonestudy.operators import scoring as E
from zonestudy.operators import stats as G
from zonestudy.operators import touches as J
from zonestudy.operators import zones as Z
from zonestudy.plans.scan import EVENT_COLUMNS, scan
from zonestudy.plans.spec import Scoring, Spec, validate
from zonestudy.sources.scratch import kept

RULES = {
    "timeframe": "5min", "htf": {"timeframe": "4h"}, "zone": {"detector": "order_block", "params": {"displacement_atr": 1.2, "max_age_bars": 200}},
    "scoring": {"max_holding_bars": 240},
}


@pytest.fixture(scope="module")
def pdf():
    return walk()


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return kept(spark.createDataFrame(pdf))


@pytest.fixture(scope="module")
def study(bars):
    return scan(bars, Spec.from_dict(RULES))


@pytest.fixture(scope="module")
def events(study):
    return kept(study.events)


def walk_forward(e, b, n, limit):
    """One trade, bar by bar."""
    long, entry, stop, target = e.bias == 1, e.entry, e.stop, e.target
    i = e.bar_seq + (0 if limit else 1)
    mfe = mae = 0.0
    out, unsure, held, r = "timeout", False, None, None
    end = min(i + n, len(b))
    for j in range(i, end):
        hi, lo, c = b.high[j], b.low[j], b.close[j]
        good, bad = (hi, lo) if long else (lo, hi)
        if limit and j == i:
            capped = max(entry, c) if long else min(entry, c)
            past = lambda p: (p - target) * e.bias >= 0
            unsure = unsure or past(good) and not past(capped)
            good = capped
        mfe, mae = max(mfe, (good - entry) * e.bias / e.risk_points), max(mae, (entry - bad) * e.bias / e.risk_points)
        if out == "timeout":
            s, g = (bad - stop) * e.bias <= 0, (good - target) * e.bias >= 0
            if s:
                out, unsure, held, r = "loss", unsure or g, j - i + 1, -1.0
            elif g:
                out, held, r = "win", j - i + 1, (target - entry) * e.bias / e.risk_points
    if out == "timeout":
        held, r = end - i, (b.close[end - 1] - entry) * e.bias / e.risk_points
    return out, bool(unsure), held, r, mfe, mae


def check_scores(events, pdf, n, limit):
    rows = events.toPandas()
    assert len(rows) > 50 and set(rows.outcome) >= {"win", "loss"}
    for e in rows.itertuples():
        out, unsure, held, r, mfe, mae = walk_forward(e, pdf, n, limit)
        assert (e.outcome, e.ambiguous, e.bars_held) == (out, unsure, held)
        assert np.allclose([e.r_fixed, e.mfe_r, e.mae_r], [r, mfe, mae])


def test_scores_are_those_of_the_loop(events, pdf):
    check_scores(events, pdf, 240, True)
    assert events.columns == EVENT_COLUMNS


def test_scores_from_the_next_open(spark, bars, pdf):
    rules = RULES | {"scoring": {"entry": "next_open", "stop": {"mode": "atr", "value": 1}, "target": {"mode": "fixed_points", "value": 6}, "max_holding_bars": 37}}
    check_scores(scan(bars, Spec.from_dict(rules)).events, pdf, 37, False)


def test_first_touch_uses_only_what_was_known(events, study, pdf):
    assert events.filter("ts < formed_at").count() == 0
    rows = events.orderBy("ts").limit(60).toPandas()
    five = pdf.set_index("ts").resample("5min").agg({"open": "first", "high": "max", "low": "min", "close": "last"}).dropna()
    before = five.close.shift(1)
    tr = pd.concat([five.high - five.low, (five.high - before).abs(), (five.low - before).abs()], axis=1).max(axis=1)
    atr = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    four = pdf.set_index("ts").resample("4h").agg({"close": "last"}).dropna()
    ema = four.close.ewm(span=50, adjust=False).mean()
    for e in rows.itertuples():
        ts = e.ts.tz_localize("UTC")
        assert e.atr == pytest.approx(atr[atr.index + pd.Timedelta("5min") <= ts].iloc[-1])
        closed = four[four.index + pd.Timedelta("4h") < ts]
        if len(closed):
            assert e.htf_bias == (1 if closed.close.iloc[-1] >= ema[closed.index[-1]] else -1)
            assert e.htf_bar_progress >= 0 and e.aligned == float(e.htf_bias == e.bias)


def test_visits_are_those_of_the_loop(spark, bars, pdf, study):
    numbered = B.with_bar_seq(bars)
    zones = study.zones.limit(40)
    zones = kept(zones)
    for trigger in J.TRIGGERS:
        got = J.separate_tests(J.zone_hits(zones, numbered, trigger, "5min", 1, True), zones).select("zone_id", "bar_seq", "test_number").toPandas()
        want = []
        for z in zones.toPandas().itertuples():
            a, b = z.formed_at.tz_localize("UTC") + pd.Timedelta("5min"), z.expires_at.tz_localize("UTC")
            own, armed, k = pdf[(pdf.ts >= a) & (pdf.ts <= b)], True, 0
            for r in own.itertuples():
                touch = r.high >= z.zone_low and r.low <= z.zone_high
                hit = {"touch": touch, "close_inside": z.zone_low <= r.close <= z.zone_high, "wick_through": r.low <= z.zone_low if z.bias == 1 else r.high >= z.zone_high}[trigger]
                if not (touch or hit):
                    armed = True
                elif armed and hit:
                    k, armed = k + 1, False
                    want.append((z.zone_id, r.Index, k))
        assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)


@pytest.mark.parametrize("trigger", J.TRIGGERS)
def test_hits_of_zones_of_any_life(spark, bars, pdf, trigger):
    """Lives of a bar to all bars, so that zones start on every level of the pyramid; prices never reached, and reached at once."""
    numbered = kept(B.with_bar_seq(bars))
    rng = np.random.default_rng(8)
    n, start = 60, rng.integers(0, len(pdf) - 10, 60)
    life = (2 ** rng.uniform(0, 14, n)).astype(int)
    low = pdf.close.to_numpy()[start] + rng.normal(0, 25, n)
    formed = pdf.ts.iloc[start].reset_index(drop=True)
    zones = pd.DataFrame({
        "symbol": "NQ", "zone_id": [f"z{k}" for k in range(n)], "formed_at": formed, "expires_at": formed + pd.to_timedelta(life, unit="min"),
        "zone_low": low, "zone_high": low + rng.uniform(0.2, 6, n), "bias": rng.choice([1, -1], n),
    })
    frame = kept(spark.createDataFrame(zones))
    want = []
    for z in zones.itertuples():
        own = pdf[(pdf.ts >= z.formed_at + pd.Timedelta("5min")) & (pdf.ts <= z.expires_at)]
        touch = (own.high >= z.zone_low) & (own.low <= z.zone_high)
        hit = {"touch": touch, "close_inside": own.close.between(z.zone_low, z.zone_high), "wick_through": own.low <= z.zone_low if z.bias == 1 else own.high >= z.zone_high}[trigger]
        want += [(z.zone_id, i) for i in own.index[hit]]
    got = [tuple(r) for r in J.zone_hits(frame, numbered, trigger, "5min").select("zone_id", "bar_seq").collect()]
    assert sorted(got) == sorted(want) and len({z for z, _ in want}) > 20
    first = {}
    for z, i in want:
        first[z] = min(i, first.get(z, i))
    tested = J.first_test(J.zone_hits(frame, numbered, trigger, "5min", first_only=True), frame)
    assert {r.zone_id: r.bar_seq for r in tested.collect()} == first


def test_placebo_is_that_of_the_loop(bars, events, pdf):
    numbered = kept(B.with_bar_seq(bars))
    got = {r.event_id: r for r in C.placebo_tests(numbered, events, 240).collect()}
    moved = 0
    for e in events.toPandas().itertuples():
        start = int(pdf.ts.searchsorted(e.formed_at.tz_localize("UTC")))
        r = got.get(e.event_id)
        if r is None:
            continue
        moved += 1
        shift = abs(r.zone_low - e.zone_low)
        assert 0.5 * e.atr - 1e-9 <= shift <= 3 * e.atr + 1e-9
        for j in range(start + 1, r.bar_seq + 1):
            inside = pdf.high[j] >= r.zone_low and pdf.low[j] <= r.zone_high
            enters = pdf.low[j - 1] > r.zone_high if e.bias == 1 else pdf.high[j - 1] < r.zone_low
            assert (inside and enters) == (j == r.bar_seq)
    assert moved > 30


def test_placebo_draws_from_short_ids(bars, events):
    """Ids have all 32 digits of a zone's hash; the moves are drawn from the first 16 and the number of the test, as in the SQL."""
    u = lambda what, key: int(hashlib.md5(f"placebo {what} 0|{key}".encode()).hexdigest()[:13], 16) / 16**13
    got = {r.event_id: r.zone_low for r in C.placebo_tests(kept(B.with_bar_seq(bars)), events, 240).collect()}
    own = [e for e in events.collect() if e.event_id in got]
    assert len(own) > 30 and all(len(e.zone_id) == 32 for e in own)
    for e in own:
        key = f"{e.zone_id[:16]}-{e.test_number}"
        move = (0.5 + 2.5 * u("size", key)) * e.atr * (-1 if u("side", key) < 0.5 else 1)
        assert got[e.event_id] == pytest.approx(e.zone_low + move, abs=1e-9)


def test_noise_has_no_edge(bars, events):
    rate = G.summarise(E.rescore(events, "fixed"), 0.33, n_boot=200).first()
    assert 0.2 < rate.rate < 0.48 and abs(rate.mean_r) < 0.4 and 0 <= rate.p_value <= 1
    assert rate.mean_r_low < rate.mean_r < rate.mean_r_high and rate.ci_low < rate.rate < rate.ci_high
    drift = C.drift_baseline(B.with_bar_seq(bars), events, Scoring(), 400).first()
    assert drift.n == 400 and 0.2 < drift.rate < 0.48
    loose = {m: E.rescore(events, m).filter("win").count() for m in ("fixed", "atr", "mfe")}
    assert loose["mfe"] > loose["fixed"]


def test_counts_add_up(study, events):
    c = study.counts().first()
    assert c.n_zones == study.zones.count() and c.n_tests_raw >= c.n_events == events.count() and c.n_filtered_out == 0


def test_splits_add_up(events):
    parts = G.split_is_oos(events, "2024-03-04", "2024-03-08")
    assert parts.count() == events.count() and parts.select("part").distinct().count() == 2


def test_bad_specs_are_refused(bars):
    bad = Spec.from_dict({"direction": "up", "zone": {"detector": "fvg", "params": {"size": 1}}, "htf": {"timeframe": "1min"}, "filters": ["foo > 1", "import os"], "trigger": {"type": "near"}, "scoring": {"stop": {"value": 0}, "max_holding_bars": "x"}})
    assert len(validate(bad)) == 8
    with pytest.raises(ValueError, match="direction"):
        scan(bars, bad)
    assert validate(Spec.from_dict(RULES)) == []


def test_fingerprint_is_of_the_rules():
    a, b, c = Spec.from_dict(RULES), Spec.from_dict(RULES | {"name": "x", "notes": "y"}), Spec.from_dict(RULES | {"direction": "long"})
    assert a.fingerprint() == b.fingerprint() != c.fingerprint() and Spec.from_json(a.to_json()) == a


def test_resample_of_a_minute_is_a_copy(bars):
    assert B.resample(bars, "1min").count() == bars.count()


def test_binomial_and_wilson(spark):
    df = spark.createDataFrame([(7, 20, 0.3), (0, 0, 0.3), (20, 20, 0.5)], "k int, n int, p double")
    rows = df.select(G.binomial_test(F.col("k"), F.col("n"), F.col("p")).alias("b"), *[c.alias(f"w{i}") for i, c in enumerate(G.wilson_interval(F.col("k"), F.col("n")))]).collect()
    assert rows[0].b == pytest.approx(0.6295, abs=1e-3) and rows[1].b is None and rows[2].b == pytest.approx(2 * 0.5**20)
    assert rows[1].w0 is None and rows[1].w1 is None and rows[2].w2 == 1.0


def test_averages_of_long_columns(spark):
    x = np.random.default_rng(4).normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=5000, freq="min"), "bar_seq": range(5000), "x": x}))
    got = X.exponential_means(df, {"y": ("x", 1 / 14), "z": ("x", 2 / 201)}).orderBy("bar_seq").toPandas()
    for name, alpha in (("y", 1 / 14), ("z", 2 / 201)):
        assert np.allclose(got[name], pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), rtol=0, atol=1e-12)


def test_stretches_change_nothing(spark, bars, monkeypatch):
    """Frames that reach into the neighbours of short stretches see the same rows as in one long one."""
    f = kept(X.build_features(B.resample(bars, "5min")))
    tests = kept(f.sample(0.2, 3).select("symbol", F.col("ts").alias("bar_ts"), F.col("ts").alias("formed_at"), F.lit(0.0).alias("displacement_atr")))

    def everything():
        frames = [X.build_features(B.resample(bars, "5min")), X.swing_points(f, 3, 6), X.htf_context(bars, "1h"), Z.order_block(f, 1.0, 3), Z.fvg(f), Z.swing_level(f, 4, 2), J.attach_bar_context(tests, f, "5min")]
        return [sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect()) for df in frames]

    whole = everything()
    monkeypatch.setattr(B, "STRETCH", 16)
    assert everything() == whole and all(whole)


def test_bar_spacing_over_months(spark):
    ts = [pd.Timestamp("2024-01-31 23:00") + pd.Timedelta(minutes=m) for m in (0, 30, 60, 90, 97, 104)] + [pd.Timestamp("2024-03-01")]
    rows = [("a", t.to_pydatetime()) for t in ts] + [("b", ts[0].to_pydatetime()), ("b", ts[-1].to_pydatetime())]
    got = dict(B.bar_spacing(spark.createDataFrame(rows, "symbol string, ts timestamp")).collect())
    assert got == {"a": 30 * 60_000_000, "b": 60_000_000}
