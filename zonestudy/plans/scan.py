"""A study from bars to scored events, and what it counted on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestudy.functions.expressions import FEATURES, with_kept
from zonestudy.operators.bars import resample, with_bar_seq
from zonestudy.operators.features import EXCHANGE_TZ, build_features, htf_context
from zonestudy.operators.scoring import score_events, trade_levels
from zonestudy.operators.touches import attach_bar_context, attach_htf_context, first_test, separate_tests, zone_hits
from zonestudy.operators.zones import detect, filter_direction
from zonestudy.plans.spec import Spec, validate
from zonestudy.sources.scratch import kept

EVENT_COLUMNS = [
    "symbol", "event_id", "ts", "formed_at", "zone_low", "zone_high", *FEATURES, "entry", "stop", "target", "risk_points", "outcome", "ambiguous",
    "r_fixed", "mfe_r", "mae_r", "bars_held", "zone_id", "bar_seq",
]
#: Share of ambiguous events from which a warning is due.
AMBIGUOUS = 0.15


@dataclass
class Scan:
    """The steps of a scan; each is a plan that runs when it is asked for."""

    symbols: DataFrame
    found: DataFrame
    higher: DataFrame | None
    direction: str
    zones: DataFrame
    tests: DataFrame
    judged: DataFrame
    events: DataFrame

    def warnings(self) -> DataFrame:
        """symbol and warning: no higher bars, no zones, no zones of the direction, or many ambiguous events; none where all is well."""
        own = self.symbols.join(self.found.groupBy("symbol").agg(F.count("*").alias("found")), "symbol", "left")
        own = own.join(self.counts(), "symbol", "left")
        said = [
            F.when(F.col("found").isNull(), "no zones: loosen the detector's parameters"),
            F.when(F.col("found").isNotNull() & (F.col("n_zones") == 0), f"no zones for direction {self.direction}"),
            F.when(F.col("warning"), "many events are ambiguous: use finer bars or wider stops"),
        ]
        if self.higher is not None:
            own = own.join(self.higher.groupBy("symbol").agg(F.count("*").alias("higher")), "symbol", "left")
            said.append(F.when(F.col("higher").isNull(), "no bars of the higher timeframe: its filters see neutral values"))
        return own.select("symbol", F.explode(F.array_compact(F.array(*said))).alias("warning"))

    def counts(self) -> DataFrame:
        """symbol, n_zones, n_tests_raw, n_filtered_out, n_events, ambiguous_share and whether that share calls for a warning; every symbol has a row."""
        zones = self.symbols.join(self.zones.groupBy("symbol").agg(F.count("*").alias("n_zones")), "symbol", "left")
        tests = self.tests.groupBy("symbol").agg(F.count("*").alias("n_tests_raw"))
        out = self.judged.groupBy("symbol").agg(F.count_if(~F.col("kept")).alias("n_filtered_out"))
        events = self.events.groupBy("symbol").agg(F.count("*").alias("n_events"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_share"))
        joined = zones.join(tests, "symbol", "left").join(out, "symbol", "left").join(events, "symbol", "left").fillna(0, ["n_zones", "n_tests_raw", "n_filtered_out", "n_events"])
        return joined.withColumn("warning", F.coalesce(F.col("ambiguous_share") > AMBIGUOUS, F.lit(False)))


def scan(bars: DataFrame, spec: Spec, exchange_tz: str = EXCHANGE_TZ) -> Scan:
    """Runs a spec over base bars of any number of symbols: resample, features, zones, their tests, what was known then, filters, and
    the trades' ends. What several steps read is written once to the shared folder. Raises ValueError, before any job, for a spec that can't run."""
    problems = validate(spec)
    if problems:
        raise ValueError("the spec can't run:\n" + "\n".join(problems))
    bars = kept(with_bar_seq(bars.select("symbol", "ts", "open", "high", "low", "close", "volume")))
    features = kept(build_features(resample(bars, spec.timeframe), exchange_tz))
    found = kept(detect(features, spec.zone.detector, spec.zone.resolved()))
    zones = filter_direction(found, spec.direction)
    t = spec.trigger
    hits = zone_hits(zones, bars, t.type, spec.timeframe, t.min_bars_after_formation, not t.first_test_only, t.first_test_only)
    tests = first_test(hits, zones) if t.first_test_only else separate_tests(hits, zones)
    known = attach_bar_context(tests, features, spec.timeframe)
    h = spec.htf
    higher = htf_context(bars, h.timeframe, h.ema_period, h.atr_period, h.slope_bars) if h.timeframe else None
    known = attach_htf_context(known, higher, h.timeframe)
    judged = with_kept(known, spec.filters)
    s = spec.scoring
    passed = judged.filter("kept").withColumn("event_id", F.concat_ws("-", "zone_id", F.col("test_number").cast("string")))
    trades = trade_levels(passed, bars, (s.stop.mode, s.stop.value), (s.target.mode, s.target.value), s.entry)
    events = score_events(kept(trades), bars, s.max_holding_bars, s.entry == "zone_proximal").withColumnRenamed("bar_ts", "ts").select(*EVENT_COLUMNS)
    return Scan(bars.select("symbol").distinct(), found, higher, spec.direction, zones, tests, judged, events)
