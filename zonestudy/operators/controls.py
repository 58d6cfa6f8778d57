"""Two control groups: trades at random bars, and zones moved to places that mean nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestudy.operators.scoring import score_events, trade_levels
from zonestudy.operators.stats import quantiles, wilson_interval
from zonestudy.operators.touches import asof_join
from zonestudy.plans.spec import Scoring


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5 of the parts: any engine draws the same."""
    key = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def draw_key(event_id: Column | str) -> Column:
    """What an event's id gives to its draws: of the 32 digits of a zone's hash the first 16, and the number of the test. Other ids count whole.

    Ids tell events apart and keep all digits; draws need not differ, and stay those of the shorter ids."""
    return F.regexp_replace(event_id, "^([0-9a-f]{16})[0-9a-f]{16}-", "$1-")


def _rates(scored: DataFrame) -> DataFrame:
    g = scored.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "win").alias("wins"))
    rate, low, high = wilson_interval(F.col("wins"), F.col("n"))
    return g.select("symbol", "n", "wins", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def _scored(tests: DataFrame, bars: DataFrame, s: Scoring) -> DataFrame:
    trades = trade_levels(tests, bars, (s.stop.mode, s.stop.value), (s.target.mode, s.target.value), s.entry)
    return score_events(trades, bars, s.max_holding_bars, s.entry == "zone_proximal")


def drift_baseline(bars: DataFrame, events: DataFrame, scoring: Scoring, n_samples: int = 3000, seed: int = 0) -> DataFrame:
    """symbol, n, wins, rate, ci_low, ci_high of ``n_samples`` trades at random bars between a symbol's first and last event, each in the
    direction of a random event, over a zone of the events' median risk at that bar's open. A symbol without room has no row.

    ``bars`` needs bar_seq. Samples are rows that meet their bar by an equal join; the direction is drawn by the share of longs."""
    spans = events.groupBy("symbol").agg(F.min("bar_seq").alias("lo"), F.max("bar_seq").alias("hi"), F.avg((F.col("bias") == 1).cast("double")).alias("longs"))
    for name, column in (("risk", "risk_points"), ("atr", "atr")):
        middle = quantiles(events, ["symbol"], column, [0.5])
        spans = spans.join(middle.select("symbol", F.col("q")[0].alias(name)), "symbol", "left")  # a row for each symbol
    ends = bars.groupBy("symbol").agg(F.count("*").alias("bars"))
    room = spans.join(ends, "symbol").withColumn("hi", F.least("hi", F.col("bars") - F.lit(scoring.max_holding_bars + 2))).filter("hi > lo")
    drawn = room.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    drawn = drawn.withColumns({
        "bar_seq": (F.col("lo") + F.floor(uniform(F.lit(f"drift place {seed}"), "symbol", "sample") * (F.col("hi") - F.col("lo")))).cast("long"),
        "bias": F.when(uniform(F.lit(f"drift side {seed}"), "symbol", "sample") < F.col("longs"), 1).otherwise(-1),
        "event_id": F.concat_ws("|", "symbol", F.col("sample").cast("string")),
    })
    at = drawn.join(bars.select("symbol", "bar_seq", "open"), ["symbol", "bar_seq"])
    long = F.col("bias") == 1
    zones = at.withColumns({"zone_low": F.when(long, F.col("open") - F.col("risk")).otherwise(F.col("open")), "zone_high": F.when(long, F.col("open")).otherwise(F.col("open") + F.col("risk"))})
    return _rates(_scored(zones.select("symbol", "event_id", "bar_seq", "bias", "zone_low", "zone_high", "atr"), bars, scoring))


def placebo_tests(bars: DataFrame, events: DataFrame, max_holding_bars: int, jitter_atr: float = 3.0, seed: int = 0) -> DataFrame:
    """Each event's zone moved up or down by 0.5 to ``jitter_atr`` ATR, with the first bar at or after its formation, within
    max(4 * max_holding_bars, 2000) bars, that enters it from the side the trade expects; events without one, or formed at the
    end of the data, go. Blocks of bars whose extremes exclude a touch are left out before bars are met."""
    horizon = max(4 * max_holding_bars, 2000)
    width = horizon // 8
    block = lambda c: F.floor(c / F.lit(width)).cast("long")
    last = bars.select("symbol", (F.col("bar_seq") + 1).alias("bar_seq"), F.col("high").alias("high_before"), F.col("low").alias("low_before"))
    b = bars.select("symbol", "bar_seq", "high", "low", block(F.col("bar_seq")).alias("_block"))
    formed = events.select("symbol", "formed_at").distinct()
    before = asof_join(formed, bars.select("symbol", "ts", F.col("bar_seq").alias("seq_before")), "formed_at", "ts", ["symbol"], strict=True)
    starts = before.select("symbol", "formed_at", F.coalesce(F.col("seq_before") + 1, F.lit(0)).cast("long").alias("first_seq"))
    ends = bars.groupBy("symbol").agg(F.count("*").alias("bars"))
    e = events.join(starts, ["symbol", "formed_at"]).join(ends, "symbol").filter("first_seq < bars - 2")
    key = draw_key("event_id")
    draw = F.lit(0.5) + uniform(F.lit(f"placebo size {seed}"), key) * F.lit(jitter_atr - 0.5)
    shift = draw * F.col("atr") * F.when(uniform(F.lit(f"placebo side {seed}"), key) < 0.5, -1).otherwise(1)
    e = e.withColumn("_shift", shift).withColumns({"zone_low": F.col("zone_low") + F.col("_shift"), "zone_high": F.col("zone_high") + F.col("_shift")})
    e = e.select("symbol", "event_id", "bias", "zone_low", "zone_high", "atr", "first_seq")
    spread = e.withColumn("_block", F.explode(F.sequence(block(F.col("first_seq")), block(F.col("first_seq") + horizon - 1))))
    extremes = b.groupBy("symbol", "_block").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    near = spread.join(extremes, ["symbol", "_block"]).filter("top >= zone_low and bottom <= zone_high").drop("top", "bottom")
    met = near.join(b, ["symbol", "_block"]).filter((F.col("bar_seq") > F.col("first_seq")) & (F.col("bar_seq") < F.col("first_seq") + horizon))
    touched = met.filter((F.col("high") >= F.col("zone_low")) & (F.col("low") <= F.col("zone_high"))).join(last, ["symbol", "bar_seq"])
    enters = F.when(F.col("bias") == 1, F.col("low_before") > F.col("zone_high")).otherwise(F.col("high_before") < F.col("zone_low"))
    hit = touched.filter(enters)
    return e.join(hit.groupBy("event_id").agg(F.min("bar_seq").alias("bar_seq")), "event_id").drop("first_seq")


def placebo_baseline(bars: DataFrame, events: DataFrame, scoring: Scoring, jitter_atr: float = 3.0, seed: int = 0) -> DataFrame:
    """symbol, n, wins, rate, ci_low, ci_high of the moved zones' trades."""
    return _rates(_scored(placebo_tests(bars, events, scoring.max_holding_bars, jitter_atr, seed), bars, scoring))
