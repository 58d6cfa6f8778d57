"""Trades from tests of zones: their levels, and how they end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOPS = ("zone_far_edge", "atr", "fixed_points")
TARGETS = ("r_multiple", "atr", "fixed_points", "none")
ENTRIES = ("zone_proximal", "next_open")


def trade_levels(
    tests: DataFrame, bars: DataFrame | None = None, stop: tuple[str, float] = ("zone_far_edge", 1.0), target: tuple[str, float] = ("r_multiple", 2.0),
    entry: str = "zone_proximal",
) -> DataFrame:
    """Tests with entry, stop, target (null: none), risk_points and ``start_seq``, the bar the trade begins on. Tests without risk,
    or without a next bar where entry is its open, go. ``bars`` (with bar_seq) is needed for that entry only."""
    for name, value, allowed in (("stop", stop[0], STOPS), ("target", target[0], TARGETS), ("entry", entry, ENTRIES)):
        if value not in allowed:
            raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
    long = F.col("bias") == 1
    if entry == "next_open":
        opens = bars.select("symbol", (F.col("bar_seq") - 1).alias("bar_seq"), F.col("open").alias("_next"))
        tests = tests.join(opens, ["symbol", "bar_seq"]).withColumns({"entry": F.col("_next"), "start_seq": F.col("bar_seq") + 1}).drop("_next")
    else:
        tests = tests.withColumns({"entry": F.when(long, F.col("zone_high")).otherwise(F.col("zone_low")), "start_seq": F.col("bar_seq")})
    height, far = F.col("zone_high") - F.col("zone_low"), F.when(long, F.col("zone_low")).otherwise(F.col("zone_high"))
    unit = {"atr": F.col("atr"), "fixed_points": F.lit(1.0), "r_multiple": F.col("risk_points")}
    if stop[0] == "zone_far_edge":
        at = far - F.lit(stop[1] - 1.0) * height * F.col("bias")
    else:
        at = F.col("entry") - F.col("bias") * F.lit(float(stop[1])) * unit[stop[0]]
    levels = tests.withColumn("stop", at).withColumn("risk_points", (F.col("entry") - F.col("stop")) * F.col("bias")).filter("risk_points > 0")
    goal = F.lit(None).cast("double") if target[0] == "none" else F.col("entry") + F.col("bias") * F.lit(float(target[1])) * unit[target[0]]
    return levels.withColumn("target", goal)


def score_events(trades: DataFrame, bars: DataFrame, max_holding_bars: int = 240, limit_fill: bool = True) -> DataFrame:
    """Trades with outcome, ambiguous, r_fixed, mfe_r, mae_r and bars_held over at most ``max_holding_bars`` bars from start_seq.

    The first bar to reach stop or target decides; both in one bar is an ambiguous loss. On the bar of a limit fill the
    favourable side counts only as far as the close, and a target that printed beyond it makes the trade ambiguous. Excursions
    are over the whole horizon, at least 0. ``trades`` needs event_id, ``bars`` bar_seq. Places are cut in blocks as long as the
    horizon, so that a trade meets at most two of them, and each trade is one grouped row: nothing walks bar by bar."""
    n = max_holding_bars
    block = lambda c: F.floor(c / F.lit(n)).cast("long")
    keys = ["event_id", "bias", "entry", "stop", "target", "risk_points", "start_seq"]
    t = trades.select("symbol", *keys).withColumn("_block", F.explode(F.sequence(block(F.col("start_seq")), block(F.col("start_seq") + n - 1))))
    b = bars.select("symbol", "bar_seq", "high", "low", "close", block(F.col("bar_seq")).alias("_block"))
    m = t.join(b, ["symbol", "_block"]).filter((F.col("bar_seq") >= F.col("start_seq")) & (F.col("bar_seq") < F.col("start_seq") + n))
    long = F.col("bias") == 1
    fill = F.lit(limit_fill) & (F.col("bar_seq") == F.col("start_seq"))
    capped = F.when(long, F.greatest("entry", "close")).otherwise(F.least("entry", "close"))
    raw = F.when(long, F.col("high")).otherwise(F.col("low"))
    m = m.withColumns({"raw": raw, "good": F.when(fill, capped).otherwise(raw), "bad": F.when(long, F.col("low")).otherwise(F.col("high")), "fill": fill})

    def reaches(price: str) -> Column:
        return F.coalesce((F.col(price) - F.col("target")) * F.col("bias") >= 0, F.lit(False))

    def size(price: str, sign: int) -> Column:
        return F.greatest(F.max((F.col(price) - F.col("entry")) * F.col("bias") * sign / F.col("risk_points")), F.lit(0.0))

    stopped = (F.col("bad") - F.col("stop")) * F.col("bias") <= 0
    g = m.groupBy("event_id").agg(
        F.min(F.when(stopped, F.col("bar_seq"))).alias("_stop"), F.min(F.when(reaches("good"), F.col("bar_seq"))).alias("_goal"),
        size("good", 1).alias("mfe_r"), size("bad", -1).alias("mae_r"), F.max("bar_seq").alias("_end"), F.max_by("close", "bar_seq").alias("_close"),
        F.max(F.col("fill") & reaches("raw") & ~reaches("good")).alias("_unsure"),
    )
    lost = F.col("_stop").isNotNull() & (F.col("_goal").isNull() | (F.col("_stop") <= F.col("_goal")))
    won = F.col("_goal").isNotNull() & ~lost
    exit_ = F.when(lost, F.col("stop")).when(won, F.col("target")).otherwise(F.col("_close"))
    ended = F.when(lost, F.col("_stop")).when(won, F.col("_goal")).otherwise(F.col("_end"))
    scored = trades.join(g, "event_id").withColumns({
        "outcome": F.when(lost, "loss").when(won, "win").otherwise("timeout"),
        "ambiguous": F.col("_unsure") | F.coalesce(F.col("_stop") == F.col("_goal"), F.lit(False)),
        "r_fixed": (exit_ - F.col("entry")) * F.col("bias") / F.col("risk_points"),
        "bars_held": (ended - F.col("start_seq") + 1).cast("int"),
    })
    return scored.drop("_stop", "_goal", "_end", "_close", "_unsure", "start_seq")


def rescore(events: DataFrame, mode: str, target_r: float = 2.0) -> DataFrame:
    """Events with ``win`` by another lens: ``fixed``, the trade's own end; ``atr``, ``target_r`` ATR in favour before one against;
    ``mfe``, more in favour than against."""
    scale = F.col("risk_points") / F.col("atr")
    lenses = {
        "fixed": F.col("outcome") == "win", "mfe": F.col("mfe_r") > F.col("mae_r"),
        "atr": (F.col("mfe_r") * scale >= target_r) & (F.col("mae_r") * scale < 1.0),
    }
    if mode not in lenses:
        raise ValueError(f"mode must be one of {sorted(lenses)}, not {mode!r}")
    return events.withColumn("win", F.coalesce(lenses[mode], F.lit(False)))
