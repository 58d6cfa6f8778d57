"""Price zones from detection bars, each with the instant it became known and the one it expires at."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonestudy.operators.bars import bar_spacing, in_stretch, stretches, without_halo
from zonestudy.operators.features import pivots
from zonestudy.operators.touches import asof_join

COLUMNS = ["symbol", "zone_id", "formed_at", "expires_at", "source_ts", "zone_low", "zone_high", "zone_height", "zone_height_atr", "displacement_atr", "bias"]


def _later(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def _zones(found: DataFrame, spacing: DataFrame, max_age_bars: int) -> DataFrame:
    """Zones from rows with symbol, known (label of the confirming bar), source_ts, zone_low, zone_high, bias and the two ATR
    measures; those without height go. An id is made of what tells zones of a symbol apart."""
    z = found.join(spacing, "symbol").withColumn("formed_at", _later(F.col("known"), F.col("tf_micros")))
    z = z.withColumn("expires_at", _later(F.col("formed_at"), F.col("tf_micros") * max_age_bars))
    z = z.withColumn("zone_height", F.col("zone_high") - F.col("zone_low")).filter("zone_height > 0")
    key = F.concat_ws("|", "symbol", F.unix_micros("formed_at").cast("string"), F.unix_micros("source_ts").cast("string"), F.format_string("%.9f", "zone_low"), F.col("bias").cast("string"))
    return z.withColumn("zone_id", F.md5(key)).select(*COLUMNS)


def order_block(
    f: DataFrame, displacement_atr: float = 1.5, displacement_bars: int = 1, require_swing_break: bool = True, swing_lookback: int = 10,
    zone_from: str = "body", max_age_bars: int = 500,
) -> DataFrame:
    """The last candle against a move of ``displacement_atr`` ATR, before the move began; if asked for, the move must also pass the
    extreme of the ``swing_lookback`` bars before it."""
    back, w = max(1, int(displacement_bars)), in_stretch()
    size = F.lag("atr", back).over(w)
    swing = w.rowsBetween(-(back - 1) - swing_lookback, -back)
    reach = w.rowsBetween(-(back - 1) - swing_lookback - 5, -back)
    candle = F.struct("open", "high", "low", "close", "ts")
    against = lambda up: F.last(F.when(F.col("close") < F.col("open") if up else F.col("close") > F.col("open"), candle), ignorenulls=True).over(reach)
    m = stretches(f, back + swing_lookback + 5).select(
        "symbol", "ts", "high", "low", "close", "open", "_own", size.alias("size"), (F.col("close") - F.lag("open", back - 1).over(w)).alias("move"),
        F.max("high").over(swing).alias("top"), F.min("low").over(swing).alias("bottom"), against(True).alias("down_candle"),
        against(False).alias("up_candle"), (F.col("_place") + 1).alias("place"),
    )
    up = F.col("move") > 0
    m = m.filter("_own").filter((F.col("place") > swing_lookback + back + 1) & (F.col("size") > 0)).withColumn("displacement_atr", F.abs("move") / F.col("size"))
    m = m.filter(F.col("displacement_atr") >= displacement_atr)
    if require_swing_break:
        m = m.filter(F.when(up, F.col("high") > F.col("top")).otherwise(F.col("low") < F.col("bottom")))
    m = m.withColumn("c", F.when(up, F.col("down_candle")).otherwise(F.col("up_candle"))).filter("c is not null")
    low, high = ("c.low", "c.high") if zone_from == "wick" else (F.least("c.open", "c.close"), F.greatest("c.open", "c.close"))
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    found = m.select(
        "symbol", F.col("ts").alias("known"), F.col("c.ts").alias("source_ts"), as_column(low).alias("zone_low"), as_column(high).alias("zone_high"),
        F.when(up, 1).otherwise(-1).alias("bias"), ((as_column(high) - as_column(low)) / F.col("size")).alias("zone_height_atr"), "displacement_atr",
    )
    return _zones(found, bar_spacing(f), max_age_bars)


def fvg(f: DataFrame, min_gap_atr: float = 0.25, max_age_bars: int = 500) -> DataFrame:
    """Between a bar and the bar two before it: prices that neither traded, of at least ``min_gap_atr`` ATR."""
    w = in_stretch()
    top, bottom = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    m = stretches(f, 2).select("symbol", "ts", "high", "low", "atr", "_own", top.alias("top"), bottom.alias("bottom")).filter("_own and atr > 0")
    up, down = F.col("low") > F.col("top"), F.col("high") < F.col("bottom")
    m = m.filter(up | down).select(
        "symbol", F.col("ts").alias("known"), F.col("ts").alias("source_ts"), "atr", F.when(up, F.col("top")).otherwise(F.col("high")).alias("zone_low"),
        F.when(up, F.col("low")).otherwise(F.col("bottom")).alias("zone_high"), F.when(up, 1).otherwise(-1).alias("bias"),
    )
    size = (F.col("zone_high") - F.col("zone_low")) / F.col("atr")
    m = m.withColumns({"zone_height_atr": size, "displacement_atr": size}).filter(F.col("zone_height_atr") >= min_gap_atr)
    return _zones(m, bar_spacing(f), max_age_bars)


def _padded(m: DataFrame, level: str, pad_atr: float) -> DataFrame:
    pad = F.lit(pad_atr) * F.col("size")
    return m.filter("size > 0").select(
        "symbol", "known", "source_ts", (F.col(level) - pad).alias("zone_low"), (F.col(level) + pad).alias("zone_high"), "bias",
        F.lit(2.0 * pad_atr).alias("zone_height_atr"), F.lit(None).cast("double").alias("displacement_atr"),
    )


def swing_level(f: DataFrame, left: int = 5, right: int = 5, zone_pad_atr: float = 0.1, max_age_bars: int = 1000) -> DataFrame:
    """Pivots, known ``right`` bars later; a bar that is both counts as a high."""
    w = in_stretch()
    m = pivots(stretches(f, left, right), left, right).withColumns({"known": F.lead("ts", right).over(w), "size": F.lead("atr", right).over(w)})
    m = without_halo(m).filter("pivot_high or pivot_low").filter("known is not null").withColumn("source_ts", F.col("ts"))
    m = m.withColumns({"level": F.when(F.col("pivot_high"), F.col("high")).otherwise(F.col("low")), "bias": F.when(F.col("pivot_high"), -1).otherwise(1)})
    return _zones(_padded(m, "level", zone_pad_atr), bar_spacing(f), max_age_bars)


def prior_session_level(f: DataFrame, which: str = "high", session: str = "RTH", zone_pad_atr: float = 0.1, max_age_bars: int = 1440) -> DataFrame:
    """A level of a session, once it has ended, if another session and another bar follow. An empty ``session`` is the whole day."""
    levels = {"high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "ts"), "open": F.min_by("open", "ts")}
    if which not in levels:
        raise ValueError(f"prior_session_level: which={which!r} is none of {sorted(levels)}")
    own = f.filter(F.col("session") == session) if session else f
    days = own.groupBy("symbol", "local_date").agg(levels[which].alias("level"), F.max("ts").alias("known"))
    days = days.withColumn("next", F.lead("local_date").over(Window.partitionBy("symbol").orderBy("local_date"))).filter("next is not null")
    spacing = bar_spacing(f)
    days = days.join(spacing, "symbol").withColumn("formed", _later(F.col("known"), F.col("tf_micros"))).drop("tf_micros")
    ends = f.groupBy("symbol").agg(F.max("ts").alias("follows"))
    days = days.join(ends, "symbol").filter("follows >= formed")
    after = asof_join(days, f.select("symbol", "ts", F.col("atr").alias("size")), "formed", "ts", ["symbol"], strict=True)
    m = after.select("symbol", "known", F.col("known").alias("source_ts"), "level", "size", F.lit(-1 if which == "high" else 1).alias("bias"))
    return _zones(_padded(m, "level", zone_pad_atr), spacing, max_age_bars)


def round_number(f: DataFrame, step: float = 100.0, zone_pad_atr: float = 0.1, max_age_bars: int = 1440) -> DataFrame:
    """The five multiples of ``step`` about each day's first price."""
    first = F.min_by(F.struct("open", "atr"), "ts")
    days = f.groupBy("symbol", "local_date").agg(first.alias("b"), F.min("ts").alias("known"))
    level = F.floor(F.col("b.open") / F.lit(step)) * F.lit(step) + F.col("k") * F.lit(step)
    m = days.withColumn("k", F.explode(F.sequence(F.lit(-2), F.lit(2)))).select(
        "symbol", "known", F.col("known").alias("source_ts"), level.alias("level"), F.col("b.atr").alias("size"), F.when(level < F.col("b.open"), 1).otherwise(-1).alias("bias")
    )
    return _zones(_padded(m, "level", zone_pad_atr), bar_spacing(f), max_age_bars)


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "order_block": order_block, "fvg": fvg, "swing_level": swing_level, "prior_session_level": prior_session_level, "round_number": round_number,
}


def detect(f: DataFrame, detector: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The zones of a detector by its name; unknown names and parameters are errors."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}; there are {sorted(DETECTORS)}")
    try:
        return DETECTORS[detector](f, **(params or {}))
    except TypeError as e:
        raise ValueError(f"detector {detector!r}: {e}") from None


def filter_direction(zones: DataFrame, direction: str) -> DataFrame:
    """Zones for long trades, short ones, or both."""
    sides = {"long": [1], "short": [-1], "both": [1, -1]}
    if direction not in sides:
        raise ValueError(f"direction must be one of {sorted(sides)}, not {direction!r}")
    return zones.filter(F.col("bias").isin(sides[direction]))
