"""Bars: from ticks, to coarser ones, and their positions within a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from zonestudy.functions.timeframe import seconds


def _epoch(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def _bin(micros: Column, length: int) -> Column:
    return F.timestamp_micros((F.floor(micros / F.lit(length)) * F.lit(length)).cast("long"))


def _ohlc(groups, open_: str, high: str, low: str, close: str, by, volume: Column) -> DataFrame:
    return groups.agg(
        F.min_by(open_, by).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(close, by).alias("close"), volume.alias("volume")
    )


def bars_from_ticks(ticks: DataFrame, timeframe: str, symbol: str, price: str, ts: str, tie: str) -> DataFrame:
    """symbol, ts, open, high, low, close, volume (the number of ticks) of each bar that holds a tick; ``tie`` orders ticks of one time."""
    at = F.col(ts).cast("timestamp")
    t = ticks.select(F.col(symbol).alias("symbol"), F.col(price).alias("price"), at.alias("at"), F.col(tie).alias("tie")).dropna(subset=["symbol", "at", "price"])
    grouped = t.groupBy("symbol", _bin(_epoch("at"), seconds(timeframe) * 1_000_000).alias("ts"))
    return _ohlc(grouped, "price", "price", "price", "price", F.struct("at", "tie"), F.count("*").cast("double"))


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a coarser timeframe: labelled by their opening, left-closed, empty ones absent, null volumes as 0.

    Bins count from midnight of the symbol's first day. Where the timeframe divides a day these are the bins from the epoch, and
    no first day is looked up. A timeframe of a minute or less leaves the bars as they are."""
    length = seconds(timeframe)
    if length <= 60:
        return bars.select("symbol", "ts", "open", "high", "low", "close", "volume")
    volume = F.coalesce(F.sum("volume"), F.lit(0.0))
    micros = length * 1_000_000
    if 86_400 % length == 0:
        return _ohlc(bars.groupBy("symbol", _bin(_epoch("ts"), micros).alias("ts")), "open", "high", "low", "close", "ts", volume).select(
            "symbol", "ts", "open", "high", "low", "close", "volume"
        )
    first = bars.groupBy("symbol").agg(_epoch(F.date_trunc("day", F.min("ts"))).alias("_anchor"))
    since = _epoch("ts") - F.col("_anchor")
    start = F.timestamp_micros((F.floor(since / F.lit(micros)) * F.lit(micros)).cast("long") + F.col("_anchor"))
    binned = bars.join(first, "symbol").withColumn("_start", start)
    return _ohlc(binned.groupBy("symbol", F.col("_start").alias("_s")), "open", "high", "low", "close", "ts", volume).select(
        "symbol", F.col("_s").alias("ts"), "open", "high", "low", "close", "volume"
    )


def with_bar_seq(bars: DataFrame, name: str = "bar_seq") -> DataFrame:
    """``bars`` with ``name``, each bar's place among its symbol's bars from 0.

    Numbered within (symbol, month), then shifted by the bars of the months before: no task sorts a whole symbol."""
    month = F.date_trunc("month", "ts")
    counts = bars.groupBy("symbol", month.alias("_month")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("symbol", "_month", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("symbol", "_month").orderBy("ts")) - 1
    return (
        bars.withColumn("_month", month)
        .withColumn(name, own)
        .join(shifts, ["symbol", "_month"])
        .withColumn(name, (F.col(name) + F.col("_shift")).cast("long"))
        .drop("_month", "_shift")
    )


#: Bars of a symbol that one window looks at, about.
STRETCH = 4096


def stretches(bars: DataFrame, before: int, after: int = 0) -> DataFrame:
    """``bars`` with ``_place``, cut in stretches by place, so that frames of up to ``before`` rows back and ``after`` rows on can be windows over
    ``in_stretch``: the rows that a stretch's frames need from its neighbours come along, and aren't ``_own``."""
    size = max(STRETCH, before, after)
    place, own = F.col("_place") % size, F.floor(F.col("_place") / size).cast("long")
    there = F.array_compact(F.array(own, F.when(place >= size - before, own + 1), F.when(place < after, own - 1)))
    return with_bar_seq(bars, "_place").withColumn("_stretch", F.explode(there)).withColumn("_own", F.col("_stretch") == own)


def in_stretch() -> WindowSpec:
    return Window.partitionBy("symbol", "_stretch").orderBy("_place")


def without_halo(cut: DataFrame) -> DataFrame:
    """Each bar once again."""
    return cut.filter("_own").drop("_place", "_stretch", "_own")


def bar_spacing(bars: DataFrame) -> DataFrame:
    """symbol, tf_micros: the most frequent distance of neighbouring bars, the smallest of equals; a minute with under three bars.

    Neighbours are sought within months; from month to month they are a month's last bar and the next one's first."""
    own = bars.select("symbol", F.date_trunc("month", "ts").alias("_month"), _epoch("ts").alias("at"))
    within = own.select("symbol", (F.col("at") - F.lag("at").over(Window.partitionBy("symbol", "_month").orderBy("at"))).alias("gap"))
    months = own.groupBy("symbol", "_month").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    across = months.select("symbol", (F.col("first") - F.lag("last").over(Window.partitionBy("symbol").orderBy("_month"))).alias("gap"))
    # a month's first bar has no gap within it: it is counted there, its gap here
    gaps = within.select("symbol", "gap", F.lit(1).alias("bar")).unionByName(across.select("symbol", "gap", F.lit(0).alias("bar")).filter("gap is not null"))
    counted = gaps.groupBy("symbol", "gap").agg(F.count("*").alias("n"), F.sum("bar").alias("bars"))
    per = counted.groupBy("symbol").agg(
        F.sum("bars").alias("bars"),
        F.max(F.when(F.col("gap").isNotNull(), F.struct("n", (-F.col("gap")).alias("minus")))).alias("top"),
    )
    return per.select("symbol", F.when(F.col("bars") < 3, F.lit(60_000_000)).otherwise(-F.col("top.minus")).cast("long").alias("tf_micros"))


def split_bars(bars: DataFrame, start, end, part: str) -> DataFrame:
    """The bars of ``in_sample``, from ``start`` up to a day after ``end``, or of ``holdout``, from then on. Naive dates are UTC."""
    cut = F.lit(end).cast("timestamp") + F.expr("interval 1 day")
    if part == "in_sample":
        return bars.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < cut))
    if part == "holdout":
        return bars.filter(F.col("ts") >= cut)
    raise ValueError(f"part must be in_sample or holdout, not {part!r}")


def split_date(bars: DataFrame, percent: float) -> DataFrame:
    """symbol, split_date: the date of the bar at place int(n * percent / 100)."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    place = F.least(F.floor(F.col("_n") * F.lit(percent) / 100), F.col("_n") - 1)
    return with_bar_seq(bars).join(counts, "symbol").filter(F.col("bar_seq") == place).select("symbol", F.to_date("ts").alias("split_date"))
