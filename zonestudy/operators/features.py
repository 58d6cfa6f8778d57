"""What a detection bar knows: volatility, sessions, the day so far, the day before, pivots, and a higher timeframe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from zonestudy.functions.recurrence import exponential_means
from zonestudy.functions.timeframe import seconds
from zonestudy.operators.bars import in_stretch, resample, stretches, with_bar_seq, without_halo

EXCHANGE_TZ = "America/New_York"
# Session windows in exchange minutes, from and to.
SESSIONS = (("ASIA", 18 * 60, 3 * 60), ("LONDON", 3 * 60, 9 * 60 + 30), ("RTH", 9 * 60 + 30, 16 * 60), ("AFTER", 16 * 60, 18 * 60))


def local_time(ts: str | Column, exchange_tz: str = EXCHANGE_TZ) -> Column:
    return F.from_utc_timestamp(ts, exchange_tz)


def session_label(ts: str | Column, exchange_tz: str = EXCHANGE_TZ) -> Column:
    """The session that a UTC time falls in; local Saturdays and Sundays are WEEKEND."""
    local = local_time(ts, exchange_tz)
    minutes = F.hour(local) * 60 + F.minute(local)
    out = F.when(F.weekday(local) >= 5, "WEEKEND")
    for name, start, end in SESSIONS:
        out = out.when((minutes >= start) & (minutes < end) if start < end else (minutes >= start) | (minutes < end), name)
    return out


def calendar_fields(bars: DataFrame, exchange_tz: str = EXCHANGE_TZ) -> DataFrame:
    """``bars`` with hour, minute, dow (0: Monday), month, year, local_date and session of the exchange's clock."""
    local = local_time("ts", exchange_tz)
    return bars.withColumns(
        {
            "hour": F.hour(local), "minute": F.minute(local), "dow": F.weekday(local), "month": F.month(local), "year": F.year(local),
            "local_date": F.to_date(local), "session": session_label("ts", exchange_tz),
        }
    )


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def smoothed(bars: DataFrame, atr: dict[str, int], ema: dict[str, int]) -> DataFrame:
    """``bars`` with Wilder averages of the true range (null for the first n - 1 bars) and exponential averages of the close."""
    means = {n: ("_range", 1 / k) for n, k in atr.items()} | {n: ("close", 2 / (k + 1)) for n, k in ema.items()}
    if atr:
        numbered = stretches(bars, 1).withColumn("_range", true_range(in_stretch())).filter("_own").drop("_stretch", "_own").withColumnRenamed("_place", "bar_seq")
    else:
        numbered = with_bar_seq(bars)
    out = exponential_means(numbered, means)
    for name, n in atr.items():
        out = out.withColumn(name, F.when(F.col("bar_seq") >= n - 1, F.col(name)))
    return out.drop("_range", "bar_seq")


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return smoothed(bars, {"atr": n}, {})


def with_ema(bars: DataFrame, span: int = 50, name: str = "ema50") -> DataFrame:
    return smoothed(bars, {}, {name: span})


def daily_bars(bars: DataFrame) -> DataFrame:
    """symbol, local_date, d_high, d_low, d_close, d_open of each exchange day; needs ``local_date``."""
    return bars.groupBy("symbol", "local_date").agg(
        F.max("high").alias("d_high"), F.min("low").alias("d_low"), F.max_by("close", "ts").alias("d_close"), F.min_by("open", "ts").alias("d_open")
    )


def prior_days(daily: DataFrame) -> DataFrame:
    """Each day with the range, high, low and close of the day before it that exists, and the gap from that close to its open."""
    days = Window.partitionBy("symbol").orderBy("local_date")
    before = {n: F.lag(c).over(days) for n, c in (("prior_day_high", "d_high"), ("prior_day_low", "d_low"), ("prior_day_close", "d_close"))}
    return daily.withColumns(before).select(
        "symbol", "local_date", *before,
        (F.col("prior_day_high") - F.col("prior_day_low")).alias("prior_day_range"),
        (F.col("d_open") - F.col("prior_day_close")).alias("gap_points"),
    )


def build_features(bars: DataFrame, exchange_tz: str = EXCHANGE_TZ, atr_n: int = 14) -> DataFrame:
    """Detection bars with all features. Undefined values are null; a division by zero is undefined."""
    f = calendar_fields(smoothed(bars, {"atr": atr_n}, {"ema50": 50}), exchange_tz)
    so_far = Window.partitionBy("symbol", "local_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_range", F.max("high").over(so_far) - F.min("low").over(so_far))
    f = f.join(prior_days(daily_bars(f)), ["symbol", "local_date"])
    return f.withColumns(
        {
            "dist_ema50_atr": F.try_divide(F.col("close") - F.col("ema50"), "atr"),
            "day_range_atr": F.try_divide("_range", "atr"),
            "prior_day_range_atr": F.try_divide("prior_day_range", "atr"),
            "gap_atr": F.try_divide("gap_points", "atr"),
        }
    ).drop("_range")


def pivots(cut: DataFrame, left: int, right: int) -> DataFrame:
    """``cut`` (see ``stretches``) with ``pivot_high`` and ``pivot_low``."""
    w = in_stretch()
    whole = F.count("*").over(w.rowsBetween(-left, right)) == left + right + 1

    def beyond(column: str, best, sign: int) -> Column:
        out = whole
        for a, b in ((-left, -1), (1, right)):
            if a <= b:
                out = out & (sign * F.col(column) > sign * best(column).over(w.rowsBetween(a, b)))
        return F.coalesce(out, F.lit(False))

    return cut.withColumns({"pivot_high": beyond("high", F.max, 1), "pivot_low": beyond("low", F.min, -1)})


def swing_points(bars: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """``bars`` with ``pivot_high`` and ``pivot_low``: strictly beyond the ``left`` bars before and the ``right`` after, all there."""
    return without_halo(pivots(stretches(bars, left, right), left, right))


def htf_context(bars: DataFrame, timeframe: str, ema_period: int = 50, atr_period: int = 14, slope_bars: int = 3) -> DataFrame:
    """Bars of a higher timeframe with their trend, slope and range, keyed by ``closed_at``, when they became known."""
    h = stretches(smoothed(resample(bars, timeframe), {"htf_atr": atr_period}, {"htf_ema": ema_period}), slope_bars)
    h = without_halo(h.withColumn("_slope", F.col("htf_ema") - F.lag("htf_ema", slope_bars).over(in_stretch())))
    side = lambda x, y: F.when(F.col(x) >= F.col(y), 1).otherwise(-1)
    return h.select(
        "symbol", F.col("ts").alias("htf_label"), (F.col("ts") + F.make_dt_interval(secs=F.lit(seconds(timeframe)))).alias("closed_at"),
        F.col("close").alias("htf_close"), F.col("open").alias("htf_open"), "htf_ema", "htf_atr", (F.col("high") - F.col("low")).alias("htf_range"),
        F.try_divide(F.col("close") - F.col("htf_ema"), "htf_atr").alias("htf_dist_ema_atr"), F.try_divide("_slope", "htf_atr").alias("htf_slope_atr"),
        F.try_divide(F.col("high") - F.col("low"), "htf_atr").alias("htf_range_atr"), side("close", "htf_ema").alias("htf_bias"), side("close", "open").alias("htf_bar_dir"),
    )
