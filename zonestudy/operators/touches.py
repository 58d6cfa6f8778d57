"""When later bars test a zone, and what was already known at that moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonestudy.functions.timeframe import seconds
from zonestudy.operators.bars import in_stretch, stretches

TRIGGERS = ("touch", "close_inside", "wick_through")
#: Detection bars in the narrowest buckets of time, and buckets of a level in one of the next.
LEAF, FAN = 4, 16


def _touches() -> Column:
    return (F.col("high") >= F.col("zone_low")) & (F.col("low") <= F.col("zone_high"))


def _hits(trigger: str) -> Column:
    if trigger == "touch":
        return _touches()
    if trigger == "close_inside":
        return F.col("close").between(F.col("zone_low"), F.col("zone_high"))
    if trigger == "wick_through":
        return F.when(F.col("bias") == 1, F.col("low") <= F.col("zone_low")).otherwise(F.col("high") >= F.col("zone_high"))
    raise ValueError(f"trigger must be one of {TRIGGERS}, not {trigger!r}")


def _may_hit(trigger: str, first_only: bool) -> Column:
    """Whether any bar of a bucket can hit the zone (or, for separate tests, touch it), by the bucket's extremes."""
    touch = (F.col("top") >= F.col("zone_low")) & (F.col("bottom") <= F.col("zone_high"))
    if trigger == "wick_through":
        through = F.when(F.col("bias") == 1, F.col("bottom") <= F.col("zone_low")).otherwise(F.col("top") >= F.col("zone_high"))
        return through if first_only else through | touch
    if trigger == "close_inside" and first_only:
        return (F.col("last_top") >= F.col("zone_low")) & (F.col("last_bottom") <= F.col("zone_high"))
    return touch


def _must_hit(trigger: str) -> Column:
    """Whether some bar of a bucket certainly hits the zone: the bar of one of the bucket's extremes."""
    if trigger == "touch":
        return F.col("top").between(F.col("zone_low"), F.col("zone_high")) | F.col("bottom").between(F.col("zone_low"), F.col("zone_high"))
    if trigger == "close_inside":
        return F.col("last_top").between(F.col("zone_low"), F.col("zone_high")) | F.col("last_bottom").between(F.col("zone_low"), F.col("zone_high"))
    return F.when(F.col("bias") == 1, F.col("bottom") <= F.col("zone_low")).otherwise(F.col("top") >= F.col("zone_high"))


def zone_hits(zones: DataFrame, bars: DataFrame, trigger: str = "touch", timeframe: str = "5min", min_bars: int = 1, every_visit: bool = False, first_only: bool = False) -> DataFrame:
    """The zones' columns with each bar (bar_ts, bar_seq, open, high, low, close) that hits them while they live, both ends included.

    ``bars`` needs bar_seq. Over the bars stands a pyramid of extremes: buckets of ``LEAF`` detection bars, and of ``FAN`` times as long from level to
    level. A zone starts at the level of which its life holds fewer than ``FAN`` buckets, and goes down only into buckets whose extremes let the
    trigger happen; so it meets the bars of few of the narrowest buckets, however long it lives. With ``first_only`` it also leaves out what lies behind
    a bucket that certainly has a hit, and only a zone's first hit is sure to be there. With ``every_visit`` bars that touch without a hit
    come along, told apart by ``is_hit``, and so does the ``bucket`` in which they met."""
    start = F.timestamp_micros(F.unix_micros("formed_at") + min_bars * seconds(timeframe) * 1_000_000)
    zones = zones.withColumn("_from", start).filter("_from <= expires_at")
    leaf = max(60, LEAF * seconds(timeframe))
    bucket = lambda ts, width: F.floor(F.unix_seconds(ts) / width).cast("long")
    life = F.unix_seconds("expires_at") - F.unix_seconds("_from")
    longest = zones.agg(F.max(life)).first()[0] or 0
    levels = 0
    while longest >= FAN * leaf * FAN**levels:
        levels += 1
    own = sum((life >= FAN * leaf * FAN**k).cast("int") for k in range(levels)) if levels else F.lit(0)
    zones = zones.withColumn("_level", own)
    bars = bars.withColumn("bucket", bucket("ts", leaf))
    extremes = [bars.groupBy("symbol", "bucket").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.max("close").alias("last_top"), F.min("close").alias("last_bottom"))]
    for _ in range(levels):
        up = extremes[-1].withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long")).groupBy("symbol", "bucket")
        extremes.append(up.agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.max("last_top").alias("last_top"), F.min("last_bottom").alias("last_bottom")))

    left: DataFrame | None = None
    for level in range(levels, -1, -1):
        width = leaf * FAN**level
        met = zones.filter(F.col("_level") == level).withColumn("bucket", F.explode(F.sequence(bucket("_from", width), bucket("expires_at", width))))
        if left is not None:
            low, high = F.greatest(F.col("bucket") * FAN, bucket("_from", width)), F.least(F.col("bucket") * FAN + FAN - 1, bucket("expires_at", width))
            met = met.unionByName(left.withColumn("bucket", F.explode(F.sequence(low, high))))
        left = met.join(extremes[level], ["symbol", "bucket"]).filter(_may_hit(trigger, not every_visit))
        if first_only:
            inside = (F.col("bucket") * width >= F.unix_seconds("_from")) & (F.col("bucket") * width + width <= F.unix_seconds("expires_at")) & _must_hit(trigger)
            sure = F.min(F.when(inside, F.col("bucket"))).over(Window.partitionBy("symbol", "zone_id"))
            left = left.withColumn("_sure", sure).filter("_sure is null or bucket <= _sure").drop("_sure")
        left = left.drop("top", "bottom", "last_top", "last_bottom")
    own = bars.select("symbol", "bucket", F.col("ts").alias("bar_ts"), "bar_seq", "open", "high", "low", "close")
    met = left.join(own, ["symbol", "bucket"]).filter(F.col("bar_ts").between(F.col("_from"), F.col("expires_at")))
    met = met.withColumn("is_hit", _hits(trigger)).drop("_from", "_level")
    return met.filter(F.col("is_hit") | _touches()) if every_visit else met.filter("is_hit").drop("bucket")


BAR = ["bar_ts", "bar_seq", "open", "high", "low", "close"]


def first_test(hits: DataFrame, zones: DataFrame) -> DataFrame:
    """Each zone's first hit, as test_number 1."""
    first = hits.filter("is_hit").groupBy("symbol", "zone_id").agg(F.min_by(F.struct(*BAR), "bar_seq").alias("b"))
    return zones.join(first, ["symbol", "zone_id"]).select(*zones.columns, *[f"b.{c}" for c in BAR], F.lit(1).alias("test_number"))


def separate_tests(hits: DataFrame, zones: DataFrame) -> DataFrame:
    """One test for each visit, numbered by zone: a visit is a run of bars that touch or hit, the test its first hit. ``hits`` must
    come from ``zone_hits`` with ``every_visit``.

    Runs are found bucket by bucket, where zones and bars have met; of each only its ends and its first hit go on to be put together with the
    runs that it continues."""
    own = Window.partitionBy("symbol", "bucket", "zone_id").orderBy("bar_seq")
    runs = hits.withColumn("run", F.col("bar_seq") - F.row_number().over(own)).groupBy("symbol", "bucket", "zone_id", "run")
    hit = F.when(F.col("is_hit"), F.col("bar_seq"))
    runs = runs.agg(F.min("bar_seq").alias("first"), F.max("bar_seq").alias("last"), F.min_by(F.struct(*BAR), hit).alias("b"))
    per_zone = Window.partitionBy("symbol", "zone_id").orderBy("first")
    begins = F.when(F.lag("last").over(per_zone) == F.col("first") - 1, 0).otherwise(1)
    visits = runs.withColumn("begins", begins).withColumn("visit", F.sum("begins").over(per_zone)).filter("b is not null")
    firsts = visits.groupBy("symbol", "zone_id", "visit").agg(F.min_by("b", "first").alias("b"))
    numbered = firsts.withColumn("test_number", F.row_number().over(Window.partitionBy("symbol", "zone_id").orderBy("visit")))
    return zones.join(numbered.drop("visit"), ["symbol", "zone_id"]).select(*zones.columns, *[f"b.{c}" for c in BAR], "test_number")


def attach_bar_context(tests: DataFrame, features: DataFrame, timeframe: str) -> DataFrame:
    """Tests with what the forming detection bar's clock says and what the last closed one measured; those without a closed bar
    or with no positive ATR go. Undefined measures are 0.

    The forming bar is the bin that holds the test, so an equal join finds it, and the closed bar is the one before."""
    before = lambda c: F.lag(c).over(in_stretch())
    own = stretches(features, 1).select(
        "symbol", "_own", F.col("ts").alias("_bin"), "session", "hour", "minute", "dow", "month", "year", "prior_day_range", "gap_points",
        before("atr").alias("atr"), before("dist_ema50_atr").alias("dist_ema50_atr"),
        F.when(before("local_date") == F.col("local_date"), before("day_range_atr")).alias("day_range_atr"), before("ts").alias("_closed"),
    ).filter("_own").drop("_own")
    micros = seconds(timeframe) * 1_000_000
    label = F.timestamp_micros((F.floor(F.unix_micros("bar_ts") / micros) * micros).cast("long"))
    if 86_400 % seconds(timeframe):  # bins don't count from the epoch
        found = asof_join(tests, own.withColumnRenamed("_bin", "_label"), "bar_ts", "_label", ["symbol"]).withColumnRenamed("_label", "_bin")
    else:
        found = tests.withColumn("_bin", label).join(own, ["symbol", "_bin"])
    joined = found.filter("_closed is not null and atr > 0")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.withColumns({
        "dist_ema50_atr": zero(F.col("dist_ema50_atr")), "day_range_atr": zero(F.col("day_range_atr")), "displacement_atr": zero(F.col("displacement_atr")),
        "prior_day_range_atr": zero(F.col("prior_day_range")) / F.col("atr"), "gap_atr": zero(F.col("gap_points")) / F.col("atr"),
        "bars_since_zone": (F.unix_micros("bar_ts") - F.unix_micros("formed_at")) / F.lit(micros),
    }).drop("_bin", "_closed", "prior_day_range", "gap_points")


HTF_FIELDS = ("htf_bias", "htf_bar_dir", "htf_slope_atr", "htf_dist_ema_atr", "htf_range_atr")


def attach_htf_context(tests: DataFrame, htf: DataFrame | None, timeframe: str = "") -> DataFrame:
    """Tests with the last higher bar that closed strictly before them: its measures, how far the next one is, and whether trend
    and bar agree with the zone. All are 0 without a higher timeframe or before its first close."""
    if htf is None:
        return tests.withColumns({c: F.lit(0.0) for c in (*HTF_FIELDS, "htf_bar_progress", "aligned", "aligned_bar")})
    keyed = asof_join(tests, htf.select("symbol", "closed_at", *HTF_FIELDS), "bar_ts", "closed_at", ["symbol"], strict=True)
    there = F.col("closed_at").isNotNull()
    progress = (F.unix_micros("bar_ts") - F.unix_micros("closed_at")) / F.lit(seconds(timeframe) * 1_000_000)
    fields = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in HTF_FIELDS}
    out = keyed.withColumns(fields).withColumn("htf_bar_progress", F.coalesce(progress, F.lit(0.0)))
    agree = lambda c: F.when(there & (F.col(c) == F.col("bias")), 1.0).otherwise(0.0)
    return out.withColumns({"aligned": agree("htf_bias"), "aligned_bar": agree("htf_bar_dir")}).drop("closed_at")


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], strict: bool = False, bucket: str = "1d") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key at, or strictly before, its time; nulls where there is none.

    Both sides are put in one order within a ``bucket`` of time and the last right row is carried along; what a bucket ends with goes to the
    rows of later ones that found none, by a window over one row for each bucket. No pairs, and no task that holds all rows of a key.
    Of right rows of one time the one with the largest values, in the order of the columns, is the last."""
    extra = [c for c in right.columns if c not in by]
    place = F.floor(F.unix_seconds("_at") / seconds(bucket)).cast("long")
    r = right.select(*by, F.col(right_on).alias("_at"), F.struct(*extra).alias("_r"), F.lit(0).alias("_side")).filter("_at is not null")
    both = left.withColumns({"_at": F.col(left_on), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True).withColumn("_bucket", place)
    order = F.col("_side").desc() if strict else F.col("_side").asc()
    w = Window.partitionBy(*by, "_bucket").orderBy("_at", order, "_r").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    ends = both.filter("_at is not null").groupBy(*by, "_bucket").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_at", "_r"))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = seen.join(carried, [*by, "_bucket"], "left").withColumn("_r", F.coalesce("_r", "_before"))
    return found.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in extra])


def event_window(events: DataFrame, bars: DataFrame, before: int = 120, after: int = 240) -> DataFrame:
    """The bars about each event by place, ``before`` to ``after``, with the event's zone and levels; ``bars`` needs bar_seq.

    Places are cut in blocks as long as a window, so that an event meets two or three of them."""
    length = before + after + 1
    block = lambda c: F.floor(c / F.lit(length)).cast("long")
    e = events.select("symbol", "event_id", F.col("bar_seq").alias("_at"), "zone_low", "zone_high", "entry", "stop", "target")
    e = e.withColumn("_block", F.explode(F.sequence(block(F.col("_at") - before), block(F.col("_at") + after))))
    b = bars.select("symbol", "ts", "bar_seq", "open", "high", "low", "close", block(F.col("bar_seq")).alias("_block"))
    return e.join(b, ["symbol", "_block"]).filter(F.col("bar_seq").between(F.col("_at") - before, F.col("_at") + after)).drop("_block", "_at")
