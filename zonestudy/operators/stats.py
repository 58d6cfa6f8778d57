"""Win rates with intervals, breakdowns, excursions, equity, splits and comparisons."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from zonestudy.sources.scratch import kept

#: Events in a group from which its rate is worth reading.
RELIABLE = 20


def wilson_interval(k: Column, n: Column, conf: float = 0.95) -> tuple[Column, Column, Column]:
    """Rate and Wilson bounds within [0, 1]; null without events."""
    z = NormalDist().inv_cdf(1 - (1 - conf) / 2)
    p = F.try_divide(k.cast("double"), n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / d
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return p, F.when(n > 0, low), F.when(n > 0, high)


def _binomial_p(k: float, n: float, p0: float) -> float:
    """Terms are summed from the most likely count outwards as far as they count at all, some dozens of standard deviations, so that
    a hundred million events take a few hundred thousand terms."""
    if not n or math.isnan(n) or math.isnan(p0):
        return math.nan
    p0 = min(max(p0, 1e-12), 1 - 1e-12)
    mode = int(min(n, math.floor((n + 1) * p0)))
    reach = int(60 + 40 * math.sqrt(n * p0 * (1 - p0)))
    low, high = max(0, mode - reach), int(min(n, mode + reach))
    if not low <= k <= high:
        return 0.0
    odds = math.log(p0) - math.log1p(-p0)
    i = np.arange(low, high, dtype=np.float64)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + odds)])  # from i to i + 1
    at_mode = math.lgamma(n + 1) - math.lgamma(mode + 1) - math.lgamma(n - mode + 1) + mode * math.log(p0) + (n - mode) * math.log1p(-p0)
    log_pmf = steps - steps[mode - low] + at_mode
    return float(min(1.0, np.exp(log_pmf[log_pmf <= log_pmf[int(k) - low] + 1e-7]).sum()))


def _binomial(k: pd.Series, n: pd.Series, p0: pd.Series) -> pd.Series:
    return pd.Series([_binomial_p(*x) for x in zip(k.astype(float), n.astype(float), p0.astype(float), strict=True)])


def binomial_test(k: Column, n: Column, p0: Column) -> Column:
    """The exact two-sided p-value of k of n against the rate p0; for rows of summaries, not of events."""
    p = pandas_udf(_binomial, "double")(k.cast("double"), n.cast("double"), p0.cast("double"))
    return F.when(F.isnan(p), None).otherwise(p)


def bootstrap_mean(events: DataFrame, column: str = "r_fixed", key: str = "event_id", n_boot: int = 5000, conf: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: mean, low, high of the mean of ``column`` by a Poisson bootstrap.

    In each of ``n_boot`` replicates an event counts a Poisson(1) number of times, drawn from a hash of its key, so the draws depend
    neither on partitions nor on order. Events of one value are drawn together: ``c`` of them count a Poisson(c) number of times, drawn from a hash of the
    value. Results in units of risk are mostly a few values, which then cost as much as a few events, however many they are. Tasks hand on two
    sums for each replicate, never rows. Null and non-finite values are left out; with none left all three are null."""
    x = events.select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), (F.col(column).cast("double") + F.lit(0.0)).alias("x"))
    x = x.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    equal = x.groupBy("x").agg(F.count("*").alias("c"), F.min("h").alias("h")).withColumn("h", F.when(F.col("c") > 1, F.xxhash64(F.lit(seed), "x")).otherwise(F.col("h")))
    together = max(1, (1 << 18) // n_boot)
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])

    def replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, sums = np.zeros(n_boot), np.zeros(n_boot)
        step = np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in frames:
            for h, c, value in pdf.loc[pdf["c"] > 1, ["h", "c", "x"]].itertuples(index=False):
                w = np.random.Generator(np.random.Philox(key=h % (1 << 64))).poisson(c, n_boot).astype(np.float64)
                weights += w
                sums += value * w
            single = pdf[pdf["c"] == 1]
            for at in range(0, len(single), together):
                h, value = single["h"].to_numpy()[at : at + together].view(np.uint64), single["x"].to_numpy()[at : at + together]
                u = h[:, None] + step
                u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(edges, ((u ^ (u >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)
                weights += w.sum(axis=0)
                sums += value @ w
        yield pd.DataFrame({"rep": np.arange(n_boot), "w": weights, "s": sums})

    drawn = equal.mapInPandas(replicate, "rep int, w double, s double").groupBy("rep").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    ends = [(1 - conf) / 2, (1 + conf) / 2]
    bounds = drawn.agg(F.percentile(F.try_divide("s", "w"), F.array(*[F.lit(e) for e in ends])).alias("q"))
    return x.agg(F.avg("x").alias("mean")).join(bounds).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def summarise(events: DataFrame, baseline_rate: float | None = None, n_boot: int = 5000) -> DataFrame:
    """One row: n, wins, rate and its interval, mean R and its interval, the share of ambiguous events, the median of bars held and,
    against a baseline rate, edge and p_value. ``events`` needs ``win``."""
    n, k = F.col("n"), F.col("wins")
    rate, low, high = wilson_interval(k, n)
    base = events.agg(
        F.count("*").alias("n"), F.count_if("win").alias("wins"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous"), F.median("bars_held").alias("median_bars")
    )
    boot = bootstrap_mean(events, n_boot=n_boot).select(F.col("mean").alias("mean_r"), F.col("low").alias("mean_r_low"), F.col("high").alias("mean_r_high"))
    out = base.join(boot).select("n", "wins", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"), "mean_r", "mean_r_low", "mean_r_high", "ambiguous", "median_bars")
    if baseline_rate is None or math.isnan(baseline_rate):
        return out
    b = F.lit(float(baseline_rate))
    return out.withColumns({"baseline_rate": b, "edge": F.col("rate") - b, "p_value": binomial_test(k, n, b)})


def rate_by_group(events: DataFrame, *columns: str) -> DataFrame:
    """by, value, n, rate, ci_low, ci_high, mean_r, reliable for each value (null too) of each column, in one pass over the events."""
    wide = events.select("win", "r_fixed", F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in columns])).alias("g"))
    rate, low, high = wilson_interval(F.col("wins"), F.col("n"))
    g = wide.groupBy("g.by", "g.value").agg(F.count("*").alias("n"), F.count_if("win").alias("wins"), F.avg("r_fixed").alias("mean_r"))
    return g.select("by", "value", "n", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"), "mean_r", (F.col("n") >= RELIABLE).alias("reliable")).orderBy("by", "value")


#: Values among which a quantile's place is found by ranking; more are counted in bins first.
RANKED = 10_000
#: Rows of bounds that are broadcast at most, some MB.
BOUNDS = 200_000


def quantiles(rows: DataFrame, by: list[str], column: str, probs: list[float]) -> DataFrame:
    """``by`` and ``q``, the exact quantiles of ``column`` with interpolation, null without values. NaN counts as the largest value.

    Values are counted in bins, map-side; the bin that holds a quantile's place is known by the counts, and its values are counted in finer bins until
    few enough are left to rank. The bins' bounds go to the rows as a broadcast, so no task meets all values of a large group."""
    x = kept(rows.select(*by, F.col(column).cast("double").alias("_x")).filter("_x is not null"))
    # the first bins are 256 for each factor e of the value, and for each unit below 1; a rising function of the value, whatever its rounding
    size = F.least(F.greatest(F.signum("_x") * F.log1p(F.abs("_x")), F.lit(-720.0)), F.lit(720.0))
    placed = _bins(x, by, F.floor(size * 256).cast("long")).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
    rank = lambda p: F.lit(p) * (F.col("_all") - 1)
    sides = [F.struct(F.lit(k).alias("_k"), F.lit(s).alias("_s"), to(rank(p)).cast("long").alias("_r"), (rank(p) - F.floor(rank(p))).alias("_f")) for k, p in enumerate(probs) for s, to in enumerate((F.floor, F.ceil))]
    picked = _holding(placed.withColumn("_t", F.explode(F.array(*sides))).select("*", "_t.*"), by)
    while True:
        picked = kept(picked)
        n, most = picked.agg(F.count("*"), F.max(F.when(_splits(), F.col("_c")))).first()
        bounds = lambda t: F.broadcast(t) if n <= BOUNDS else t  # noqa: B023, E731
        if (most or 0) <= RANKED:
            break
        wide = picked.filter(_splits() & (F.col("_c") > RANKED)).select(*by, "_k", "_s", "_r", "_f", "_lo", "_hi")
        met = x.join(bounds(wide), by).filter("_x between _lo and _hi")
        # parts of the bin's width; halves first, as the width of all doubles is none
        part = F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * 4095).cast("long")
        finer = _holding(_bins(met, [*by, "_k", "_s", "_r", "_f"], part, [*by, "_k", "_s"]), by)
        picked = picked.filter(~(_splits() & (F.col("_c") > RANKED))).unionByName(finer)
    last = x.join(bounds(picked.filter(_splits()).select(*by, "_k", "_s", "_r", "_f", "_lo", "_hi")), by).filter("_x between _lo and _hi")
    ranked = _holding(_bins(last, [*by, "_k", "_s", "_r", "_f"], F.col("_x"), [*by, "_k", "_s"]), by)
    found = picked.filter(~_splits()).unionByName(ranked).groupBy(*by, "_k").agg(*[F.max(F.when(F.col("_s") == s, F.col("_lo"))).alias(c) for s, c in enumerate(("_l", "_h"))], F.max("_f").alias("_f"))
    value = F.when(F.col("_f") == 0, F.col("_l")).otherwise(F.col("_l") * (1 - F.col("_f")) + F.col("_h") * F.col("_f"))
    listed = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_k", value.alias("v")))).alias("_s"))  # a few for each group
    return listed.select(*by, F.transform("_s", lambda s: s["v"]).alias("q"))


def _splits() -> Column:
    """Whether a bin has different values, and a width."""
    return (F.col("_lo") < F.col("_hi")) & (F.col("_hi") < float("inf")) & (F.col("_lo") > float("-inf")) | (F.col("_lo") < F.col("_hi")) & (F.col("_c") <= RANKED)


def _bins(x: DataFrame, by: list[str], place: Column, within: list[str] | None = None) -> DataFrame:
    """Of each bin its count, least and largest value, and the count up to it."""
    g = x.groupBy(*by, place.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return g.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*(within or by)).orderBy("_bin")))


def _holding(bins: DataFrame, by: list[str]) -> DataFrame:
    """The bins that hold place ``_r``, counted from their first value now."""
    own = bins.filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
    return own.select(*by, "_k", "_s", (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"), "_f", "_lo", "_hi", "_c")


def excursion_quantiles(events: DataFrame) -> DataFrame:
    """measure, count, mean, std, min, q25, q50, q75, q90, max of mfe_r, mae_r and bars_held."""
    long = events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in ("mfe_r", "mae_r", "bars_held")])).alias("m")).select("m.*")
    g = long.groupBy("measure").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    g = g.join(quantiles(long, ["measure"], "x", [0.25, 0.5, 0.75, 0.9]), "measure", "left")  # a row for each measure
    return g.select("measure", "count", "mean", "std", "min", *[F.col("q")[i].alias(f"q{n}") for i, n in enumerate((25, 50, 75, 90))], "max")


def excursion_histogram(events: DataFrame, bins: int = 60) -> DataFrame:
    """measure, bin, low, high, n: equal widths from the least to the largest value of mfe_r and mae_r, the last bin closed."""
    long = events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in ("mfe_r", "mae_r")])).alias("m")).select("m.*").dropna()
    ends = long.groupBy("measure").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / F.lit(bins)
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("a"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    g = long.join(F.broadcast(ends), "measure").groupBy("measure", place.alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return g.select("measure", "bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def equity_curve(events: DataFrame) -> DataFrame:
    """symbol, ts, event_id, r_fixed and ``equity``, its running sum over each symbol's events; null before the first that has a result.

    Sums run within days; what a day starts from is the sum over a row for each day before, so no task holds a symbol."""
    own = events.select("symbol", "ts", "event_id", "r_fixed", F.to_date("ts").alias("_day"))
    daily = own.groupBy("symbol", "_day").agg(F.sum("r_fixed").alias("_sum"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = daily.select("symbol", "_day", F.sum("_sum").over(before).alias("_start"))
    day = Window.partitionBy("symbol", "_day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = own.join(starts, ["symbol", "_day"]).withColumn("_own", F.sum("r_fixed").over(day))
    total = F.coalesce(F.col("_start") + F.col("_own"), "_start", "_own")
    return run.select("symbol", "ts", "event_id", "r_fixed", total.alias("equity"))


def split_is_oos(events: DataFrame, start, end) -> DataFrame:
    """Events with ``part``: in_sample from start to end, out_of_sample after it; earlier ones go. Naive dates are UTC."""
    ts, a, b = F.col("ts"), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return events.withColumn("part", F.when((ts >= a) & (ts <= b), "in_sample").when(ts > b, "out_of_sample")).filter("part is not null")


def filter_outcome(events: DataFrame, which: str) -> DataFrame:
    """Wins, losses or ambiguous events."""
    tests = {"wins": F.col("outcome") == "win", "losses": F.col("outcome") == "loss", "ambiguous": F.col("ambiguous")}
    if which not in tests:
        raise ValueError(f"which must be one of {sorted(tests)}, not {which!r}")
    return events.filter(tests[which])


def compare_splits(in_sample: DataFrame, out_of_sample: DataFrame) -> DataFrame:
    """One row of two summaries: both rates, their difference, and whether the intervals overlap."""
    a = in_sample.select(*[F.col(c).alias(f"is_{c}") for c in ("n", "rate", "ci_low", "ci_high")])
    b = out_of_sample.select(*[F.col(c).alias(f"oos_{c}") for c in ("n", "rate", "ci_low", "ci_high")])
    meets = (F.col("is_ci_low") <= F.col("oos_ci_high")) & (F.col("oos_ci_low") <= F.col("is_ci_high"))
    return a.join(b).withColumns({"rate_change": F.col("oos_rate") - F.col("is_rate"), "overlap": meets})


def baseline_table(summary: DataFrame, controls: dict[str, DataFrame]) -> DataFrame:
    """control, rate, n, edge, p_value for each control, and ``verdict``: whether every edge is above 0 with a p-value up to .05."""
    rows = None
    for name, c in controls.items():
        own = c.select(F.lit(name).alias("control"), F.col("rate"), F.col("n"))
        rows = own if rows is None else rows.unionByName(own)
    s = summary.select(F.col("n").alias("_n"), F.col("wins").alias("_wins"), F.col("rate").alias("_rate"))
    t = rows.join(s).withColumns({"edge": F.col("_rate") - F.col("rate"), "p_value": binomial_test(F.col("_wins"), F.col("_n"), F.col("rate"))})
    whole = Window.partitionBy(F.lit(1))  # a row for each control
    fails = (F.col("edge") <= 0) | (F.col("p_value") > 0.05) | F.col("edge").isNull()
    return t.withColumn("verdict", F.when(F.max(fails.cast("int")).over(whole) == 1, "no edge").otherwise("edge")).select("control", "rate", "n", "edge", "p_value", "verdict")


def deflated_threshold(trials: Column) -> Column:
    """The largest z-score that chance alone leads one to expect of so many trials."""
    return F.sqrt(2 * F.ln(F.greatest(F.lit(1.0), trials.cast("double"))))
