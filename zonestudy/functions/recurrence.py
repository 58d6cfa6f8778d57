"""Exponential moving averages over long ordered columns, with windows that span short chunks only."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A chunk is this many mean lifetimes long: powers within it stay near 1, and those of a few chunks vanish.
LIFETIMES = 3


def exponential_means(bars: DataFrame, means: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``bars`` (with bar_seq) with a column for each of ``means``: name -> (column, alpha), the recurrence y = (1 - alpha) y + alpha x over
    each symbol's bars in their order, from y = x at the first bar. Inputs must not be null.

    Bars are cut in chunks by place. Within a chunk y is a running sum with weights that are powers of (1 - alpha). What
    the chunks before add is their last values times powers of the chunk's decay, of which so many are summed that the rest is
    below double precision. So nothing but one row for each chunk is ordered over a whole symbol, and all of it is JVM code."""
    largest = max(a for _, a in means.values())
    size = max(1, round(LIFETIMES / largest))
    chunked = bars.withColumns({"_chunk": F.floor(F.col("bar_seq") / size).cast("long"), "_k": (F.col("bar_seq") % size).cast("double")})
    within = Window.partitionBy("symbol", "_chunk").orderBy("bar_seq").rowsBetween(Window.unboundedPreceding, 0)
    for name, (column, alpha) in means.items():
        keep = 1.0 - alpha
        summed = F.sum(F.col(column) * F.pow(F.lit(keep), -F.col("_k"))).over(within)
        chunked = chunked.withColumn(f"_{name}", summed * F.pow(F.lit(keep), "_k") * F.lit(alpha))
    lasts = chunked.groupBy("symbol", "_chunk").agg(
        *[F.max_by(f"_{n}", "bar_seq").alias(f"_{n}_last") for n in means], *[F.min_by(c, "bar_seq").alias(f"_{n}_first") for n, (c, _) in means.items()]
    )
    order = Window.partitionBy("symbol").orderBy("_chunk")
    carries = {}
    for name, (_, alpha) in means.items():
        decay = (1.0 - alpha) ** size
        terms = 1 if decay <= 0 else math.ceil(42 / -math.log(decay))
        before = [F.coalesce(F.lag(f"_{name}_last", m + 1).over(order), F.lit(0.0)) * F.lit(decay**m) for m in range(terms)]
        seed = F.first(f"_{name}_first").over(order) * F.pow(F.lit(decay), F.col("_chunk").cast("double"))
        carries[f"_{name}_carry"] = reduce(add, before) + seed
    out = chunked.join(lasts.select("symbol", "_chunk", *[c.alias(n) for n, c in carries.items()]), ["symbol", "_chunk"])
    for name, (_, alpha) in means.items():
        out = out.withColumn(name, F.col(f"_{name}") + F.pow(F.lit(1.0 - alpha), F.col("_k") + 1) * F.col(f"_{name}_carry"))
    return out.select(*bars.columns, *means)
