"""Connected components of a graph held as a table of edges, and joins that hot keys don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.shared import dropped, written

#: Rows of one key from which the key is hot, and hot keys that are broadcast at most: the ones with the most rows.
HOT, BROADCAST = 1 << 15, 1 << 16


def joined_by(rows: DataFrame, keyed: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each key with the number of its rows in ``many``; ``many`` goes.

    The rows of hot keys meet a broadcast of at most ``BROADCAST`` rows where they lie; all others are dealt out by the key. Of
    ``total`` rows, fewer than one hot key has, none needs that."""
    if total < HOT:
        return rows.join(keyed.drop("many"), list(keys))
    hot = F.broadcast(keyed.filter(F.col("many") >= HOT).orderBy(F.desc("many"), *keys).limit(BROADCAST).drop("many"))
    cold = rows.join(hot.select(*keys), list(keys), "left_anti").join(keyed.drop("many"), list(keys))
    return rows.join(hot, list(keys)).unionByName(cold)


def salted_join(rows: DataFrame, others: DataFrame, total: int, key: str) -> DataFrame:
    """``rows`` joined to ``others``, both of which may have many rows of one ``key``.

    Of a key with ``HOT`` rows or more each ``HOT`` of ``rows`` are dealt out by themselves and the key's ``others`` go to all of them. Which keys
    those are is a broadcast of at most ``BROADCAST`` rows, those with the most; what is beyond has less than that share of ``total`` rows."""
    if total < HOT:
        return rows.join(others, key)
    many = rows.groupBy(key).agg(F.count("*").alias("many")).filter(F.col("many") >= HOT).orderBy(F.desc("many"), key).limit(BROADCAST)
    hot = F.broadcast(written(many.select(key, F.ceil(F.col("many") / HOT).cast("int").alias("salts")), "hot"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("salts")
    each = others.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(each, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b: long).

    Alternates two steps until nothing changes: each node's larger neighbours are tied to its smallest neighbour, then its smaller
    ones are. Each step is a grouped minimum and a join on the node that deals with nodes of very many edges apart; the number of
    rounds grows with the logarithm of the nodes. The edges are
    written after each round. Repeated edges and loops are allowed; null ends are left out; no edges give no rows."""

    def star(pairs: DataFrame, total: int, larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("many")).withColumn("low", F.least("low", "u"))
        joined = joined_by(pairs, low, total, "u")
        if larger:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        return out.filter("u != v").distinct()

    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a != b")
    edges = written(edges.distinct(), "edges")
    total, before = edges.count(), None
    while total:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tied, last = written(star(both, 2 * total, True), "edges"), edges
        edges = written(star(tied, 2 * total, False), "edges")
        dropped(last, tied)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        total, before = state[0], state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
