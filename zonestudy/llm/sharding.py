"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonestudy.llm.shared import written


def prefix_shards(rows: DataFrame, order: list[str], size: Column, n_shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: cut into ``n_shards`` runs of near-equal total ``size`` in the order of ``order``.

    The rows are range-partitioned on the order once. Each partition's total gives the bytes before it; within a
    partition a running sum does the rest, so no task sees more than one partition. A row goes to the shard in which the
    middle of its bytes falls: a shard's size differs from the target by less than the largest row. ``slot`` counts
    the rows of a shard from 0 without gaps.

    Equal keys are split by the row's position in the input, so a key that many rows share can spread over several
    partitions. Null keys come first. No rows give no rows. ``size`` must be a non-negative long, not null; all sizes
    zero puts every row into shard 0. All columns stay, whatever their names; ``shard`` or ``slot`` among them is an error."""
    if taken := {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the rows already have {', '.join(sorted(taken))}")
    keys = [*(f"key{i}" for i in range(len(order))), "tie"]
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), size.alias("size"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=False)])
    kept = written(own.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "sharding")
    totals = kept.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*keys)
    placed = kept.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(within) - 1).join(starts, "part")
    placed = placed.withColumn("middle", 2 * (F.col("upto") + F.col("bytes_before")) - F.col("size"))
    shard = F.least(F.lit(n_shards - 1), F.coalesce(F.expr(f"middle * {n_shards} div nullif(2 * total, 0)"), F.lit(0))).cast("int")
    placed = written(placed.select("row", shard.alias("shard"), (F.col("rank") + F.col("rows_before")).alias("rank")), "shards")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` to ``path``/shard=0 ... with ids in order; whole rows, with all their columns and ``slot``. A null text counts one
    byte. No rows write no shard; columns named ``shard`` or ``slot`` are an error."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    out = prefix_shards(docs, [id_col], size, n_shards)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, in shards of near-equal bytes.

    Size is the text's UTF-8 bytes (null: none) plus 1; the CRC of a null text is that of no bytes, 0. Shards are
    contiguous in the order of doc_id, ties in the order of CRC and size, so repeated rows are interchangeable. Law
    ``bytes`` holds; ``grown_shard`` belongs to another law and is null. Other columns of ``docs`` are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return prefix_shards(rows, ["doc_id", "text_crc32", "size"], F.col("size"), n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
