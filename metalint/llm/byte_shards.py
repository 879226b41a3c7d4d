"""Contiguous shards of near equal bytes, from global prefix sums of per-partition totals.

Rows are put in order by a range partitioning; each partition sums its own rows up, and adds what all earlier
partitions hold together. A row belongs to the shard in whose equal part of all bytes its first byte lies, so a shard
is off its target by less than one row at either end. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalint.llm.common import cut, shuffle_width

SHARDS = 8


def prefix_sums(rows: DataFrame, value: str, order: list) -> DataFrame:
    """rows with ``before`` (sum of value over all rows before this one), ``rank`` (their number) and ``total``.

    Rows that order alike are told apart by their place, which only fixes the order among them. The partition totals
    are one row per partition.
    """
    wide = shuffle_width(rows.sparkSession)
    tied = rows.withColumn("row_tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(wide, *order, "row_tie").sortWithinPartitions(*order, "row_tie").drop("row_tie")
    placed = cut(spread.withColumn("place", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("place", 33)))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("piece").agg(F.sum(value).alias("piece_sum"), F.count("*").alias("piece_rows"))
    pieces = pieces.select(
        "piece", F.coalesce(F.sum("piece_sum").over(earlier), F.lit(0)).alias("sum_before"),
        F.coalesce(F.sum("piece_rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("piece_sum").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("own_sum", F.sum(value).over(within)).join(pieces, "piece")
    return summed.withColumn("before", F.col("sum_before") + F.col("own_sum") - F.col(value)).withColumn(
        "rank", F.col("rows_before") + F.col("place") - F.shiftleft("piece", 33)).drop("place", "piece", "own_sum", "sum_before", "rows_before")


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text), shards from 0.

    Other columns are not looked at. Order is by doc_id, nulls first, then by size and checksum; equal rows follow one
    another. A null text has no bytes, so its size is 1, and checksum 0. Fewer rows than shards leave shards empty; an
    empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    sized = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    placed = cut(prefix_sums(sized, "size", order).withColumn(
        "shard", F.expr(f"cast(cast(before as decimal(20, 0)) * {shards} div total as int)")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
