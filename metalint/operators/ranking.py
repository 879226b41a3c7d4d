"""First, top and rank inside key groups, without putting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, shuffle_width

ROWS_PER_TASK = 1_000_000


def _struct(cols: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key group in `order`.

    An aggregate, not a window: each map task reduces its part of a group to one row, so a key that
    holds a third of the table still shuffles one row per task. Nulls sort first. `order` must be total.
    """
    payload = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(_struct(payload), _struct(order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in payload]).select(*df.columns)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark applies the limit before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
                  max_group: int = ROWS_PER_TASK) -> DataFrame:
    """Exact 1-based position in each key group; `order` must be total.

    Groups up to `max_group` rows use a plain window. Larger ones are cut into ordered pieces by a range
    partitioning on (keys, order); positions are counted inside the pieces and shifted by the sizes of the
    pieces before. The shift table has one row per piece, so it is bounded by the number of partitions.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_group).drop("_n")
    big_keys = cut(sizes)
    if big_keys.isEmpty():
        return df.withColumn(name, F.row_number().over(plain))

    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    small = df.alias("l").join(big_keys.alias("r"), same, "left_anti")
    big = df.alias("l").join(big_keys.alias("r"), same, "left_semi")
    pieces = cut(
        big.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    counts = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = pieces.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))
    )
    on = [*same, F.col("l._piece") == F.col("r._piece")]
    ranked = (
        inside.alias("l").join(shifts.alias("r"), on)
        .select(*[F.col(f"l.{c}").alias(c) for c in df.columns],
                (F.col("l._pos") + F.col("r._before")).cast("int").alias(name))
    )
    return small.withColumn(name, F.row_number().over(plain)).unionByName(ranked)


def listed_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-blank values of each group as rows (keys, rank, value), ranked by the value without its case.

    A list of any length is as many rows; values that differ by case only are one.
    """
    shown = df.where(F.col(value).rlike(r"\S")).withColumn("_k", F.lower(value))
    values = shown.groupBy(*keys, "_k").agg(F.min(value).alias(value))
    return rank_in_group(values, keys, [F.col("_k")], "rank").select(*keys, "rank", value)


def top_two(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: the most frequent value, its count, whether another value ties with it, and totals.

    Three aggregates in a row, each with map-side combining; no window over the group.
    """
    per_value = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    per_count = per_value.groupBy(*keys, "_n").agg(
        F.count("*").alias("_values"), F.min(value).alias("_least"),
        (F.count("*") * F.col("_n")).alias("_rows"),
    )
    return per_count.groupBy(*keys).agg(
        F.sum("_rows").alias("peers"),
        F.sum("_values").alias("distinct_values"),
        F.max("_n").alias("dominant_count"),
        (F.max_by("_values", "_n") > 1).alias("tied"),
        F.max_by("_least", "_n").alias("dominant_value"),
    )
