"""Mixing sources to target weights by systematic sampling.

A source's expected copies for each of its documents are target / size of the source. Within the source the documents
are in order of size, their expected copies are summed up to and including each, one random offset is added, and a
document is emitted once for each whole number that its sum crosses. The order by size makes the words taken come as
close to the target as single documents allow.

Ranks come from a range partitioning: a partition's rows are numbered in order, and what earlier partitions have of
the same source is added, so a source with any share of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metalint.llm.common import WORD, cut, fresh, shuffle_width

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text; none where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size), one row per source.

    Sources by code point, null last, weigh WEIGHTS in turn and share all sizes; a target stops at MAX_COPIES times
    its source's size and the excess is shared anew among the others. With sources in order of cap per weight, the
    capped ones come first: the last level at which one more cap would not be reached is found with running sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (place + 1).cast("int"))
    named = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MAX_COPIES).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    named = named.withColumn("left", left).withColumn("open", F.sum("weight").over(after))
    named = named.withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    free = F.col("capped") == F.lit(False)
    level = F.max(F.when(free, F.col("left"))).over(everything), F.max(F.when(free, F.col("open"))).over(everything)
    named = named.withColumn("share_left", level[0]).withColumn("share_open", level[1])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("share_left") / F.col("share_open"))
    return named.select("source", "source_size", target.alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The random offset of a source, from 0 to below 1, the same in every run."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:s"), source), F.lit(f"{seed}:null"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(2**32).cast("long")


def planned_copies(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (key columns, source, size) with source_size, target and copies."""
    keys = [c for c in sized.columns if c not in ("source", "size")]
    wide = shuffle_width(sized.sparkSession)
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), *[F.col(k).asc_nulls_last() for k in keys]]
    sized = sized.withColumn("row_tie", F.monotonically_increasing_id())
    spread = sized.repartitionByRange(wide, *order, "row_tie").sortWithinPartitions(*order, "row_tie").drop("row_tie")
    placed = cut(spread.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("piece", F.shiftright("place", 33))
    pieces = placed.groupBy("source", "piece").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("source", "piece", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    pieces = pieces.toDF("in_source", "in_piece", "shift")
    targets = targets.withColumnRenamed("source", "of_source")
    ranked = placed.join(pieces, placed["source"].eqNullSafe(pieces["in_source"]) & (placed["piece"] == pieces["in_piece"]))
    ranked = ranked.join(targets, ranked["source"].eqNullSafe(targets["of_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, start = F.col("place") + F.col("shift"), offset_of(F.col("source"), seed)
    copies = F.floor(start + (rank + 1) * rate) - F.floor(start + rank * rate)
    return ranked.select(*keys, "source", "size", "source_size", "target", F.least(copies, F.lit(MAX_COPIES).cast("long")).alias("copies"))


def mix_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs (doc_id, text, source).

    Other columns are not looked at. A null or empty text has no words: it may be taken, but adds none. Equal rows are
    told apart by their place only, which no result depends on. A source whose texts have no words at all gets no
    copies. An empty table gives an empty result.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = planned_copies(sized, source_targets(sized), seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that it does not take are left out.

    Rows with the same doc_id, source and text share their copies, and one of them is repeated as often as all are taken.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = cut(docs.select("doc_id", key.alias("th"), "source", word_count(F.col("text")).alias("size")))
    of_id, of_text, of_source, copies, rows_of, copy = fresh(docs, "mix_id", "mix_th", "mix_source", "mix_copies", "mix_rows", "mix_copy")
    plan = planned_copies(sized, source_targets(sized), seed).groupBy("doc_id", "th", "source").agg(F.sum("copies"), F.count("*"))
    plan = plan.toDF(of_id, of_text, of_source, copies, rows_of).where(F.col(copies) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (key == F.col(of_text)) & F.col("source").eqNullSafe(F.col(of_source))
    rows = docs.join(plan, same)
    # One row of each set of equal rows stands for all of them and is repeated.
    once = rows.where(F.col(rows_of) == 1).unionByName(rows.where(F.col(rows_of) > 1).dropDuplicates([of_id, of_text, of_source]))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def mix_sql(seed: int = SEED) -> str:
    return f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
        t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::BIGINT AS weight FROM t),
        o AS (SELECT source, source_size, weight, source_size * {MAX_COPIES} AS cap,
                     (sum(source_size) OVER () - coalesce(sum(source_size * {MAX_COPIES}) OVER (ORDER BY source_size * {MAX_COPIES} / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
                     sum(weight) OVER (ORDER BY source_size * {MAX_COPIES} / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
              FROM w),
        c AS (SELECT *, cap * open <= rest * weight AS capped FROM o),
        s AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * max(CASE WHEN NOT capped THEN rest END) OVER ())
                     / max(CASE WHEN NOT capped THEN open END) OVER () END AS target FROM c),
        r AS (SELECT d.doc_id, d.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS rank,
                     ('0x' || substr(md5(coalesce('{seed}:s' || d.source, '{seed}:null')), 1, 8))::BIGINT / {2**32} AS start
              FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, size, source_size, target,
               (least(floor(start + rank * rate) - floor(start + (rank - 1) * rate), {MAX_COPIES}) * size)::BIGINT AS taken,
               least(floor(start + rank * rate) - floor(start + (rank - 1) * rate), {MAX_COPIES})::BIGINT AS copies
        FROM r"""
