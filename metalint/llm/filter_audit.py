"""What each of five filters removes in any order, with repeats found behind a counting-Bloom pass.

Filters A to D are conditions on a row of its own. E, a text that a smaller id has as well, needs all texts: each task
counts its texts' hashes in a counting Bloom sketch (counters end at two), sketches are merged in rounds of bounded
groups, and a text with any cell that was counted once is unique for certain. Only the others, possible repeats, are
shuffled: grouped by the full text, combined before the shuffle, they give the smallest id of each text, and a row
that isn't such a first one fails E. So a sketch that is too small for its table costs time and never a result.

A row's failures are a mask of five bits. Whatever order the filters have, its fate follows from its mask, so the
table is counted by (part, mask) and the 120 orders are worked out on at most 32 counts of each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import WORD, cut, drop_folder, open_folder, scratch_folder, write_whole
from metalint.llm.folding import folded
from metalint.llm.wordhash import mix

NAMES = "ABCDE"
ORDERS = ["".join(p) for p in permutations(NAMES)]
MIN_WORDS = 200
#: Cells of the sketch: for each text, and at most (a bit each in the workers, 32 MB).
CELLS_PER_TEXT, MOST_CELLS = 16, 2**28
SEGMENTS, PROBES = 64, 3
_GAP = WORD.replace("^", "")
_sketches: dict[str, np.ndarray] = {}


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cells of each hash, one row per probe."""
    steps = np.arange(1, PROBES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return (mix(hashes.astype(np.int64).view(np.uint64) + steps) & np.uint64(cells - 1)).astype(np.int64)


def _counted(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Distinct cells in order, each with a bit that tells counts of two and more, as uint32."""
    order = np.argsort(cells, kind="stable")
    cells, twice = cells[order], twice[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    more = np.diff(np.append(first, len(cells))) > 1
    if len(first):
        more |= np.logical_or.reduceat(twice, first)
    return (cells[first] * 2 + more).astype("<u4").tobytes()


def _merged(total: bytes | None, state: bytes) -> bytes:
    if total is None:
        return state
    both = np.frombuffer(total + state, "<u4").astype(np.int64)
    return _counted(both >> 1, (both & 1).astype(bool))


def _sketcher(cells: int):
    """Counted cells of a task's texts, by segment of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total, size = pyspark.TaskContext.get().partitionId(), b"", cells // SEGMENTS
        for batch in batches:
            found = _cells(batch.column("h").to_numpy(), cells).ravel()
            total = _merged(total, _counted(found, np.zeros(len(found), bool)))
        values = np.frombuffer(total, "<u4")
        bounds = np.searchsorted(values >> 1, np.arange(SEGMENTS + 1) * size)
        parts = [(s, values[lo:hi] - np.uint32(2 * s * size)) for s, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if hi > lo]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in parts], pa.int64()), pa.array([piece] * len(parts), pa.int64()), pa.array([v.astype("<u4").tobytes() for _, v in parts], pa.binary())],
            names=["segment", "piece", "state"])

    return run


def _segment_writer(folder: str, size: int):
    """Writes a bit for each cell of a segment: counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, state in zip(batch.column("segment").to_pylist(), batch.column("state").to_pylist(), strict=True):
                values, bits = np.frombuffer(state, "<u4"), np.zeros(size, bool)
                bits[values[(values & 1) == 1] >> 1] = True
                write_whole(folder, f"segment-{segment:03d}", np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("segment")], names=["segment"])

    return run


def _sketch(folder: str, cells: int) -> np.ndarray:
    """The whole sketch, read once per worker; segments that hold no text have no file."""
    if folder not in _sketches:
        _sketches.clear()
        store, path = open_folder(folder)
        size, bits = cells // SEGMENTS // 8, np.zeros(cells // 8, np.uint8)
        for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith("segment-"):
                at = int(info.base_name.removeprefix("segment-")) * size
                with store.open_input_file(info.path) as file:
                    bits[at:at + size] = np.frombuffer(file.read(), np.uint8)
        _sketches[folder] = bits
    return _sketches[folder]


def possible_repeats(hashes: DataFrame, texts: int, folder: str) -> Column:
    """A condition on column h: False only for hashes that occur once in hashes (h long), which has so many rows.

    The sketch is a set of files in folder, which must stay until the condition has been used.
    """
    cells = 1 << int(np.ceil(np.log2(min(max(CELLS_PER_TEXT * texts, 2**16), MOST_CELLS))))
    states = folded(hashes.select("h").mapInArrow(_sketcher(cells), "segment long, piece long, state binary"), "segment", _merged)
    cut(states.mapInArrow(_segment_writer(folder, cells // SEGMENTS), "segment long"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        bits, at = _sketch(folder, cells), _cells(h.to_numpy(), cells)
        return pd.Series(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0))

    return maybe("h")


def _own_failures(text: Column) -> Column:
    """Bits of the conditions A to D."""
    words = F.array_remove(F.split(text, _GAP), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failures = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures)), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the failed filters of every row, bit 0 for A to bit 4 for E."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    folder = scratch_folder(docs.sparkSession, "filter-audit")
    marked = rows.withColumn("maybe", possible_repeats(rows, docs.count(), folder) & F.col("doc_id").isNotNull())
    flags = cut(marked.select("doc_id", "part", _own_failures(F.col("text")).alias("mask"), F.when(F.col("maybe"), F.sha2("text", 256)).alias("text_sha")))
    firsts = marked.where("maybe").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.sha2("text", 256).alias("text_sha"), F.lit(0).alias("repeats"))
    judged = flags.where("text_sha is not null").join(firsts, ["doc_id", "text_sha"], "left")
    masks = cut(flags.where("text_sha is null").select("doc_id", "part", "mask").unionByName(
        judged.select("doc_id", "part", (F.col("mask") + F.coalesce("repeats", F.lit(1 << 4))).alias("mask"))))
    drop_folder(folder)
    return masks


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part its counts by mask, an array of (mask, n, good, toxic) of at most 32."""
    marks = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    marked = masks.join(marks.where("good + toxic > 0"), "doc_id").groupBy("part", "mask").agg(
        F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).select("*", zero.alias("good"), zero.alias("toxic"))
    both = counted.unionByName(marked).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    return both.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part and order.

    docs (doc_id, text, source), labels (doc_id, quality, toxic); other columns are not looked at. A null text is
    empty, a null source is the part with the empty name. Of repeated rows, those with the smallest id of their text
    all pass E; a null id is neither smaller nor larger than any, so such a row passes E and has no label. A document
    is good or toxic if any of its labels says so. Texts are taken whole. An empty table gives no rows.
    """
    rows = mask_counts(failure_masks(docs), labels).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit_of = f"shiftleft(1, instr('{NAMES}', substring(filter_order, {{}}, 1)) - 1)"
    earlier = sum((F.expr(f"if(step > {j}, {bit_of.format(j)}, 0)") for j in range(1, 5)), F.lit(0))
    rows = rows.withColumn("bit", F.expr(bit_of.format("step"))).withColumn("earlier", earlier)

    def total(amount, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(holds(c.mask), amount(c)).otherwise(0))

    bit, before = F.col("bit"), F.col("earlier")
    fails = lambda m: m.bitwiseAND(bit) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    lost = lambda m: fails(m) & passed(m)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c.n, lambda m: ~fails(m) & passed(m)).alias("kept"), total(lambda c: c.n, lost).alias("removed"),
        total(lambda c: c.n, lambda m: fails(m) & ~passed(m)).alias("redundant"), total(lambda c: c.n, lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c.good, lost).alias("good_lost"), total(lambda c: c.toxic, lost).alias("toxic_lost"),
        # A filter comes first among the k that a row fails in one k-th of the orders.
        total(lambda c: c.n * (F.lit(len(ORDERS)) / F.bit_count(c.mask)).cast("long"), fails).alias("shapley"))


def audit_sql() -> str:
    """The rows of audit for DuckDB: every order walked through the masks."""
    words = f"[w for w in string_split_regex(t, '{_GAP}') if w <> '']"
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    return f"""
with texts as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, min(doc_id) over (partition by coalesce(text, '')) first_id from documents),
counted as (select *, len({words}) n, len(list_distinct({words})) n_distinct from texts),
masks as (
  select doc_id, part,
    (n < {MIN_WORDS})::int + 2 * (100 * n_distinct < 50 * n)::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int as mask
  from counted),
marks as (select doc_id, max(coalesce(quality = 1, false)::int) good, max(coalesce(toxic = 1, false)::int) toxic from labels group by doc_id),
cells as (
  select part, mask, count(*) n, coalesce(sum(good), 0) good, coalesce(sum(toxic), 0) toxic
  from masks left join marks using (doc_id) group by part, mask),
steps as (
  select o filter_order, step, 1 << (instr('{NAMES}', o[step]) - 1) bit,
    coalesce(list_sum([1 << (instr('{NAMES}', o[i]) - 1) for i in range(1, step)]), 0)::bigint before
  from (values {orders}) t(o), unnest(range(1, 6)) s(step)),
walked as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (before | bit) = 0), 0) kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0) removed,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0) redundant, coalesce(sum(n) filter (mask = bit), 0) unique_fails,
    coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0) good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0) toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) shapley
from walked"""
