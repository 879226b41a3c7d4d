"""Product quantisation; nearest codebook entries by sliced and intersected bit masks.

A vector is cut into equal parts, each part is replaced by the index of the nearest entry of its part's codebook, and
codebooks are refined in rounds (each entry becomes the mean of what chose it). All numbers are whole, so results are
the same in any partitioning.

The nearest entry is found exactly. For each coordinate the entries are sorted, and each place of that order carries a
mask of the entries before it, a bit per entry in uint64 words. A radius selects a range of each coordinate; the masks
at its two ends differ in just the entries within, and the AND over all coordinates leaves those in the box around the
vector. Only their distances are taken. An entry outside the box is further off than the radius, so the best of the
box is final if it lies within; else the radius grows to the best distance so far (or twofold, if the box is empty)
and only new entries of the larger box are looked at. Entries that lie together share a word, so a box leaves whole
words empty. The codebooks are a few hundred rows and travel with the tasks; sums of a round are added up in rounds of
bounded groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import cut
from metalint.llm.folding import folded
from metalint.llm.vectors import component_limit, exact_product, extent, finite, scaled
from metalint.llm.wordhash import batches_of

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Share of entries whose own nearest entry lies within the initial radius.
NEAR_SHARE = 0.9
#: Totals of this many labels, of this many characters each, are broadcast; more are joined by a shuffle.
LABELS_SENT, LABEL_CHARS = 10_000, 200
_BATCH = 8192
_FAR = 2**62


def _words_of(entries: np.ndarray) -> list[np.ndarray]:
    """Entries in groups of at most 64 that lie together, by halving along the widest coordinate; each in ascending order."""
    groups = [np.arange(len(entries))]
    while max(map(len, groups)) > 64:
        halves = []
        for group in groups:
            widest = np.ptp(entries[group], axis=0).argmax()
            order = group[np.argsort(entries[group, widest], kind="stable")]
            cut_at = -(-len(order) // 128) * 64
            halves += [order[:cut_at], order[cut_at:]] if len(group) > 64 else [group]
        groups = halves
    return [np.sort(g) for g in groups]


class MaskIndex:
    """Exact nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        self.words = _words_of(entries)
        bit = np.zeros((n, len(self.words)), np.uint64)
        for w, group in enumerate(self.words):
            bit[group, w] = np.uint64(1) << np.arange(len(group), dtype=np.uint64)
        self.order = [np.sort(entries[:, j]) for j in range(width)]
        self.before = []
        for j in range(width):
            masks = np.bitwise_or.accumulate(bit[np.argsort(entries[:, j], kind="stable")], axis=0)
            self.before.append(np.concatenate([np.zeros((1, len(self.words)), np.uint64), masks]))
        self.squares = (entries**2).sum(1)
        apart = self.squares[:, None] + self.squares - 2 * exact_product(entries, entries)
        np.fill_diagonal(apart, _FAR)
        near = apart.min(1) if n > 1 else np.zeros(1, np.int64)
        self.radius = int(np.ceil(np.sqrt(float(np.quantile(near, NEAR_SHARE)))))

    def box(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask words of the entries that differ from each row by at most its radius in every coordinate."""
        inside = np.full((len(rows), len(self.words)), ~np.uint64(0))
        for j, (order, before) in enumerate(zip(self.order, self.before, strict=True)):
            low = np.searchsorted(order, rows[:, j] - radius, "left")
            high = np.searchsorted(order, rows[:, j] + radius, "right")
            inside &= before[high] ^ before[low]
        return inside

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; the lower index of equal ones."""
        index, best = np.full(len(rows), len(self.entries)), np.full(len(rows), _FAR)
        squares = (rows**2).sum(1)
        todo, radius = np.arange(len(rows)), np.full(len(rows), self.radius)
        seen = np.zeros((len(rows), len(self.words)), np.uint64)
        while len(todo):
            masks = self.box(rows[todo], radius)
            new = masks & ~seen
            for w, group in enumerate(self.words):
                some = np.flatnonzero(new[:, w])
                at = todo[some]
                apart = squares[at, None] + self.squares[group] - 2 * exact_product(rows[at], self.entries[group])
                bits = np.unpackbits(new[some, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                apart[bits[:, :len(group)] == 0] = _FAR
                place = apart.argmin(1) if len(some) else np.zeros(0, np.int64)
                low, which = apart[np.arange(len(some)), place], group[place]
                better = (low < best[at]) | ((low == best[at]) & (which < index[at]))
                best[at[better]], index[at[better]] = low[better], which[better]
            open_ = best[todo] > radius**2
            todo, radius, seen = todo[open_], radius[open_], masks[open_]
            # The root of a whole number, rounded up: the larger box holds all that is as near as the best.
            radius = np.where(best[todo] < _FAR, np.ceil(np.sqrt(best[todo].astype(np.float64))).astype(np.int64) + 1, 2 * radius + 1)
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and place in the part; width is the number of components that are cut into parts."""

    entries: np.ndarray
    scale: float

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def indexes(self) -> list[MaskIndex]:
        return [MaskIndex(part) for part in self.entries]


def _parts(column: pa.Array, books: Codebooks) -> np.ndarray:
    """Parts of each vector, by part, vector and place."""
    rows = scaled(column, books.scale, books.width)
    return rows.reshape(len(rows), books.entries.shape[0], -1).transpose(1, 0, 2)


def _choices(books: Codebooks):
    """Counts and sums of the parts that chose each entry, as one state per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = books.indexes()
        total = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), np.int64)
        for batch in batches_of(batches, _BATCH):
            for index, sums, rows in zip(indexes, total, _parts(batch.column("v"), books), strict=True):
                chosen, _ = index.nearest(rows)
                sums[:, 0] += np.bincount(chosen, minlength=len(sums))
                np.add.at(sums[:, 1:], chosen, rows)
        piece = pyspark.TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([piece], pa.int64()), pa.array([total.tobytes()])], names=["key", "piece", "state"])

    return run


def _add(total: bytes | None, state: bytes) -> bytes:
    return state if total is None else (np.frombuffer(total, np.int64) + np.frombuffer(state, np.int64)).tobytes()


def train(vectors: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks of all vectors: at first the parts of the rows with the smallest keys, then means, round by round.

    Rows left out, clipping and shorter vectors are as in encode. Null keys come last, equal keys are ordered by their
    vectors. Fewer rows than entries give smaller codebooks; no row gives None.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(finite("v"))
    n, width = extent(rows, "v")
    if not n:
        return None
    width = -(-width // parts) * parts
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    whole = scaled(pa.array(first, pa.list_(pa.float64())), scale, width)
    books = Codebooks(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2), scale)
    for _ in range(rounds):
        states = folded(rows.select("v").mapInArrow(_choices(books), "key long, piece long, state binary"), "key", _add).collect()
        sums = np.frombuffer(states[0]["state"], np.int64).reshape(*books.entries.shape[:2], -1)
        means = sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1)
        books = Codebooks(np.where(sums[:, :, :1] > 0, means, books.entries), scale)
    return books


def _encoder(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = books.indexes()
        for batch in batches_of(batches, _BATCH):
            found = [index.nearest(rows) for index, rows in zip(indexes, _parts(batch.column("v"), books), strict=True)]
            codes = np.stack([chosen for chosen, _ in found], 1).astype(np.uint8)
            error = np.sum([far for _, far in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())],
                names=["id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks | None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code binary, error): a byte per part, and the squared distance to the entries they stand for.

    A component x counts as floor(scale * x), x as double, clipped where a squared distance would not fit a long. A
    shorter vector goes on with zeros, an empty one is all zeros; lengths that do not divide into the parts are filled
    up likewise. Rows whose vector is null or holds a null or a component that is not finite are left out. Repeated
    rows and null keys stay. A vector longer than the codebooks is an error. Other columns are not looked at.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    kept = rows.where(finite("v"))
    if books is None:
        return kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).toDF(key, label, "code", "error")
    return kept.mapInArrow(_encoder(books), schema).toDF(key, label, "code", "error")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the error summed over equal labels; null labels are equal."""
    coded = cut(coded)
    totals = cut(coded.groupBy(F.col(label).alias("of_label")).agg(F.sum("error").alias("label_error")))
    n, longest = totals.agg(F.count("*"), F.max(F.length(F.col("of_label").cast("string")))).first()
    if n <= LABELS_SENT and (longest or 0) <= LABEL_CHARS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col(label).eqNullSafe(F.col("of_label"))).drop("of_label")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row; an empty table gives no rows."""
    books = train(vectors)
    coded = with_label_error(encode(vectors, books))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def compress_sql(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rows of compress for DuckDB, every part against every entry; lengths that divide into the parts."""
    steps = []
    apart = "list_sum([(x.w[i] - c.w[i]) * (x.w[i] - c.w[i]) for i in range(1, len(x.w) + 1)])"
    for r in range(rounds + 1):
        steps.append(f"chosen{r} as materialized (select x.n, x.p, min({apart} * {entries} + c.e) best from piece x join book{r} c using (p) group by all)")
        if r < rounds:
            steps.append(f"""
sums{r} as (
  select x.p, a.best % {entries} e, i, cast(floor(sum(x.w[i]) / count(*)) as bigint) mean
  from piece x join chosen{r} a using (n, p), unnest(range(1, len(x.w) + 1)) t(i) group by all),
book{r + 1} as materialized (
  select c.p, c.e, coalesce(m.w, c.w) w
  from book{r} c left join (select p, e, list(mean order by i) w from sums{r} group by all) m using (p, e))""")
    return f"""
with whole as (
  select row_number() over (order by vec_id, embedding) n, vec_id, label, [cast(floor({scale} * cast(x as double)) as bigint) for x in embedding] v
  from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
piece as materialized (
  select n, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] w from whole, unnest(range({parts})) t(p)),
book0 as materialized (select p, n - 1 e, w from piece where n <= {entries}),
{",".join(steps)},
coded as (
  select n, string_agg(printf('%02x', best % {entries}), '' order by p) code, cast(sum(best // {entries}) as bigint) error
  from chosen{rounds} group by n)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
  (select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) from book{rounds}) codebooks_sha256
from coded join whole using (n)"""
