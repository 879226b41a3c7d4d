"""Exact top-k search by inner product: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are scaled to whole numbers, so scores are exact. They are put in order of descending length, by a range
partitioning, and written as chunk files; queries are packed likewise. The axes are rotated to those of the singular
value decomposition of all vectors, so the first ones carry most of a product. For a query q and a vector v,

    q.v <= (sum over the first h rotated axes) + |rest of q| * |rest of v|

and the bound with h = 0 is |q| * |v|. What cannot reach the query's k-th best score so far is passed over by its
length, then by the bounds at STEPS of the axes; only what is left gets its exact product. Bounds carry a slack for the
rounding of floats, so they never lose a row.

A level takes four times as many chunks as all before it. Its work units, a chunk against a pack, are spread over the
cluster; each gives only rows above the query's floor, the k-th best of the earlier levels, so a level gives a few
rows per query. Units whose longest vector cannot reach any floor of their pack are not made; when none is left the
search ends. Files lie in the shared folder, so a repeated unit reads what the lost one read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalint.llm.common import cut, drop_folder, open_folder, scratch_folder, shuffle_width, write_whole
from metalint.llm.folding import folded
from metalint.llm.vectors import exact_product, extent, finite, scaled

SCALE, TOP = 256, 5
CHUNK, PACK = 16_384, 16_384
_ROWS, _ASKS = 4096, 1024
STEPS = (3 / 8, 3 / 4)
#: Share of a block's pairs from which whole products are cheaper than single ones.
_DENSE = 0.1
_NONE = -(2**63)
_RESULT = "query_id long, rank int, vec_id long, score long"


def _moments(scale: float, width: int):
    """The second moments of a task's vectors, as one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = scaled(batch.column("v"), scale, width).astype(np.float64)
            total += rows.T @ rows
        piece = pyspark.TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([piece], pa.int64()), pa.array([total.tobytes()])], names=["key", "piece", "state"])

    return run


def _add(total: bytes | None, state: bytes) -> bytes:
    return state if total is None else (np.frombuffer(total) + np.frombuffer(state)).tobytes()


def rotation(vectors: DataFrame, scale: float, width: int) -> np.ndarray:
    """Columns are the right singular vectors of all vectors, the largest singular value first. width x width numbers."""
    states = folded(vectors.select("v").mapInArrow(_moments(scale, width), "key long, piece long, state binary"), "key", _add).collect()
    moments = np.frombuffer(states[0]["state"]).reshape(width, width) if states else np.eye(width)
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def _file_writer(folder: str, kind: str, size: int, scale: float, width: int):
    """Files of up to size vectors each in the order of the task's rows; (name, n, longest) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, made, ids, rows = pyspark.TaskContext.get().partitionId(), [], [], []

        def close(last: bool) -> None:
            nonlocal ids, rows
            all_ids, whole = np.concatenate(ids), np.concatenate(rows)
            at = 0
            while at < len(all_ids) and (last or len(all_ids) - at >= size):
                part = whole[at:at + size]
                small = part.astype(np.int16 if np.abs(part).max(initial=0) < 2**15 else np.int32)
                np.savez(out := io.BytesIO(), ids=all_ids[at:at + size], rows=small)
                name = f"{kind}-{piece:07d}-{len(made):04d}"
                write_whole(folder, name, out.getvalue())
                made.append((name, len(part), float(np.linalg.norm(part.astype(float), axis=1).max())))
                at += size
            ids, rows = [all_ids[at:]], [whole[at:]]

        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            rows.append(scaled(batch.column("v"), scale, width).astype(np.int32))
            if sum(map(len, ids)) >= size:
                close(False)
        if sum(map(len, ids)):
            close(True)
        names, counts, longest = zip(*made, strict=True) if made else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(longest, pa.float64())], names=["name", "n", "longest"])

    return run


def _written(rows: DataFrame, folder: str, kind: str, size: int, n: int, scale: float, width: int) -> DataFrame:
    """(name, n, longest, place): files of rows (id, v) by descending length; place counts them from 0.

    The number of files follows from the number of rows, whatever the number of partitions.
    """
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2)))
    pieces = max(1, -(-n // size))
    order = [F.col("length").desc(), F.col("id")]
    placed = rows.withColumn("length", length).repartitionByRange(pieces, *order).coalesce(pieces).sortWithinPartitions(*order)
    files = cut(placed.select("id", "v").mapInArrow(_file_writer(folder, kind, size, scale, width), "name string, n long, longest double"))
    # One row per file of some 2 MB: no more rows than a listing of the folder has.
    return cut(files.withColumn("place", F.row_number().over(Window.orderBy(F.col("longest").desc(), "name")) - 1))


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{name}") as file:
        return dict(np.load(io.BytesIO(file.read())))


class _Side:
    """The vectors of a file: whole numbers, lengths, and for each step the rotated head with what bounds the rest."""

    def __init__(self, folder: str, name: str, turn: np.ndarray, asking: bool):
        stored = _load(folder, name)
        self.ids, self.rows = stored["ids"], stored["rows"]
        turned = self.rows.astype(np.float64) @ turn
        self.length = np.sqrt((turned**2).sum(1))
        width = turn.shape[0]
        slack = 1e-6 * (width + 8)
        self.heads = []
        for step in STEPS:
            h = max(1, min(width, round(step * width)))
            rest = np.sqrt(np.maximum((turned[:, h:] ** 2).sum(1), 0))
            ends = np.stack([rest, self.length * (slack if asking else 1)], 1)
            self.heads.append(np.concatenate([turned[:, :h], ends], 1).astype(np.float32))


def _best(ask: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query: highest score, then smallest id; by query and rank."""
    order = np.lexsort((ids, -score, ask))
    sorted_ask = ask[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_ask, sorted_ask) < k]


def _pairs(asks: _Side, lo: int, hi: int, side: _Side, a: int, b: int, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of what may be among the k best in a block; queries and vectors as places in their files."""
    asked, seen = np.arange(lo, hi), np.arange(a, b)
    asked = asked[asks.length[lo:hi] * side.length[a:b].max() * (1 + 1e-9) >= floor]
    live = np.ones((len(asked), len(seen)), bool)
    for ask_head, head in zip(asks.heads, side.heads, strict=True):
        if not asked.size or not seen.size:
            break
        limit = floor[asked - lo].astype(np.float32)
        live = ask_head[asked] @ head[seen].T >= np.nextafter(limit, np.float32(-np.inf))[:, None]
        rows, columns = live.any(1), live.any(0)
        asked, seen, live = asked[rows], seen[columns], live[rows][:, columns]
    if not live.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if live.mean() < _DENSE:
        r, c = np.nonzero(live)
        r, c = asked[r], seen[c]
        x, y = asks.rows[r], side.rows[c]
        exact = np.abs(asks.rows).max(initial=0) * float(np.abs(side.rows).max(initial=0)) * asks.rows.shape[1] < 2**53
        kind = np.float64 if exact else np.int64
        return r, c, np.einsum("ij,ij->i", x.astype(kind), y.astype(kind)).astype(np.int64)
    score = exact_product(asks.rows[asked], side.rows[seen])
    own = np.argsort(side.ids[seen], kind="stable")
    left, right = (np.searchsorted(side.ids[seen][own], asks.ids[asked], how) for how in ("left", "right"))
    for i in np.flatnonzero(right > left):
        score[i, own[left[i]:right[i]]] = _NONE
    # The k-th highest of the block is a floor of its own; a query that has fewer keeps all.
    least = np.partition(score, max(len(seen) - k, 0), axis=1)[:, max(len(seen) - k, 0)]
    r, c = np.nonzero(score >= np.maximum(floor[asked - lo], least)[:, None])
    return asked[r], seen[c], score[r, c]


def _searcher(folder: str, floors: str | None, turn: np.ndarray, k: int):
    """Rows (pack, slot, query_id, vec_id, score) of the units (chunk, pack) that beat the queries' floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[str, _Side]] = {}

        def side(kind: str, name: str) -> _Side:
            if held.get(kind, ("",))[0] != name:
                held[kind] = (name, _Side(folder, name, turn, kind == "pack"))
            return held[kind][1]

        for batch in batches:
            for chunk_name, pack_name in zip(batch.column("chunk").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                chunk, asks = side("chunk", chunk_name), side("pack", pack_name)
                n = len(asks.ids)
                floor = _load(floors, pack_name) if floors else {"score": np.full(n, _NONE), "id": np.full(n, 2**63 - 1)}
                for lo in range(0, n, _ASKS):
                    hi = min(n, lo + _ASKS)
                    score, ident = floor["score"][lo:hi].copy(), floor["id"][lo:hi].copy()
                    got = [np.zeros(0, np.int64)] * 3  # query, id, score
                    for a in range(0, len(chunk.ids), _ROWS):
                        b = min(len(chunk.ids), a + _ROWS)
                        q, v, s = _pairs(asks, lo, hi, chunk, a, b, score, k)
                        ids = chunk.ids[v]
                        keep = (ids != asks.ids[q]) & ((s > score[q - lo]) | ((s == score[q - lo]) & (ids < ident[q - lo])))
                        if not keep.any():
                            continue
                        got = [np.concatenate(x) for x in zip(got, (q[keep], ids[keep], s[keep]), strict=True)]
                        first = _best(got[0], got[2], got[1], k)
                        got = [x[first] for x in got]
                        full = np.flatnonzero(np.bincount(got[0] - lo, minlength=hi - lo) == k)
                        last = np.searchsorted(got[0], full + lo, "right") - 1
                        score[full], ident[full] = got[2][last], got[1][last]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pack_name] * len(got[0]), pa.string()), *(pa.array(x, pa.int64()) for x in (got[0], asks.ids[got[0]], got[1], got[2]))],
                        names=["pack", "slot", "query_id", "vec_id", "score"])

    return run


def _floor_writer(floors: str, k: int):
    """Writes the k-th best (score, id) of each query of a pack; (pack, need): the least of these scores."""

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, score, ident = keys[0].as_py(), None, None
        for batch in batches:
            if score is None:
                n = batch.column("n")[0].as_py()
                score, ident = np.full(n, _NONE), np.full(n, 2**63 - 1)
            at = batch.filter(pc.equal(batch.column("rank"), k))
            slot = at.column("slot").to_numpy()
            score[slot], ident[slot] = at.column("score").to_numpy(), at.column("vec_id").to_numpy()
        np.savez(out := io.BytesIO(), score=score, id=ident)
        write_whole(floors, name, out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(score.min())], pa.int64())], names=["pack", "need"])

    return run


def top_inner(queries: DataFrame, vectors: DataFrame, k: int = TOP, scale: float = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the highest inner products, for every row of queries.

    A component x counts as floor(scale * x), x as double; beyond 2**30 over the root of the number of components it is
    clipped. A shorter vector goes on with zeros, an empty one is all zeros. Rows whose key or vector is null, or whose
    vector holds a null or a component that is not finite, take no part on either side. A query's own rows, all that
    have its key, are not among its results. Equal scores go to the smaller key; repeated rows of vectors count each,
    and a repeated query is answered as often. Fewer than k other rows give them all; no queries or no vectors give no
    rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    asking, rows = (d.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & finite("v")) for d in (queries, vectors))
    n_asking, asked_width = extent(asking, "v")
    n, width = extent(rows, "v")
    if not n or not n_asking:
        return spark.createDataFrame([], _RESULT)
    width = max(width, asked_width)
    turn = rotation(rows, scale, width)
    folder = scratch_folder(spark, "inner-search")
    chunks = _written(rows, folder, "chunk", CHUNK, n, scale, width)
    packs = _written(asking, folder, "pack", PACK, n_asking, scale, width)
    total, n_packs = chunks.count(), packs.count()
    best, floors, needs, start, end = None, None, None, 0, 1
    while start < total:
        level = chunks.where(F.col("place").between(start, end - 1)).select(F.col("name").alias("chunk"), "longest")
        # Every chunk meets every pack: the list of units is what the query set asks for.
        units = level.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1)))).join(packs.select("place", F.col("name").alias("pack")), "place").drop("place")
        if needs is not None:
            units = units.join(needs, "pack").where(F.col("longest") * F.col("reach") >= F.col("need"))
        units = cut(units.select("chunk", "pack"))
        n_units = units.count()
        if best is not None and not n_units:
            break
        wide = max(1, min(n_units, max(shuffle_width(spark), n_units // 8)))
        found = units.repartitionByRange(wide, "chunk", "pack").mapInArrow(
            _searcher(folder, floors, turn, k), "pack string, slot long, query_id long, vec_id long, score long")
        ranked = Window.partitionBy("pack", "slot").orderBy(F.col("score").desc(), "vec_id")
        both = found if best is None else best.drop("rank").unionByName(found)
        best = cut(both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        start, end = end, min(total, 4 * end)
        if start < total:
            floors = f"{folder}/floors-{start}"
            of_pack = packs.select(F.col("name").alias("pack"), "n").join(best.drop("query_id"), "pack", "left")
            reach = packs.select(F.col("name").alias("pack"), (F.col("longest") * (1 + 1e-9)).alias("reach"))
            needs = cut(of_pack.groupBy("pack").applyInArrow(_floor_writer(floors, k), "pack string, need long").join(reach, "pack"))
    drop_folder(folder)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_sql(k: int = TOP, scale: int = SCALE, every: int = 50) -> str:
    """The rows of op11 for DuckDB: every query against all rows."""
    return f"""
with whole as (
  select vec_id, [cast(floor({scale} * cast(x as double)) as bigint) for x in embedding] v
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id query_id, c.vec_id,
    cast(coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0) as bigint) score
  from whole q join whole c on q.vec_id % {every} = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k}"""
