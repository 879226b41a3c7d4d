"""Exact search and vector codes against brute force, on odd rows as well."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from metalint.llm import inner_search, vector_codes
from metalint.llm.vector_codes import MaskIndex

DIM = 12
CLASH = ["id", "v", "length", "pack", "slot", "rank", "score", "name", "n", "code", "error", "of_label", "label_error", "place"]


@pytest.fixture(scope="module")
def vector_rows():
    """Vectors of unlike lengths and few directions, ties, copies, odd components, short and empty ones, null keys."""
    rng = np.random.Generator(np.random.PCG64(5))
    spread = rng.normal(size=(600, DIM)) * (2.0 ** -np.arange(DIM)) * rng.gamma(1.5, size=(600, 1))
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(spread)]
    rows += [(1000 + i, spread[3].tolist(), None) for i in range(120)]  # a large group of copies
    rows += [(50, spread[50].tolist(), 1), (50, spread[51].tolist(), 1)]  # repeated keys
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * (DIM - 2), 1), (2002, [float("nan")] * DIM, None), (2003, [float("inf")] * DIM, 2)]
    rows += [(2004, [], 3), (2050, [2.5, -1.0], 3), (None, spread[0].tolist(), None), (2100, [1e300] * 3, 4), (2101, [0.0] * DIM, 4)]
    return rows


def frame(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
                          + [T.StructField(c, T.StringType()) for c in CLASH])
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema)


def kept(rows, scale, width):
    limit = int(2**30 / width**0.5)
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(min(max(np.floor(scale * x), -limit), limit)) for x in v]
            yield i, tuple(whole + [0] * (width - len(whole))), label


@pytest.mark.parametrize(("chunk", "pack"), [(16_384, 16_384), (32, 5)])
def test_search_is_exact(spark, vector_rows, monkeypatch, chunk, pack):
    monkeypatch.setattr(inner_search, "CHUNK", chunk)
    monkeypatch.setattr(inner_search, "PACK", pack)
    df = frame(spark, vector_rows)
    got = inner_search.top_inner(df.where("vec_id % 50 = 0"), df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [r for r in kept(vector_rows, 256, DIM) if r[0] is not None]
    want = []
    for q, v, _ in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w, _ in rows if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_of_few_rows(spark, vector_rows):
    alone = frame(spark, [vector_rows[0]])
    assert inner_search.top_inner(alone, alone).collect() == []
    assert inner_search.top_inner(alone, frame(spark, [])).collect() == []
    assert inner_search.top_inner(frame(spark, []), alone).collect() == []
    two = frame(spark, vector_rows[:2])
    assert [(r.query_id, r.rank, r.vec_id) for r in inner_search.top_inner(alone, two).collect()] == [(0, 1, 1)]


def brute_codes(rows, entries=256, rounds=4, parts=4):
    width = -(-DIM // parts) * parts
    whole = list(kept(rows, 1024, width))
    cut = [[v[p * width // parts:(p + 1) * width // parts] for p in range(parts)] for _, v, _ in whole]
    first = sorted(range(len(whole)), key=lambda n: (whole[n][0] is None, whole[n][0] or 0, [float(x) for x in whole[n][1]]))[:entries]
    books = [np.array([cut[n][p] for n in first], dtype=object) for p in range(parts)]
    for r in range(rounds + 1):
        found = []
        for p in range(parts):
            part = np.array([c[p] for c in cut], dtype=object)
            apart = np.array([((books[p] - row) ** 2).sum(1) for row in part])
            found.append((apart.argmin(1), apart.min(1)))
            if r < rounds:
                for e in range(len(books[p])):
                    own = part[found[-1][0] == e]
                    if len(own):
                        books[p][e] = [sum(c) // len(own) for c in own.T]
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    errors = [int(sum(f[1][n] for f in found)) for n in range(len(whole))]
    totals = {}
    for (_, _, label), e in zip(whole, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    return [(i, "".join(f"{f[0][n]:02x}" for f in found), errors[n], totals[label], digest) for n, (i, _, label) in enumerate(whole)]


def test_codes_are_exact(spark, vector_rows):
    got = vector_codes.compress(frame(spark, vector_rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_codes(vector_rows), key=str)


def test_codes_of_few_rows(spark, vector_rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS_SENT", 0)  # totals by a shuffle join
    assert vector_codes.compress(frame(spark, [])).collect() == []
    some = vector_rows[:5] + [(7, None, None), (8, vector_rows[0][1], None), (9, vector_rows[0][1], None)]
    assert sorted(map(tuple, vector_codes.compress(frame(spark, some)).collect())) == sorted(brute_codes(some))


def test_mask_index_takes_ties_and_far_rows():
    rng = np.random.Generator(np.random.PCG64(9))
    entries = rng.integers(-5, 6, (200, 3))
    rows = np.concatenate([rng.integers(-7, 8, (500, 3)), rng.integers(-(2**26), 2**26, (20, 3))])
    index, best = MaskIndex(entries).nearest(rows)
    apart = ((rows[:, None].astype(object) - entries) ** 2).sum(2)
    assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_box_leaves_far_entries_out():
    entries = np.arange(256)[:, None] * np.array([100, -100])
    index = MaskIndex(entries)
    inside = index.box(entries[[0, 128]], np.array([150, 150]))
    assert [sum(int(w).bit_count() for w in row) for row in inside] == [2, 3]
