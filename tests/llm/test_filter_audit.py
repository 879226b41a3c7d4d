"""The filter audit against brute force, with a sketch of any size."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metalint.llm import filter_audit
from metalint.llm.common import drop_folder, scratch_folder


@pytest.fixture(scope="module")
def audit_rows(odd_rows):
    """The odd rows, copies across parts, long texts, and texts that fail each filter on their own."""
    rng = random.Random(11)

    def words(n, distinct):
        return " ".join(f"w{rng.randrange(distinct)}" for _ in range(n))

    rows = list(odd_rows)
    rows += [(200 + i, words(250, 5000), f"s{i % 3}") for i in range(30)]
    rows += [(300 + i, words(220, 40), "s1") for i in range(5)] + [(310 + i, words(250, 9000) + " #1", "s2") for i in range(5)]
    rows += [(320 + i, words(250, 9000).upper(), "s0") for i in range(5)]
    copy = words(300, 9000)
    rows += [(400 + i, copy, f"s{i % 3}") for i in range(200)] + [(399, copy, "late"), (399, copy, "later"), (None, copy, "s1")]
    rows += [(700, "Été \U0001f600 " * 150, ""), (701, "A B\x0bC\x0cD", None), (702, "", "s2")]
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic", "n", "mask", "part")])
    rows = [(i, i % 2, i % 3 == 0, 1, 1, 1) for i in range(0, 720, 2)] + [(399, 1, None, 1, 1, 1), (399, 0, 1, 1, 1, 1), (None, 1, 1, 1, 1, 1), (9999, 1, 1, 1, 1, 1)]
    return spark.createDataFrame([tuple(None if x is None else int(x) for x in r) for r in rows], schema)


def brute(rows, labels):
    good, toxic = ({r.doc_id for r in labels.collect() if r[c] == 1} for c in ("quality", "toxic"))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    kept_by, out = Counter(), []
    failed = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        failed.append((source or "", {n for n, b in zip("ABCDE", bad, strict=True) if b}, i in good and i is not None, i in toxic and i is not None))
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[:step - 1])
                lost = [f for f in own if name in f[1] and not f[1] & before]
                kept_by[part, name] += len(lost)
                out.append((part, "".join(order), step, sum(not f[1] & {*before, name} for f in own), len(lost), sum(name in f[1] for f in own) - len(lost),
                            sum(f[1] == {name} for f in own), sum(f[2] for f in lost), sum(f[3] for f in lost)))
    return sorted((*r, kept_by[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("most_cells", [2**28, 2**9])
def test_audit(make_docs, labels, audit_rows, monkeypatch, most_cells):
    monkeypatch.setattr(filter_audit, "MOST_CELLS", most_cells)  # a sketch that is full sends all texts the exact way
    got = filter_audit.audit(make_docs(audit_rows).repartition(5), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(audit_rows, labels)


def test_empty_tables(make_docs, labels, audit_rows):
    assert filter_audit.audit(make_docs([]), labels).collect() == []
    some = audit_rows[:3]
    none = labels.where("false")
    assert sorted(map(tuple, filter_audit.audit(make_docs(some), none).collect())) == brute(some, none)


def test_sketch_clears_most_unique_texts_and_no_repeat(spark):
    rows = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 5000, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"), "id").repartition(40)
    folder = scratch_folder(spark, "sketch-test")
    maybe = {r.id for r in rows.where(filter_audit.possible_repeats(rows, 20_000, folder)).collect()}
    drop_folder(folder)
    assert set(range(5000)) <= maybe and len(maybe) < 5500
