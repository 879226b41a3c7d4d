from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from oracle import DATA, compare, connect

from metalint.llm import byte_shards, decontaminate, mixing, url_trust
from metalint.llm.queries import ORACLES, QUERIES
from metalint.plans import catalogue

from .conftest import EXTRA, sentence
from .test_near_dedup import FOLD


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, monkeypatch, name):
    monkeypatch.setattr(catalogue, "QUERIES", QUERIES)
    monkeypatch.setattr(catalogue, "ORACLES", ORACLES)
    result = compare(spark, name, "0.001", connect("0.001"))
    assert result["ok"], result


def test_shards_balance(make_docs, odd_rows):
    rows = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["law"], r["grown_shard"])
                   for r in byte_shards.shard_plan(make_docs(odd_rows)).collect()), key=lambda r: (r[3], r[4]))
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in odd_rows)
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in rows) == want
    ids = [-1 if r[0] is None else r[0] for r in rows]
    assert ids == sorted(ids) and {r[5:] for r in rows} == {("bytes", None)}
    total, before = sum(r[1] for r in rows), 0
    slots = Counter()
    for r in rows:
        assert r[3] == before * 8 // total and r[4] == slots[r[3]]
        slots[r[3]] += 1
        before += r[1]
    assert byte_shards.shard_plan(make_docs([])).collect() == []


def brute_windows(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = [word.findall((t or "").translate(FOLD)) for t in docs]
    windows = {}
    for item, text in items:
        words = word.findall((text or "").translate(FOLD))
        m = min(10, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i:i + m]), set()).add(item)
    out = []
    for words in split:
        hit, found = set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(words) - m + 1):
                if tuple(words[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(words[i:i + m])]
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((len(words), len(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def leaked(odd_rows):
    rng = random.Random(9)
    items = [(i, sentence(rng, 25)) for i in range(12)] + [(50, "Short Item"), (51, None), (52, "..."), (None, sentence(rng, 14)), (3, sentence(rng, 12))]
    rows = list(odd_rows)
    for i in range(30):
        item = items[i % 12][1].split()
        rows.append((200 + i, f"{sentence(rng, 20)}\n{' -- '.join(item[i % 8:i % 8 + 6 + i % 12]).upper()}, {sentence(rng, 20)}", "s1"))
    rows += [(300, "a short item! here short item", "s2"), (300, "a short item! here short item", "s2"), (301, f"{items[4][1]} {items[4][1]}", "s0"), (302, items[15][1], "s0")]
    return rows, items


def test_contamination(spark, make_docs, leaked):
    rows, items = leaked
    benchmark = spark.createDataFrame([(i, t, 1, "y") for i, t in items], "item_id long, text string, m int, doc_id string")
    got = [tuple(r) for r in decontaminate.contamination(make_docs(rows), benchmark).collect()]
    want = [(d, *b) for (d, *_), b in zip(rows, brute_windows([t for _, t, _ in rows], items), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(make_docs([]), benchmark).collect() == []
    none = decontaminate.contamination(make_docs(rows), benchmark.where("1 = 0")).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)


def test_capital_sigma_hashes_alike(spark, make_docs):
    """Lower-casing picks a sigma by what surrounds the word, hashing must not."""
    rest = " ".join(f"w{i}" for i in range(7))
    benchmark = spark.createDataFrame([(1, f"ΟΔΟΣ.ΑΒ ΛΟΓΟΣ {rest}"), (2, f"λογος ΝΟΜΟΣ: ΑΒ {rest}")], "item_id long, text string")
    rows = [(1, f"ΟΔΟΣ ΑΒ ΛΟΓΟΣ {rest}", "s"), (2, f"λογος ΝΟΜΟΣ ΑΒ {rest}", "s"), (3, f"λογοσ ΝΟΜΟΣ ΑΒ {rest}", "s")]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(make_docs(rows), benchmark).collect()}
    assert got == {1: (10, 1), 2: (10, 1), 3: (0, 0)}


def test_removal(spark, make_docs, leaked):
    rows, items = leaked
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = brute_windows([t for _, t, _ in rows], items)
    clean = decontaminate.clean_documents(make_docs(rows), benchmark)
    assert set(EXTRA) < set(clean.columns)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((d, t) for (d, t, _), h in zip(rows, hits, strict=True) if not h[4])
    cut = Counter((r["doc_id"], r["text"]) for r in decontaminate.clean_documents(make_docs(rows), benchmark, remove="spans").collect())
    assert cut[(300, "a here ")] == 2 and cut[(302, "")] == 1
    for (d, t, _), h in zip(rows, hits, strict=True):
        if not h[4]:
            assert cut[(d, t)]
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    assert sum(len(words.findall(t or "")) * n for (_, t), n in cut.items()) == sum(h[0] - h[1] for h in hits)


def test_join_without_broadcast(spark, make_docs, leaked, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    rows, items = leaked
    got = decontaminate.contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sum(r["n_hit"] for r in got.collect()) == sum(h[1] for h in brute_windows([t for _, t, _ in rows], items))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    open_ = set(names)
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]} if w else set()
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over


def test_mix(make_docs, odd_rows):
    rng = random.Random(4)
    rows = odd_rows + [(1000 + i, sentence(rng, rng.randint(0, 60)), "big" if i % 3 else "small" if i % 30 else "tiny") for i in range(600)]
    plan = mixing.mix_plan(make_docs(rows)).collect()
    sizes, taken = Counter(), Counter()
    by_id = {d: s for d, _, s in rows}
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(plan) == len(rows)
    for r in plan:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            s = by_id[r["doc_id"]]
            taken[s] += r["taken"]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    for s in ("big", "small", "tiny"):
        assert abs(taken[s] - want[s]) <= 3 * 60
    mixed = mixing.mixed_documents(make_docs(rows))
    assert set(EXTRA) < set(mixed.columns)
    copies = Counter()
    for r in plan:
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.mix_plan(make_docs([])).collect() == [] and mixing.mixed_documents(make_docs([])).count() == 0


def test_trust_follows_links(spark):
    page = '<p><a class="x" href="{}">to</a></p>'
    rows = [(1, "http://good.org/a", page.format("https://Friend.net/x")), (2, "https://friend.net/", page.format("http://far.net")),
            (3, "http://farm.net/1", page.format("http://sub.com/de/") * 3), (4, "http://sub.com/de/x?y#z", "<a href='/local'>"), (5, "http://sub.com/es/", None),
            (6, None, None), (7, "no scheme", "x"), (8, "HTTP://EXAMPLE.ORG/es/?q", "x"), (9, "http://a.example.org/en/12", ""), (9, "http://a.example.org/en/12", "")]
    pages = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "page_id long, url string, html string, host string, score double")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_trust.url_verdicts(pages).collect()}
    assert got == {
        (1, "good.org", "/a", "org/", "allow"), (2, "friend.net", "/", None, "allow"), (3, "farm.net", "/1", None, "block"),
        (4, "sub.com", "/de/x", "com/de/", "block"), (5, "sub.com", "/es/", None, "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "example.org", "/es/", "example.org/es/", "block"), (9, "a.example.org", "/en/12", "example.org/en/1", "block")}
    assert url_trust.url_verdicts(pages).count() == 10 and url_trust.url_verdicts(pages.where("1 = 0")).collect() == []
