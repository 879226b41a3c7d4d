from __future__ import annotations

import random
import re

import pytest

from metalint.llm import near_dedup
from metalint.llm.components import connected

from .conftest import EXTRA, sentence

FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets, parent = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, *_) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def drifting(rng, n):
    """Near copies, each changed a little more than some earlier one, so links chain."""
    texts = [sentence(rng, 60).split()]
    while len(texts) < n:
        words = list(rng.choice(texts[-30:]))
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(words)
    return [" ".join(w) for w in texts]


def test_odd_rows(make_docs, odd_rows):
    out = near_dedup.near_groups(make_docs(odd_rows))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(out) == brute(odd_rows)
    kept = near_dedup.drop_near_copies(make_docs(odd_rows))
    assert set(EXTRA) < set(kept.columns)
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == len(set(left))
    # One row stays of each component, and every row without words.
    linked = {c for _, n, c in brute(odd_rows) if n}
    assert sorted(d for d, t in left if shingles(t)) == sorted(linked | {107, 107}) or len(left) == len(linked) + 1 + 4


def test_empty(make_docs):
    assert near_dedup.near_groups(make_docs([])).collect() == []
    assert near_dedup.drop_near_copies(make_docs([])).count() == 0


@pytest.mark.parametrize("limits", [{}, {"TINY": 3, "NODE": 8, "BLOCK": 4, "LEVELS": 3}])
def test_chains_and_copies(make_docs, monkeypatch, limits):
    """With tiny limits nodes branch, are cut into blocks and reach the last level."""
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(11)
    texts = drifting(rng, 120) + [sentence(rng, rng.randint(1, 90)) for _ in range(60)]
    passage = sentence(rng, 30)
    texts += [f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}" for _ in range(40)] + [texts[0]] * 80
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    assert result(near_dedup.near_groups(make_docs(rows))) == brute(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501)] + [(900, 900 + i) for i in range(1, 50)]
    got = {r["uid"]: r["label"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in (500, 501, 502)} == {500} and got[930] == 900
