from __future__ import annotations

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA

from metalint.llm import licenses, quality, suffix_tree
from metalint.llm.common import documents, table

from .conftest import EXTRA, sentence
from .test_near_dedup import FOLD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_quality_counts(make_docs, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(500, "a b c a b c a b c", "s"), (501, "x\ny\nx\n \n \nx y\tz\x0b**|\nx", "s"), (502, "日本 語é ß" * 30, "s"), (503, "same line\n" * 40, "s")]
    rows += [(510 + i, "\n".join(rng.choice(["one two", "three", "", "#$ four"]) for _ in range(30)), "s") for i in range(20)]
    out = quality.score(make_docs(rows), None).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"], r["kept"]) for r in out), key=str)
    want = []
    for d, t, _ in rows:
        c = brute_counts(t)
        bad = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((d, *c, bad, not bad))
    assert got == sorted(want, key=str)
    good = quality.good_documents(make_docs(rows), None)
    assert set(EXTRA) < set(good.columns) and good.count() == sum(w[-1] for w in want)
    assert quality.score(make_docs([]), None).collect() == [] and quality.good_documents(make_docs([]), None).count() == 0


def test_quality_on_rows_not_fitted(spark):
    """Fitted on the even ids, held against the labels of the odd ones."""
    docs, labels = documents(spark, f"{DATA}/sf0.1"), table(spark, f"{DATA}/sf0.1", "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("n_words >= 50").collect()
    right = [(r["p_quality"] >= 0.5) == (r["quality"] == 1) for r in rows]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]) > 0.98


def test_quality_labels(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1, "t"), (2, None, "t"), (None, 0, "t"), (1, 0, "t")], "doc_id long, quality int, text string")
    assert quality.train(make_docs(odd_rows), labels) is None and quality.train(make_docs([]), labels) is None


@pytest.fixture(scope="module")
def chained():
    """Texts in which some words nearly always follow others."""
    rng = random.Random(8)
    follow = {w: rng.choice("abcdefghijkl") for w in "abcdefghijkl"}
    rows = []
    for i in range(400):
        words = [rng.choice("abcdefghijkl")]
        while len(words) < 60:
            words.append(follow.get(words[-1], "a") if rng.random() < 0.8 else rng.choice("abcdefghijkl") if rng.random() < 0.9 else sentence(rng, 1))
        rows.append((i, " ".join(words), "s"))
    return rows


def test_suffix_tree_scores(make_docs, odd_rows, chained):
    rows = odd_rows + chained
    out = suffix_tree.score(make_docs(rows)).collect()
    split = {(d, t): WORD.findall((t or "").translate(FOLD)) + [None] for d, t, _ in rows}
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, *_ in rows}
    counts = Counter(w for d, t, _ in rows if not held[d] for w in split[d, t])
    total, distinct = sum(counts.values()), len(counts)
    base = {w: math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for ws in split.values() for w in ws}
    want = Counter((d, held[d], len(split[d, t]), sum(counts[w] > 0 for w in split[d, t]), total, round(sum(base[w] for w in split[d, t]), 6)) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    mine = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100 and r["n_tokens"] == 61]
    assert mine and sum(r["score"] for r in mine) > sum(r["base_score"] for r in mine) + 0.3 * 61 * len(mine)
    assert suffix_tree.score(make_docs([])).collect() == []


def brute_scores(rows):
    """score of each row by a tree kept in dictionaries, contexts as strings with the nearest word last."""
    texts = [(zlib.crc32(b"" if d is None else str(d).encode()) % 10 > 0, [*WORD.findall((t or "").translate(FOLD)), None]) for d, t, _ in rows]
    counts = Counter(w for train, ws in texts if train for w in ws)
    total = sum(counts.values()) + 0.1 * (len(counts) + 1)
    base = lambda w: (counts[w] + 0.1) / total
    many = {w for w in counts if counts[w] >= 2}
    other = 1 - sum(map(base, many))
    name = lambda w: w if w in many else "?"
    after = {}
    for train, ws in texts:
        padded = [name(None)] * suffix_tree.DEPTH + [name(w) for w in ws]
        for i in range(suffix_tree.DEPTH, len(padded) if train else 0):
            for k in range(1, suffix_tree.DEPTH + 1):
                after.setdefault(tuple(padded[i - k:i]), Counter())[padded[i]] += 1
    states = {(): ({}, 0.0)}

    def probability(context, w):
        while True:
            if context not in states:
                context = context[1:]
            elif not context:
                return other if w == "?" else base(w)
            elif w in states[context][0]:
                return states[context][0][w]
            else:
                return states[context][1] * probability(context[1:], w)

    for context in sorted(after, key=len):
        p = {w: (n - 0.5) / sum(after[context].values()) for w, n in after[context].items() if n >= 2}
        if p and context[1:] in states:
            q = {w: probability(context[1:], w) for w in p}
            rest, rest_q = (1 - min(sum(x.values()), 1 - 1e-12) for x in (p, q))
            if sum(p[w] * math.log(p[w] / q[w]) for w in p) + rest * math.log(rest / rest_q) >= suffix_tree.DIVERGENCE:
                states[context] = p, rest / rest_q
    out = []
    for _, ws in texts:
        padded = [name(None)] * suffix_tree.DEPTH + [name(w) for w in ws]
        out.append(sum(
            math.log10(probability(tuple(padded[i:i + suffix_tree.DEPTH]), name(w)) * (base(w) / other if name(w) == "?" else 1)) for i, w in enumerate(ws)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2])
def test_suffix_tree_with_few_texts_to_learn_from(make_docs, n):
    """With one text the end is no symbol: it has the one of all other words, also before a text."""
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10][:n] + [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, f"a b c a b c x{i} y z{i} a b c q r x{i} s t a", "s") for i in ids]
    got = sorted((r["doc_id"], round(r["score"], 5)) for r in suffix_tree.score(make_docs(rows)).collect())
    assert np.allclose([x for _, x in got], [x for _, x in sorted(zip([i for i, *_ in rows], brute_scores(rows), strict=True))], atol=2e-5)


def test_suffix_tree_sends_packed_keys():
    """A chunk sends its next symbols as one row for each range of keys, some 6 bytes each, and gets an answer of a byte or two."""
    rng = random.Random(3)
    keys = np.unique(np.array([rng.randrange(2**64) for _ in range(100_000)], np.uint64))
    rows = list(suffix_tree._sent(5, 4, keys, n=np.ones(len(keys), np.int64)))
    assert len(rows) == 4 and sum(b.nbytes for b in rows) < 7 * len(keys)
    group = pa.Table.from_batches([rows[1], rows[1].set_column(1, "chunk", pa.array([6], "int64"))])
    answer = suffix_tree._count(group)
    assert answer.column("data").nbytes < 2 * group.column("size").to_numpy().sum()
    first, second = (suffix_tree._unpack(r["data"], r["size"], np.int64) for r in answer.to_pylist())
    assert (abs(first) == 2).all() and (first == -second).all()


def test_suffix_tree_against_brute_force(make_docs, odd_rows, chained, monkeypatch):
    """Few and many chunks; a passage of rare words that a share of all tokens would leave out is learnt."""
    rng = random.Random(12)
    passage = sentence(rng, 12)
    rows = odd_rows + chained + [(2000 + i, f"{sentence(rng, 300)} {passage} {sentence(rng, 300)}", "s") for i in range(30)]
    want = sorted((str(d), len(WORD.findall(t or "")), round(x, 5)) for (d, t, _), x in zip(rows, brute_scores(rows), strict=True))
    for size in (24_000_000, 20_000):
        monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", size)
        got = sorted((str(r["doc_id"]), r["n_tokens"] - 1, round(r["score"], 5)) for r in suffix_tree.score(make_docs(rows)).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-5)


def test_distributions_sum_to_one():
    """Next-symbol probabilities in a hand-made tree of depth two, over all symbols."""
    root = np.array([0.2, 0.5, 0.3])
    words = np.array([10, 20], np.uint64)
    tree = suffix_tree.Tree(words, 0.2, 100, 3)
    strings = np.array([[1], [2]])
    keys = suffix_tree._keys_of_strings(strings)[-1]
    order = np.argsort(keys)
    suffix_tree._grow(tree, keys[order], np.zeros(2, np.uint64), np.array([[0, 0, 1], [1, 2, 0], [30, 10, 25]]), np.array([50, 40]), root)
    assert len(tree.states[0]) == 2
    deeper = suffix_tree._keys_of_strings(np.array([[1, 2]]))
    suffix_tree._grow(tree, deeper[1], deeper[0], np.array([[0], [2], [20]]), np.array([21]), root)
    for before in ([10], [20], [20, 10], [10, 20], [99, 10]):
        total = 0.0
        for nxt, base in zip((99, 10, 20), root, strict=True):
            tokens = np.array([*before, nxt, int(suffix_tree.END)], np.uint64)
            bounds = np.array([0, len(tokens)])
            logs = suffix_tree.log_probabilities(tree, tokens, bounds, np.log(np.full(len(tokens), base)))
            total += math.exp(logs[len(before)])
        assert abs(total - 1) < 1e-9


def test_licences(make_docs, odd_rows):
    rng = random.Random(6)
    rows = list(odd_rows)
    for i, family in enumerate(licenses.FAMILIES):
        rows.append((600 + i, f"{sentence(rng, 40)}\n{sentence(rng, 3)} {licenses.TEMPLATES[family][0].upper()} {sentence(rng, 4)}\n{sentence(rng, 30)}", "s"))
        rows.append((700 + i, sentence(rng, 300) + " " + licenses.TEMPLATES[family][0] + " " + sentence(rng, 10), "s"))
    rows += [(800, "The license of the driver was apache country software general", "s"), (801, "Released under the\n\nMIT License.", "s")]
    docs = make_docs(rows)
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.train(docs)).collect()}
    right = [got[600 + i]["family"] == f for i, f in enumerate(licenses.FAMILIES)]
    assert np.mean(right) > 0.9
    for d, t, _ in rows:
        if d is not None and (d < 600 or d >= 800) and d != 107 and d != 104:
            assert got[d]["family"] is None and got[d]["n_licensed"] == 0
            if d != 108:
                assert got[d]["n_paragraphs"] == sum(bool(re.search(r"[A-Za-z0-9\x80-\U0010ffff]", x)) for x in (t or "").split("\n"))
    empty = make_docs([])
    assert licenses.scan(empty, licenses.train(empty)).collect() == []


def found_families(make_docs, texts):
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    rng = random.Random(2)
    model = licenses.train(make_docs([(i, sentence(rng, 60), "s") for i in range(200)]))
    return {r["doc_id"]: (r["n_paragraphs"], r["n_licensed"], r["families"]) for r in licenses.scan(docs, model).collect()}


def test_licences_inside_long_lines(make_docs):
    """Every template after, before and between many words of one line; two notices in a line; equal ones count once."""
    rng = random.Random(9)
    want, texts = [], []
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            for before, after in ((300, 10), (0, 250), (1000, 1000)):
                texts.append(f"{sentence(rng, before)} {template} {sentence(rng, after)}")
                want.append((1, 1, [family]))
    texts.append(f"{sentence(rng, 100)} Licensed under the MIT license. Licensed under the Apache License, Version 2.0. {sentence(rng, 100)}")
    want.append((1, 2, ["apache", "mit"]))
    texts.append(f"{sentence(rng, 100)} Licensed under the MIT license. {sentence(rng, 100)} Licensed under the MIT license.")
    want.append((1, 1, ["mit"]))
    texts.append(sentence(rng, 2000))
    want.append((1, 0, []))
    got = found_families(make_docs, texts)
    assert [(texts[i][-200:], got[i]) for i in range(len(texts)) if got[i] != want[i]] == []


def test_wrapped_licences(make_docs):
    """Every template wrapped at several widths, plain and behind comment marks, with text around it; blank lines part paragraphs."""
    rng = random.Random(10)
    want, texts = [], []
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            for width in (20, 45, 72):
                for mark in ("", "# ", " * ", "// "):
                    lines = [sentence(rng, 8), *textwrap.wrap(template, width), sentence(rng, 8)]
                    texts.append(f"{sentence(rng, 30)}\n{mark.rstrip()}\n" + rng.choice(["\n", "\r\n"]).join(mark + x for x in lines))
                    want.append((2, 1, [family]))
    texts += ["This library is free software; you can redistribute it\n\nand/or modify it under the terms of the GNU\n \t\nLesser General Public License.", "one\ntwo\n*\nthree"]
    want += [(3, 0, []), (2, 0, [])]
    got = found_families(make_docs, texts)
    assert [(texts[i][-200:], got[i]) for i in range(len(texts)) if got[i] != want[i]] == []


def test_licence_model_on_held_out_variants():
    texts, classes = licenses._variants(seed=77)
    rng = random.Random(5)
    known, _ = licenses._variants()
    unknown = [sentence(rng, rng.randint(3, 40)) for _ in range(400)]
    words, owner, _, n = licenses._paragraphs(pa.array([*known, *unknown]))
    weights, bias = licenses._fit(words, owner, np.array([*licenses._variants()[1], *[licenses.UNKNOWN] * 400]))
    words, owner, _, n = licenses._paragraphs(pa.array(texts))
    best = licenses._scores(weights, bias, words, owner, n).argmax(axis=1)
    assert np.mean(best == np.array(classes)) > 0.95
