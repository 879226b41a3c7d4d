"""Quality rules: plain counts of a text, and a logistic regression on hashed word and character n-grams.

The regression is fitted on at most ``LABELLED`` rows of each class of the labelled table (a hashed sample,
so any run takes the same), three quarters of them for the weights and one quarter for the calibration
(Platt scaling, weighted to the class shares of all labelled rows). A text's features are the shares of its words,
word pairs and character triples in ``BUCKETS`` hash buckets each, so its score is three averages of weights: whole
texts are scored batch by batch without building a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import fresh, hashed_sample
from metalint.llm.wordhash import _SPACE, batches_of, hash_spans, mix, sums_between, text_bytes, word_spans

BUCKETS = 1 << 17
LABELLED = 1500
KEEP_FROM = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50
ROUNDS = 150

_GROUPS = 3
_SCALE = 100.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Model:
    """Weights by bucket, one row for each kind of feature, and the calibrated slope and offset."""

    weights: np.ndarray
    slope: float
    offset: float


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, if its owner has it more than once, and if it isn't the first of these."""
    both = mix(keys + owner.astype(np.uint64) * _MUL[1])
    _, first, group, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return count[group] > 1, later


def text_counts(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    texts = len(offsets) - 1
    in_word = ~_SPACE[raw]
    n_words = np.diff(bounds)
    starts, ends, line_bounds = word_spans(raw, offsets, _NEWLINE)
    filled = np.concatenate([[0], np.cumsum(in_word)])
    has_word = filled[ends] > filled[starts]
    line_owner = np.repeat(np.arange(texts), np.diff(line_bounds))[has_word]
    _, later = _repeats(hash_spans(raw, starts, ends)[has_word], line_owner)

    owner = np.repeat(np.arange(texts), n_words)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    several, _ = _repeats(words[at] * _MUL[0] + words[at + 1] * _MUL[1] + words[at + 2] * _MUL[2], owner[at])
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[at[several] + k] = True
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": sums_between(in_word & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": sums_between(_SYMBOL[raw], offsets),
        "n_dup_lines": np.bincount(line_owner[later], minlength=texts).astype(np.int64),
        "n_repeat_words": sums_between(marked, bounds),
    }


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - 17)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every word, word pair and character triple in text order, each with the bounds of the texts."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[1:] == owner[:-1])
    pair_bounds = np.searchsorted(at, bounds)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    char_bounds = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    triples = chars * _MUL[0]
    for k in (1, 2):
        triples[:-k] += chars[k:] * _MUL[k] if len(chars) > k else np.zeros(0, np.uint64)
    keep = np.ones(len(chars), bool)
    for k in (1, 2):
        ends = char_bounds[1:] - k
        keep[ends[ends >= char_bounds[:-1]]] = False
    kept = np.flatnonzero(keep)
    return [
        (_buckets(mix(words)), bounds),
        (_buckets(mix(words[at] * _MUL[0] + words[at + 1] * _MUL[1])), pair_bounds),
        (_buckets(mix(triples[kept])), np.searchsorted(kept, char_bounds)),
    ]


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(batch.column("text"))
    starts, ends, bounds = word_spans(raw, offsets)
    return raw, offsets, hash_spans(raw, starts, ends), bounds


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets with their shares, as bytes."""
    for batch in batches_of(batches, 256):
        parts = features(*_read(batch))
        for i in range(batch.num_rows):
            where, share = [], []
            for g, (bucket, bounds) in enumerate(parts):
                own, n = np.unique(bucket[bounds[i]:bounds[i + 1]], return_counts=True)
                where.append(own + g * BUCKETS)
                share.append(n / max(1, bounds[i + 1] - bounds[i]))
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([
                row.column("doc_id"), row.column("good"),
                pa.array([np.concatenate(where).astype("<i4").tobytes()]), pa.array([np.concatenate(share).astype("<f4").tobytes()]),
            ], names=["doc_id", "good", "where", "share"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(where: list[np.ndarray], share: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Logistic regression by Adam steps on all rows, classes weighted to count the same, with a small L2 penalty."""
    column, value = np.concatenate(where), np.concatenate(share).astype(np.float64) * _SCALE
    row = np.repeat(np.arange(len(where)), [len(w) for w in where])
    known, column = np.unique(column, return_inverse=True)
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    w, m, v, bias = (np.zeros(len(known)) for _ in range(4))
    bias = np.zeros(3)
    for step in range(1, ROUNDS + 1):
        z = bias[0] + np.bincount(row, value * w[column], minlength=len(where))
        slope = weight * (_sigmoid(z) - good)
        grad = np.bincount(column, value * slope[row], minlength=len(known)) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias[1], bias[2] = 0.9 * bias[1] + 0.1 * slope.sum(), 0.999 * bias[2] + 0.001 * slope.sum() ** 2
        bias[0] -= 0.05 * (bias[1] / (1 - 0.9**step)) / (np.sqrt(bias[2] / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(_GROUPS * BUCKETS + 1)
    out[known], out[-1] = w, bias[0]
    return out


def calibrate(z: np.ndarray, good: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton steps, weighted to the share of good rows."""
    weight = np.where(good, prior / max(1, good.sum()), (1 - prior) / max(1, (~good).sum()))
    target = np.where(good, 1 - 1 / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x, beta = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])

    def loss(beta: np.ndarray) -> float:
        s = x @ beta
        return float(weight @ (np.logaddexp(0, s) - target * s)) + 5e-5 * float(((beta - [1, 0]) ** 2).sum())

    for _ in range(50):
        p = _sigmoid(x @ beta)
        grad = x.T @ (weight * (p - target)) + 1e-4 * (beta - [1, 0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), grad)
        while loss(beta - step) > loss(beta) and abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of labels (doc_id, quality 0 or 1), or None where a class has fewer than eight rows.

    A doc_id with several labels takes the smallest; null ids and null labels are left out.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    counts = dict(labels.groupBy("good").count().collect())
    if min(counts.get(True, 0), counts.get(False, 0)) < 8:
        return None
    picked = hashed_sample(labels.where("good"), "doc_id", LABELLED).union(hashed_sample(labels.where("not good"), "doc_id", LABELLED))
    # At most 2 * LABELLED ids: a bound that no input changes.
    rows = texts.join(F.broadcast(picked), "doc_id").mapInArrow(_compact, "doc_id long, good boolean, where binary, share binary")
    rows = sorted({r["doc_id"]: r for r in rows.toLocalIterator()}.items())
    if not rows:
        return None
    good = np.array([r["good"] for _, r in rows])
    where = [np.frombuffer(r["where"], "<i4") for _, r in rows]
    share = [np.frombuffer(r["share"], "<f4") for _, r in rows]
    held = np.arange(len(rows)) % 4 == 3
    if min(good[held].sum(), (~good[held]).sum(), good[~held].sum(), (~good[~held]).sum()) == 0:
        return None
    fit = np.flatnonzero(~held)
    weights = fit_weights([where[i] for i in fit], [share[i] for i in fit], good[fit])
    z = np.array([weights[-1] + _SCALE * float(weights[where[i]] @ share[i]) for i in np.flatnonzero(held)])
    slope, offset = calibrate(z, good[held], counts[True] / (counts[True] + counts[False]))
    table = weights[:-1].reshape(_GROUPS, BUCKETS) * _SCALE
    return Model(table.astype(np.float32), slope, slope * float(weights[-1]) + offset)


def probabilities(model: Model, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    z = 0.0
    for weights, (bucket, bounds) in zip(model.weights, parts, strict=True):
        z = z + sums_between(weights[bucket], bounds) / np.maximum(1, np.diff(bounds))
    return _sigmoid(model.slope * z + model.offset)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Counts, base_failed, p_quality and kept of every row of docs (doc_id, text; other columns are not looked at).

    A null or empty text has no words and fails the base rules. Without a model the base rules alone decide and
    p_quality is null. Repeated rows give repeated results; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches_of(batches, 512):
            data = _read(batch)
            counts = text_counts(*data)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
            p = probabilities(known, features(*data)) if known is not None else None
            verdict = ~failed if p is None else ~failed & (p >= KEEP_FROM)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(verdict),
                pa.nulls(batch.num_rows, pa.float64()) if p is None else pa.array(p),
            ], names=["doc_id", *COUNTS, "base_failed", "kept", "p_quality"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, p_quality double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def good_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    [verdict] = fresh(docs, "quality_rule_keeps")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(verdict, F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches_of(batches, 512):
            data = _read(batch)
            counts = text_counts(*data)
            keep = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= REPEAT_PERCENT * counts["n_words"])
            if known is not None:
                keep &= probabilities(known, features(*data)) >= KEEP_FROM
            kept = batch.filter(pa.array(keep))
            yield kept.append_column(verdict, pa.array(np.ones(kept.num_rows, bool)))

    return docs.mapInArrow(run, schema).drop(verdict)
