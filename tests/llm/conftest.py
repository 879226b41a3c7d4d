from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

EXTRA = ["uid", "node", "n", "label", "th", "size", "place", "row_tie", "hit_id", "mix_id", "near_th", "kept_id", "key", "kept", "hit_spans", "mix_copy", "quality_rule_keeps"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents (doc_id, text, lang, source, n_chars) with further columns whose names the operators use inside."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in EXTRA])

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(EXTRA)) for i, t, s in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one very long text, equal rows, and one id with two texts."""
    rng = random.Random(3)
    base = sentence(rng, 80)
    rows = [(i, sentence(rng, 60 + i), f"s{i % 4}") for i in range(20)]
    rows += [(100, None, "s0"), (101, "", "s1"), (102, " \n\t ", None), (103, "One", "s2"), (None, base, "s3"), (None, None, None)]
    rows += [(104, base, "s1"), (104, base, "s1"), (104, base, "s1"), (105, base.upper(), "s2"), (106, base + " tail", "s2")]
    rows += [(107, sentence(rng, 70), "s0"), (107, sentence(rng, 70), "s0"), (108, sentence(rng, 30_000), "s3")]
    return rows
