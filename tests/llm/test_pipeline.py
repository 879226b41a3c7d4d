from __future__ import annotations

import corpus_pipeline
from oracle import DATA
from pyspark.sql import functions as F

from metalint.llm import decontaminate, mixing, near_dedup, quality
from metalint.llm.common import documents, scratch_folder, table

from .test_file_operators import ids_of
from .test_native_operators import brute_windows
from .test_near_dedup import brute


def test_stages(spark):
    """Each stage's output against brute force on the stage's own input."""
    sf = f"{DATA}/sf0.001"
    docs, folder = documents(spark, sf), scratch_folder(spark, "test-pipeline")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs.select("doc_id", "text", "source").collect()
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "tokens" or docs.columns == columns
    ids = lambda name: sorted(r["doc_id"] for r in before[name])
    model = quality.train(documents(spark, sf), table(spark, sf, "labels"))
    assert ids("near_dedup") == sorted(r["doc_id"] for r in quality.score(documents(spark, sf), model).where("kept").collect())
    assert ids("decontaminate") == sorted({c for _, _, c in brute([tuple(r) for r in before["near_dedup"]])})
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    hits = brute_windows([r["text"] for r in before["decontaminate"]], items)
    assert ids("mix") == sorted(r["doc_id"] for r, h in zip(before["decontaminate"], hits, strict=True) if not h[4])
    mixed = mixing.mix_plan(spark.createDataFrame(before["mix"])).agg(F.sum("copies")).first()[0]
    assert len(before["tokens"]) == mixed
    assert docs.count() == mixed and docs.agg(F.sum("n_tokens")).first()[0] == sum(map(len, ids_of(r["text"] for r in before["tokens"])))


def test_stages_on_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    assert near_dedup.drop_near_copies(quality.good_documents(docs, None)).columns == docs.columns
    benchmark = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert decontaminate.clean_documents(docs, benchmark).count() == len(odd_rows)
