"""Registered queries of this subpackage, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metalint.llm import byte_shards, decontaminate, filter_audit, inner_search, licenses, mixing, near_dedup, quality, suffix_tree, token_shards, url_trust, vector_codes, warc
from metalint.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dedup.near_groups(documents(spark, sf_dir))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of all documents."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLES["op10_decontaminate"] = decontaminate.contamination_sql()


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents in the mix of their sources."""
    return mixing.mix_plan(documents(spark, sf_dir))


ORACLES["op1_mix"] = mixing.mix_sql()


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as shards and read back through their index."""
    return token_shards.encode_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_trust.url_verdicts(table(spark, sf_dir, "pages"))


ORACLES["op4_url_trust"] = url_trust.verdict_sql()


@query
def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return byte_shards.shard_plan(documents(spark, sf_dir))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records of all pages, read back through the merged capture index."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


ORACLES["op3_warc"] = warc.archive_sql()


@query
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return suffix_tree.score(documents(spark, sf_dir))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families in all documents."""
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, licenses.train(docs))


@query
def op11_inner_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return inner_search.top_inner(vectors.where("vec_id % 50 = 0"), vectors)


ORACLES["op11_inner_search"] = inner_search.search_sql()


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all vectors."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


ORACLES["op13_vector_codes"] = vector_codes.compress_sql()


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.audit_sql()
