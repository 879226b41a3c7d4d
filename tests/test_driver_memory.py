"""Nothing as large as the input is broadcast: what is made from small files may be many times larger than they are."""

from pyspark.sql import functions as F

from metalint.operators import formula, graph, lineage
from metalint.session import cut, few_or_shuffled


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _queries(spark):
    """Texts made from keys alone; Spark's size estimate is that of the keys."""
    return spark.range(40).select(
        F.lit(0).alias("m"), F.col("id").alias("k"), F.concat(F.lit("q"), "id").alias("query"), (F.col("id") % 2 == 0).alias("loaded"),
        F.lit(False).alias("dynamic"),
        F.concat(F.lit('let\n s = q'), (F.col("id") + 1) % 40, F.lit(',\n r = Table.RenameColumns(s, {{"a", "b"}})\nin r')).alias("expression"))


def test_column_refs_and_renames_are_shuffled(spark):
    q = _queries(spark)
    refs = lineage.query_column_refs(q, ["m"], ["k"])
    columns = q.select("m", F.lit("b").alias("column")).distinct()
    renames = lineage.query_renames(q, ["m"])
    found = lineage.resolve_lineage_columns(refs, columns, renames, ["m"])
    assert "BroadcastHashJoin" not in _plan(refs) and "BroadcastHashJoin" not in _plan(found)
    assert refs.count() == 40 and {r.model_column for r in found.collect()} == {"b"}


def test_query_usage_is_shuffled(spark):
    q = _queries(spark)
    refs = formula.query_refs(q, ["m"], ["k"])
    assert "BroadcastHashJoin" not in _plan(refs).split("LeftAnti")[0].split("Filter")[0]
    usage, edges = lineage.query_usage(q, refs, ["m"], ["k"])
    assert "BroadcastHashJoin" not in _plan(usage)
    assert edges.count() == 40 and {(r.loaded, r.role) for r in usage.collect()} == {(True, "LoadedAndSupporting"), (False, "HelperOrStaging")}


def test_broadcast_follows_from_the_count(spark):
    rows = spark.range(50).select(F.col("id").alias("x"))
    texts = cut(spark.range(1000).select(F.col("id").alias("x")))
    assert "BroadcastHashJoin" in _plan(texts.join(few_or_shuffled(rows, 50), "x"))
    many = texts.join(few_or_shuffled(rows, 49), "x")
    assert "SortMergeJoin" in _plan(many) and many.count() == 50


def test_chase_rounds_are_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(_plan(df)) or cut(df))
    pointers = spark.range(9).select(F.lit(0).alias("m"), F.col("id").alias("node"), (F.col("id") + 1).alias("next"),
                                     F.when(F.col("id") == 8, "end").alias("answer"))
    got = graph.chase(pointers, ["m"])
    assert {r.answer for r in got.collect()} == {"end"} and len(plans) > 1
    assert not any("BroadcastHashJoin" in p for p in plans)
