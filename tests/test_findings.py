from pyspark.sql import functions as F

from metalint import session
from metalint.plans import catalogue, rules


def _write(spark, folder, n):
    """Orders of four lines each, some twice, with missing and repeated keys."""
    lines = [(None if i % 13 == 0 else i // 4, None if i % 11 == 0 else i % 7, i % 4 + 1, float(i % 10), "RAN"[i % 3], "OF"[i % 2]) for i in range(n)]
    tables = {
        "lineitem": (lines + lines[:3], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"),
        "orders": ([(i, i % 3, "FOP"[i % 3 and i % 2]) for i in range(n // 4)], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "customer": ([(i, i) for i in range(3)], "c_custkey long, c_nationkey int"),
        "part": ([(i, "p", "b", i % 5) for i in range(6)], "p_partkey long, p_name string, p_brand string, p_size int"),
        "events": ([(i, i % 3, "click", None if i % 8 == 0 else float(i), '{"k": 1}') for i in range(20)],
                   "event_id long, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).withColumn("l_suppkey", F.lit(1)).write.parquet(f"{folder}/{name}.parquet")


def test_findings_of_large_tables_have_tasks_by_rows(spark, tmp_path, monkeypatch):
    _write(spark, str(tmp_path), 160)
    run = catalogue.QUERIES["findings_sorted"]
    left_to_spark = [tuple(r) for r in run(spark, str(tmp_path)).collect()]
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    tasks = 33  # 163 rows
    assert tasks > spark.sparkContext.defaultParallelism
    df = run(spark, str(tmp_path))
    rows = df.collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, left_to_spark))
    rank = {"Error": 0, "Warning": 1}
    keys = [(rank.get(r.severity, 2), r.rule_id, *((x is not None, x or 0) for x in (r.report, r.page, r.visual, r.obj))) for r in rows]
    assert keys == sorted(keys) and {r.rule_id for r in rows} == {"PBI-MODEL-001", "PBI-ACCESS-001", "PBI-ACCESS-002", "PBI-NAV-008"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == plan.count(f"], {tasks}\n") == 5
    counted = {r.rule_id: r.findings for r in catalogue.QUERIES["catalogue_counts"](spark, str(tmp_path)).collect()}
    assert sum(counted.values()) == len(rows)


def test_lost_references_are_looked_up_once(estate):
    """Findings, their evidence and twice their contexts read lost references; each would look all references up in the models again."""
    plan = rules.finding_contexts(estate)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
