import random

from pyspark.sql import functions as F

from metalint.operators import containers, graph
from metalint.session import Buckets


def _brute(roots, edges):
    seen, todo = set(roots), list(roots)
    while todo:
        m, n = todo.pop()
        for em, s, d in edges:
            if (em, s) == (m, n) and (m, d) not in seen:
                seen.add((m, d))
                todo.append((m, d))
    return seen


def test_reachable_with_cycles_and_a_hub(spark):
    rnd = random.Random(7)
    edges = {(m, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for m in range(3) for _ in range(40)}
    edges |= {(0, "hub", f"n{i}") for i in range(40)} | {(0, "n3", "n3"), (1, "a", "b"), (1, "b", "a")}
    roots = {(0, "n1"), (0, "hub"), (1, "a"), (2, "n5")}
    e = spark.createDataFrame(sorted(edges), "m int, src string, dst string")
    r = spark.createDataFrame(sorted(roots), "m int, node string")
    for per_task in (5, 1_000_000):
        got = {(x.m, x.node) for x in graph.reachable(r, e, ["m"], per_task=per_task).collect()}
        assert got == _brute(roots, edges)


def test_a_round_moves_the_frontier_only(spark):
    """Neither the edges nor the visited nodes are shuffled again, however many rounds there were."""
    chain = spark.range(40).select(F.lit("m").alias("m"), F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    roots = spark.createDataFrame([("direct", "m", "n0"), ("structural", "m", "n35")], "kind string, m string, node string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges, _ = graph._adjacency(chain, ["m"], 1_000_000)
        visited = Buckets(roots, ["kind", "m", "node"])
        for _ in range(3):
            step = graph._next_nodes(visited.batch(visited.batches - 1), edges, None, visited, ["kind"], ["m"])
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2
            visited.add(step)
        assert visited.release().count() == 8
        edges.release()
        got = {(r.kind, r.node) for r in graph.reachable(roots, chain, ["m"], label=["kind"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == {("direct", f"n{i}") for i in range(41)} | {("structural", f"n{i}") for i in range(35, 41)}


def test_edges_of_unknown_nodes_do_not_carry(spark):
    e = spark.createDataFrame([("m", "role", "c"), ("m", "x", "y")], "m string, src string, dst string")
    r = spark.createDataFrame([("m", "role"), ("m", "x")], "m string, node string")
    known = spark.createDataFrame([("m", "x"), ("m", "y"), ("m", "c")], "m string, node string")
    assert {x.node for x in graph.reachable(r, e, ["m"], known=known).collect()} == {"role", "x", "y"}


def test_state_precedence_and_scope(spark):
    objects = spark.createDataFrame([("m", n) for n in "dispuq"] + [("other", "i")], "m string, node string")
    edges = spark.createDataFrame([("m", "d", "i"), ("m", "s", "p"), ("m", "q", "u"), ("m", "u", "q"), ("m", "s", "i")], "m string, src string, dst string")
    direct = spark.createDataFrame([("m", "d")], "m string, node string")
    roots = direct.withColumn("kind", F.lit("direct")).unionByName(
        spark.createDataFrame([("m", "s", "structural"), ("m", "d", "structural")], "m string, node string, kind string"))
    closure = graph.reachable(roots, edges, ["m"], label=["kind"])
    got = {(r.m, r.node): r.state for r in graph.classify_objects(objects, direct, closure, edges, ["m"]).collect()}
    assert got == {("m", "d"): "DirectlyUsed", ("m", "i"): "IndirectlyUsed", ("m", "s"): "StructurallyRequired", ("m", "p"): "StructurallyRequired",
                   ("m", "u"): "UsedOnlyByUnusedBranch", ("m", "q"): "UsedOnlyByUnusedBranch", ("other", "i"): "ApparentlyUnused"}


def test_chase_long_chain_dead_end_and_cycle(spark):
    rows = [("s", f"a{i}", f"a{i + 1}", None) for i in range(50)] + [("s", "a50", None, "end")]
    rows += [("s", "x", "y", None), ("s", "y", "x", None), ("s", "z", "x", None), ("s", "g", "gone", None)]
    p = spark.createDataFrame(rows, "s string, node string, next string, answer string")
    got = {r.node: (r.answer, r.ends) for r in graph.chase(p, ["s"]).collect()}
    assert all(got[f"a{i}"] == ("end", "answer") for i in range(51))
    assert {got[n][1] for n in "xyz"} == {"cycle"} and got["g"] == (None, "gone")


def test_groups_and_tab_ranks(spark):
    rows = [("p", "g1", True, "g1", None, 5), ("p", "g2", True, "g2", "g1", 1), ("p", "v1", False, "v1", "g2", 9), ("p", "v2", False, "v2", "g2", 9),
            ("p", "v3", False, "v3", None, 7), ("p", "v4", False, "v4", "nope", 1), ("p", "d", True, "d1", None, 0), ("p", "d", True, "d2", None, 0),
            ("p", "v5", False, "v5", "d", 1), ("p", "c1", True, "c1", "c2", 1), ("p", "c2", True, "c2", "c1", 1), ("p", "v6", False, "v6", None, None)]
    c = spark.createDataFrame(rows, "page string, name string, is_group boolean, path string, parent_group string, tab_order int")
    groups = c.where("is_group").withColumnRenamed("name", "grp")
    settled = containers.resolve_groups(groups, c, ["page"])
    got = {r.path: r.resolution for r in settled.collect()}
    assert got == {"g1": "Root", "g2": "ResolvedGroup", "v1": "ResolvedGroup", "v2": "ResolvedGroup", "v3": "Root", "v4": "MissingGroup",
                   "d1": "Root", "d2": "Root", "v5": "AmbiguousGroup", "c1": "Cycle", "c2": "Cycle", "v6": "Root"}
    ranks = {r.path: r.label for r in containers.tab_ranks(settled, ["page"]).collect()}
    assert ranks == {"v3": "1", "g1": "2", "d1": "3", "d2": "4", "g2": "2.1", "v1": "2.1.1", "v2": "2.1.2"}
