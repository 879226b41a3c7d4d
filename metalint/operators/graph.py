"""Dependency graph: closure, states, reasons, confidence, activation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Buckets, cut, shuffled
from .ranking import first_by

EDGES_PER_TASK = 1_000_000


def _adjacency(edges: DataFrame, scope: list[str], per_task: int) -> tuple[Buckets, DataFrame | None]:
    """Edges laid out once by (scope, source, piece), and the number of pieces of sources that have several.

    A source with more than `per_task` outgoing edges is spread over several pieces. The fan table lists
    only those sources, so it has at most |edges| / per_task rows; it is None where there are none.
    """
    adj = cut(edges.select(*scope, "src", "dst").distinct())
    fan = cut(
        adj.groupBy(*scope, "src").agg(F.count("*").alias("_d")).where(F.col("_d") > per_task)
        .select(*scope, "src", F.ceil(F.col("_d") / per_task).cast("int").alias("_fan"))
    )
    if fan.isEmpty():
        return Buckets(adj, [*scope, "src"]), None
    adj = adj.join(fan, [*scope, "src"], "left").withColumn(
        "_piece", F.pmod(F.xxhash64("dst"), F.coalesce("_fan", F.lit(1))).cast("int")
    ).drop("_fan")
    return Buckets(adj, [*scope, "src", "_piece"]), fan


def _next_nodes(frontier: DataFrame, adj: Buckets, fan: DataFrame | None, visited: Buckets, label: list[str], scope: list[str]) -> DataFrame:
    """Nodes one edge away from the frontier that were not visited. The frontier and what it finds are shuffled, nothing else."""
    key = [*label, *scope, "node"]
    here = frontier.withColumnRenamed("node", "src")
    if fan is not None:
        here = here.join(fan, [*scope, "src"], "left").withColumn(
            "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))
        ).drop("_fan")
    hop = here.join(shuffled(adj.all()), adj.keys).select(*label, *scope, F.col("dst").alias("node"))
    return hop.distinct().join(shuffled(visited.all()), key, "left_anti").select(*key)


def reachable(roots: DataFrame, edges: DataFrame, scope: Sequence[str], label: Sequence[str] = (),
              known: DataFrame | None = None, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """All nodes reached from the roots, roots included; cycles end by the visited test.

    roots: label, scope, node. edges: scope, src, dst. known: scope, node (edges leaving other nodes are
    ignored). Several root sets share one run through `label`. Edges and visited nodes are laid out by their keys and
    stay where they are: a round moves the nodes of the last round to their edges and what they lead to to its place,
    and adds the new ones as a batch, so all rounds together shuffle each node and each edge once. The driver sees one
    emptiness test a round.
    """
    scope, label = list(scope), list(label)
    key = [*label, *scope, "node"]
    if known is not None:
        edges = edges.join(shuffled(known.select(*scope, F.col("node").alias("src")).distinct()), [*scope, "src"], "left_semi")
    adj, fan = _adjacency(edges, scope, per_task)
    visited = Buckets(roots.select(*key).distinct(), key)
    while not (frontier := visited.batch(visited.batches - 1)).isEmpty():
        visited.add(_next_nodes(frontier, adj, fan, visited, label, scope))
    adj.release()
    return visited.release()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Exact distinct over all columns, case kept."""
    return edges.dropDuplicates()


def classify_objects(objects: DataFrame, direct: DataFrame, closure: DataFrame, edges: DataFrame,
                     scope: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """State of each object by precedence: direct, reached from a report, reached from model structure,
    pointed at by a known node, nothing.

    objects: scope, node, ...; direct: scope, node; closure: kind ('direct' / 'structural'), scope, node.
    """
    s = list(scope)
    key = [*s, "node"]
    flags = closure.groupBy(*key).agg(
        F.bool_or(F.col("kind") == "direct").alias("by_report"),
        F.bool_or(F.col("kind") == "structural").alias("by_structure"),
    )
    if known is not None:
        edges = edges.join(known.select(*s, F.col("node").alias("src")).distinct(), [*s, "src"], "left_semi")
    pointed = edges.select(*s, F.col("dst").alias("node")).distinct().withColumn("pointed", F.lit(True))
    used = direct.select(*key).distinct().withColumn("is_direct", F.lit(True))
    joined = objects.join(used, key, "left").join(flags, key, "left").join(pointed, key, "left")
    off = F.lit(False)
    return joined.withColumn(
        "state",
        F.when(F.coalesce("is_direct", off), "DirectlyUsed")
        .when(F.coalesce("by_report", off), "IndirectlyUsed")
        .when(F.coalesce("by_structure", off), "StructurallyRequired")
        .when(F.coalesce("pointed", off), "UsedOnlyByUnusedBranch")
        .otherwise("ApparentlyUnused"),
    ).drop("is_direct", "by_report", "by_structure", "pointed")


def classify_tables(tables: DataFrame, object_states: DataFrame, table_flags: DataFrame,
                    scope: Sequence[str]) -> DataFrame:
    """State of each table; a table without objects is classified too.

    object_states: scope, tbl, state. table_flags: scope, tbl, by_report, by_structure, unused_target.
    """
    s = [*scope, "tbl"]
    owned = object_states.groupBy(*s).agg(
        F.bool_or(F.col("state") == "DirectlyUsed").alias("any_direct"),
        F.bool_or(F.col("state") == "UsedOnlyByUnusedBranch").alias("any_branch"),
    )
    joined = tables.join(owned, s, "left").join(table_flags, s, "left")
    off = F.lit(False)
    return joined.withColumn(
        "state",
        F.when(F.coalesce("any_direct", off), "DirectlyUsed")
        .when(F.coalesce("by_report", off), "IndirectlyUsed")
        .when(F.coalesce("by_structure", off), "StructurallyRequired")
        .when(F.coalesce("unused_target", off) | F.coalesce("any_branch", off), "UsedOnlyByUnusedBranch")
        .otherwise("ApparentlyUnused"),
    ).drop("any_direct", "any_branch", "by_report", "by_structure", "unused_target")


def node_reachability(nodes: DataFrame, closure: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Both reachability flags of every node seen (objects and both edge ends)."""
    key = [*scope, "node"]
    flags = closure.groupBy(*key).agg(
        F.bool_or(F.col("kind") == "direct").alias("from_report"),
        F.bool_or(F.col("kind") == "structural").alias("from_structure"),
    )
    off = F.lit(False)
    return nodes.join(flags, key, "left").withColumns(
        {"from_report": F.coalesce("from_report", off), "from_structure": F.coalesce("from_structure", off)}
    )


def supports(state: Column, from_report: Column, from_structure: Column) -> Column:
    """Can a predecessor with this reachability explain the state of its target?"""
    return (
        F.when(state == "IndirectlyUsed", from_report)
        .when(state == "StructurallyRequired", from_structure)
        .when(state == "UsedOnlyByUnusedBranch", ~from_report & ~from_structure)
        .otherwise(F.lit(False))
    )


def usage_reason(objects: DataFrame, edges: DataFrame, reach: DataFrame, scope: Sequence[str],
                 priorities: dict[str, int], order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """For each object the one incoming edge that explains its state.

    Kinds are tried by priority; inside a kind ties go by `order`. objects: scope, node, state;
    edges: scope, src, dst, kind plus the order and carried columns; reach: node_reachability.
    """
    s = list(scope)
    explained = objects.where(F.col("state").isin("IndirectlyUsed", "StructurallyRequired", "UsedOnlyByUnusedBranch"))
    source = reach.select(*s, F.col("node").alias("src"), "from_report", "from_structure")
    incoming = (
        edges.where(F.col("kind").isin(*priorities))
        .join(source, [*s, "src"])
        .withColumnRenamed("dst", "node")
        .join(explained.select(*s, "node", "state"), [*s, "node"])
        .where(supports(F.col("state"), F.col("from_report"), F.col("from_structure")))
    )
    rank = None
    for kind, value in priorities.items():
        rank = F.when(F.col("kind") == kind, value) if rank is None else rank.when(F.col("kind") == kind, value)
    best = first_by(
        incoming.select(*s, "node", rank.alias("priority"), *order, *carry, "kind", "src"),
        [*s, "node"], ["priority", *order, "src", "kind"],
    )
    return objects.join(best, [*s, "node"], "left")


# Which states each limitation impact puts in doubt.
IMPACT_STATES = {
    "MayCreateDependencies": ("UsedOnlyByUnusedBranch", "ApparentlyUnused"),
    "DependencyEffectUnknown": ("UsedOnlyByUnusedBranch", "ApparentlyUnused"),
    "MayInvalidateExistingEvidence": (
        "DirectlyUsed", "IndirectlyUsed", "StructurallyRequired", "UsedOnlyByUnusedBranch", "ApparentlyUnused",
    ),
}


def qualify(usage: DataFrame, limitations: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Mark states that a limitation of the same model puts in doubt."""
    states = F.create_map(*[x for k, v in IMPACT_STATES.items()
                            for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    doubtful = (
        limitations.select(*scope, F.explode(F.try_element_at(states, "impact")).alias("state")).distinct()
        .withColumn("_q", F.lit(True))
    )
    return usage.join(doubtful, [*scope, "state"], "left").withColumn(
        "confidence", F.when(F.col("_q"), "QualifiedByLimitation").otherwise("Established")
    ).drop("_q")


def activation(relationships: DataFrame, calls: DataFrame, reach: DataFrame, scope: Sequence[str]) -> DataFrame:
    """State of each inactive relationship from the calls matched to it.

    relationships: scope, name, active; calls: scope, relationship, node (the caller); reach: scope, node,
    from_report.
    """
    s = list(scope)
    sources = (
        calls.select(*s, F.col("relationship").alias("name"), "node").distinct()
        .join(reach.select(*s, "node", "from_report"), [*s, "node"], "left")
        .groupBy(*s, "name")
        .agg(F.bool_or(F.coalesce("from_report", F.lit(False))).alias("_live"), F.count("*").alias("sources"))
    )
    joined = relationships.where("not active").join(sources, [*s, "name"], "left")
    return joined.withColumn(
        "activation",
        F.when(F.coalesce("_live", F.lit(False)), "ActivatedByReportUsedDax")
        .when(F.coalesce("sources", F.lit(0)) > 0, "ReferencedOnlyByUnusedDax")
        .otherwise("NoDetectedActivation"),
    ).withColumn("sources", F.coalesce("sources", F.lit(0))).drop("_live")


def chase(pointers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Follow `next` from every node to the first node with an `answer`, by pointer doubling.

    pointers: scope, node (unique), next, answer. Returns scope, node, answer; a null answer means the chain
    ends at a node that does not exist or runs into a cycle, told apart by `ends` ('answer', 'gone', 'cycle').
    Every round doubles the distance looked ahead, so a chain of length d needs about log2(d) rounds. A chain
    that ends has nodes at every smaller distance, so a round that settles nothing proves that what is left
    is cyclic.
    """
    s = list(scope)
    off = F.lit(None).cast("string")
    start = pointers.select(*s, "node", "next", "answer",
                            F.when(F.col("answer").isNotNull(), F.lit("answer")).otherwise(off).alias("ends"))
    start = cut(start)
    settled = start.where("ends is not null").drop("next")
    todo = start.where("ends is null")
    left = todo.count()
    while left:
        ahead = todo.select(*s, F.col("node").alias("next"), F.col("next").alias("after")).withColumn("_t", F.lit(True))
        found = settled.select(*s, F.col("node").alias("next"), F.col("answer").alias("_a"), F.col("ends").alias("_e"))
        step = (
            todo.drop("answer", "ends").join(shuffled(found), [*s, "next"], "left").join(shuffled(ahead), [*s, "next"], "left")
            .select(*s, "node", F.when(F.col("_t"), F.col("after")).otherwise(F.col("next")).alias("next"),
                    F.col("_a").alias("answer"),
                    F.when(F.col("_e").isNotNull(), F.col("_e"))
                    .when(F.col("_t").isNull(), F.lit("gone")).otherwise(off).alias("ends"))
        )
        step = cut(step)
        settled = settled.unionByName(step.where("ends is not null").drop("next"))
        todo = step.where("ends is null")
        before, left = left, todo.count()
        if left == before:
            break
    cyclic = todo.select(*s, "node", "answer", F.lit("cycle").alias("ends"))
    return settled.unionByName(cyclic)
