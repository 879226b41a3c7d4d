"""Resolution and dependency-graph operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, resolve
from ..session import cut
from .registry import query
from .views import Tables


def _closure(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    direct = cut(t.direct_roots())  # closure and classification both start from these
    roots = direct.withColumn("kind", F.lit("direct")).unionByName(
        t.structural_roots().withColumn("kind", F.lit("structural"))
    )
    edges = t.edges()
    return direct, edges, graph.reachable(roots, edges, ["model_id"], label=["kind"])


def states(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects with their state, plus the edges and closure they rest on."""
    direct, edges, closure = _closure(t)
    objects = t.objects().withColumn("node", F.col("obj"))
    return graph.classify_objects(objects, direct, closure, edges, ["model_id"]), edges, closure


@query("reach_states", "SELECT model_id, tbl, obj, state FROM v_state")
def reach_states(t: Tables) -> DataFrame:
    """State of every object by precedence over both closures."""
    return states(t)[0].select("model_id", "tbl", "obj", "state")


@query("resolve_refs", """
    WITH u AS (
      SELECT f.obj, f.context, r.model_id, count(*) AS n FROM v_ref f JOIN v_report r USING (report)
      GROUP BY ALL),
    w AS (
      SELECT u.model_id, o.tbl, o.name, u.context, sum(n) AS refs
      FROM u JOIN v_object o USING (obj) GROUP BY ALL),
    q AS (
      SELECT w.model_id, w.tbl, w.name, w.context, w.refs,
             count(*) FILTER (o.typ = 'Column') > 0 AS c, count(*) FILTER (o.typ = 'Measure') > 0 AS m,
             min(o.typ) AS typ
      FROM w LEFT JOIN v_object o ON o.model_id = w.model_id AND lower(o.tbl) = lower(w.tbl)
                                  AND lower(o.name) = lower(w.name)
      WHERE w.context <> 'Formatting' GROUP BY ALL),
    n AS (
      SELECT w.model_id, w.tbl, w.name, w.context, w.refs,
             (SELECT count(DISTINCT (o.tbl, o.name)) FROM v_object o WHERE o.model_id = w.model_id
                AND o.typ = 'Measure' AND lower(o.name) = lower(w.name)) AS m,
             (SELECT count(DISTINCT (o.tbl, o.name)) FROM v_object o WHERE o.model_id = w.model_id
                AND o.typ = 'Column' AND lower(o.name) = lower(w.name) AND lower(o.tbl) = lower(w.tbl)) AS c
      FROM w WHERE w.context = 'Formatting')
    SELECT model_id, tbl, name, context, 'qualified' AS mode, CAST(refs AS BIGINT) AS refs,
           CASE WHEN c <> m THEN 'Resolved' WHEN c THEN 'Ambiguous' ELSE 'NotFound' END AS outcome,
           CASE WHEN c <> m THEN typ ELSE '' END AS to_typ
    FROM q
    UNION ALL
    SELECT model_id, tbl, name, context, 'unqualified', CAST(refs AS BIGINT),
           CASE WHEN c + m = 1 THEN 'Resolved' WHEN c + m = 0 THEN 'NotFound' ELSE 'Ambiguous' END,
           CASE WHEN c + m <> 1 THEN '' WHEN c = 1 THEN 'Column' ELSE 'Measure' END
    FROM n""")
def resolve_refs(t: Tables) -> DataFrame:
    """Every reference resolved by name: qualified ones by table and name, the others by name alone.

    References are reduced to distinct (model, object, context) before any join.
    """
    names = t.objects().select("obj", "tbl", "name")
    per_object = (
        t.refs().join(t.reports().select("report", "model_id"), "report")
        .groupBy("model_id", "obj", "context").agg(F.count("*").alias("n"))
    )
    wanted = (
        per_object.join(names, "obj").groupBy("model_id", "tbl", "name", "context")
        .agg(F.sum("n").alias("refs"))
    )
    objects = t.objects().select("model_id", "tbl", F.col("name").alias("obj"), "typ").distinct()
    ref_id = ["model_id", "tbl", "name", "context", "refs"]
    refs = wanted.withColumn("obj", F.col("name"))
    qualified = resolve.resolve_qualified(refs.where("context <> 'Formatting'"), objects, ["model_id"], ref_id)
    bare = refs.where("context = 'Formatting'").withColumn("context_tbl", F.col("tbl"))
    unqualified = resolve.resolve_unqualified(
        bare.select("model_id", "context_tbl", "obj", "name", "context", "refs", F.col("tbl").alias("own_tbl")),
        objects, ["model_id"], ["model_id", F.col("own_tbl").alias("tbl"), "name", "context", "refs"],
    )
    both = qualified.withColumn("mode", F.lit("qualified")).unionByName(
        unqualified.withColumn("mode", F.lit("unqualified"))
    )
    return both.select("model_id", "tbl", "name", "context", "mode", "refs", "outcome",
                       F.coalesce("to_typ", F.lit("")).alias("to_typ"))


@query("unresolved_refs", """
    SELECT report, page, visual, obj, context, count(*) AS evidence
    FROM v_bound b
    WHERE context <> 'Formatting'
      AND NOT EXISTS (SELECT 1 FROM v_object o WHERE o.model_id = b.model_id AND o.obj = b.obj)
    GROUP BY ALL""")
def unresolved_refs(t: Tables) -> DataFrame:
    """References of bound reports whose object is not in the bound model."""
    bound = t.bound_refs().where("context <> 'Formatting'")
    gone = bound.join(t.objects().select("model_id", "obj"), ["model_id", "obj"], "left_anti")
    return gone.groupBy("report", "page", "visual", "obj", "context").agg(F.count("*").alias("evidence"))


@query("direct_usage", """
    SELECT o.model_id, o.obj, o.typ, count(b.report) > 0 AS is_direct,
           count(DISTINCT (b.report, b.page, b.visual, b.context)) FILTER (b.report IS NOT NULL) AS evidence,
           count(DISTINCT b.report) AS reports
    FROM v_object o LEFT JOIN
      (SELECT * FROM v_bound WHERE NOT (context = 'Formatting' AND visual % 2 = 0)) b
      ON b.model_id = o.model_id AND b.obj = o.obj
    GROUP BY ALL""")
def direct_usage(t: Tables) -> DataFrame:
    """Objects with the distinct evidence of their direct use; stale selector references do not count.

    Evidence is made distinct per (object, place) first, so a very popular object is only a counter.
    """
    stale = F.col("visual") % 2 == 0
    refs = t.bound_refs().withColumns({
        "origin": F.when(F.col("context") == "Formatting", "Formatting selector identity").otherwise("Binding"),
        "relevance": F.when(stale, "High-confidence persisted").otherwise("Active"),
    })
    used = refs.where(resolve.establishes_use(F.col("origin"), F.col("relevance")))
    evidence = used.select("model_id", "obj", "report", "page", "visual", "context").distinct()
    per_report = evidence.groupBy("model_id", "obj", "report").agg(F.count("*").alias("n"))
    per_object = per_report.groupBy("model_id", "obj").agg(
        F.sum("n").alias("evidence"), F.count("*").alias("reports")
    )
    zero = F.lit(0).cast("long")
    return t.objects().join(per_object, ["model_id", "obj"], "left").select(
        "model_id", "obj", "typ", F.col("evidence").isNotNull().alias("is_direct"),
        F.coalesce("evidence", zero).alias("evidence"), F.coalesce("reports", zero).alias("reports"),
    )


@query("table_states", """
    SELECT model_id, tbl, CASE
      WHEN bool_or(state = 'DirectlyUsed') THEN 'DirectlyUsed'
      WHEN bool_or(state = 'IndirectlyUsed') THEN 'IndirectlyUsed'
      WHEN bool_or(state = 'StructurallyRequired') THEN 'StructurallyRequired'
      WHEN bool_or(state = 'UsedOnlyByUnusedBranch') THEN 'UsedOnlyByUnusedBranch'
      ELSE 'ApparentlyUnused' END AS state, count(*) AS objects
    FROM v_state GROUP BY ALL""")
def table_states(t: Tables) -> DataFrame:
    """State of each table: its objects' use, then the reachability of the table node itself.

    The containing-table edges run from objects to their table, so a table node is reached exactly when one
    of its objects is.
    """
    objects, _, closure = states(t)
    objects = objects.select("model_id", "tbl", "node", "state")
    flags = (
        closure.join(objects.select("model_id", "node", "tbl"), ["model_id", "node"])
        .groupBy("model_id", "tbl")
        .agg(F.bool_or(F.col("kind") == "direct").alias("by_report"),
             F.bool_or(F.col("kind") == "structural").alias("by_structure"))
        .withColumn("unused_target", F.lit(False))
    )
    tables = objects.groupBy("model_id", "tbl").agg(F.count("*").alias("objects"))
    return graph.classify_tables(tables, objects, flags, ["model_id"]).select("model_id", "tbl", "state", "objects")


@query("node_reach", """
    WITH nodes AS (
      SELECT model_id, obj AS node FROM v_object UNION SELECT model_id, src FROM v_edge
      UNION SELECT model_id, dst FROM v_edge)
    SELECT n.model_id, n.node, coalesce(f.by_report, false) AS from_report,
           coalesce(f.by_structure, false) AS from_structure
    FROM nodes n LEFT JOIN v_flags f USING (model_id, node)""")
def node_reach(t: Tables) -> DataFrame:
    """Reachability flags of every object and edge end."""
    _, edges, closure = _closure(t)
    nodes = resolve.distinct_nodes(
        t.objects().select("model_id", F.col("obj").alias("node")),
        edges.select("model_id", F.col("src").alias("node")),
        edges.select("model_id", F.col("dst").alias("node")),
    )
    return graph.node_reachability(nodes, closure, ["model_id"])


KIND_PRIORITY = {"SortBy": 1, "FieldParameter": 2, "Dax": 4, "ReportMeasure": 4}


@query("reason_pick", """
    WITH p AS (
      SELECT s.model_id, s.obj, s.state, e.kind, o.tbl AS from_tbl, o.name AS from_name, e.src,
             row_number() OVER (PARTITION BY s.model_id, s.obj ORDER BY
               CASE e.kind WHEN 'SortBy' THEN 1 WHEN 'FieldParameter' THEN 2 ELSE 4 END,
               lower(o.tbl), lower(o.name), o.typ, e.src, e.kind) AS rn
      FROM v_state s
      JOIN v_edge e ON e.model_id = s.model_id AND e.dst = s.obj
      JOIN v_object o ON o.model_id = e.model_id AND o.obj = e.src
      LEFT JOIN v_flags f ON f.model_id = e.model_id AND f.node = e.src
      WHERE CASE s.state WHEN 'IndirectlyUsed' THEN coalesce(f.by_report, false)
                 WHEN 'StructurallyRequired' THEN coalesce(f.by_structure, false)
                 WHEN 'UsedOnlyByUnusedBranch' THEN NOT coalesce(f.by_report, false)
                                               AND NOT coalesce(f.by_structure, false)
                 ELSE false END)
    SELECT s.model_id, s.obj, s.state, coalesce(p.kind, '') AS kind,
           coalesce(p.from_tbl || '[' || p.from_name || ']', '') AS because
    FROM v_state s LEFT JOIN p ON p.model_id = s.model_id AND p.obj = s.obj AND p.rn = 1""")
def reason_pick(t: Tables) -> DataFrame:
    """The incoming edge that explains each state."""
    objects, edges, closure = states(t)
    names = t.objects().select("model_id", F.col("obj").alias("src"), F.lower("tbl").alias("k1"),
                               F.lower("name").alias("k2"), F.col("typ").alias("k3"),
                               F.concat("tbl", F.lit("["), "name", F.lit("]")).alias("because"))
    reach = graph.node_reachability(
        resolve.distinct_nodes(edges.select("model_id", F.col("src").alias("node"))), closure, ["model_id"]
    )
    named = edges.join(names, ["model_id", "src"]).withColumnRenamed("because", "label")
    found = graph.usage_reason(
        objects.select("model_id", "obj", "node", "state"), named, reach, ["model_id"], KIND_PRIORITY,
        ["k1", "k2", "k3"], ["label"],
    )
    return found.select("model_id", "obj", "state", F.coalesce("kind", F.lit("")).alias("kind"),
                        F.coalesce("label", F.lit("")).alias("because"))


@query("confidence", """
    WITH lim AS (
      SELECT DISTINCT s_nationkey AS model_id, CASE WHEN s_acctbal >= 2500 OR s_suppkey % 4 = 2 THEN 'NoKnownDependencyEffect'
               WHEN s_suppkey % 4 = 0 THEN 'MayCreateDependencies' WHEN s_suppkey % 4 = 1 THEN 'DependencyEffectUnknown'
               ELSE 'MayInvalidateExistingEvidence' END AS impact
      FROM supplier)
    SELECT s.model_id, s.obj, s.state,
           CASE WHEN EXISTS (SELECT 1 FROM lim l WHERE l.model_id = s.model_id AND (
                  l.impact = 'MayInvalidateExistingEvidence' OR
                  (l.impact IN ('MayCreateDependencies', 'DependencyEffectUnknown')
                   AND s.state IN ('UsedOnlyByUnusedBranch', 'ApparentlyUnused'))))
                THEN 'QualifiedByLimitation' ELSE 'Established' END AS confidence
    FROM v_state s""")
def confidence(t: Tables) -> DataFrame:
    """States put in doubt by a limitation of the same model; limitations come from suppliers."""
    key = F.col("s_suppkey") % 4
    limitations = t.table("supplier").select(
        F.col("s_nationkey").alias("model_id"),
        F.when((F.col("s_acctbal") >= 2500) | (key == 2), "NoKnownDependencyEffect").when(key == 0, "MayCreateDependencies")
        .when(key == 1, "DependencyEffectUnknown").otherwise("MayInvalidateExistingEvidence").alias("impact"),
    )
    return graph.qualify(states(t)[0].select("model_id", "obj", "state"), limitations, ["model_id"])


_REL_SQL = """
    rel AS (
      SELECT model_id, src, dst, model_id || ':' || src || '-' || dst AS name, src % 3 = 0 AS active
      FROM v_forward WHERE src <> dst),
    call AS (
      SELECT o.model_id, o.obj AS node,
             CASE WHEN o.obj % 2 = 0 THEN o.obj ELSE f.dst END AS a,
             CASE WHEN o.obj % 2 = 0 THEN f.dst ELSE o.obj END AS b
      FROM v_object o JOIN v_forward f ON f.model_id = o.model_id AND f.src = o.obj
      WHERE o.obj % 3 <> 0 AND o.obj % 7 < 4),
    uni AS (
      SELECT model_id, least(src, dst) AS lo, greatest(src, dst) AS hi, min(name) AS name
      FROM rel GROUP BY ALL HAVING count(*) = 1)"""


def _relationships(t: Tables) -> tuple[DataFrame, DataFrame]:
    forward = t.edges().where(F.floor(F.col("src") / 25) % 2 == 0).select("model_id", "src", "dst")
    # A reversed edge can start in an even block too; the forward one is recognised by its formula.
    total = t.table("part").agg(F.count("*").alias("n")).scalar()
    src = F.col("src")
    forward = forward.where((src + 25 * (src % 7 + 1)) % total == F.col("dst")).distinct()
    text = [F.col(c).cast("string") for c in ("src", "dst")]
    rel = forward.where("src <> dst").select(
        "model_id", F.concat("model_id", F.lit(":"), text[0], F.lit("-"), text[1]).alias("name"),
        (src % 3 == 0).alias("active"),
        F.lit("").alias("from_tbl"), text[0].alias("from_col"), F.lit("").alias("to_tbl"), text[1].alias("to_col"),
    )
    swap = src % 2 == 0
    calls = forward.where((src % 3 != 0) & (src % 7 < 4)).select(
        "model_id", src.alias("node"),
        F.lit("").alias("tbl1"), F.when(swap, text[0]).otherwise(text[1]).alias("col1"),
        F.lit("").alias("tbl2"), F.when(swap, text[1]).otherwise(text[0]).alias("col2"),
    )
    return rel, calls


@query("endpoint_pairs", f"""
    WITH {_REL_SQL}
    SELECT c.model_id, c.node, u.name AS relationship
    FROM call c JOIN uni u ON u.model_id = c.model_id AND u.lo = least(c.a, c.b) AND u.hi = greatest(c.a, c.b)""")
def endpoint_pairs(t: Tables) -> DataFrame:
    """Calls that name two endpoints, matched to the one relationship between them in either order."""
    rel, calls = _relationships(t)
    return resolve.match_endpoint_pair(calls, rel, ["model_id"]).select("model_id", "node", "relationship")


@query("activation", f"""
    WITH {_REL_SQL},
    src AS (
      SELECT u.model_id, u.name, c.node, coalesce(f.by_report, false) AS live
      FROM call c JOIN uni u ON u.model_id = c.model_id AND u.lo = least(c.a, c.b) AND u.hi = greatest(c.a, c.b)
      LEFT JOIN v_flags f ON f.model_id = c.model_id AND f.node = c.node),
    per AS (SELECT model_id, name, bool_or(live) AS live, count(DISTINCT node) AS sources FROM src GROUP BY ALL)
    SELECT r.model_id, r.name, coalesce(p.sources, 0) AS sources,
           CASE WHEN p.live THEN 'ActivatedByReportUsedDax' WHEN p.sources > 0 THEN 'ReferencedOnlyByUnusedDax'
                ELSE 'NoDetectedActivation' END AS activation
    FROM rel r LEFT JOIN per p USING (model_id, name) WHERE NOT r.active""")
def activation(t: Tables) -> DataFrame:
    """Inactive relationships and whether a call in reachable code switches them on."""
    rel, calls = _relationships(t)
    matched = cut(resolve.match_endpoint_pair(calls, rel, ["model_id"]).select("model_id", "node", "relationship"))
    _, _, closure = _closure(t)
    nodes = matched.select("model_id", "node").distinct()
    reach = graph.node_reachability(nodes, closure, ["model_id"])
    found = graph.activation(rel.select("model_id", "name", "active"), matched, reach, ["model_id"])
    return found.select("model_id", "name", "sources", "activation")


@query("bind_models", """
    WITH m AS (SELECT model_id, model, 'models/' || lower(model) AS path FROM v_model),
    r AS (
      SELECT o_orderkey AS report, kind, model_id,
             CASE WHEN o_orderkey % 10 = 3 THEN 'models/none' ELSE 'MODELS/nation_' || model_id END AS target,
             o_orderkey % 11 <> 5 AS available, 'Nation_' || (o_orderkey % 60) AS report_name
      FROM orders JOIN v_report ON report = o_orderkey)
    SELECT r.report, r.kind, coalesce(m.model, n.model, '') AS model
    FROM r LEFT JOIN m ON r.kind = 'ByPath' AND r.available AND m.path = lower(r.target)
           LEFT JOIN v_model n ON r.kind = 'Unspecified' AND lower(n.model) = lower(r.report_name)""")
def bind_models(t: Tables) -> DataFrame:
    """Report to model: by available path, by name, or not at all."""
    models = t.models().select(F.lit(0).alias("project"), "model",
                               F.concat(F.lit("models/"), F.lower("model")).alias("model_path"))
    key = F.col("report")
    reports = t.reports().select(
        F.lit(0).alias("project"), "report", "kind",
        F.when(key % 10 == 3, "models/none").otherwise(F.concat(F.lit("MODELS/nation_"), "model_id")).alias("target_path"),
        (key % 11 != 5).alias("available"),
        F.concat(F.lit("Nation_"), key % 60).alias("report_name"),
    )
    bound = resolve.bind_models(reports, models, name="report_name")
    return bound.select("report", "kind", F.coalesce("model", F.lit("")).alias("model"))


@query("edges_distinct", """
    SELECT DISTINCT model_id, src, dst, kind FROM v_edge ORDER BY model_id, src, dst, kind""")
def edges_distinct(t: Tables) -> DataFrame:
    """Distinct edges in a fixed order."""
    return graph.distinct_edges(t.edges()).orderBy("model_id", "src", "dst", "kind")


@query("membership_expand", """
    WITH pt AS (
      SELECT DISTINCT s_nationkey AS model_id, 'P' || (s_suppkey % 3) AS perspective,
             'Brand#' || (1 + s_suppkey % 24) AS tbl, s_acctbal > 5000 AS inc
      FROM supplier),
    p AS (SELECT model_id, perspective, tbl, bool_or(inc) AS include_all FROM pt GROUP BY ALL),
    lv AS (
      SELECT model_id, tbl, 'L' || obj AS obj, 'HierarchyLevel' AS typ, 'H' || (obj % 2) AS hierarchy
      FROM v_object WHERE obj % 9 = 0),
    ob AS (SELECT model_id, tbl, CAST(obj AS VARCHAR) AS obj, typ, '' AS hierarchy FROM v_object
           UNION ALL SELECT * FROM lv)
    SELECT p.model_id, p.perspective, ob.tbl, ob.obj, ob.typ, ob.hierarchy
    FROM p JOIN ob USING (model_id, tbl)
    WHERE p.include_all OR (ob.typ <> 'HierarchyLevel' AND CAST(ob.obj AS BIGINT) % 4 = 1)
       OR (ob.typ = 'HierarchyLevel' AND ob.hierarchy = 'H1')""")
def membership_expand(t: Tables) -> DataFrame:
    """Objects that perspectives expose, by include-all or by list."""
    key = F.col("s_suppkey")
    tables = t.table("supplier").select(
        F.col("s_nationkey").alias("model_id"), F.concat(F.lit("P"), key % 3).alias("perspective"),
        F.concat(F.lit("Brand#"), 1 + key % 24).alias("tbl"), (F.col("s_acctbal") > 5000).alias("inc"),
    ).groupBy("model_id", "perspective", "tbl").agg(F.bool_or("inc").alias("include_all"))
    base = t.objects()
    levels = base.where("obj % 9 = 0").select(
        "model_id", "tbl", F.concat(F.lit("L"), "obj").alias("obj"), F.lit("HierarchyLevel").alias("typ"),
        F.concat(F.lit("H"), F.col("obj") % 2).alias("hierarchy"),
    )
    fields = base.select("model_id", "tbl", F.col("obj").cast("string").alias("obj"), "typ",
                         F.lit("").alias("hierarchy"))
    listed = fields.where("cast(obj as bigint) % 4 = 1").select(
        "model_id", "tbl", F.col("obj").alias("member"), F.lower("typ").alias("kind")
    ).unionByName(levels.where("hierarchy = 'H1'").select(
        "model_id", "tbl", F.col("hierarchy").alias("member"), F.lit("hierarchy").alias("kind")
    ).distinct())
    members = tables.select("model_id", "perspective", "tbl").join(listed, ["model_id", "tbl"])
    return resolve.expand_membership(tables, members, fields.unionByName(levels), ["model_id"])
