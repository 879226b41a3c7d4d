"""Counts, facets, locations, findings and exports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_review_candidate, location_label, state_label, state_order
from ..functions.text import guard_formula
from ..operators import containers, peers, resolve, rollups
from ..operators.ranking import listed_values
from ..session import dealt, ordered, tasks_for
from .graph_queries import states
from .registry import query
from .rules import catalogue, catalogue_table
from .views import Tables


@query("rollup_summary", """
    SELECT CASE WHEN grouping(model_id) = 0 AND grouping(state) = 0 THEN 'state' WHEN grouping(model_id) = 0 THEN 'model' ELSE 'all' END AS level,
           coalesce(model_id, -1) AS model_id, coalesce(state, '') AS state, count(*) AS objects,
           count(*) FILTER (typ = 'Column') AS columns, count(*) FILTER (typ = 'Measure') AS measures,
           count(*) FILTER (NOT system) AS developer, count(*) FILTER (system) AS generated
    FROM v_state GROUP BY GROUPING SETS ((), (model_id), (model_id, state))""")
def rollup_summary(t: Tables) -> DataFrame:
    """Object counts for the estate, per model and per model and state."""
    counts = rollups.inventory_counts(
        states(t)[0].select("model_id", "state", "typ", "system"), [[], ["model_id"], ["model_id", "state"]],
        {"objects": F.count("*"), "columns": F.count_if(F.col("typ") == "Column"),
         "measures": F.count_if(F.col("typ") == "Measure"), "developer": F.count_if(~F.col("system")),
         "generated": F.count_if(F.col("system"))})
    level = F.when(F.col("model_id").isNull(), "all").when(F.col("state").isNull(), "model").otherwise("state")
    return counts.select(level.alias("level"), F.coalesce("model_id", F.lit(-1)).alias("model_id"),
                         F.coalesce("state", F.lit("")).alias("state"), "objects", "columns", "measures", "developer", "generated")


@query("distinct_field_counts", """
    SELECT report, page, count(DISTINCT obj) AS distinct_fields FROM v_ref GROUP BY ALL""")
def distinct_field_counts(t: Tables) -> DataFrame:
    """Distinct fields per page."""
    refs = t.refs().select("report", "page", F.lit("Column").alias("typ"), F.lit("T").alias("tbl"),
                           F.lit(None).cast("string").alias("hierarchy"), F.col("obj").cast("string").alias("obj"))
    return rollups.distinct_fields(refs, ["report", "page"])


@query("table_references", """
    WITH s AS (SELECT model_id, tbl, bool_or(state = 'DirectlyUsed') AS used FROM v_state GROUP BY ALL)
    SELECT model_id, count(*) FILTER (used) AS referenced, count(*) FILTER (NOT used) AS not_referenced FROM s GROUP BY ALL""")
def table_references(t: Tables) -> DataFrame:
    """Tables per model with and without a directly used object."""
    usage = states(t)[0].select("model_id", "tbl", "state")
    return rollups.table_reference_counts(usage, t.objects(), ["model_id"])


@query("facet_counts", """
    WITH v AS (SELECT p_brand AS value, min(p_type) AS label, count(*) AS rows FROM part GROUP BY ALL),
    s AS (SELECT label, count(*) > 1 AS many FROM v GROUP BY ALL)
    SELECT value, label, rows, CASE WHEN many THEN label || ' (' || value || ')' ELSE label END AS shown FROM v JOIN s USING (label)""")
def facet_counts(t: Tables) -> DataFrame:
    """Filter options with labels told apart where they repeat."""
    return rollups.facet_options(
        t.table("part").select(F.col("p_brand").alias("value"), F.col("p_type").alias("p_label")), "value", "p_label")


_FINDINGS_SQL = """
    f AS (
      SELECT 'PBI-MODEL-001' AS rule_id, 'Error' AS severity, report, page, visual, obj, count(*) AS evidence
      FROM v_bound b WHERE context <> 'Formatting' AND NOT EXISTS (SELECT 1 FROM v_object o WHERE o.model_id = b.model_id AND o.obj = b.obj)
      GROUP BY ALL
      UNION ALL
      SELECT 'PBI-ACCESS-002', 'Warning', report, page, -1, tab_order, count(*) FROM v_visual WHERE tab_order >= 0
      GROUP BY report, page, tab_order HAVING count(*) > 1
      UNION ALL
      SELECT 'PBI-ACCESS-001', 'Warning', report, page, visual, l_partkey, count(*) FROM v_visual
      WHERE coalesce(tab_order, 0) >= 0 AND alt IS NULL GROUP BY ALL
      UNION ALL
      SELECT 'PBI-NAV-008', 'Information', -1, -1, visual, event_id, 1 FROM v_action WHERE enabled IS DISTINCT FROM false AND event_id % 4 = 0)"""


def _tasks(t: Tables) -> int:
    """Tasks that findings are dealt into: rows are counted from the footers of the files."""
    return tasks_for(t.table("lineitem").count())


def _findings(t: Tables) -> DataFrame:
    tasks = _tasks(t)
    bound = t.bound_refs(tasks).where("context <> 'Formatting'")
    gone = bound.join(t.objects().select("model_id", "obj"), ["model_id", "obj"], "left_anti")
    place = ["report", "page", "visual", "obj"]
    unresolved = dealt(gone.select(*place), tasks, *place).groupBy(*place).agg(F.count("*").alias("evidence")).withColumns(
        {"rule_id": F.lit("PBI-MODEL-001"), "severity": F.lit("Error")})
    visuals = t.visuals()
    explicit = dealt(visuals.where(containers.explicit_order(F.col("tab_order"))), tasks, "report", "page", "tab_order")
    dup = containers.duplicate_ranks(explicit, ["report", "page"], "tab_order")
    dup = dup.select("report", "page", F.lit(-1).alias("visual"), F.col("tab_order").cast("long").alias("obj"),
                     F.col("n").alias("evidence"), F.lit("PBI-ACCESS-002").alias("rule_id"), F.lit("Warning").alias("severity"))
    alt = visuals.where(containers.in_tab_order(F.col("tab_order")) & F.col("alt").isNull()).select(
        "report", "page", "visual", F.col("l_partkey").alias("obj"))
    alt = dealt(alt, tasks, *place).groupBy(*place).agg(F.count("*").alias("evidence")).withColumns(
        {"rule_id": F.lit("PBI-ACCESS-001"), "severity": F.lit("Warning")})
    dynamic = t.actions().where("(enabled is null or enabled) and event_id % 4 = 0").select(
        F.lit(-1).cast("long").alias("report"), F.lit(-1).alias("page"), F.col("visual").cast("int").alias("visual"),
        F.col("event_id").alias("obj"), F.lit(1).cast("long").alias("evidence"),
        F.lit("PBI-NAV-008").alias("rule_id"), F.lit("Information").alias("severity"))
    return resolve.union_all(unresolved, dup, alt, dynamic)


@query("findings_sorted", f"""
    WITH {_FINDINGS_SQL} SELECT * FROM f
    ORDER BY CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END, rule_id, report, page, visual, obj""")
def findings_sorted(t: Tables) -> DataFrame:
    """Findings of four rules in report order."""
    return ordered(_findings(t), _tasks(t), rollups.severity_rank(F.col("severity")), "rule_id", "report", "page", "visual", "obj")


@query("catalogue_counts", """
    WITH """ + _FINDINGS_SQL + """
    SELECT r.rule_id, r.category, count(f.rule_id) AS findings FROM (VALUES """ + ", ".join(
    f"('{r['rule_id']}', '{r['category']}')" for r in catalogue()) + """) r(rule_id, category) LEFT JOIN f USING (rule_id) GROUP BY ALL""")
def catalogue_counts(t: Tables) -> DataFrame:
    """Findings per catalogue rule, zero counts kept."""
    return rollups.catalogue_counts(catalogue_table(t.spark).select("rule_id", "category"), _findings(t))


_EVIDENCE_SQL = """
    ev AS (
      SELECT obj, report, CASE WHEN context = 'Formatting' THEN NULL ELSE page END AS page,
             CASE WHEN context = 'Projection' THEN visual END AS visual,
             CASE context WHEN 'Projection' THEN 'Projection' WHEN 'Filter' THEN CASE WHEN visual % 2 = 0 THEN 'Drillthrough' ELSE 'Filter' END
                  ELSE 'Filter' END AS context
      FROM v_ref)"""


def _evidence(t: Tables) -> DataFrame:
    c = F.col("context")
    return t.refs().select(
        "obj", "report", F.when(c != "Formatting", F.col("page")).alias("page"),
        F.when(c == "Projection", F.col("visual")).alias("visual"),
        F.when(c == "Projection", c).when((c == "Filter") & (F.col("visual") % 2 == 0), "Drillthrough").otherwise("Filter").alias("context"))


@query("locations", f"""
    WITH {_EVIDENCE_SQL},
    l AS (SELECT DISTINCT obj, report, page, visual, CASE WHEN visual IS NOT NULL THEN 'Visual' WHEN page IS NULL THEN 'Report' ELSE 'Page' END AS kind,
                 CASE WHEN visual IS NULL THEN context END AS context FROM ev)
    SELECT obj, report, coalesce(page, -1) AS page, coalesce(visual, -1) AS visual, kind, coalesce(context, '') AS context FROM l
    WHERE NOT (kind = 'Page' AND context = 'Filter' AND EXISTS (SELECT 1 FROM l d WHERE d.obj = l.obj AND d.report = l.report
               AND d.page = l.page AND d.kind = 'Page' AND d.context = 'Drillthrough'))""")
def locations(t: Tables) -> DataFrame:
    """Distinct places where each object is used."""
    minus = F.lit(-1)
    return rollups.usage_locations(_evidence(t), ["obj"]).select(
        "obj", "report", F.coalesce("page", minus).alias("page"), F.coalesce("visual", minus).alias("visual"), "kind",
        F.coalesce("context", F.lit("")).alias("context"))


_PLACES_SQL = """
    p AS (
      SELECT DISTINCT model_id, obj, CASE WHEN context = 'Formatting' THEN report || ' > Report-level use'
               ELSE report || ' > page ' || page || ' > v' || visual END AS place
      FROM v_bound WHERE obj % 25 = model_id)"""


def _places(t: Tables) -> DataFrame:
    refs = t.bound_refs().where("obj % 25 = model_id")
    formatting = F.col("context") == "Formatting"
    place = location_label(
        F.col("report").cast("string"), F.when(~formatting, F.concat(F.lit("page "), "page")),
        F.when(~formatting, F.concat(F.lit("v"), "visual")), F.lit(None).cast("string"), F.lit("Filter"), F.lit(True))
    return refs.select("model_id", "obj", place.alias("place")).distinct()


@query("usage_places", f"""
    WITH {_PLACES_SQL}
    SELECT model_id, obj, row_number() OVER (PARTITION BY model_id, obj ORDER BY lower(place)) AS rank, place FROM p""")
def usage_places(t: Tables) -> DataFrame:
    """The places of every object in the export, one row each."""
    return listed_values(_places(t), ["model_id", "obj"], "place")


@query("usage_export", f"""
    WITH {_PLACES_SQL},
    c AS (SELECT model_id, obj, count(*) AS n FROM p GROUP BY ALL)
    SELECT s.model_id, s.tbl, CASE WHEN s.obj % 7 = 0 THEN '''=' || s.name ELSE s.name END AS object, s.obj, s.typ,
           CASE s.state WHEN 'DirectlyUsed' THEN 'Directly used' WHEN 'IndirectlyUsed' THEN 'Indirectly used'
             WHEN 'StructurallyRequired' THEN 'Structurally required' WHEN 'UsedOnlyByUnusedBranch' THEN 'Used only by unused branch'
             ELSE 'Apparently unused' END AS usage,
           CASE s.state WHEN 'ApparentlyUnused' THEN 0 WHEN 'UsedOnlyByUnusedBranch' THEN 1 WHEN 'StructurallyRequired' THEN 2
             WHEN 'IndirectlyUsed' THEN 3 ELSE 4 END AS review_order,
           coalesce(c.n, 0) AS location_count,
           CASE WHEN s.state IN ('ApparentlyUnused', 'UsedOnlyByUnusedBranch') THEN 'Yes' ELSE 'No' END AS review_candidate
    FROM v_state s LEFT JOIN c USING (model_id, obj) WHERE NOT s.system""")
def usage_export(t: Tables) -> DataFrame:
    """One export row per developer object; `usage_places` lists its places."""
    counts = _places(t).groupBy("model_id", "obj").agg(F.count("*").alias("location_count"))
    named = F.when(F.col("obj") % 7 == 0, F.concat(F.lit("="), "name")).otherwise(F.col("name"))
    state = F.col("state")
    return (
        states(t)[0].where("not system").join(counts, ["model_id", "obj"], "left")
        .select("model_id", "tbl", guard_formula(named).alias("object"), "obj", "typ", state_label(state).alias("usage"),
                state_order(state).alias("review_order"), F.coalesce("location_count", F.lit(0).cast("long")).alias("location_count"),
                F.when(is_review_candidate(state), "Yes").otherwise("No").alias("review_candidate"))
    )


@query("json_export", """
    SELECT model_id, 'objects' AS section, to_json({'tbl': tbl, 'obj': obj, 'name': name, 'typ': typ, 'state': state}) AS json FROM v_state
    UNION ALL SELECT model_id, 'edges', to_json({'from': src, 'to': dst, 'kind': kind}) FROM (SELECT DISTINCT * FROM v_edge)
    UNION ALL SELECT model_id, 'models', to_json({'model': model}) FROM v_model""")
def json_export(t: Tables) -> DataFrame:
    """The inventory as JSON fragments, one per entity, keyed by model and section."""
    from ..sources.sinks import json_fragments

    objects, edges, _ = states(t)
    return json_fragments({
        "objects": objects.select("model_id", "tbl", "obj", "name", "typ", "state"),
        "edges": edges.distinct().select("model_id", F.col("src").alias("from"), F.col("dst").alias("to"), "kind"),
        "models": t.models(),
    }, ["model_id"])


_LIMITS_SQL = """
    lim AS (
      SELECT s_nationkey AS model_id, 'construct ' || (s_suppkey % 3) AS construct, CASE WHEN s_suppkey % 2 = 0 THEN 'NotYetAnalyzed' ELSE 'PartiallyAnalyzed' END AS support,
             CASE s_suppkey % 4 WHEN 0 THEN 'MayCreateDependencies' WHEN 1 THEN 'DependencyEffectUnknown'
               WHEN 2 THEN 'NoKnownDependencyEffect' ELSE 'MayInvalidateExistingEvidence' END AS impact,
             'ConstructNotSupported' AS reason, 'roles/' || (s_suppkey % 50) || '.tmdl' AS artifact_path
      FROM supplier)"""


def _limitations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.table("supplier").select(
        F.col("s_nationkey").alias("model_id"), F.concat(F.lit("construct "), k % 3).alias("construct"),
        F.when(k % 2 == 0, "NotYetAnalyzed").otherwise("PartiallyAnalyzed").alias("support"),
        F.when(k % 4 == 0, "MayCreateDependencies").when(k % 4 == 1, "DependencyEffectUnknown")
        .when(k % 4 == 2, "NoKnownDependencyEffect").otherwise("MayInvalidateExistingEvidence").alias("impact"),
        F.lit("ConstructNotSupported").alias("reason"), F.concat(F.lit("roles/"), k % 50, F.lit(".tmdl")).alias("artifact_path"))


@query("coverage_groups", f"""
    WITH {_LIMITS_SQL}
    SELECT model_id, construct, support, impact, reason, count(DISTINCT artifact_path) AS artifacts
    FROM lim GROUP BY ALL""")
def coverage_groups(t: Tables) -> DataFrame:
    """Limitations grouped per model."""
    return rollups.coverage_groups(_limitations(t), ["model_id"])


@query("coverage_artifacts", f"""
    WITH {_LIMITS_SQL},
    a AS (SELECT DISTINCT model_id, construct, support, impact, reason, artifact_path FROM lim)
    SELECT *, row_number() OVER (PARTITION BY model_id, construct, support, impact, reason ORDER BY lower(artifact_path)) AS rank FROM a""")
def coverage_artifacts(t: Tables) -> DataFrame:
    """The artifacts of every limitation group, one row each."""
    return rollups.coverage_artifacts(_limitations(t), ["model_id"])


@query("coverage_by_model", f"""
    WITH {_LIMITS_SQL},
    g AS (SELECT model_id, count(DISTINCT (construct, support, impact, reason)) AS groups, count(DISTINCT artifact_path) AS artifacts,
                 bool_or(impact = 'MayInvalidateExistingEvidence') AS all_states, bool_or(impact IN ('MayCreateDependencies', 'DependencyEffectUnknown')) AS absent
          FROM lim GROUP BY ALL)
    SELECT g.model_id, g.groups, g.artifacts, count(*) FILTER (all_states OR (absent AND s.state IN ('UsedOnlyByUnusedBranch', 'ApparentlyUnused'))) AS qualified,
           count(*) AS objects FROM g JOIN v_state s USING (model_id) GROUP BY ALL""")
def coverage_by_model(t: Tables) -> DataFrame:
    """Coverage of each model with the number of objects in doubt."""
    from ..operators import graph

    limits = _limitations(t)
    usage = graph.qualify(states(t)[0].select("model_id", "obj", "state"), limits, ["model_id"])
    return rollups.coverage_by_model(limits, usage, ["model_id"])


@query("outlier_examples", """
    WITH v AS (SELECT report, val, count(*) AS c FROM v_visual GROUP BY ALL),
    s AS (SELECT report, sum(c) AS peers, count(*) AS k, max(c) AS dom, max_by(val, c) AS dv,
                 count(*) FILTER (c = (SELECT max(c) FROM v v2 WHERE v2.report = v.report)) AS top FROM v GROUP BY report),
    o AS (SELECT x.val, 'r' || x.report || 'v' || x.visual AS ex FROM v_visual x JOIN s USING (report)
          WHERE s.peers >= 4 AND s.k >= 2 AND s.top = 1 AND s.dom * 4 >= s.peers * 3 AND x.val <> s.dv),
    r AS (SELECT val, ex, row_number() OVER (PARTITION BY val ORDER BY ex) AS rn FROM (SELECT DISTINCT val, ex FROM o))
    SELECT o.val, count(*) AS members, (SELECT string_agg(ex, ', ' ORDER BY ex) FROM r WHERE r.val = o.val AND rn <= 20) AS examples
    FROM o GROUP BY o.val""")
def outlier_examples(t: Tables) -> DataFrame:
    """Outliers per value with up to 20 examples."""
    rows = peers.mode_outliers(t.visuals(), ["report"], "val")
    return rollups.grouped_examples(rows.select("val", F.concat(F.lit("r"), "report", F.lit("v"), "visual").alias("ex")), ["val"], "ex")


@query("role_label_cells", """
    WITH r AS (SELECT DISTINCT report, page, CASE context WHEN 'Projection' THEN 'values' WHEN 'Filter' THEN 'filter' ELSE 'tooltips' END AS role FROM v_ref)
    SELECT report, page, string_agg(role, ', ' ORDER BY role) FILTER (role <> 'filter' OR NOT EXISTS
      (SELECT 1 FROM r o WHERE o.report = r.report AND o.page = r.page AND o.role <> 'filter')) AS roles
    FROM r GROUP BY ALL""")
def role_label_cells(t: Tables) -> DataFrame:
    """Role cell of each page; filter is named only when it is the only role."""
    c = F.col("context")
    evidence = t.refs().withColumn("role", F.when(c == "Projection", "values").when(c == "Filter", "filter").otherwise("tooltips"))
    return rollups.role_labels(evidence, ["report", "page"])
