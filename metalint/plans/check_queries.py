"""Checks, ranks, peers and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import position_bucket as bucket
from ..functions.labels import visual_label
from ..functions.paths import norm_path, resolve_relative
from ..functions.schemas import schema_state, schema_uri_parts
from ..functions.text import guard_formula, humanize, is_hex_color, literal_number, unquote_literal, useful_label
from ..operators import checks, containers, peers, resolve
from .registry import query
from .views import Tables


@query("missing_target", """
    SELECT event_id, typ, target FROM v_action
    WHERE enabled AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = target)""")
def missing_target(t: Tables) -> DataFrame:
    """Enabled actions whose target does not exist; nations are the targets."""
    actions = t.actions().withColumn("scope", F.lit(0))
    nations = t.table("nation").select(F.lit(0).alias("scope"), F.col("n_nationkey").alias("target"))
    return resolve.missing_target(
        actions, nations, ["scope"], "target", where=checks.is_enabled(F.col("enabled"))
    ).select("event_id", "typ", "target")


_ACTIONS_SQL = """
    a AS (
      SELECT event_id, visual, enabled, event_id % 4 = 0 AS dynamic,
             CASE typ WHEN 'click' THEN 'Bookmark' WHEN 'view' THEN 'PageNavigation' WHEN 'purchase' THEN 'WebUrl'
                  WHEN 'error' THEN 'page' ELSE '' END AS act,
             CASE WHEN event_id % 3 <> 0 THEN CAST(target AS VARCHAR) END AS tgt
      FROM v_action)"""


@query("action_rules", f"""
    WITH {_ACTIONS_SQL},
    known AS (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation),
    caught AS (SELECT DISTINCT o_custkey AS visual FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT event_id, 'PBI-NAV-008' AS rule_id, 'Information' AS severity FROM a
    WHERE enabled IS DISTINCT FROM false AND dynamic
    UNION ALL
    SELECT event_id, 'PBI-NAV-001', CASE WHEN visual IN (SELECT visual FROM caught) THEN 'Information' ELSE 'Error' END
    FROM a WHERE enabled AND act = 'Bookmark' AND tgt IS NOT NULL AND tgt NOT IN (SELECT k FROM known)
    UNION ALL
    SELECT event_id, 'PBI-NAV-007', 'Error' FROM a
    WHERE enabled AND lower(act) IN ('page', 'pagenavigation') AND tgt IS NOT NULL AND tgt NOT IN (SELECT k FROM known)
    UNION ALL
    SELECT event_id, 'PBI-NAV-002', 'Warning' FROM a WHERE enabled AND NOT dynamic AND (act = '' OR tgt IS NULL)""")
def action_rules(t: Tables) -> DataFrame:
    """The four action checks with their three-valued enabled flag."""
    kind, target = F.col("typ"), F.when(F.col("event_id") % 3 != 0, F.col("target").cast("string"))
    a = t.actions().select(
        "event_id", "visual", "enabled", (F.col("event_id") % 4 == 0).alias("dynamic"),
        F.when(kind == "click", "Bookmark").when(kind == "view", "PageNavigation").when(kind == "purchase", "WebUrl")
        .when(kind == "error", "page").otherwise("").alias("type"),
        target.alias("bookmark"), target.alias("page_target"), target.alias("url"), F.lit(0).alias("report"))
    known = t.table("nation").select(F.lit(0).alias("report"), F.col("n_nationkey").cast("string").alias("page"))
    caught = t.table("orders").where("o_orderpriority = '1-URGENT'").select(F.lit(0).alias("report"), F.col("o_custkey").alias("visual"))
    flags = checks.action_flags(a, known, known.withColumnRenamed("page", "bookmark"), caught, ["report"])

    def hit(rule: str, when, severity) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule_id"), severity.alias("severity")))

    return flags.select("event_id", F.inline(F.array_compact(F.array(
        hit("PBI-NAV-001", F.col("bookmark_missing"), F.when(F.col("captured"), "Information").otherwise("Error")),
        hit("PBI-NAV-002", F.col("lacking").isNotNull(), F.lit("Warning")), hit("PBI-NAV-007", F.col("page_missing"), F.lit("Error")),
        hit("PBI-NAV-008", F.col("depends"), F.lit("Information"))))))


@query("tab_dupes", """
    SELECT report, page, tab_order, count(*) AS n FROM v_visual
    WHERE tab_order >= 0 GROUP BY ALL HAVING count(*) > 1""")
def tab_dupes(t: Tables) -> DataFrame:
    """Tab orders used more than once on a page, among visuals in the tab order."""
    visuals = t.visuals().where(containers.explicit_order(F.col("tab_order")))
    return containers.duplicate_ranks(visuals, ["report", "page"], "tab_order")


_GROUPS_SQL = """
    g AS (
      SELECT CAST(p_partkey % 25 AS INT) AS page, p_partkey AS id, CAST(p_partkey AS VARCHAR) AS name,
             CASE WHEN p_partkey % 40 = 0 THEN CAST(p_partkey AS VARCHAR)
                  WHEN p_partkey % 31 = 5 THEN 'none'
                  WHEN (p_partkey // 25) % 2 = 0
                    THEN CAST((p_partkey + 25 * (p_partkey % 7 + 1)) % (SELECT count(*) FROM part) AS VARCHAR)
                  WHEN p_partkey % 3 = 0 THEN '' END AS parent,
             p_size % 9 - 1 AS tab
      FROM part),
    gg AS (SELECT * FROM g UNION ALL SELECT page, id + 1000000000, name, parent, tab FROM g WHERE id % 50 = 13),
    nm AS (SELECT page, name, count(*) AS c, min(nullif(parent, '')) AS parent FROM gg GROUP BY ALL),
    walk AS (
      SELECT page, id, nullif(parent, '') AS at, CAST([] AS VARCHAR[]) AS seen,
             CASE WHEN nullif(parent, '') IS NULL THEN 'Root' END AS outcome FROM gg
      UNION ALL
      SELECT w.page, w.id, nm.parent, list_append(w.seen, w.at),
             CASE WHEN nm.name IS NULL THEN 'MissingGroup' WHEN nm.c > 1 THEN 'AmbiguousGroup'
                  WHEN list_contains(w.seen, w.at) THEN 'Cycle'
                  WHEN nm.parent IS NULL THEN 'ResolvedGroup' END
      FROM walk w LEFT JOIN nm ON nm.page = w.page AND nm.name = w.at
      WHERE w.outcome IS NULL)"""


def _groups(t: Tables) -> DataFrame:
    part = t.table("part").select("p_partkey", "p_size")
    total = part.agg(F.count("*").alias("n")).scalar()
    key = F.col("p_partkey")
    g = part.select(
        (key % 25).cast("int").alias("page"), key.alias("id"), key.cast("string").alias("name"),
        F.when(key % 40 == 0, key.cast("string")).when(key % 31 == 5, "none")
        .when(F.floor(key / 25) % 2 == 0, ((key + 25 * (key % 7 + 1)) % total).cast("string"))
        .when(key % 3 == 0, "").alias("parent_group"),
        (F.col("p_size") % 9 - 1).alias("tab_order"),
    )
    return g.unionByName(g.where("id % 50 = 13").withColumn("id", F.col("id") + 1000000000))


@query("group_chain", f"""
    WITH {_GROUPS_SQL} SELECT page, id, outcome AS resolution FROM walk WHERE outcome IS NOT NULL""")
def group_chain(t: Tables) -> DataFrame:
    """Ancestry outcome of nested groups with missing, doubled and circular parents."""
    g = _groups(t)
    return containers.resolve_groups(g.withColumnRenamed("name", "grp"), g, ["page"]).select("page", "id", "resolution")


@query("tab_rank", f"""
    WITH {_GROUPS_SQL},
    res AS (SELECT page, id, outcome FROM walk WHERE outcome IN ('Root', 'ResolvedGroup')),
    el AS (
      SELECT g.page, g.id, g.name, CASE WHEN r.outcome = 'Root' THEN '' ELSE g.parent END AS up,
             row_number() OVER (PARTITION BY g.page, CASE WHEN r.outcome = 'Root' THEN '' ELSE g.parent END
                                ORDER BY g.tab DESC, g.id) AS r
      FROM gg g JOIN res r USING (page, id) WHERE g.tab >= 0),
    lab AS (
      SELECT page, id, name, CAST(r AS VARCHAR) AS label FROM el WHERE up = ''
      UNION ALL
      SELECT e.page, e.id, e.name, l.label || '.' || e.r FROM el e JOIN lab l ON l.page = e.page AND l.name = e.up)
    SELECT page, id, label FROM lab""")
def tab_rank(t: Tables) -> DataFrame:
    """Friendly nested tab ranks."""
    g = _groups(t)
    settled = containers.resolve_groups(g.withColumnRenamed("name", "grp"), g, ["page"])
    ranks = containers.tab_ranks(
        settled.withColumns({"path": F.col("id"), "is_group": F.lit(True)}), ["page"])
    return ranks.select("page", F.col("path").alias("id"), "label")


@query("mode_outliers", """
    WITH v AS (SELECT report, val, count(*) AS c FROM v_visual GROUP BY ALL),
    s AS (
      SELECT report, sum(c) AS peers, count(*) AS k, max(c) AS dom, max_by(val, c) AS dv,
             count(*) FILTER (c = (SELECT max(c) FROM v v2 WHERE v2.report = v.report)) AS top
      FROM v GROUP BY report)
    SELECT x.report, x.page, x.visual, x.val, lower(s.dv) AS dominant_value, CAST(s.peers AS BIGINT) AS peers,
           s.dom AS dominant_count
    FROM v_visual x JOIN s USING (report)
    WHERE s.peers >= 4 AND s.k >= 2 AND s.top = 1 AND s.dom * 4 >= s.peers * 3 AND x.val <> s.dv""")
def mode_outliers(t: Tables) -> DataFrame:
    """Visuals whose value differs from the one that at least 75 % of the report's visuals share."""
    return peers.mode_outliers(t.visuals(), ["report"], "val").select(
        "report", "page", "visual", "val", "dominant_value", "peers", "dominant_count")


@query("theme_match", """
    WITH r AS (
      SELECT p_type AS card, p_brand AS property, CASE WHEN p_size % 5 = 0 THEN '*' ELSE 'T' || (p_size % 3) END AS vt,
             CASE WHEN p_size % 2 = 0 THEN '*' ELSE 'P1' END AS ps,
             CASE WHEN p_partkey % 6 = 0 THEN 'D' || (p_partkey % 4) END AS di,
             CASE WHEN p_partkey % 23 = 0 THEN 'UnsupportedComplex' ELSE 'NumericLiteral' END AS kind,
             CAST(CAST(floor(p_retailprice) AS INT) % 50 AS VARCHAR) AS value, p_partkey AS ord
      FROM part),
    o AS (
      SELECT DISTINCT p_type AS card, CASE WHEN l_suppkey % 9 = 0 THEN 'Other' ELSE 'BRAND#' || (1 + l_suppkey % 25) END AS property,
             't' || (l_suppkey % 4) AS vt, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'p1' ELSE 'P2' END AS ps,
             CASE WHEN l_suppkey % 2 = 0 THEN 'd' || (l_suppkey % 4) END AS di, CAST(l_suppkey % 50 AS VARCHAR) AS saved
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (
      SELECT o.*, count(r.card) AS rules, count(*) FILTER (r.vt = '*' OR lower(r.vt) = o.vt) AS vis,
             count(*) FILTER ((r.vt = '*' OR lower(r.vt) = o.vt)
               AND (r.ps = '*' OR lower(r.ps) = lower(CASE WHEN o.ps = '' THEN '*' ELSE o.ps END))
               AND (o.di IS NULL OR r.di IS NULL OR lower(r.di) = o.di)) AS n,
             count(*) FILTER (r.kind = 'UnsupportedComplex' AND (r.vt = '*' OR lower(r.vt) = o.vt)
               AND (r.ps = '*' OR lower(r.ps) = lower(CASE WHEN o.ps = '' THEN '*' ELSE o.ps END))
               AND (o.di IS NULL OR r.di IS NULL OR lower(r.di) = o.di)) AS bad,
             min_by(r.value, r.ord) FILTER ((r.vt = '*' OR lower(r.vt) = o.vt)
               AND (r.ps = '*' OR lower(r.ps) = lower(CASE WHEN o.ps = '' THEN '*' ELSE o.ps END))
               AND (o.di IS NULL OR r.di IS NULL OR lower(r.di) = o.di)) AS value
      FROM o LEFT JOIN r ON lower(r.card) = lower(o.card) AND lower(r.property) = lower(o.property)
      GROUP BY ALL)
    SELECT card, property, vt AS visual_type, ps AS preset, coalesce(di, '') AS disc, saved, n AS candidates,
           CASE WHEN rules = 0 THEN 'NoExplicitRule' WHEN vis = 0 THEN 'MappingUnavailable' WHEN n = 0 THEN 'NoExplicitRule'
                WHEN bad > 0 THEN 'UnsupportedCandidate' WHEN n = 1 THEN 'SingleSupportedCandidate'
                ELSE 'MultipleCandidates' END AS theme_state,
           CASE WHEN rules = 0 OR vis = 0 OR n = 0 THEN 'ThemeCandidateUnavailable' WHEN bad > 0 THEN 'DynamicOrUnsupported'
                WHEN n > 1 THEN 'ComparisonAmbiguous' WHEN value = saved THEN 'SavedValueMatchesTheme'
                ELSE 'SavedValueDiffersFromTheme' END AS comparison
    FROM m""")
def theme_match(t: Tables) -> DataFrame:
    """Theme rules that speak about a saved value, and the comparison with the one found."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rules = t.table("part").select(
        F.col("p_type").alias("card"), F.col("p_brand").alias("property"),
        F.when(size % 5 == 0, "*").otherwise(F.concat(F.lit("T"), size % 3)).alias("visual_type"),
        F.when(size % 2 == 0, "*").otherwise("P1").alias("preset"),
        F.when(key % 6 == 0, F.concat(F.lit("D"), key % 4)).alias("discriminator"),
        F.when(key % 23 == 0, "UnsupportedComplex").otherwise("NumericLiteral").alias("value_kind"),
        (F.col("p_retailprice").cast("int") % 50).cast("string").alias("value"), key.alias("source_order"),
    )
    s = F.col("l_suppkey")
    used = t.table("lineitem").select("l_partkey", "l_suppkey").distinct().join(
        t.table("part").select("p_partkey", F.col("p_type").alias("card")), F.col("l_partkey") == F.col("p_partkey"))
    obs = used.select(
        "card", F.when(s % 9 == 0, "Other").otherwise(F.concat(F.lit("BRAND#"), 1 + s % 25)).alias("property"),
        F.concat(F.lit("t"), s % 4).alias("visual_type"),
        F.when(s % 3 == 0, "").when(s % 3 == 1, "p1").otherwise("P2").alias("preset"),
        F.when(s % 2 == 0, F.concat(F.lit("d"), s % 4)).alias("discriminator"),
        (s % 50).cast("string").alias("value"), F.lit("PersistedLiteral").alias("classification"),
    ).distinct()
    got = peers.compare_theme(peers.theme_candidates(obs, rules))
    return got.select("card", "property", "visual_type", "preset", F.coalesce("discriminator", F.lit("")).alias("disc"),
                      F.col("value").alias("saved"), "candidates", "theme_state", "comparison")


@query("file_gate", """
    WITH f AS (
      SELECT page_id // 8 AS project, CASE page_id % 8
          WHEN 0 THEN 'P.pbip' WHEN 1 THEN 'R.Report/definition/report.json'
          WHEN 2 THEN 'M.SemanticModel/definition/tables/T.tmdl'
          WHEN 3 THEN CASE WHEN (page_id // 8) % 5 = 0 THEN 'M.SemanticModel/model.bim' ELSE 'M.SemanticModel/definition/model.tmdl' END
          WHEN 4 THEN CASE WHEN (page_id // 8) % 4 = 1 THEN 'r.report/DEFINITION/report.json' ELSE 'R.Report/x.json' END
          WHEN 5 THEN CASE WHEN (page_id // 8) % 7 = 3 THEN NULL ELSE 'R.Report/a.png' END
          WHEN 6 THEN CASE WHEN (page_id // 8) % 3 = 1 THEN 'Q.pbip' ELSE 'notes.txt' END
          ELSE CASE WHEN (page_id // 8) % 6 = 2 THEN 'R.Report/a/b/c/d/e.json' ELSE 'R.Report/y.json' END END AS path,
        length(html) AS len, page_id % 8 AS slot FROM pages),
    g AS (
      SELECT project, count(*) AS visited,
             count(*) FILTER (path LIKE '%.json' OR path LIKE '%.tmdl' OR path LIKE '%.bim' OR path LIKE '%.pbip') AS files,
             coalesce(sum(len) FILTER (path LIKE '%.json' OR path LIKE '%.tmdl' OR path LIKE '%.bim' OR path LIKE '%.pbip'), 0) AS total,
             coalesce(max(len) FILTER (path LIKE '%.json' OR path LIKE '%.tmdl' OR path LIKE '%.bim' OR path LIKE '%.pbip'), 0) AS largest,
             coalesce(max(len(string_split(path, '/'))), 0) AS depth, count(*) FILTER (path LIKE '%.pbip') AS pbip,
             count(*) FILTER (path LIKE '_.Report/%' OR path LIKE 'r.report/%' OR path LIKE '_.SemanticModel/%') AS arts,
             count(*) FILTER (path IS NULL) AS bad,
             bool_or(path = 'M.SemanticModel/model.bim') AS bim, bool_or(path LIKE 'M.SemanticModel/definition/%') AS def
      FROM f GROUP BY ALL)
    SELECT project, visited, files, concat_ws('; ',
        CASE WHEN files > 6 THEN 'too many files' END, CASE WHEN largest > 15000 THEN 'file too large' END,
        CASE WHEN total > 60000 THEN 'project too large' END, CASE WHEN depth > 5 THEN 'too deep' END,
        CASE WHEN pbip <> 1 THEN 'not exactly one project file' END,
        CASE WHEN arts = 0 THEN 'no report or model folder' END, CASE WHEN bad > 0 THEN 'path not allowed' END) AS reasons,
      CASE WHEN bim AND def THEN 'Ambiguous' WHEN bim THEN 'UnsupportedFormat' WHEN def THEN 'Supported' ELSE '' END AS outcome,
      (SELECT count(*) FROM (SELECT lower(path) AS k FROM f f2 WHERE f2.project = g.project AND path IS NOT NULL
         AND (path LIKE '%.json' OR path LIKE '%.tmdl' OR path LIKE '%.bim' OR path LIKE '%.pbip')
         GROUP BY 1 HAVING count(*) > 1)) AS doubled
    FROM g""")
def file_gate(t: Tables) -> DataFrame:
    """Admission, eligibility and doubled paths of projects made of pages."""
    from ..sources.estate import is_admitted_path

    project, slot = F.floor(F.col("page_id") / 8), F.col("page_id") % 8
    raw = t.table("pages").select(
        project.alias("project"), F.length("html").cast("long").alias("length"),
        F.when(slot == 0, "./P.pbip").when(slot == 1, "R.Report\\definition\\report.json")
        .when(slot == 2, "M.SemanticModel/definition/x/../tables/T.tmdl")
        .when(slot == 3, F.when(project % 5 == 0, "M.SemanticModel/model.bim").otherwise("M.SemanticModel/definition/model.tmdl"))
        .when(slot == 4, F.when(project % 4 == 1, "r.report/DEFINITION/report.json").otherwise("R.Report/x.json"))
        .when(slot == 5, F.when(project % 7 == 3, "../escape.json").otherwise("R.Report/a.png"))
        .when(slot == 6, F.when(project % 3 == 1, "Q.pbip").otherwise("notes.txt"))
        .otherwise(F.when(project % 6 == 2, "R.Report/a/b/c/d/e.json").otherwise("R.Report/y.json")).alias("path"),
    )
    files = raw.withColumn("rel_path", norm_path(F.col("path"))).withColumn(
        "allowed", F.coalesce(is_admitted_path(F.col("rel_path")), F.lit(False)))
    limits = {"visited": 10_000, "files": 6, "file_bytes": 15_000, "total_bytes": 60_000, "depth": 5}
    gate = checks.admission(files, limits=limits)
    outcome = checks.eligibility(files).select("project", "outcome")
    doubled = checks.duplicate_paths(files.where("allowed")).groupBy("project").agg(F.count("*").alias("doubled"))
    return gate.join(outcome, "project", "left").join(doubled, "project", "left").select(
        "project", "visited", "files", F.array_join("reasons", "; ").alias("reasons"),
        F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("doubled", F.lit(0).cast("long")).alias("doubled"))


@query("path_norm", """
    SELECT page_id, CASE page_id % 9
        WHEN 0 THEN 'a/b/' || page_id WHEN 1 THEN 'x' || page_id || '/y' WHEN 2 THEN '' WHEN 3 THEN ''
        WHEN 4 THEN '' WHEN 5 THEN regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '/?([?#].*)?$', '')
        WHEN 6 THEN '' WHEN 7 THEN 'k' ELSE '' END AS normal,
      CASE page_id % 9 WHEN 0 THEN 'base/dir/a/b/' || page_id WHEN 1 THEN 'base/dir/x' || page_id || '/y'
        WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'base/up' || page_id
        WHEN 5 THEN 'base/dir/' || regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '/?([?#].*)?$', '')
        WHEN 6 THEN '' WHEN 7 THEN 'base/dir/k' ELSE 'base' END AS resolved
    FROM pages""")
def path_norm(t: Tables) -> DataFrame:
    """Normalised and base-relative paths; empty where the path is rejected."""
    i, k = F.col("page_id"), F.col("page_id") % 9
    tail = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+/", ""), r"[?#].*$", "")
    path = (
        F.when(k == 0, F.concat(F.lit("a/./b//"), i)).when(k == 1, F.concat(F.lit("z\\..\\x"), i, F.lit("\\y")))
        .when(k == 2, F.concat(F.lit("/rooted"), i)).when(k == 3, F.concat(F.lit("C:\\x"), i))
        .when(k == 4, F.concat(F.lit("../up"), i)).when(k == 5, tail).when(k == 6, F.lit("../../../gone"))
        .when(k == 7, F.lit("./j/.././k/")).otherwise(F.lit(".."))
    )
    return t.table("pages").select(
        "page_id", F.coalesce(norm_path(path), F.lit("")).alias("normal"),
        F.coalesce(resolve_relative(F.lit("base/dir"), path), F.lit("")).alias("resolved"))


@query("position_bucket", """
    WITH b AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 20 AS x, l_tax * 8000 AS y,
             l_discount * 1000 AS w, CASE WHEN l_linestatus = 'O' THEN 100.0 END AS h,
             CASE WHEN l_partkey % 17 = 0 THEN 0.0 ELSE 1280.0 END AS pw, 720.0 AS ph FROM lineitem),
    c AS (SELECT *, (x + coalesce(w, 0) / 2) / nullif(pw, 0) AS cx, (y + coalesce(h, 0) / 2) / ph AS cy FROM b),
    d AS (SELECT *, CASE WHEN cx < 1e0 / 3e0 THEN 'left' WHEN cx > 2e0 / 3e0 THEN 'right' ELSE 'centre' END AS hz,
                 CASE WHEN cy < 1e0 / 3e0 THEN 'upper' WHEN cy > 2e0 / 3e0 THEN 'lower' ELSE 'centre' END AS vt FROM c),
    e AS (SELECT CASE WHEN pw = 0 THEN 'Position unavailable' WHEN hz = 'centre' AND vt = 'centre' THEN 'Centre of page'
                 ELSE upper(vt[1]) || vt[2:] || '-' || hz || ' of page' END AS place, l_orderkey, l_linenumber FROM d)
    SELECT l_orderkey, l_linenumber, place FROM e""")
def position_bucket(t: Tables) -> DataFrame:
    """Where a box sits on its page."""
    place = bucket(
        F.col("l_quantity") * 20, F.col("l_tax") * 8000, F.col("l_discount") * 1000,
        F.when(F.col("l_linestatus") == "O", 100.0), F.when(F.col("l_partkey") % 17 == 0, 0.0).otherwise(1280.0),
        F.lit(720.0))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))


@query("humanize", r"""
    WITH a AS (
      SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') || 'Total-x'
               WHEN 1 THEN lower(p_type) || 'Chart' WHEN 2 THEN '__' || p_brand WHEN 3 THEN 'barChart' ELSE '-' || p_name || ' _b' END AS c
      FROM part),
    b AS (SELECT p_partkey, c, regexp_replace(regexp_replace(regexp_replace(c, '([a-z])([A-Z])', '\1 \2', 'g'),
                 '(^| )[_-]+', '\1', 'g'), '[_-]+', ' ', 'g') AS s FROM a)
    SELECT p_partkey, c AS raw, upper(s[1]) || s[2:] AS label,
           CASE WHEN c = 'barChart' THEN 'Bar chart' ELSE upper(s[1]) || s[2:] END AS visual,
           CASE WHEN c[1] IN ('=', '+', '-', '@') THEN '''' || c ELSE c END AS guarded,
           length(regexp_replace(c, '[^A-Za-z0-9]', '', 'g')) >= 2 AS useful
    FROM b""")
def humanize_names(t: Tables) -> DataFrame:
    """Labels, guards and usefulness of names."""
    k = F.col("p_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Total-x")))
        .when(k == 1, F.concat(F.lower("p_type"), F.lit("Chart"))).when(k == 2, F.concat(F.lit("__"), "p_brand"))
        .when(k == 3, "barChart").otherwise(F.concat(F.lit("-"), "p_name", F.lit(" _b")))
    )
    c = F.col("raw")
    return t.table("part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", "raw", humanize(c).alias("label"), visual_label(c).alias("visual"),
        guard_formula(c).alias("guarded"), useful_label(c).alias("useful"))


@query("literals", r"""
    WITH a AS (
      SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN '''it''''s ' || l_partkey || ''''
        WHEN 1 THEN CAST(l_partkey AS VARCHAR) || 'D' WHEN 2 THEN CAST(l_partkey AS VARCHAR) || '.50'
        WHEN 3 THEN '#' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') ELSE 'plain' END AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'it''s ' || l_partkey ELSE v END AS text,
           CASE l_partkey % 5 WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN CAST(l_partkey AS VARCHAR) || '.5' ELSE '' END AS num,
           l_partkey % 5 = 3 AS hex
    FROM a""")
def literals(t: Tables) -> DataFrame:
    """Literal unquoting, numeric suffixes and colour tests."""
    p = F.col("l_partkey")
    raw = (
        F.when(p % 5 == 0, F.concat(F.lit("'it''s "), p, F.lit("'"))).when(p % 5 == 1, F.concat(p, F.lit("D")))
        .when(p % 5 == 2, F.concat(p, F.lit(".50"))).when(p % 5 == 3, F.concat(F.lit("#"), F.lpad((p % 1000).cast("string"), 3, "0")))
        .otherwise("plain")
    )
    v = F.col("v")
    return t.table("lineitem").select("l_orderkey", "l_linenumber", raw.alias("v")).select(
        "l_orderkey", "l_linenumber", unquote_literal(v).alias("text"),
        F.coalesce(literal_number(v), F.lit("")).alias("num"), is_hex_color(v).alias("hex"))


@query("schema_uri", """
    WITH a AS (
      SELECT page_id, CASE page_id % 7
          WHEN 0 THEN 'https://developer.microsoft.com/json-schemas/fabric/item/report/definition/page/2.1.0/schema.json'
          WHEN 1 THEN 'https://developer.microsoft.com/json-schemas/fabric/item/report/definition/page/2.' || (page_id % 5) || '.' || page_id || '/schema.json'
          WHEN 2 THEN 'https://developer.microsoft.com/json-schemas/fabric/item/report/visual' || page_id || '/1.0.0/schema.json'
          WHEN 3 THEN url WHEN 4 THEN '' WHEN 5 THEN NULL
          ELSE 'https://developer.microsoft.com/json-schemas/fabric/item/report/definition/page/2.1/schema.json' END AS uri FROM pages)
    SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'page' WHEN 1 THEN 'page' WHEN 2 THEN 'visual' || page_id ELSE '' END AS family,
           CASE page_id % 7 WHEN 0 THEN '2.1.0' WHEN 1 THEN '2.' || (page_id % 5) || '.' || page_id WHEN 2 THEN '1.0.0' ELSE '' END AS version,
           CASE page_id % 7 WHEN 0 THEN 'VerifiedExact' WHEN 1 THEN 'RecognisedUnverifiedVersion' WHEN 2 THEN 'UnknownFamily'
                WHEN 5 THEN 'MetadataMissing' ELSE 'MetadataMalformed' END AS state
    FROM a""")
def schema_uri(t: Tables) -> DataFrame:
    """Schema addresses split and classified."""
    root = "https://developer.microsoft.com/json-schemas/fabric/item/report/"
    i, k = F.col("page_id"), F.col("page_id") % 7
    uri = (
        F.when(k == 0, root + "definition/page/2.1.0/schema.json")
        .when(k == 1, F.concat(F.lit(root + "definition/page/2."), i % 5, F.lit("."), i, F.lit("/schema.json")))
        .when(k == 2, F.concat(F.lit(root + "visual"), i, F.lit("/1.0.0/schema.json"))).when(k == 3, F.col("url"))
        .when(k == 4, "").when(k == 6, root + "definition/page/2.1/schema.json")
    )
    u, none = F.col("uri"), F.lit("")
    parts = schema_uri_parts(u)
    return t.table("pages").select("page_id", uri.alias("uri")).select(
        "page_id", F.coalesce(parts["family"], none).alias("family"), F.coalesce(parts["version"], none).alias("version"),
        schema_state(F.lit("Page"), u.isNotNull(), F.lit(True), u).alias("state"))
