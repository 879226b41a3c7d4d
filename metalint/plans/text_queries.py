"""Text, document and lineage operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import formula, lineage
from ..session import shuffle_width, shuffled
from ..sources import json_nodes as nodes
from ..sources import text_blocks as blocks
from .registry import query
from .views import Tables


@query("comment_mask", r"""
    SELECT id, md5(list_aggregate(list_transform(
             regexp_extract_all(text, '#"[^"]*(?:""[^"]*)*(?:"|\z)|"[^"]*(?:""[^"]*)*(?:"|\z)|//[^\r\n]*|/\*(?s:.*?)(?:\*/|\z)|[^#"/]+|[#/]'),
             lambda p: CASE WHEN p LIKE '"%' OR p LIKE '//%' OR p LIKE '/*%' THEN regexp_replace(p, '[^\r\n]', ' ', 'g') ELSE p END),
             'string_agg', '')) AS masked_md5,
           contains(lower(text), 'expression.evaluate') OR contains(lower(text), '#shared')
             OR contains(lower(text), 'record.field') AS dynamic
    FROM v_text""")
def comment_mask(t: Tables) -> DataFrame:
    """Strings and comments blanked in every document, page and turn."""
    text = F.col("text")
    return t.texts().select("id", F.md5(formula.mask_text(text)).alias("masked_md5"),
                            formula.is_dynamic(text).alias("dynamic"))


@query("name_in_text", r"""
    WITH n AS (SELECT DISTINCT unnest([text, regexp_extract(text, '^[^ ]+ [^ ]+'), '--', '->', '%', '.)']) AS name FROM benchmark),
    m AS (
      SELECT id, list_aggregate(list_transform(
             regexp_extract_all(text, '#"[^"]*(?:""[^"]*)*(?:"|\z)|"[^"]*(?:""[^"]*)*(?:"|\z)|//[^\r\n]*|/\*(?s:.*?)(?:\*/|\z)|[^#"/]+|[#/]'),
             lambda p: CASE WHEN p LIKE '"%' OR p LIKE '//%' OR p LIKE '/*%' THEN regexp_replace(p, '[^\r\n]', ' ', 'g') ELSE p END),
             'string_agg', '') AS masked FROM v_text)
    SELECT m.id, n.name FROM m JOIN n ON contains(lower(m.masked), lower(n.name))
    WHERE n.name <> '' AND regexp_matches(m.masked, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(n.name) || '($|[^A-Za-z0-9_.])')""")
def name_in_text(t: Tables) -> DataFrame:
    """Which benchmark texts, their openings (two words) and some names of marks alone occur as a name in which text."""
    texts = t.texts().select(F.lit(0).alias("scope"), "id", formula.mask_text(F.col("text")).alias("masked"))
    opening = F.regexp_extract("text", r"^[^ ]+ [^ ]+", 0)
    names = t.table("benchmark").select(
        F.lit(0).alias("scope"), F.explode(F.array("text", opening, *map(F.lit, ("--", "->", "%", ".)")))).alias("name")).where("name <> ''")
    return formula.names_in_text(texts, names, ["scope"], ["id"]).select("id", "name")


@query("token_refs", """
    WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_name AS n, p_type AS y, p_size AS z FROM part)
    SELECT k, 'Qualified' AS ref_kind, b AS tbl, n || ']x' AS obj, '''' || b || '''[' || n || ']]x]' AS ref_text FROM p
    UNION ALL SELECT k, 'Unqualified', '', n, '[' || n || ']' FROM p
    UNION ALL SELECT k, 'Name', y, y, y FROM p WHERE z % 3 <> 0
    UNION ALL SELECT k, 'Call', '', 'fn' || (z % 4), 'fn' || (z % 4) FROM p WHERE z % 4 < 2
    UNION ALL SELECT k, 'Qualified', 'T' || k, 'Date', 'T' || k || ' [Date]' FROM p""")
def token_refs(t: Tables) -> DataFrame:
    """References in formulas written from part rows, with comments, strings, escapes and suffixes."""
    text = F.concat(
        F.lit("VAR a = SUM('"), "p_brand", F.lit("'["), "p_name", F.lit("]]x]) -- old [gone]\n + ["), "p_name",
        F.lit("] // '"), "p_brand", F.lit("'[no]\n + COUNTROWS("),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(F.col("p_type")),
        F.lit(") /* T[z] \n [w] */ + fn"), F.col("p_size") % 4, F.lit(" (1) + T"), F.col("p_partkey"),
        F.lit(" [Date].[Year] + \"it \"\" [s]\" + ["), "p_name", F.lit("]"),
    )
    rows = t.table("part").select(F.lit(0).alias("model"), F.col("p_partkey").alias("k"), text.alias("e"))
    tables = t.table("part").select(F.lit(0).alias("model"), F.upper("p_type").alias("tbl")).distinct()
    functions = t.table("part").where("p_size % 4 < 2").select(
        F.lit(0).alias("model"), F.concat(F.lit("FN"), F.col("p_size") % 4).alias("fn")).distinct()
    got = formula.formula_refs(rows, ["model", "k"], "e", ["model"], tables, functions)
    return got.select("k", "ref_kind", F.coalesce("tbl", F.lit("")).alias("tbl"), "obj", "ref_text").withColumn(
        "tbl", F.when(F.col("ref_kind") == "Call", "").otherwise(F.col("tbl")))


@query("call_pairs", """
    SELECT p_partkey AS k, p_brand AS tbl1, p_name AS col1, 'T' || p_size AS tbl2, 'c' AS col2 FROM part WHERE p_partkey % 3 <> 0""")
def call_pairs(t: Tables) -> DataFrame:
    """Two-endpoint calls in formulas; commented, quoted or incomplete ones do not count."""
    call = F.concat(F.lit("UseRelationship ( '"), "p_brand", F.lit("'["), "p_name", F.lit("] , T"), "p_size", F.lit("[c] )"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-- "), call, F.lit("\n USERELATIONSHIP(A[b])"))).otherwise(
        F.concat(F.lit('CALCULATE([m], '), call, F.lit(', "'), call, F.lit('")')))
    rows = t.table("part").select(F.col("p_partkey").alias("k"), text.alias("e"))
    return formula.relationship_calls(rows, ["k"], "e")


@query("field_param_entries", """
    SELECT p_partkey AS k, p_brand AS tbl, p_name AS obj, '''' || p_brand || '''[' || p_name || ']' AS ref_text FROM part
    WHERE p_partkey % 4 <> 1
    UNION ALL SELECT p_partkey, 'T', 'c' || p_size, 'T[c' || p_size || ']' FROM part WHERE p_partkey % 4 <> 1""")
def field_param_entries(t: Tables) -> DataFrame:
    """Entries of field parameter texts."""
    body = F.concat(F.lit(" {\n (\"a\", NAMEOF('"), "p_brand", F.lit("'["), "p_name", F.lit("]), 0),\n // NAMEOF(Z[z])\n (\"NAMEOF(Q[q])\", nameof( T[c"),
                    "p_size", F.lit("] ), 1), (\"again\", NAMEOF(T[c"), "p_size", F.lit("]), 2) }"))
    text = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("EVALUATE"), body)).otherwise(body)
    rows = t.table("part").select(F.col("p_partkey").alias("k"), text.alias("e"))
    return formula.field_params(rows, ["k"], "e")


def _sources(t: Tables) -> DataFrame:
    k = F.col("page_id") % 6
    call = (
        F.when(k == 0, F.concat(F.lit('Web.Contents("'), "url", F.lit('")')))
        .when(k == 1, F.concat(F.lit('File.Contents( "C:\\d\\'), "page_id", F.lit('.csv")')))
        .when(k == 2, F.concat(F.lit('folder.files("\\\\srv\\s'), "page_id", F.lit('")')))
        .when(k == 3, F.concat(F.lit('Sql.Database("srv", "db'), "page_id", F.lit('")')))
        .when(k == 4, F.lit("Excel.Workbook(File.Contents(Path))"))
        .otherwise(F.lit('// File.Contents("C:\\x")\n Unknown.Call("x") & File.Contents ("rel\\y.csv") & File.Contents("C:\\z")'))
    )
    return t.table("pages").select(
        (F.col("page_id") % 4).cast("int").alias("model_id"), F.concat(F.lit("q"), "page_id").alias("query"),
        F.concat(F.lit("let\n  S = "), call, F.lit("\nin S")).alias("expression"))


_SOURCES_SQL = """
    src AS (
      SELECT CAST(page_id % 4 AS INT) AS model_id, 'q' || page_id AS query, family, function, location_kind FROM pages JOIN (VALUES
        (0, 'Web', 'Web.Contents', 'WebAddress'), (1, 'File', 'File.Contents', 'LocalFile'),
        (2, 'Folder', 'folder.files', 'DynamicOrUnspecified'), (3, 'SQL Server', 'Sql.Database', 'NamedServer'),
        (4, 'Excel', 'Excel.Workbook', 'DynamicOrUnspecified'), (4, 'File', 'File.Contents', 'DynamicOrUnspecified'),
        (5, 'File', 'File.Contents', 'LocalFile')) AS f(k, family, function, location_kind) ON page_id % 6 = k)"""


@query("url_class", f"WITH {_SOURCES_SQL} SELECT * FROM src")
def url_class(t: Tables) -> DataFrame:
    """Connector calls and the kind of place each names; the first literal call in the raw text counts."""
    return formula.data_sources(_sources(t), ["model_id", "query"])


@query("file_source_groups", f"""
    WITH {_SOURCES_SQL}
    SELECT model_id, query, CASE WHEN bool_or(location_kind = 'NetworkFile') THEN 'network file' ELSE 'local file' END AS source,
           count(*) AS calls FROM src WHERE location_kind IN ('LocalFile', 'NetworkFile') GROUP BY ALL""")
def file_source_groups(t: Tables) -> DataFrame:
    """Queries that read local or network files."""
    from ..operators.rollups import file_sources

    return file_sources(formula.data_sources(_sources(t), ["model_id", "query"]), ["model_id", "query"])


@query("connector_summary", f"""
    WITH {_SOURCES_SQL}
    SELECT model_id, family, count(DISTINCT query) AS queries, count(DISTINCT function) AS functions,
           count(DISTINCT location_kind) AS locations FROM src GROUP BY ALL""")
def connector_summary(t: Tables) -> DataFrame:
    """Connector families in use per model."""
    from ..operators.rollups import connector_summary as summary

    return summary(formula.data_sources(_sources(t), ["model_id", "query"]), ["model_id"])


def _m_queries(t: Tables) -> DataFrame:
    """Query texts from parts: every even block reads another part's query, renames, selects and joins."""
    part = t.table("part").select("p_partkey")
    total = part.agg(F.count("*").alias("n")).scalar()
    part = part.repartition(shuffle_width(t.spark), "p_partkey")  # the texts are many times larger than the keys
    k = F.col("p_partkey")
    other = (k + 25 * (k % 7 + 1)) % total
    text = F.when(
        F.floor(k / 25) % 2 == 0,
        F.concat(F.lit("let\n    Source = q"), other, F.lit(',\n    #"re n" = Table.RenameColumns(Source, {{"amount", "a'),
                 k % 3, F.lit('"}, {"x", "y"}}),\n    sel = Table.SelectColumns(#"re n", {"a'), k % 3,
                 F.lit('", "z"}),\n    j = Table.NestedJoin(sel, {"z"}, #"q'), (k + 25) % total,
                 F.lit('", {"key"}, "n", 1),\n    e = Table.ExpandTableColumn(j, "n", {"city"})\nin\n    e')),
    ).otherwise(F.concat(F.lit('let s = Sql.Database("q'), other, F.lit('", "x"), // q'), other, F.lit("\n r = Table.RenameColumns(s, {{\"city\", \"Town\"}, {\"amount\", \"Sum\"}})\nin r")))
    return part.select((k % 25).cast("int").alias("model_id"), k.alias("qid"), F.concat(F.lit("q"), k).alias("query"),
                       (k % 3 == 0).alias("loaded"), text.alias("expression"))


_M_SQL = """
    q AS (
      SELECT CAST(p_partkey % 25 AS INT) AS model_id, p_partkey AS k, p_partkey % 3 = 0 AS loaded, (p_partkey // 25) % 2 = 0 AS even,
             (p_partkey + 25 * (p_partkey % 7 + 1)) % (SELECT count(*) FROM part) AS o,
             (p_partkey + 25) % (SELECT count(*) FROM part) AS j FROM part),
    refs AS (SELECT DISTINCT model_id, k, x FROM (
      SELECT model_id, k, o AS x FROM q WHERE even UNION ALL SELECT model_id, k, j FROM q WHERE even) WHERE x <> k),
    reach AS (SELECT model_id, k FROM q WHERE loaded UNION
      SELECT r.model_id, r.x FROM reach a JOIN refs r ON r.model_id = a.model_id AND r.k = a.k)"""


@query("query_roles", f"""
    WITH {_M_SQL}
    SELECT q.model_id, 'q' || q.k AS query,
           CASE WHEN q.loaded THEN 'LoadedToModel' WHEN EXISTS (SELECT 1 FROM reach r WHERE r.model_id = q.model_id AND r.k = q.k)
                THEN 'SupportingQuery' ELSE 'ApparentlyUnused' END AS state,
           CASE WHEN q.loaded AND u THEN 'LoadedAndSupporting' WHEN q.loaded THEN 'LoadedOnly' WHEN u THEN 'HelperOrStaging'
                ELSE 'ApparentlyOrphaned' END AS role, consumers
    FROM (SELECT q.*, EXISTS (SELECT 1 FROM refs WHERE refs.model_id = q.model_id AND refs.x = q.k) AS u,
                 (SELECT count(*) FROM refs WHERE refs.model_id = q.model_id AND refs.x = q.k) AS consumers FROM q) q""")
def query_roles(t: Tables) -> DataFrame:
    """State, role and number of consumers of every query, from the texts alone."""
    q = _m_queries(t).withColumn("dynamic", formula.is_dynamic(F.col("expression")))
    refs = formula.query_refs(q, ["model_id"], ["qid"])
    usage, edges = lineage.query_usage(q, refs, ["model_id"], ["qid"])
    consumers = edges.groupBy("model_id", F.col("dst").alias("query")).agg(F.count_distinct("src").alias("consumers"))
    return usage.join(shuffled(consumers), ["model_id", "query"], "left").select(
        "model_id", "query", "state", "role", F.coalesce("consumers", F.lit(0).cast("long")).alias("consumers"))


@query("column_lineage", f"""
    WITH {_M_SQL},
    m AS (
      SELECT model_id, k, o AS x, c, kind, step FROM q JOIN (VALUES
        ('amount', 'RenamedColumn', 're n'), ('x', 'RenamedColumn', 're n'), ('amount', 'SelectedColumn', 'sel'),
        ('z', 'SelectedColumn', 'sel'), ('z', 'MergeKey', 'j')) AS v(c, kind, step) ON even
      UNION ALL
      SELECT model_id, k, j, c, kind, step FROM q JOIN (VALUES ('key', 'MergeKey', 'j'), ('city', 'ExpandedColumn', 'e'))
        AS v(c, kind, step) ON even)
    SELECT model_id, k AS qid, 'q' || x AS source_query, c AS column, kind AS usage_kind, step FROM m WHERE x <> k""")
def column_lineage(t: Tables) -> DataFrame:
    """Columns of other queries that each query mentions, step by step."""
    refs = lineage.query_column_refs(_m_queries(t), ["model_id"], ["qid"])
    return refs.select("model_id", "qid", "source_query", "column", "usage_kind", "step").distinct()


@query("rename_chain", f"""
    WITH {_M_SQL},
    m AS (
      SELECT DISTINCT model_id, k, o AS x, c FROM q JOIN (VALUES ('amount'), ('x'), ('z')) AS v(c) ON even
      UNION SELECT model_id, k, j, c FROM q JOIN (VALUES ('key'), ('city')) AS v(c) ON even),
    ren AS (
      SELECT k, 'amount' AS f, 'a' || (k % 3) AS t FROM q WHERE even UNION ALL SELECT k, 'x', 'y' FROM q WHERE even
      UNION ALL SELECT k, 'city', 'Town' FROM q WHERE NOT even UNION ALL SELECT k, 'amount', 'Sum' FROM q WHERE NOT even),
    col AS (
      SELECT k, c FROM q JOIN (VALUES ('a0'), ('a1'), ('Town'), ('key')) AS v(c) ON true
      UNION ALL SELECT k, 'Sum' FROM q WHERE k % 2 = 0)
    SELECT m.model_id, m.k AS qid, 'q' || m.x AS source_query, m.c AS column, coalesce(c0.c, c1.c) AS model_column
    FROM m LEFT JOIN col c0 ON c0.k = m.x AND c0.c = m.c
           LEFT JOIN ren ON ren.k = m.x AND ren.f = m.c LEFT JOIN col c1 ON c1.k = m.x AND c1.c = ren.t
    WHERE m.x <> m.k AND coalesce(c0.c, c1.c) IS NOT NULL""")
def rename_chain(t: Tables) -> DataFrame:
    """Mentioned columns followed through the source query's renames to a model column."""
    q = _m_queries(t)
    refs = lineage.query_column_refs(q, ["model_id"], ["qid"]).select("model_id", "qid", "source_query", "column").distinct()
    renames = lineage.query_renames(q, ["query"]).withColumnRenamed("query", "source_query")
    listed = q.select(F.col("query").alias("source_query"),
                      F.explode(F.array(*[F.lit(c) for c in ("a0", "a1", "Town", "key")])).alias("column"))
    extra = q.where("qid % 2 = 0").select(F.col("query").alias("source_query"), F.lit("Sum").alias("column"))
    got = lineage.resolve_lineage_columns(refs, listed.unionByName(extra), renames, ["source_query"])
    return got.select("model_id", "qid", "source_query", "column", "model_column")


@query("kv_flatten", """
    WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, value < 3 AS low FROM events)
    SELECT event_id, '$' AS path, 'object' AS vtype, '' AS value, 0 AS depth FROM e
    UNION ALL SELECT event_id, '$.id', 'number', CAST(event_id AS VARCHAR), 1 FROM e
    UNION ALL SELECT event_id, '$.visual', 'object', '', 1 FROM e
    UNION ALL SELECT event_id, '$.visual.filters', 'array', '', 2 FROM e
    UNION ALL SELECT event_id, '$.visual.filters[0]', 'object', '', 2 FROM e
    UNION ALL SELECT event_id, '$.visual.filters[0].' || event_type, 'number', k, 3 FROM e
    UNION ALL SELECT event_id, '$.visual.filters[1]', 'string', event_type || ' "q" é', 2 FROM e
    UNION ALL SELECT event_id, '$.low', CASE WHEN low THEN 'true' ELSE 'false' END, CAST(low AS VARCHAR), 1 FROM e
    UNION ALL SELECT event_id, '$.none', 'null', '', 1 FROM e""")
def kv_flatten(t: Tables) -> DataFrame:
    """JSON documents written from events, flattened to nodes."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit('{"id":'), F.col("event_id"), F.lit(',"visual":{"filters":[{"'), "event_type", F.lit('":'), k, F.lit('},"'),
        "event_type", F.lit(' \\"q\\" \\u00e9"]},"low":'), (F.col("value") < 3).cast("string"), F.lit(',"none":null}'))
    files = t.table("events").select(F.lit("p").alias("project"), F.col("event_id").cast("string").alias("rel_path"),
                                     F.encode(text, "UTF-8").alias("content"))
    return nodes.json_nodes(files).select(
        F.col("rel_path").cast("long").alias("event_id"), "path", "vtype", F.coalesce("value", F.lit("")).alias("value"),
        F.size("ancestors").alias("depth"))


@query("line_blocks", """
    WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_name AS n, p_type AS y, p_size AS z FROM part)
    SELECT k, 'measure' AS kw, n || '''s' AS name, '' AS data_type, z % 2 = 0 AS hidden,
           CASE z % 3 WHEN 0 THEN 'SUM(' || y || ')' WHEN 1 THEN 'VAR a = 1' || chr(10) || '    + 2' || chr(10) || chr(10) || 'RETURN a'
                ELSE 'X' || chr(10) || '  Y: 1' END AS expr, '' AS source FROM p
    UNION ALL SELECT k, 'column', 'c' || z, 'int64', z % 5 = 0, '', '' FROM p
    UNION ALL SELECT k, 'partition', b, '', false, 'm', 'let' || chr(10) || '    S = ' || z || chr(10) || 'in S' FROM p""")
def line_blocks(t: Tables) -> DataFrame:
    """Model text written from parts, read back as blocks with properties and expressions."""
    k, z = F.col("p_partkey"), F.col("p_size")
    measure = (
        F.when(z % 3 == 0, F.concat(F.lit(" = SUM("), "p_type", F.lit(")\n")))
        .when(z % 3 == 1, F.lit(" =\n\n\t\t\tVAR a = 1\n\t\t\t    + 2\n\n\t\t\tRETURN a\n"))
        .otherwise(F.lit(" = ```\n\t\t\tX\n\t\t\t  Y: 1\n\t\t\t```\n"))
    )
    text = F.concat(
        F.lit("table '"), "p_brand", F.lit("'\n\tlineageTag: t\n\n\tmeasure '"), "p_name", F.lit("''s'"), measure,
        F.when(z % 2 == 0, "\t\tisHidden\n").otherwise(""), F.lit("\t\tformatString: 0\n\n\tcolumn c"), z,
        F.lit("\n\t\tdataType: int64\n"), F.when(z % 5 == 0, "\t\tISHIDDEN\n").otherwise(""),
        F.lit("\t\tsummarizeBy: none\n\n\tpartition '"), "p_brand", F.lit("' = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\tlet\n\t\t\t\t    S = "),
        z, F.lit("\n\t\t\t\tin S\n\n\tannotation A = 1\n"))
    files = t.table("part").select(F.lit("p").alias("project"), k.cast("string").alias("rel_path"),
                                             F.encode(text, "UTF-8").alias("content"))
    rows = blocks.block_rows(blocks.blocks(blocks.model_lines(files), (0, 4)), 4, (0,))
    body = F.col("body")
    return rows.where(F.col("kw").isin("measure", "column", "partition")).select(
        F.col("rel_path").cast("long").alias("k"), "kw", "name",
        F.coalesce(blocks.prop(body, "dataType", 8), F.lit("")).alias("data_type"),
        blocks.flag(body, "isHidden", 8).alias("hidden"),
        F.coalesce(blocks.block_expr(F.col("trimmed"), F.col("tail"), body, 4), F.lit("")).alias("expr"),
        F.coalesce(blocks.assigned_expr(body, "source", 8), F.lit("")).alias("source"))


@query("text_lines", """
    SELECT id, count(*) AS lines, count(*) FILTER (trim(l) <> '') AS filled, max(length(l)) AS longest
    FROM (SELECT id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS l FROM v_text) GROUP BY id""".replace("\\\\", "\\"))
def text_lines(t: Tables) -> DataFrame:
    """Line table of every document, page and turn, summed up per text."""
    files = t.texts().select(F.lit("p").alias("project"), F.col("id").alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    return blocks.model_lines(files).groupBy(F.col("rel_path").alias("id")).agg(
        F.count("*").alias("lines"), F.count_if(F.trim("text") != "").alias("filled"), F.max(F.length("text")).alias("longest"))
