"""Formula and query text: tokens, masks, names in text, connectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.urls import location_kind
from ..session import cut, few_or_shuffled, shuffled
from .ranking import first_by

# Building blocks of the token patterns. Repetitions are unrolled so that the regex engine loops, not recurses.
_STRING = r'"[^"]*(?:""[^"]*)*(?:"|\z)'
_BLOCK = r"/\*(?s:.*?)(?:\*/|\z)"
_QUOTED = r"'[^']*(?:''[^']*)*'"
_WORD = r"[\p{L}_][\p{L}\p{Nd}_]*"
_BRACKET = r"\[[^\]]*(?:\]\][^\]]*)*\]"
_OPEN = r"\[[^\]]*(?:\]\][^\]]*)*\z"
_NAME = rf"(?:{_QUOTED}|{_WORD})"
_FIELD = rf"{_NAME}\s*{_BRACKET}"

_FORMULA_COMMENT = rf"//[^\r\n]*|--[^\r\n]*|{_BLOCK}"
FORMULA_TOKENS = (
    rf"{_FORMULA_COMMENT}|{_STRING}"
    rf"|{_FIELD}(?:\s*\.\s*{_BRACKET})*"
    rf"|{_NAME}\s*{_OPEN}"
    rf"|{_WORD}\s*\(|{_QUOTED}|{_WORD}"
    rf"|\.\s*{_BRACKET}|{_BRACKET}|{_OPEN}"
)


def _unquote(c: Column) -> Column:
    inner = F.substr(c, F.lit(2), F.length(c) - 2)
    return F.when(c.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(c)


def _bracket_name(c: Column) -> Column:
    inner = F.regexp_extract(c, rf"({_BRACKET})\z", 1)
    return F.replace(F.substr(inner, F.lit(2), F.length(inner) - 2), F.lit("]]"), F.lit("]"))


def formula_tokens(df: DataFrame, keys: Sequence[str], expression: str) -> DataFrame:
    """Reference tokens of each expression in text order: keys, pos, ref_kind, tbl, obj, ref_text.

    ref_kind is Qualified, Unqualified, Name (a bare or quoted name: a table if such a table exists) or
    Call. Comments, strings and hierarchy suffixes give nothing.
    """
    tokens = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(expression), F.lit(FORMULA_TOKENS), F.lit(0)))
                       .alias("pos", "token"))
    token = F.col("token")
    field = F.regexp_extract(token, rf"^{_FIELD}", 0)
    name = F.regexp_extract(token, rf"^{_NAME}", 0)
    skip = token.rlike(r'^(?:"|/[/*]|--|\.)') | token.rlike(rf"{_OPEN}")
    kind = (
        F.when(field != "", "Qualified")
        .when(token.startswith("["), "Unqualified")
        .when(token.rlike(r"^[^']*\($"), "Call")
        .otherwise("Name")
    )
    kept = tokens.where(~skip).select(
        *keys, "pos", kind.alias("ref_kind"),
        F.when(name != "", _unquote(name)).alias("_n"), field.alias("_f"), "token",
    )
    k = F.col("ref_kind")
    return kept.select(
        *keys, "pos", "ref_kind",
        F.when(k.isin("Qualified", "Name"), F.col("_n")).alias("tbl"),
        F.when(k == "Qualified", _bracket_name(F.col("_f"))).when(k == "Unqualified", _bracket_name(F.col("token")))
        .otherwise(F.col("_n")).alias("obj"),
        F.when(k == "Qualified", F.col("_f")).when(k == "Call", F.col("_n"))
        .when(k == "Name", F.regexp_extract("token", rf"^{_NAME}", 0)).otherwise(F.col("token")).alias("ref_text"),
    )


def formula_refs(df: DataFrame, keys: Sequence[str], expression: str, scope: Sequence[str],
                 tables: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct references: field references, names of known tables, calls of known functions."""
    s = list(scope)
    tokens = formula_tokens(df, keys, expression)
    known_t = tables.select(*s, fold("tbl").alias("_k")).distinct()
    known_f = functions.select(*s, fold("fn").alias("_k")).distinct()
    fields = tokens.where("ref_kind in ('Qualified', 'Unqualified')")
    names = tokens.where("ref_kind = 'Name'").withColumn("_k", fold("tbl")).join(known_t, [*s, "_k"], "left_semi")
    calls = tokens.where("ref_kind = 'Call'").withColumn("_k", fold("obj")).join(known_f, [*s, "_k"], "left_semi")
    cols = [*keys, "ref_kind", "tbl", "obj", "ref_text"]
    return fields.select(*cols).unionByName(names.select(*cols)).unionByName(calls.select(*cols)).distinct()


def relationship_calls(df: DataFrame, keys: Sequence[str], expression: str) -> DataFrame:
    """USERELATIONSHIP calls with exactly two qualified columns: keys, tbl1, col1, tbl2, col2."""
    call = rf"(?i:USERELATIONSHIP)\s*\(\s*{_FIELD}\s*,\s*{_FIELD}\s*\)"
    pattern = rf"{_FORMULA_COMMENT}|{_STRING}|{call}|{_QUOTED}|{_WORD}"
    tokens = df.where(F.lower(expression).contains("userelationship")).select(
        *keys, F.explode(F.regexp_extract_all(F.col(expression), F.lit(pattern), F.lit(0))).alias("token")
    ).where(F.col("token").rlike(r"^(?i:USERELATIONSHIP)\s*\("))
    fields = F.regexp_extract_all(F.regexp_extract("token", r"(?s)\((.*)\)", 1), F.lit(_FIELD), F.lit(0))
    parts = tokens.select(*keys, fields.alias("_f"))

    def table(i: int) -> Column:
        return _unquote(F.regexp_extract(F.col("_f")[i], rf"^{_NAME}", 0))

    return parts.select(
        *keys, table(0).alias("tbl1"), _bracket_name(F.col("_f")[0]).alias("col1"),
        table(1).alias("tbl2"), _bracket_name(F.col("_f")[1]).alias("col2"),
    ).distinct()


def field_params(df: DataFrame, keys: Sequence[str], expression: str) -> DataFrame:
    """Entries of `{ ... NAMEOF('T'[c]) ... }` texts: keys, tbl, obj, ref_text, distinct."""
    call = rf"(?i:NAMEOF)\s*\(\s*{_FIELD}\s*\)"
    pattern = rf"{_FORMULA_COMMENT}|{_STRING}|{call}|{_WORD}"
    text = F.trim(F.regexp_replace(F.col(expression), r"^\s+|\s+$", ""))
    tokens = df.where(text.startswith("{") & text.endswith("}")).select(
        *keys, F.explode(F.regexp_extract_all(F.col(expression), F.lit(pattern), F.lit(0))).alias("token")
    ).where(F.col("token").rlike(r"^(?i:NAMEOF)\s*\("))
    field = F.regexp_extract("token", rf"(?i:NAMEOF)\s*\(\s*({_FIELD})", 1)
    return tokens.select(*keys, field.alias("_f")).select(
        *keys, _unquote(F.regexp_extract("_f", rf"^{_NAME}", 0)).alias("tbl"),
        _bracket_name(F.col("_f")).alias("obj"), F.col("_f").alias("ref_text"),
    ).distinct()


# Pieces of a query text: quoted names are kept, strings and comments blanked, everything else kept.
_MASK_PIECES = (
    r'#"[^"]*(?:""[^"]*)*(?:"|\z)' rf"|{_STRING}" r"|//[^\r\n]*" rf"|{_BLOCK}" r'|[^#"/]+|[#/]'
)


def mask_text(c: Column) -> Column:
    """Strings and comments as blanks of the same length, line breaks kept; `#"name"` untouched."""
    pieces = F.regexp_extract_all(c, F.lit(_MASK_PIECES), F.lit(0))
    hidden = F.transform(
        pieces,
        lambda p: F.when(p.rlike(r'^(?:"|//|/\*)'), F.regexp_replace(p, r"[^\r\n]", " ")).otherwise(p),
    )
    return F.array_join(hidden, "")


def is_dynamic(c: Column) -> Column:
    """Text that evaluates names at run time."""
    low = F.lower(c)
    return low.contains("expression.evaluate") | low.contains("#shared") | low.contains("record.field")


_PLAIN = r"a-z0-9_\x{80}-\x{10FFFF}"


def _block_words(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, and every other character beyond ASCII by itself."""
    low = F.lower(c)
    # Two patterns, as one with both as alternatives takes three times as long.
    beyond = F.split(F.regexp_replace(low, r"[\x00-\x7F]+", ""), "")
    return F.array_distinct(F.array_remove(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), beyond), ""))


def _mark_runs(c: Column) -> Column:
    """The distinct runs of marks, characters that are part of no word, with a letter between them."""
    return F.array_join(F.array_distinct(F.split(F.lower(c), f"[{_PLAIN}]+")), "a")


def _block_marks(runs: Column, n: int) -> Column:
    """All sequences of n marks in runs of them; they overlap."""
    return F.array_distinct(F.regexp_extract_all(runs, F.lit(f"(?s)(?=([^{_PLAIN}]{{{n}}}))"), F.lit(1)))


def names_in_text(texts: DataFrame, names: DataFrame, scope: Sequence[str], key: Sequence[str],
                  masked: str = "masked") -> DataFrame:
    """Which known names occur in which text, as a whole word or as `#"name"`.

    texts: scope, key, masked; names: scope, name. A text that holds a name holds every plain word of it
    whole, so each name is looked for only where its rarest word occurs. A name without words is made of marks; it
    is looked for where its rarest pair of adjacent marks occurs (a single mark: where that occurs). Only words and
    marks travel in the blocking join, and only those that some name has. Candidate pairs are distinct (text, name)
    and are checked against the whole text afterwards. An empty name occurs nowhere.
    """
    s, k = list(scope), list(key)
    asked = names.select(*s, "name").distinct().select(*s, "name", _block_words(F.col("name")).alias("_a"))
    marks = F.when(F.length("name") > 1, _block_marks(_mark_runs(F.col("name")), 2)).otherwise(_block_marks(_mark_runs(F.col("name")), 1))
    asked = asked.select(*s, "name", F.explode(F.when(F.size("_a") > 0, F.col("_a")).otherwise(marks)).alias("_w"))
    runs = _mark_runs(F.col(masked))
    held = F.concat(_block_words(F.col(masked)), _block_marks(runs, 2), _block_marks(runs, 1))
    words = texts.select(*s, *k, F.explode(held).alias("_w"))
    words = cut(words.join(few_or_shuffled(asked.select(*s, "_w").distinct()), [*s, "_w"], "left_semi"))
    frequency = words.groupBy(*s, "_w").agg(F.count("*").alias("_n"))
    rarest = few_or_shuffled(first_by(
        asked.join(shuffled(frequency), [*s, "_w"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))), [*s, "name"], ["_n", "_w"]
    ).drop("_n"))
    pairs = words.join(rarest, [*s, "_w"]).select(*s, *k, "name").distinct()
    quoted = F.concat(F.lit('#"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))
    # The name comes first in its pattern and what stands before it is looked at afterwards: that is twice as fast.
    literal = F.concat(F.lit(r"\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit("(?iu)"), literal, F.lit("(?![A-Za-z0-9_.])(?<![A-Za-z0-9_]"), literal, F.lit(")"))
    held = pairs.join(shuffled(texts.select(*s, *k, masked, F.lower(masked).alias("_low"), F.contains(masked, F.lit('#"')).alias("_q"))), [*s, *k])
    # Plain substring tests first: they settle most candidates, and patterns that differ by row are slow.
    found = F.contains(F.col("_low"), F.lower("name")) & F.rlike(F.col(masked), pattern)
    return held.where((F.col("_q") & F.contains(F.col("_low"), F.lower(quoted))) | found).select(*s, *k, "name")


_BINDING = r'(?m)^\s*(#"[^"]*(?:""[^"]*)*"|[A-Za-z_][A-Za-z0-9_.]*)\s*='


def unquote_query_name(c: Column) -> Column:
    inner = F.substr(c, F.lit(3), F.length(c) - 3)
    return F.when(c.startswith('#"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)


def local_steps(texts: DataFrame, key: Sequence[str], masked: str = "masked") -> DataFrame:
    steps = F.explode(F.regexp_extract_all(F.col(masked), F.lit(_BINDING), F.lit(1)))
    return texts.select(*key, steps.alias("_s")).select(*key, unquote_query_name(F.col("_s")).alias("step"))


def query_refs(queries: DataFrame, scope: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Query-to-query references by name: scope, key, name (the referenced query).

    queries: scope, key, query, expression. Names of the query's own steps and its own name do not count.
    """
    s, k = list(scope), list(key)
    texts = queries.withColumn("masked", mask_text(F.col("expression")))
    hits = names_in_text(texts, queries.select(*s, F.col("query").alias("name")), s, k)
    own = local_steps(texts, [*s, *k]).select(*s, *k, fold("step").alias("_n")).distinct()
    self_name = queries.select(*s, *k, fold("query").alias("_n"))
    return hits.withColumn("_n", fold("name")).join(
        shuffled(own.unionByName(self_name).distinct()), [*s, *k, "_n"], "left_anti"
    ).drop("_n")


# Connector functions and the family each belongs to.
CONNECTORS = {
    "File.Contents": "File",
    "Folder.Files": "Folder",
    "Folder.Contents": "Folder",
    "Excel.Workbook": "Excel",
    "Csv.Document": "Text or CSV",
    "Pdf.Tables": "PDF",
    "Web.Contents": "Web",
    "OData.Feed": "OData",
    "SharePoint.Files": "SharePoint",
    "SharePoint.Contents": "SharePoint",
    "Sql.Database": "SQL Server",
    "Odbc.DataSource": "ODBC",
    "Odbc.Query": "ODBC",
    "OleDb.DataSource": "OLE DB",
    "Oracle.Database": "Oracle",
    "PostgreSQL.Database": "PostgreSQL",
    "MySQL.Database": "MySQL",
    "Snowflake.Databases": "Snowflake",
    "GoogleBigQuery.Database": "Google BigQuery",
    "AmazonRedshift.Database": "Amazon Redshift",
    "SapHana.Database": "SAP HANA",
    "AnalysisServices.Database": "Analysis Services",
    "CommonDataService.Database": "Dataverse",
    "PowerPlatform.Dataflows": "Power Platform dataflow",
    "AzureStorage.Blobs": "Azure Blob Storage",
    "AzureStorage.DataLake": "Azure Data Lake Storage",
    "Lakehouse.Contents": "Fabric Lakehouse",
    "Warehouse.Contents": "Fabric Warehouse",
    "Spark.Tables": "Spark",
}


def data_sources(queries: DataFrame, key: Sequence[str], expression: str = "expression") -> DataFrame:
    """Connector calls of each query, once per function: key, family, function, location_kind.

    The call is looked for in the masked text, its first literal argument in the raw text. The family table
    is a map literal of 29 entries, so nothing is joined.
    """
    calls = F.regexp_extract_all(
        mask_text(F.col(expression)),
        F.lit(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_]*\.[A-Za-z][A-Za-z0-9_]*)\s*\("), F.lit(1),
    )
    families = F.create_map(*[x for k, v in CONNECTORS.items() for x in (F.lit(k.lower()), F.lit(v))])
    found = queries.select(*key, F.col(expression).alias("_e"), F.posexplode(calls).alias("_p", "function"))
    known = found.withColumn("family", F.try_element_at(families, F.lower("function"))).where("family is not null")
    # One row per function and query, in the spelling that comes first in the text.
    firsts = known.groupBy(*key, F.lower("function").alias("_k")).agg(
        F.min_by(F.struct("function", "family", "_e"), "_p").alias("_r")
    ).select(*key, "_r.*")
    pattern = F.concat(F.lit(r"(?i)\Q"), "function", F.lit(r'\E\s*\(\s*"([^"]*(?:""[^"]*)*)"'))
    raw = F.get(F.regexp_extract_all(F.col("_e"), pattern, F.lit(1)), F.lit(0))
    return firsts.select(
        *key, "family", "function",
        location_kind(F.col("function"), F.replace(raw, F.lit('""'), F.lit('"'))).alias("location_kind"),
    )
