"""Counts, facets, coverage, locations and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, guard_formula, is_blank
from .ranking import listed_values, top_n


def inventory_counts(rows: DataFrame, levels: Sequence[Sequence[str]], counts: dict[str, Column]) -> DataFrame:
    """The same counts at several levels in one pass (GROUPING SETS); absent level columns are null."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    return rows.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in columns]).agg(
        *[c.alias(n) for n, c in counts.items()]
    )


def distinct_fields(refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact number of distinct fields, folded; distinct rows are formed before they are counted."""
    identity = [fold(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("typ", "tbl", "hierarchy", "obj")]
    return refs.select(*keys, *identity).distinct().groupBy(*keys).agg(F.count("*").alias("distinct_fields"))


def state_counts(usage: DataFrame, keys: Sequence[str], generated: str = "system") -> DataFrame:
    """Developer and generated objects per state."""
    return usage.groupBy(*keys, "state").agg(
        F.count_if(~F.col(generated)).alias("developer"), F.count_if(F.col(generated)).alias("generated")
    )


def exclude_generated(objects: DataFrame, tables: DataFrame, scope: Sequence[str]) -> DataFrame:
    own = tables.where("system").select(*scope, fold("tbl").alias("_k")).distinct()
    return objects.withColumn("_k", fold("tbl")).join(own, [*scope, "_k"], "left_anti").drop("_k")


def table_reference_counts(usage: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables with and without a directly used object."""
    used = usage.where("state = 'DirectlyUsed'").select(*keys, fold("tbl").alias("_k")).distinct().withColumn("_u", F.lit(1))
    return tables.select(*keys, fold("tbl").alias("_k")).distinct().join(used, [*keys, "_k"], "left").groupBy(*keys).agg(
        F.count("_u").alias("referenced"), F.count_if(F.col("_u").isNull()).alias("not_referenced")
    )


def file_sources(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local and network file sources per query; one network location makes the query a network one."""
    return sources.where(F.col("location_kind").isin("LocalFile", "NetworkFile")).groupBy(*keys).agg(
        F.when(F.bool_or(F.col("location_kind") == "NetworkFile"), "network file").otherwise("local file").alias("source"),
        F.count("*").alias("calls"),
    )


def connector_summary(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per family: distinct queries, functions, location kinds; each counted over its own distinct rows."""
    by = [*keys, "family"]
    return sources.groupBy(*by).agg(
        F.count_distinct("query").alias("queries"), F.count_distinct("function").alias("functions"),
        F.count_distinct("location_kind").alias("locations"),
    )


def connector_lists(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Queries, functions and location kinds of each family, one row each: keys, family, list, rank, value."""
    columns = ("query", "function", "location_kind")
    rows = sources.select(*keys, "family", F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("value")) for c in columns])).alias("_x"))
    return listed_values(rows.select(*keys, "family", "_x.*"), [*keys, "family", "list"], "value")


def catalogue_counts(catalogue: DataFrame, findings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Findings per rule, rules without any kept with zero."""
    counted = findings.groupBy(*scope, "rule_id").agg(F.count("*").alias("_n"))
    if not scope:
        return catalogue.join(counted, "rule_id", "left").withColumn("findings", F.coalesce("_n", F.lit(0))).drop("_n")
    # At most one entry per rule, so the map has 32 entries at most; every scope lists the whole catalogue.
    maps = counted.groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "_n"))).alias("_m"))
    return _spread(maps, catalogue)


def _spread(maps: DataFrame, catalogue: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in catalogue.collect()])
    return maps.withColumn("_r", F.explode(rows)).select(
        *[c for c in maps.columns if c != "_m"], "_r.*",
        F.coalesce(F.try_element_at("_m", F.col("_r.rule_id")), F.lit(0)).alias("findings"),
    )


def facet_options(df: DataFrame, value: str, label: str, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct values with labels; a label shared by several values is told apart by its value."""
    options = df.where(~is_blank(F.col(value).cast("string"))).groupBy(*scope, value).agg(
        F.min(label).alias("label"), F.count("*").alias("rows")
    )
    shared = options.groupBy(*scope, F.col("label")).agg((F.count("*") > 1).alias("_many"))
    return options.join(shared, [*scope, "label"]).withColumn(
        "shown", F.when(F.col("_many"), F.concat("label", F.lit(" ("), F.col(value).cast("string"), F.lit(")")))
        .otherwise(F.col("label"))
    ).drop("_many")


LIMITATION_KEY = ["construct", "support", "impact", "reason"]


def coverage_groups(limitations: DataFrame, scope: Sequence[str], artifact: str = "artifact_path") -> DataFrame:
    """Limitations by (construct, support, impact, reason) with the distinct artifact count; `coverage_artifacts` lists them."""
    by = [*scope, *LIMITATION_KEY]
    return limitations.select(*by, artifact).distinct().groupBy(*by).agg(F.count("*").alias("artifacts"))


def coverage_artifacts(limitations: DataFrame, scope: Sequence[str], artifact: str = "artifact_path") -> DataFrame:
    """The artifacts of each limitation group, one row each with its rank."""
    return listed_values(limitations, [*scope, *LIMITATION_KEY], artifact)


def coverage_by_model(limitations: DataFrame, usage: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per model: limitation groups, distinct artifacts, qualified and total objects."""
    groups = coverage_groups(limitations, scope).groupBy(*scope).agg(F.count("*").alias("groups"))
    artifacts = limitations.select(*scope, "artifact_path").distinct().groupBy(*scope).agg(F.count("*").alias("artifacts"))
    objects = usage.groupBy(*scope).agg(
        F.count_if(F.col("confidence") == "QualifiedByLimitation").alias("qualified"), F.count("*").alias("objects")
    )
    return groups.join(artifacts, list(scope)).join(objects, list(scope), "left")


SCHEMA_KEY = ["kind", "state", "family", "version", "expected_family", "baseline"]


def schema_coverage(observations: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Documents whose schema is not verified exactly, grouped without their URIs; `schema_documents` lists both."""
    return observations.where("state <> 'VerifiedExact'").groupBy(*scope, *SCHEMA_KEY).agg(
        F.count("*").alias("documents"), F.count_distinct("uri").alias("uris")
    )


def schema_documents(observations: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The documents of each group of `schema_coverage` with their URIs, one row each."""
    return observations.where("state <> 'VerifiedExact'").select(*scope, *SCHEMA_KEY, "rel_path", "uri")


def grouped_examples(df: DataFrame, keys: Sequence[str], example: str, n: int = 20) -> DataFrame:
    """Group size with at most n sorted examples (the limit is the feature); the rest is only counted."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("members"))
    distinct = df.select(*keys, F.col(example).alias("_e")).distinct()
    kept = top_n(distinct, keys, [F.col("_e")], n).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("_e")), ", ").alias("examples")
    )
    return sizes.join(kept, list(keys))


def usage_locations(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct places of use: visuals as such; pages and reports with their context.

    A page's Filter place is dropped when the same page also has a Drillthrough one.
    """
    k = list(keys)
    in_visual = F.col("visual").isNotNull()
    kind = F.when(in_visual, "Visual").when(F.col("page").isNull(), "Report").otherwise("Page")
    context = F.when(~in_visual, F.col("context"))
    places = evidence.select(*k, "report", "page", "visual", kind.alias("kind"), context.alias("context")).dropDuplicates()
    # Contexts of a page are a short closed list, so its places fit one row until the dropped one is known.
    at = [*k, "report", "page", "visual", "kind"]
    grouped = places.groupBy(*at).agg(F.collect_list(F.struct("context")).alias("_c"))
    drill = (F.col("kind") == "Page") & F.exists("_c", lambda c: c["context"] == "Drillthrough")
    kept = F.when(drill, F.filter("_c", lambda c: ~c["context"].eqNullSafe(F.lit("Filter")))).otherwise(F.col("_c"))
    return grouped.select(*at, F.explode(kept).alias("_p")).select(*at, F.col("_p.context").alias("context"))


def role_labels(evidence: DataFrame, place: Sequence[str], role: str = "role") -> DataFrame:
    """Distinct roles at a place; `filter` only when there is no other role. Roles are a short closed list."""
    roles = evidence.where(~is_blank(F.col(role))).groupBy(*place).agg(F.array_sort(F.collect_set(F.lower(role))).alias("_r"))
    other = F.filter("_r", lambda r: r != "filter")
    return roles.select(*place, F.array_join(F.when(F.size(other) > 0, other).otherwise(F.col("_r")), ", ").alias("roles"))



def guard_all(df: DataFrame) -> DataFrame:
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.select(*[guard_formula(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


# Severities in report order.
SEVERITY_ORDER = ("Error", "Warning")


def severity_rank(c: Column) -> Column:
    return F.when(c == SEVERITY_ORDER[0], 0).when(c == SEVERITY_ORDER[1], 1).otherwise(2)


def sort_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Output order: text keys folded, then as written; only for sinks."""
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.orderBy(*[F.lower(c) if c in text else F.col(c) for c in keys], *[F.col(c) for c in keys if c in text])


def sort_findings(findings: DataFrame) -> DataFrame:
    """Severity, rule, then place; artifact and evidence settle what is left. Nulls come first."""
    low = [F.lower(c).asc_nulls_first() for c in ("report", "page_display", "visual")]
    return findings.orderBy(
        severity_rank(F.col("severity")), "rule_id", *low,
        F.col("artifact_path").asc_nulls_first(), F.col("evidence").asc_nulls_first(),
        F.col("object_name").asc_nulls_first(),
    )
