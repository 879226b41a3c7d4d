"""Reference resolution: joins and anti-joins on folded identities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, is_blank


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)



def distinct_nodes(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def minus(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def with_folded(df: DataFrame, *names: str) -> DataFrame:
    """Add `<name>_k`, the folded key of each named column (null becomes empty)."""
    return df.withColumns({f"{n}_k": fold(F.coalesce(F.col(n), F.lit(""))) for n in names})


def bind_models(reports: DataFrame, models: DataFrame, project: Sequence[str] = ("project",),
                name: str = "report") -> DataFrame:
    """Model of each report: ByPath on the target path if it is available, Unspecified on the report name.

    reports: project, report, kind, target_path, available; models: project, model, model_path.
    Reports bound to nothing local keep a null model.
    """
    p = list(project)
    models = with_folded(models, "model", "model_path")
    by_path = (
        reports.where((F.col("kind") == "ByPath") & F.coalesce(F.col("available"), F.lit(False)))
        .withColumn("model_path_k", fold(F.coalesce("target_path", F.lit(""))))
        .join(models.select(*p, "model", "model_path", "model_path_k"), [*p, "model_path_k"])
    )
    by_name = (
        reports.where(F.col("kind") == "Unspecified").withColumn("model_k", fold(name))
        .join(models.select(*p, "model", "model_path", "model_k"), [*p, "model_k"])
    )
    keep = [*p, "report", "model", "model_path"]
    matches = by_path.select(*keep).unionByName(by_name.select(*keep))
    one = matches.groupBy(*p, "report").agg(F.min_by("model", F.struct("model_path", "model")).alias("model"))
    return reports.join(one, [*p, "report"], "left")



def exclude_report_measures(refs: DataFrame, report_measures: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Drop measure references that name a measure of the report itself."""
    own = with_folded(report_measures.select(*scope, F.col("entity").alias("tbl"), F.col("name").alias("obj")),
                      "tbl", "obj").select(*scope, "tbl_k", "obj_k", F.lit("Measure").alias("typ")).distinct()
    return with_folded(refs, "tbl", "obj").join(own, [*scope, "tbl_k", "obj_k", "typ"], "left_anti")


def establishes_use(origin: Column, relevance: Column) -> Column:
    """Every reference counts except a selector identity that is only left over in saved formatting."""
    stale = (origin == "Formatting selector identity") & (relevance == "High-confidence persisted")
    return ~F.coalesce(stale, F.lit(False))



def _named(objects: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Columns and measures of a model by folded name; one row per identity."""
    return with_folded(objects.where(F.col("typ").isin("Column", "Measure")), "tbl", "obj").select(
        *scope, "tbl", "obj", "typ", "tbl_k", "obj_k"
    )


def resolve_qualified(refs: DataFrame, objects: DataFrame, scope: Sequence[str], ref_id: Sequence[str]) -> DataFrame:
    """`T[x]`: a column or a measure wins alone; both is Ambiguous, neither NotFound.

    refs: scope, ref_id, tbl, obj. Distinct identities are resolved once, so a name that a third of all
    references use is one row in the join; the caller joins the outcome back if it needs every reference.
    """
    s = list(scope)
    wanted = with_folded(refs, "tbl", "obj")
    per_name = _named(objects, s).groupBy(*s, "tbl_k", "obj_k").agg(
        F.count_if(F.col("typ") == "Column").alias("_c"),
        F.count_if(F.col("typ") == "Measure").alias("_m"),
        F.min(F.struct("tbl", "obj", "typ")).alias("_o"),
    )
    joined = wanted.join(per_name, [*s, "tbl_k", "obj_k"], "left")
    return _qualified_outcome(joined, ref_id)


def _qualified_outcome(joined: DataFrame, ref_id: Sequence[str]) -> DataFrame:
    both = (F.coalesce("_c", F.lit(0)) > 0) & (F.coalesce("_m", F.lit(0)) > 0)
    one = (F.coalesce("_c", F.lit(0)) > 0) != (F.coalesce("_m", F.lit(0)) > 0)
    where = F.concat(F.lit("'"), "tbl", F.lit("["), "obj", F.lit("]'"))
    return joined.select(
        *ref_id,
        F.when(one, "Resolved").when(both, "Ambiguous").otherwise("NotFound").alias("outcome"),
        F.when(one, F.col("_o.tbl")).alias("to_tbl"),
        F.when(one, F.col("_o.obj")).alias("to_obj"),
        F.when(one, F.col("_o.typ")).alias("to_typ"),
        F.when(both, F.concat(where, F.lit(": a column and a measure share this name.")))
        .when(~one, F.concat(where, F.lit(": no such object in the model."))).alias("reason"),
    )


def resolve_unqualified(refs: DataFrame, objects: DataFrame, scope: Sequence[str], ref_id: Sequence[str]) -> DataFrame:
    """`[x]`: measures named x anywhere in the model plus column x of the context table; one candidate wins.

    refs: scope, ref_id, context_tbl, obj. Candidates are counted per name before the join, so a name
    shared by very many measures is one row.
    """
    s = list(scope)
    named = _named(objects, s)
    measures = named.where("typ = 'Measure'").groupBy(*s, "obj_k").agg(
        F.count("*").alias("_m"), F.min(F.struct("tbl", "obj", "typ")).alias("_mo")
    )
    columns = named.where("typ = 'Column'").groupBy(*s, "tbl_k", "obj_k").agg(
        F.min(F.struct("tbl", "obj", "typ")).alias("_co")
    )
    wanted = with_folded(refs.withColumn("tbl", F.col("context_tbl")), "tbl", "obj")
    joined = wanted.join(measures, [*s, "obj_k"], "left").join(columns, [*s, "tbl_k", "obj_k"], "left")
    n = F.coalesce("_m", F.lit(0)) + F.when(F.col("_co").isNull(), 0).otherwise(1)
    pick = F.when(n == 1, F.coalesce("_co", "_mo"))
    context = F.coalesce("context_tbl", F.lit(""))
    return joined.select(
        *ref_id,
        F.when(n == 1, "Resolved").when(n == 0, "NotFound").otherwise("Ambiguous").alias("outcome"),
        pick["tbl"].alias("to_tbl"), pick["obj"].alias("to_obj"), pick["typ"].alias("to_typ"),
        F.when(n == 0, F.concat(F.lit("["), "obj", F.lit("]: neither a measure nor a column of '"), context, F.lit("'.")))
        .when(n > 1, F.concat(F.lit("["), "obj", F.lit("]: more than one object could be meant.")))
        .alias("reason"),
    )




def match_endpoint_pair(calls: DataFrame, relationships: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The one relationship whose two endpoints equal the pair of a call, in either order.

    Each side gets its two folded endpoints in sorted order, which turns the either-order test into an
    equi-join; pairs named by several relationships match none.
    """
    s = list(scope)

    def pair(a_t: str, a_c: str, b_t: str, b_c: str) -> tuple[Column, Column]:
        a = F.concat_ws("\u001f", fold(a_t), fold(a_c))
        b = F.concat_ws("\u001f", fold(b_t), fold(b_c))
        return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")

    sides = pair("from_tbl", "from_col", "to_tbl", "to_col")
    unique = (
        relationships.select(*s, "name", *sides).groupBy(*s, "lo", "hi")
        .agg(F.count("*").alias("_n"), F.min("name").alias("relationship"))
        .where("_n = 1").drop("_n")
    )
    return calls.select("*", *pair("tbl1", "col1", "tbl2", "col2")).join(unique, [*s, "lo", "hi"]).drop("lo", "hi")


def expand_membership(perspective_tables: DataFrame, members: DataFrame, objects: DataFrame,
                      scope: Sequence[str]) -> DataFrame:
    """Objects a perspective exposes.

    includeAll exposes every column, measure and hierarchy level of the table; otherwise the listed columns
    and measures, and all levels of the listed hierarchies. Two equi-joins, one per case.
    """
    s = list(scope)
    objs = with_folded(objects, "tbl", "obj", "hierarchy").where(
        F.col("typ").isin("Column", "Measure", "HierarchyLevel")
    ).select(*s, "tbl_k", "obj_k", "hierarchy_k", "tbl", "obj", "typ", "hierarchy")
    tables = with_folded(perspective_tables, "tbl").select(*s, "perspective", "tbl_k", "include_all")
    whole = tables.where("include_all").drop("include_all").join(objs, [*s, "tbl_k"])
    listed = (
        with_folded(members, "tbl", "member").select(*s, "perspective", "tbl_k", "member_k", "kind")
        .join(tables.where("not include_all").drop("include_all"), [*s, "perspective", "tbl_k"], "left_semi")
    )
    fields = listed.where("kind in ('column', 'measure')").withColumnRenamed("member_k", "obj_k").join(
        objs.where("typ <> 'HierarchyLevel'"), [*s, "tbl_k", "obj_k"]
    )
    levels = listed.where("kind = 'hierarchy'").withColumnRenamed("member_k", "hierarchy_k").join(
        objs.where("typ = 'HierarchyLevel'"), [*s, "tbl_k", "hierarchy_k"]
    )
    out = [*s, "perspective", "tbl", "obj", "typ", "hierarchy"]
    return union_all(whole.select(*out), fields.select(*out), levels.select(*out)).distinct()


def missing_target(rows: DataFrame, targets: DataFrame, scope: Sequence[str], key: str,
                   target_key: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows that name a target which does not exist in their scope; exact case, blanks name nothing."""
    named = rows.where(~is_blank(F.col(key).cast("string")))
    if where is not None:
        named = named.where(where)
    known = targets.select(*scope, F.col(target_key or key).alias("_t")).distinct()
    on = [F.col(f"r.{c}") == F.col(f"k.{c}") for c in scope] + [F.col(f"r.{key}") == F.col("k._t")]
    return named.alias("r").join(known.alias("k"), on, "left_anti")
