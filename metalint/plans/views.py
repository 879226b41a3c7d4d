"""Projections of the TPC-H-like tables into the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt


class Tables:
    """The driver's tables and the derived shapes, read lazily with only the columns a query touches."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def models(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("model"))

    def objects(self) -> DataFrame:
        return self.table("part").select(
            (F.col("p_partkey") % 25).cast("int").alias("model_id"),
            F.col("p_brand").alias("tbl"),
            F.col("p_partkey").alias("obj"),
            F.when(F.col("p_partkey") % 5 == 0, "Measure").otherwise("Column").alias("typ"),
            F.col("p_name").alias("name"),
            (F.col("p_size") % 10 == 0).alias("system"),
        )

    def edges(self) -> DataFrame:
        """model_id, src, dst, kind: one forward edge per part of even block, and some reversed ones."""
        part = self.table("part").select("p_partkey", "p_size")
        total = part.agg(F.count("*").alias("n")).scalar()
        key = F.col("p_partkey")
        forward = part.where(F.floor(key / 25) % 2 == 0).select(
            (key % 25).cast("int").alias("model_id"),
            key.alias("src"),
            ((key + 25 * (key % 7 + 1)) % total).alias("dst"),
            F.when(key % 4 == 0, "Dax").when(key % 4 == 1, "SortBy")
            .when(key % 4 == 2, "FieldParameter").otherwise("ReportMeasure").alias("kind"),
            "p_size",
        )
        back = forward.where("p_size = 1").select(
            "model_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"
        )
        return forward.drop("p_size").unionByName(back)

    def reports(self) -> DataFrame:
        status = F.col("o_orderstatus")
        kind: Column = F.when(status == "F", "ByPath").when(status == "O", "ByConnection").otherwise("Unspecified")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("report"), F.col("c_nationkey").alias("model_id"), kind.alias("kind")
        )

    def refs(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("report"),
            (F.col("l_linenumber") % 3).cast("int").alias("page"),
            F.col("l_linenumber").alias("visual"),
            F.col("l_partkey").alias("obj"),
            F.when(flag == "R", "Projection").when(flag == "A", "Filter").otherwise("Formatting").alias("context"),
        )

    def visuals(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("report"),
            (F.col("l_linenumber") % 3).cast("int").alias("page"),
            F.col("l_linenumber").alias("visual"),
            "l_partkey", "l_suppkey",
            (F.col("l_quantity").cast("int") % 8 - 1).alias("tab_order"),
            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("alt"),
            F.col("l_linestatus").alias("val"),
        )

    def actions(self) -> DataFrame:
        value = F.col("value")
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("visual"),
            F.col("event_type").alias("typ"),
            F.get_json_object("props", "$.k").cast("int").alias("target"),
            F.when(value >= 1, value > 5).alias("enabled"),
        )

    def texts(self) -> DataFrame:
        docs = self.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
        pages = self.table("pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
        talks = self.table("conversations").select(
            F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("id"), "text"
        )
        return docs.unionByName(pages).unionByName(talks)

    def bound_refs(self, tasks: int = 1) -> DataFrame:
        """References of reports with a local model, with the model they are looked up in; dealt by report into that many tasks."""
        local = self.reports().where("kind = 'ByPath'").select("report", "model_id")
        return dealt(self.refs(), tasks, "report").join(local, "report")

    def direct_roots(self) -> DataFrame:
        """Objects that a visual with number 1 uses, inside the report's own model."""
        used = self.bound_refs().where("visual = 1").select("model_id", F.col("obj").alias("node")).distinct()
        return used.where(F.col("node") % 25 == F.col("model_id"))

    def structural_roots(self) -> DataFrame:
        return self.objects().where(F.col("obj") % 40 == 7).select("model_id", F.col("obj").alias("node"))


# The same shapes for the comparison SQL.
SQL_VIEWS = {
    "v_model": "SELECT n_nationkey AS model_id, n_name AS model FROM nation",
    "v_object": """
        SELECT CAST(p_partkey % 25 AS INT) AS model_id, p_brand AS tbl, p_partkey AS obj,
               CASE WHEN p_partkey % 5 = 0 THEN 'Measure' ELSE 'Column' END AS typ,
               p_name AS name, p_size % 10 = 0 AS system
        FROM part""",
    "v_forward": """
        SELECT CAST(p_partkey % 25 AS INT) AS model_id, p_partkey AS src,
               (p_partkey + 25 * (p_partkey % 7 + 1)) % (SELECT count(*) FROM part) AS dst,
               CASE p_partkey % 4 WHEN 0 THEN 'Dax' WHEN 1 THEN 'SortBy'
                    WHEN 2 THEN 'FieldParameter' ELSE 'ReportMeasure' END AS kind, p_size
        FROM part WHERE (p_partkey // 25) % 2 = 0""",
    "v_edge": """
        SELECT model_id, src, dst, kind FROM v_forward
        UNION ALL SELECT model_id, dst, src, kind FROM v_forward WHERE p_size = 1""",
    "v_report": """
        SELECT o_orderkey AS report, c_nationkey AS model_id,
               CASE o_orderstatus WHEN 'F' THEN 'ByPath' WHEN 'O' THEN 'ByConnection'
                    ELSE 'Unspecified' END AS kind
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_ref": """
        SELECT l_orderkey AS report, CAST(l_linenumber % 3 AS INT) AS page, l_linenumber AS visual,
               l_partkey AS obj,
               CASE l_returnflag WHEN 'R' THEN 'Projection' WHEN 'A' THEN 'Filter' ELSE 'Formatting' END AS context
        FROM lineitem""",
    "v_visual": """
        SELECT l_orderkey AS report, CAST(l_linenumber % 3 AS INT) AS page, l_linenumber AS visual,
               l_partkey, l_suppkey, CAST(l_quantity AS INT) % 8 - 1 AS tab_order,
               nullif(l_returnflag, 'N') AS alt, l_linestatus AS val
        FROM lineitem""",
    "v_action": """
        SELECT event_id, user_id AS visual, event_type AS typ,
               CAST(json_extract_string(props, '$.k') AS INT) AS target,
               CASE WHEN value >= 1 THEN value > 5 END AS enabled
        FROM events""",
    "v_text": """
        SELECT 'd' || doc_id AS id, text FROM documents
        UNION ALL SELECT 'p' || page_id, html FROM pages
        UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations""",
    "v_bound": """
        SELECT f.*, r.model_id FROM v_ref f JOIN v_report r USING (report) WHERE r.kind = 'ByPath'""",
    "v_direct": """
        SELECT DISTINCT model_id, obj AS node FROM v_bound WHERE visual = 1 AND obj % 25 = model_id""",
    "v_structural": "SELECT model_id, obj AS node FROM v_object WHERE obj % 40 = 7",
    "v_closure": """
        SELECT 'direct' AS kind, model_id, node FROM v_direct
        UNION SELECT 'structural', model_id, node FROM v_structural
        UNION SELECT c.kind, c.model_id, e.dst FROM v_closure c JOIN v_edge e ON e.model_id = c.model_id AND e.src = c.node""",
    "v_flags": """
        SELECT model_id, node, bool_or(kind = 'direct') AS by_report, bool_or(kind = 'structural') AS by_structure
        FROM v_closure GROUP BY ALL""",
    "v_state": """
        SELECT o.model_id, o.tbl, o.obj, o.name, o.typ, o.system, CASE
                 WHEN EXISTS (SELECT 1 FROM v_direct d WHERE d.model_id = o.model_id AND d.node = o.obj)
                   THEN 'DirectlyUsed'
                 WHEN coalesce(f.by_report, false) THEN 'IndirectlyUsed'
                 WHEN coalesce(f.by_structure, false) THEN 'StructurallyRequired'
                 WHEN EXISTS (SELECT 1 FROM v_edge e WHERE e.model_id = o.model_id AND e.dst = o.obj)
                   THEN 'UsedOnlyByUnusedBranch'
                 ELSE 'ApparentlyUnused' END AS state
        FROM v_object o LEFT JOIN v_flags f ON f.model_id = o.model_id AND f.node = o.obj""",
}


def with_views(sql: str) -> str:
    """Prefix the views that the statement uses, directly or through another view."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name in text and name not in needed:
                needed.append(name)
                visit(body.replace(name, ""))

    visit(sql)
    text = sql.strip()
    if not needed:
        return f"WITH RECURSIVE {text[5:]}" if text[:5].upper() == "WITH " else text
    ordered = [n for n in SQL_VIEWS if n in needed]
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in ordered)
    if text[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {ctes}, {text[5:]}"
    return f"WITH RECURSIVE {ctes} {text}"
