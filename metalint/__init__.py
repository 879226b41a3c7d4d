"""Metadata lineage and assurance over estates of BI projects, as Spark DataFrame operators."""
