"""Connected components of an undirected graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import cut


def connected(links: DataFrame) -> DataFrame:
    """(uid, label) for every end of a link (a, b); label is the smallest uid of the component.

    Each round takes the smallest label among the neighbours and then follows the labels' own labels once, so a chain
    is done in logarithmically many rounds. Minima combine before the shuffle; the driver sees one flag per round.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "uid").select("uid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = lower.select(F.col("uid").alias("label"), F.col("label").alias("root"))
        jumped = cut(lower.join(root, "label").select("uid", "old", F.least("label", "root").alias("label")))
        labels = jumped.select("uid", "label")
        if jumped.where("label < old").isEmpty():
            return labels
