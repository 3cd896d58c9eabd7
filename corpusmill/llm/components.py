"""Connected components over a table of links, distributed: labels spread by joins, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace, materialise


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> (node, component): the smallest node reachable from each linked node.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label. Every round is written to the shared folder, so lineage stays short and a lost executor
    costs at most one round; only a count of changes reaches the driver.
    """
    space = Workspace(links.sparkSession, "components")
    both = space.table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = space.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = nearer.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), F.col("label").alias("old"))
        moved = space.table(moved, "labels")
        if moved.where("label <> old").isEmpty():
            found = materialise(moved.select("node", F.col("label").alias("component")), "components")
            space.close()
            return found
        labels = moved.select("node", "label")
